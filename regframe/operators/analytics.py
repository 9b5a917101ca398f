"""Aggregates over establishments: top-k by state, activity level, status,
municipality; opening/closure cohorts.

Each aggregate first reduces the fact table to one row per small key (partial
aggregation on the map side, then a shuffle of at most #keys rows per task),
and only then joins the bounded dimension. Top-k uses ``orderBy().limit()``
which Spark plans as a per-partition top-k (TakeOrderedAndProject) with the
grouping key as tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regframe.bundle import Registry
from regframe.functions.ids import py_digits
from regframe.functions.labels import status_label
from regframe.operators import filters
from regframe.schemas import ACTIVITY_LEVELS

ACTIVE = "02"
CLOSED = "08"
DATE8_RE = r"\A[0-9]{8}\z"


def by_state(reg: Registry, *, limit: int = 30) -> DataFrame:
    """Establishments per state (all statuses), top ``limit``."""
    return (
        reg["estabelecimento"]
        .groupBy("uf")
        .agg(F.count(F.lit(1)).alias("estabelecimentos"))
        .orderBy(F.desc("estabelecimentos"), F.asc_nulls_first("uf"))
        .limit(limit)
    )


def by_activity(
    reg: Registry, *, uf: str | None = None, nivel: str = "subclasse", limit: int = 30
) -> DataFrame:
    """Active establishments per principal activity at a hierarchy level.

    Codes outside the hierarchy form a NULL group (left join).
    """
    if nivel not in ACTIVITY_LEVELS:
        raise ValueError(f"nivel must be one of: {', '.join(ACTIVITY_LEVELS)}")
    est = reg["estabelecimento"].where(F.col("situacao_cadastral") == ACTIVE)
    if uf:
        est = est.where(F.col("uf") == uf.upper())
    per_code = est.groupBy("cnae_fiscal").agg(F.count(F.lit(1)).alias("_n"))
    if nivel == "subclasse":
        d = reg.dim("cnae")
        j = per_code.join(d, per_code["cnae_fiscal"] == d["codigo"], "left").select(
            per_code["cnae_fiscal"].alias("cnae"), d["descricao"].alias("descricao"), "_n"
        )
        key = "cnae"
    else:
        filters.require(reg, "cnae_hierarquia", "an activity-level aggregate")
        h = reg.dim("cnae_hierarquia")
        j = per_code.join(h, per_code["cnae_fiscal"] == h["cnae"], "left").select(
            h[nivel].alias(nivel), h[f"{nivel}_desc"].alias("descricao"), "_n"
        )
        key = nivel
    return (
        j.groupBy(key, "descricao")
        .agg(F.sum("_n").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first(key), F.asc_nulls_first("descricao"))
        .limit(limit)
    )


def by_status(reg: Registry) -> DataFrame:
    """Establishments per status with its label, no limit."""
    return (
        reg["estabelecimento"]
        .groupBy(F.col("situacao_cadastral").alias("situacao"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("situacao_desc", status_label("situacao"))
        .orderBy(F.desc("n"), F.asc_nulls_first("situacao"))
    )


def by_municipality(
    reg: Registry,
    *,
    uf: str | None = None,
    cnae: str | None = None,
    cnae_secao: str | None = None,
    limit: int = 6000,
) -> DataFrame:
    """Active establishments per covered municipality with code, name, centroid.

    Inner join: municipalities without an external code are dropped.
    """
    filters.require(reg, "municipio_ibge", "the municipality aggregate")
    est = reg["estabelecimento"].where(F.col("situacao_cadastral") == ACTIVE)
    est = filters.apply(reg, est, filters.EstFilter(uf=uf, cnae=cnae, cnae_secao=cnae_secao))
    per_code = est.groupBy("municipio").agg(F.count(F.lit(1)).alias("_n"))
    mi = reg.dim("municipio_ibge")
    j = per_code.join(mi, per_code["municipio"] == mi["codigo_rf"], "inner")
    return (
        j.groupBy(
            mi["codigo_ibge"].alias("municipio_ibge"),
            mi["nome"],
            mi["uf"],
            mi["latitude"],
            mi["longitude"],
        )
        .agg(F.sum("_n").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first("municipio_ibge"))
        .limit(limit)
    )


def with_map_radius(agg: DataFrame, count_col: str = "n") -> DataFrame:
    """Marker radius of a municipality aggregate on a map: ``sqrt(n) * 40``."""
    return agg.withColumn("raio", F.sqrt(F.col(count_col)) * 40)


def cohorts(
    reg: Registry,
    *,
    freq: str = "ano",
    desde: str | None = None,
    ate: str | None = None,
    uf: str | None = None,
    municipio: str | None = None,
    municipio_ibge: str | None = None,
    cnae: str | None = None,
    cnae_secao: str | None = None,
    cnae_divisao: str | None = None,
    matriz_filial: str | None = None,
) -> DataFrame:
    """Openings, closures, balance, still-active and survival per year or month.

    One scan: every establishment emits an opening event (period of its start
    date) and, when closed, a closure event (period of its status date); a
    single grouped sum replaces two aggregates and a full outer join.
    Survival compares with today's status (snapshot semantics).
    """
    if freq not in ("ano", "mes"):
        raise ValueError("freq must be 'ano' or 'mes'")
    n = 4 if freq == "ano" else 6
    est = filters.apply(
        reg,
        reg["estabelecimento"],
        filters.EstFilter(
            uf=uf,
            municipio=municipio,
            municipio_ibge=municipio_ibge,
            cnae=cnae,
            cnae_secao=cnae_secao,
            cnae_divisao=cnae_divisao,
            matriz_filial=matriz_filial,
        ),
    )
    start = F.col("data_inicio_atividades")
    status_date = F.col("data_situacao_cadastral")
    opened = F.coalesce(start.rlike(DATE8_RE), F.lit(False))
    closed = F.coalesce(
        (F.col("situacao_cadastral") == CLOSED) & status_date.rlike(DATE8_RE), F.lit(False)
    )
    active = F.coalesce(F.col("situacao_cadastral") == ACTIVE, F.lit(False))
    ev_type = "struct<periodo:string,ab:int,at:int,bx:int>"
    events = F.array(
        F.when(
            opened,
            F.struct(
                F.substring(start, 1, n).alias("periodo"),
                F.lit(1).alias("ab"),
                active.cast("int").alias("at"),
                F.lit(0).alias("bx"),
            ),
        ).cast(ev_type),
        F.when(
            closed,
            F.struct(
                F.substring(status_date, 1, n).alias("periodo"),
                F.lit(0).alias("ab"),
                F.lit(0).alias("at"),
                F.lit(1).alias("bx"),
            ),
        ).cast(ev_type),
    )
    ev = (
        est.where(opened | closed)
        .select(F.explode(events).alias("e"))
        .where(F.col("e").isNotNull())  # an absent event is a NULL element
        .select("e.*")
    )
    g = ev.groupBy("periodo").agg(
        F.sum("ab").cast("long").alias("aberturas"),
        F.sum("bx").cast("long").alias("baixas"),
        F.sum("at").cast("long").alias("ativas_hoje"),
    )
    if desde:
        g = g.where(F.col("periodo") >= py_digits(desde)[:n])
    if ate:
        g = g.where(F.col("periodo") <= py_digits(ate)[:n])
    return g.select(
        "periodo",
        "aberturas",
        "baixas",
        (F.col("aberturas") - F.col("baixas")).alias("saldo"),
        "ativas_hoje",
        F.when(
            F.col("aberturas") > 0, F.round(F.col("ativas_hoje") / F.col("aberturas"), 4)
        ).alias("taxa_sobrevivencia"),
    ).orderBy("periodo")


def count_by(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """``GROUP BY cols`` count, ordered by count then key."""
    return (
        df.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), *[F.asc_nulls_first(c) for c in cols])
    )


def bridge_by_kind(reg: Registry) -> DataFrame:
    return count_by(reg["estabelecimento_cnae"], "tipo")


def active_by_section(reg: Registry) -> DataFrame:
    """Active establishments per activity section (the NULL group included)."""
    filters.require(reg, "cnae_hierarquia", "the section aggregate")
    est = reg["estabelecimento"].where(F.col("situacao_cadastral") == ACTIVE)
    per_code = est.groupBy("cnae_fiscal").agg(F.count(F.lit(1)).alias("_n"))
    h = reg.dim("cnae_hierarquia")
    j = per_code.join(h, per_code["cnae_fiscal"] == h["cnae"], "left")
    return (
        j.groupBy(h["secao"].alias("secao"))
        .agg(F.sum("_n").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first("secao"))
    )


def active_by_external_code(reg: Registry) -> DataFrame:
    """Active establishments per external municipality code (NULL when uncovered)."""
    filters.require(reg, "municipio_ibge", "the external-code aggregate")
    est = reg["estabelecimento"].where(F.col("situacao_cadastral") == ACTIVE)
    per_code = est.groupBy("municipio").agg(F.count(F.lit(1)).alias("_n"))
    mi = reg.dim("municipio_ibge")
    j = per_code.join(mi, per_code["municipio"] == mi["codigo_rf"], "left")
    return (
        j.groupBy(mi["codigo_ibge"].alias("municipio_ibge"))
        .agg(F.sum("_n").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first("municipio_ibge"))
    )
