"""Derived model: each derived table is a pure function of its inputs.

Rebuilding any artefact is idempotent: call the function again and overwrite
(see :func:`regframe.operators.maintain.write_table`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regframe.bundle import Registry, bounded_broadcast
from regframe.functions import ids
from regframe.schemas import PARTNER_COLUMNS, PARTNER_RULE_MONTH, SIMPLES_COLUMNS, text_schema

# numeric text DuckDB-style: no type suffixes ('1d'), no thousands separators
_NUMERIC_RE = r"\A\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"


def companies(raw: DataFrame) -> DataFrame:
    """Raw companies + ``capital_social`` (DOUBLE)."""
    s = F.translate(F.col("capital_social_str"), ",", ".")
    cap = F.when(s.rlike(_NUMERIC_RE), F.trim(s).try_cast("double"))
    return raw.withColumn("capital_social", cap)


def establishments(raw: DataFrame) -> DataFrame:
    """Raw establishments + full key ``cnpj``."""
    return raw.withColumn("cnpj", ids.full_key("cnpj_basico", "cnpj_ordem", "cnpj_dv"))


def head_office_map(empresas: DataFrame, estabelecimento: DataFrame) -> DataFrame:
    """Distinct (base key, head-office key) of companies that have a head office.

    The right-side filter makes the left join an inner one; the distinct reuses
    the join's hash partitioning on ``cnpj_basico`` (no second shuffle).
    """
    heads = estabelecimento.where(F.col("matriz_filial") == "1").select("cnpj_basico", "cnpj")
    return (
        empresas.select("cnpj_basico")
        .join(heads, "cnpj_basico", "inner")
        .select("cnpj_basico", "cnpj")
        .distinct()
    )


def partners(socios_original: DataFrame, base2matriz: DataFrame, ano_mes: str) -> DataFrame:
    """Partners with the head-office key of their company.

    From ``PARTNER_RULE_MONTH`` on, a company partner (identifier '1') carries a
    base key; it is replaced by that company's head-office key (NULL when not
    resolved). Rows with a NULL identifier fall in neither branch from that
    month on, as in the published rule.
    """
    m = base2matriz.select("cnpj_basico", F.col("cnpj").alias("cnpj"))
    rest = [c for c in PARTNER_COLUMNS if c != "cnpj_basico"]
    base = socios_original
    if ano_mes >= PARTNER_RULE_MONTH:
        # Only companies are looked up by document: people stay where they are, and rows
        # without an identifier are in neither branch.
        firm = F.col("identificador_de_socio") == "1"
        holder = m.select(F.col("cnpj_basico").alias("_doc_base"), F.col("cnpj").alias("_doc_head")).hint("shuffle_hash")
        firms = base.where(firm).join(holder, F.col("cnpj_cpf_socio") == F.col("_doc_base"), "left")
        firms = firms.withColumn("cnpj_cpf_socio", F.col("_doc_head")).select(*PARTNER_COLUMNS)
        base = base.where(~firm).select(*PARTNER_COLUMNS).unionByName(firms)
    # The company's own key comes last: its shuffle is also the one that clusters the table
    # (see maintain.CLUSTERED). Neither join sorts the partners: one row a company is hashed.
    return base.join(m.hint("shuffle_hash"), "cnpj_basico", "left").select("cnpj", "cnpj_basico", *rest)


def activity_bridge(estabelecimento: DataFrame) -> DataFrame:
    """(cnpj, cnae, tipo): principal code plus each trimmed secondary code.

    One scan and no shuffle: an explode of one array per establishment.
    """
    code = lambda c, kind: F.struct(c.alias("cnae"), F.lit(kind).alias("tipo"))
    secondary = F.split(F.coalesce("cnae_fiscal_secundaria", F.lit("")), ",")
    every = F.concat(
        F.array(code(F.col("cnae_fiscal"), "principal")),
        F.transform(secondary, lambda c: code(F.trim(c), "secundario")),
    )
    return (
        estabelecimento.select("cnpj", F.explode(every).alias("item"))
        .select("cnpj", "item.cnae", "item.tipo")
        .where(F.coalesce("cnae", F.lit("")) != "")
    )


def activity_hierarchy(cnae: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per activity code with its class, group, division and section.

    Joined on the 5-character class prefix, so retired sub-classes still map.
    """
    k = classes.select(
        "classe",
        "classe_desc",
        "grupo",
        "grupo_desc",
        "divisao",
        "divisao_desc",
        "secao",
        "secao_desc",
    )
    return cnae.join(
        bounded_broadcast(k),
        F.substring(cnae["codigo"], 1, 5) == k["classe"],
        "left",
    ).select(
        cnae["codigo"].alias("cnae"),
        cnae["descricao"].alias("cnae_desc"),
        "classe",
        "classe_desc",
        "grupo",
        "grupo_desc",
        "divisao",
        "divisao_desc",
        "secao",
        "secao_desc",
    )


def view_active(reg: Registry) -> DataFrame:
    return reg["estabelecimento"].where(F.col("situacao_cadastral") == "02")


def view_head_office(reg: Registry) -> DataFrame:
    return reg["estabelecimento"].where(F.col("matriz_filial") == "1")


def view_mei(reg: Registry) -> DataFrame:
    si = reg["simples"].where(F.upper(F.coalesce(F.col("opcao_mei"), F.lit(""))) == "S")
    return reg["estabelecimento"].join(si.select("cnpj_basico"), "cnpj_basico", "inner").select(
        *reg["estabelecimento"].columns
    )


def reference_meta(reg: Registry, *, text_index: bool, project: str = "regframe") -> DataFrame:
    """(referencia, valor): date, establishment count, month, project, index flag."""
    n = reg["estabelecimento"].agg(F.count(F.lit(1)).cast("string").alias("valor"))
    rows = reg.spark.createDataFrame(
        [
            ("CNPJ", reg.data_ref),
            ("ano_mes", reg.ano_mes),
            ("projeto", project),
            ("fts", "1" if text_index else "0"),
        ],
        "referencia string, valor string",
    )
    return rows.unionByName(n.select(F.lit("cnpj_qtde").alias("referencia"), "valor"))


def empty_simples(spark) -> DataFrame:
    """Typed empty frame when the optional simples files are absent."""
    return spark.createDataFrame([], text_schema(SIMPLES_COLUMNS))


def base_tables(
    raw: dict[str, DataFrame | None],
    codes: dict[str, DataFrame | None],
    *,
    municipio_ibge: DataFrame | None = None,
    cep_geo: DataFrame | None = None,
) -> dict[str, DataFrame | None]:
    """Tables that come straight from the raw files (plus the dimensions)."""
    est = establishments(raw["estabelecimento"])
    simples = raw.get("simples")
    if simples is None:
        simples = empty_simples(est.sparkSession)
    frames: dict[str, DataFrame | None] = {
        "empresas": companies(raw["empresas"]),
        "estabelecimento": est,
        "simples": simples,
        "municipio_ibge": municipio_ibge,
        "cep_geo": cep_geo,
    }
    frames.update(codes)
    return frames


def derived_tables(
    base: dict[str, DataFrame | None],
    raw: dict[str, DataFrame | None],
    *,
    ano_mes: str,
    cnae_classes: DataFrame | None = None,
    head_offices: DataFrame | None = None,
) -> dict[str, DataFrame | None]:
    """Tables derived from the base ones: head-office map, activity bridge,
    resolved partners, activity hierarchy.

    ``head_offices`` is the already written head-office map when the caller
    stores the model in stages (the partners then read it instead of
    re-deriving it from the establishments).
    """
    b2m = head_offices if head_offices is not None else head_office_map(
        base["empresas"], base["estabelecimento"]
    )
    frames: dict[str, DataFrame | None] = {
        "cnpj_base2matriz": b2m,
        "estabelecimento_cnae": activity_bridge(base["estabelecimento"]),
    }
    if raw.get("socios_original") is not None:
        frames["socios"] = partners(raw["socios_original"], b2m, ano_mes)
    elif raw.get("socios") is not None:
        frames["socios"] = raw["socios"]
    else:
        raise RuntimeError("neither raw partners nor resolved partners are available")
    if cnae_classes is not None and base.get("cnae") is not None:
        frames["cnae_hierarquia"] = activity_hierarchy(base["cnae"], cnae_classes)
    return frames


def build_registry(
    raw: dict[str, DataFrame | None],
    codes: dict[str, DataFrame | None],
    *,
    ano_mes: str,
    data_ref: str = "desconhecida",
    municipio_ibge: DataFrame | None = None,
    cnae_classes: DataFrame | None = None,
    cep_geo: DataFrame | None = None,
) -> Registry:
    """Raw tables + code tables + dimensions -> the derived registry (lazy)."""
    base = base_tables(raw, codes, municipio_ibge=municipio_ibge, cep_geo=cep_geo)
    frames = dict(base)
    frames.update(derived_tables(base, raw, ano_mes=ano_mes, cnae_classes=cnae_classes))
    return Registry(frames, ano_mes=ano_mes, data_ref=data_ref)
