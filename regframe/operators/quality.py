"""Post-load data-quality checks as one report DataFrame.

Each check is a one-row aggregate; the fact table is read once for all of its
checks (many ``count_if`` in one pass). The report has the columns
``(ordem, check_name, ok, nivel, detalhe, valor)``; ``valor`` is text
('None' when a check has no value). ``ok`` of the base = every ``erro`` check ok.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regframe.bundle import Registry
from regframe.functions import ids
from regframe.schemas import ABROAD_MUNICIPALITY

# --- fixed values: check names, levels and descriptions of the report --------
CHECKS = {
    "tabela_empresas": ("erro", "existência de empresas"),
    "tabela_estabelecimento": ("erro", "existência de estabelecimento"),
    "tabela_socios": ("erro", "existência de socios"),
    "tabela_cnae": ("erro", "existência de cnae"),
    "count_estabelecimento": ("erro", "estabelecimentos > 0"),
    "cnpj_preenchido": ("erro", "estabelecimento.cnpj sem nulos"),
    "cnpj_formato": ("aviso", "CNPJ com 14 posições [0-9A-Z]{12}[0-9]{2}"),
    "cnpj_dv": ("aviso", "CNPJ com dígito verificador inválido"),
    "cnpj_alfanumerico": ("aviso", "CNPJs alfanuméricos (informativo)"),
    "cnae_orfaos_amostra": ("erro", "CNAEs sem descrição (amostra)"),
    "count_empresas": ("erro", "empresas > 0"),
    "count_socios": ("erro", "sócios carregados"),
    "count_estabelecimento_cnae": ("erro", "ponte CNAE"),
    "municipio_ibge_cobertura": ("aviso", "municípios RF sem código IBGE (exceto 9707 EXTERIOR)"),
}


def _rows(df: DataFrame, checks: list[tuple[int, str, Column, Column]]) -> DataFrame:
    """Report rows of several checks read off one aggregate row of ``df``.

    ``checks`` holds ``(order, name, ok, value)`` expressions over that row;
    ``inline`` turns them into rows, so the table behind ``df`` is scanned once
    for all of them (separate one-row frames in a union would each keep only
    their own column after pruning and scan the table again).
    """
    structs = []
    for order, name, ok, valor in checks:
        nivel, detalhe = CHECKS[name]
        structs.append(
            F.struct(
                F.lit(order).alias("ordem"),
                F.lit(name).alias("check_name"),
                ok.alias("ok"),
                F.lit(nivel).alias("nivel"),
                F.lit(detalhe).alias("detalhe"),
                F.coalesce(valor.cast("string"), F.lit("None")).alias("valor"),
            )
        )
    return df.select(F.inline(F.array(*structs)))


def _row(df: DataFrame, order: int, name: str, ok: Column, valor: Column) -> DataFrame:
    return _rows(df, [(order, name, ok, valor)])


def bad_digits(reg: Registry) -> DataFrame:
    """Well-formed keys whose check digits are wrong, with the expected digits."""
    est = reg["estabelecimento"].select("cnpj").where(ids.is_full_key("cnpj"))
    est = est.withColumn("dv_esperado", ids.check_digits(F.substring("cnpj", 1, 12)))
    return est.where(F.substring("cnpj", 13, 2) != F.col("dv_esperado"))


def orphan_activities(reg: Registry) -> DataFrame:
    """Distinct principal activity codes without a description."""
    est = reg["estabelecimento"].select("cnae_fiscal").where(
        F.col("cnae_fiscal").isNotNull() & (F.col("cnae_fiscal") != "")
    )
    codes = reg["cnae"].select(F.col("codigo").alias("cnae_fiscal"))
    return est.distinct().join(codes, "cnae_fiscal", "left_anti")


def uncovered_municipalities(reg: Registry) -> DataFrame:
    m = reg["municipio"].select("codigo").where(F.col("codigo") != ABROAD_MUNICIPALITY)
    mi = reg["municipio_ibge"].select(F.col("codigo_rf").alias("codigo"))
    return m.join(mi, "codigo", "left_anti")


def report(reg: Registry) -> DataFrame:
    spark = reg.spark
    one = spark.range(1)
    rows: list[DataFrame] = [
        _rows(
            one,
            [
                (i, f"tabela_{t}", F.lit(reg.has(t)), F.lit(None))
                for i, t in enumerate(("empresas", "estabelecimento", "socios", "cnae"))
            ],
        )
    ]
    if reg.has("estabelecimento"):
        k = F.col("cnpj")
        full = ids.is_full_key(k)
        wrong = full & (F.substring(k, 13, 2) != ids.check_digits(F.substring(k, 1, 12)))
        agg = reg["estabelecimento"].select("cnpj").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(k.isNull() | (k == "")).alias("n_null"),
            F.count_if(~full).alias("n_fmt"),
            F.count_if(wrong).alias("n_dv"),
            F.count_if(k.rlike("[A-Z]")).alias("n_alpha"),
        )
        rows.append(
            _rows(
                agg,
                [
                    (4, "count_estabelecimento", F.col("n") > 0, F.col("n")),
                    (5, "cnpj_preenchido", F.col("n_null") == 0, F.col("n_null")),
                    (6, "cnpj_formato", F.col("n_fmt") == 0, F.col("n_fmt")),
                    (7, "cnpj_dv", F.col("n_dv") == 0, F.col("n_dv")),
                    (8, "cnpj_alfanumerico", F.lit(True), F.col("n_alpha")),
                ],
            )
        )
        if reg.has("cnae"):
            orf = orphan_activities(reg).agg(F.count(F.lit(1)).alias("n"))
            rows.append(_row(orf, 9, "cnae_orfaos_amostra", F.col("n") == 0, F.col("n")))
    if reg.has("empresas"):
        n = reg["empresas"].agg(F.count(F.lit(1)).alias("n"))
        rows.append(_row(n, 10, "count_empresas", F.col("n") > 0, F.col("n")))
    if reg.has("socios"):
        n = reg["socios"].agg(F.count(F.lit(1)).alias("n"))
        rows.append(_row(n, 11, "count_socios", F.col("n") >= 0, F.col("n")))
    if reg.has("estabelecimento_cnae"):
        n = reg["estabelecimento_cnae"].agg(F.count(F.lit(1)).alias("n"))
        rows.append(_row(n, 12, "count_estabelecimento_cnae", F.col("n") > 0, F.col("n")))
    if reg.has("municipio_ibge") and reg.has("municipio"):
        # bounded by the municipality dimension, so one small group
        cov = uncovered_municipalities(reg).agg(
            F.array_join(F.sort_array(F.collect_list("codigo")), ",").alias("lista")
        )
        rows.append(
            _row(
                cov,
                13,
                "municipio_ibge_cobertura",
                F.col("lista") == "",
                F.when(F.col("lista") == "", F.lit("0")).otherwise(F.col("lista")),
            )
        )
    return functools.reduce(DataFrame.unionByName, rows)


def overall_ok(rep: DataFrame) -> DataFrame:
    """One row: ``ok`` = every ``erro`` check passed."""
    return rep.agg(
        F.coalesce(F.min(F.when(F.col("nivel") == "erro", F.col("ok"))), F.lit(True)).alias("ok"),
        F.count(F.lit(1)).alias("checks"),
    )
