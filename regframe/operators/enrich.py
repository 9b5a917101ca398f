"""Order-preserving enrichment of a key list.

Input: a DataFrame ``(pos, entrada)``. Output: one row per input row (more
when a base key has two head offices, as published), ``encontrado``/``erro``/
``dv_valido`` flags and 37 registry columns, ordered by ``pos``.

Two steps. The list is parsed and resolved once (a full key stands for itself, a base key
for its head offices) and kept as a table in the shared folder, so that the planner
knows its size. Then every big table is scanned once, reduced to the list by a semi
join (establishments by target, companies and simples by the front of the target: none
waits for another), and what is left meets the list: companies and simples by company
key, establishments by full key. Rows without a target take no part in the joins and
come back by a union, so they do not all meet in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.bundle import Registry
from regframe.functions import ids
from regframe.functions.labels import status_label
from regframe.operators import geo
from regframe.session import written

OUTPUT_COLUMNS = [
    "pos",
    "entrada",
    "cnpj_normalizado",
    "encontrado",
    "cnpj",
    "razao_social",
    "nome_fantasia",
    "matriz_filial",
    "situacao_cadastral",
    "data_situacao_cadastral",
    "data_inicio_atividades",
    "natureza_juridica",
    "natureza_juridica_desc",
    "porte_empresa",
    "capital_social",
    "cnae_fiscal",
    "cnae_descricao",
    "cnae_fiscal_secundaria",
    "uf",
    "municipio",
    "municipio_nome",
    *geo.EXTRA_COLUMNS,
    "cep",
    "tipo_logradouro",
    "logradouro",
    "numero",
    "complemento",
    "bairro",
    "opcao_simples",
    "opcao_mei",
    "erro",
    "dv_valido",
    "situacao_cadastral_desc",
]


#: What the result takes from the establishment and from the company.
EST_COLUMNS = [
    "cnpj",
    "cnpj_basico",
    "nome_fantasia",
    "matriz_filial",
    "situacao_cadastral",
    "data_situacao_cadastral",
    "data_inicio_atividades",
    "cnae_fiscal",
    "cnae_fiscal_secundaria",
    "uf",
    "municipio",
    "cep",
    "tipo_logradouro",
    "logradouro",
    "numero",
    "complemento",
    "bairro",
]
EMP_COLUMNS = ["razao_social", "natureza_juridica", "porte_empresa", "capital_social"]


def entries_from_list(spark: SparkSession, values: list) -> DataFrame:
    """A small in-memory list (API input) as ``(pos, entrada)``."""
    text = pa.array([None if v is None else str(v) for v in values], pa.string())
    rows = pa.table({"pos": pa.array(range(len(values)), pa.int64()), "entrada": text})
    return spark.createDataFrame(rows)  # a local relation, whose size the planner knows


def resolve(reg: Registry, entries: DataFrame) -> DataFrame:
    """``pos, entrada, chave, cnpj_alvo, base`` of a list, written to the shared folder: the
    normalised key, the establishment it stands for and that one's company key."""
    strip = F.regexp_replace(F.coalesce(F.col("entrada"), F.lit("")), r"^\s+|\s+$", "")
    ent = ids.with_list_key(entries.select("pos", strip.alias("entrada")), "entrada", "chave")
    by_base = F.length("chave") == 8
    heads = reg["cnpj_base2matriz"].select(F.col("cnpj_basico").alias("_hb"), F.col("cnpj").alias("_head"))
    asked = ent.where(by_base)
    heads = heads.join(asked.select(F.col("chave").alias("_hb")), "_hb", "left_semi")
    listed = asked.join(heads, F.col("chave") == F.col("_hb"), "left")
    plain = ent.where(F.coalesce(~by_base, F.lit(True))).select("*", F.col("chave").alias("cnpj_alvo"))
    both = plain.unionByName(listed.drop("_hb").withColumnRenamed("_head", "cnpj_alvo"))
    return written(both.withColumn("base", F.substring("cnpj_alvo", 1, 8)), "regframe-lists")


def enrich(reg: Registry, entries: DataFrame) -> DataFrame:
    """Enrich ``(pos, entrada)``."""
    asked = resolve(reg, entries)
    full = F.length("chave") == 14
    # rows with something to look up; the rest is only echoed
    wanted = asked.where("cnpj_alvo is not null")
    echoed = asked.where("cnpj_alvo is null")
    targets, bases = wanted.select(F.col("cnpj_alvo").alias("cnpj")), wanted.select(F.col("base").alias("cnpj_basico"))
    est = reg["estabelecimento"].select(*EST_COLUMNS).join(targets, "cnpj", "left_semi")
    emp = reg["empresas"].select("cnpj_basico", *EMP_COLUMNS).join(bases, "cnpj_basico", "left_semi")
    si = reg["simples"].select("cnpj_basico", "opcao_simples", "opcao_mei").join(bases, "cnpj_basico", "left_semi")
    firms = wanted
    for side in (emp, si):
        firms = firms.join(side.withColumnRenamed("cnpj_basico", "_b"), F.col("base") == F.col("_b"), "left").drop("_b")
    j = firms.join(est, F.col("cnpj_alvo") == F.col("cnpj"), "left")
    # a target that is no establishment has no company either
    missing = F.col("cnpj").isNull()
    j = j.withColumns({c: F.when(~missing, F.col(c)) for c in (*EMP_COLUMNS, "opcao_simples", "opcao_mei")})
    j = j.unionByName(echoed, allowMissingColumns=True).drop("base")
    for dim, code, name in (
        ("natureza_juridica", "natureza_juridica", "natureza_juridica_desc"),
        ("cnae", "cnae_fiscal", "cnae_descricao"),
        ("municipio", "municipio", "municipio_nome"),
    ):
        d = reg.dim(dim).select(F.col("codigo").alias(f"_{dim}"), F.col("descricao").alias(name))
        j = j.join(d, j[code] == d[f"_{dim}"], "left").drop(f"_{dim}")
    j = geo.with_extras(reg, j)
    j = (
        j.withColumn("cnpj_normalizado", F.col("chave"))
        .withColumn("encontrado", F.col("cnpj").isNotNull())
        .withColumn("erro", F.when(F.col("chave").isNull(), F.lit(ids.KEY_FORMAT_ERROR)))
        .withColumn("dv_valido", F.when(full, ids.digits_valid("chave")))
        .withColumn("situacao_cadastral_desc", status_label("situacao_cadastral", empty_as_null=True))
    )
    return j.select(*OUTPUT_COLUMNS).orderBy("pos")


def found_ratio(enriched: DataFrame) -> DataFrame:
    """(encontrados, total, taxa) of an enrichment result, one row."""
    return enriched.agg(
        F.count_if(F.col("encontrado")).alias("encontrados"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn(
        "taxa", F.when(F.col("total") > 0, F.round(F.col("encontrados") / F.col("total"), 4))
    )
