"""Dimension tables: municipality codes and the activity hierarchy.

Builders take the public source tables as DataFrames (downloading them is
outside the engine) and check them with Spark, not on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.schemas import ACTIVITY_CLASS_COLUMNS


def municipalities_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """``municipio_ibge`` from its header CSV: text, then boolean and doubles."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        "codigo_rf",
        "codigo_ibge",
        "nome",
        "uf",
        "regiao",
        (F.col("capital") == "1").alias("capital"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
    )


def activity_classes_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(*ACTIVITY_CLASS_COLUMNS)


def build_municipalities(municipios: DataFrame, estados: DataFrame) -> DataFrame:
    """Municipalities joined to their state by state code.

    ``municipios``: siafi_id, codigo_ibge, nome, codigo_uf, capital, latitude,
    longitude; ``estados``: codigo_uf, uf, regiao. The internal code is the
    zero-filled (4) SIAFI id. Raises when an internal code repeats.
    """
    st = estados.select("codigo_uf", "uf", "regiao")
    m = municipios.join(st, "codigo_uf", "inner").select(
        F.when(F.length("siafi_id") < 4, F.lpad("siafi_id", 4, "0"))
        .otherwise(F.col("siafi_id"))
        .alias("codigo_rf"),
        "codigo_ibge",
        "nome",
        "uf",
        "regiao",
        F.col("capital").cast("string").alias("capital"),
        F.col("latitude").cast("string").alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
    )
    dups = m.groupBy("codigo_rf").count().where(F.col("count") > 1).select("codigo_rf")
    bad = dups.orderBy("codigo_rf").limit(20).collect()  # at most 20 codes for the message
    if bad:
        raise RuntimeError(f"duplicate internal municipality code: {[r[0] for r in bad]}")
    return m.orderBy("codigo_ibge")


def build_activity_classes(subclasses_json: DataFrame) -> DataFrame:
    """One row per class from the nested sub-class records (the greatest id wins).

    Input records: ``{id, descricao, classe: {id, descricao, grupo: {id,
    descricao, divisao: {id, descricao, secao: {id, descricao}}}}}``; the
    flattening is a nested-field select and a per-class ``max_by`` on the record's
    id, then its content, so that reruns agree (partial aggregation).
    """
    c = subclasses_json.select(
        F.col("id").cast("string").alias("_ord"),
        F.col("classe.id").alias("classe"),
        F.col("classe.descricao").alias("classe_desc"),
        F.col("classe.grupo.id").alias("grupo"),
        F.col("classe.grupo.descricao").alias("grupo_desc"),
        F.col("classe.grupo.divisao.id").alias("divisao"),
        F.col("classe.grupo.divisao.descricao").alias("divisao_desc"),
        F.col("classe.grupo.divisao.secao.id").alias("secao"),
        F.col("classe.grupo.divisao.secao.descricao").alias("secao_desc"),
    )
    rest = [x for x in ACTIVITY_CLASS_COLUMNS if x != "classe"]
    return (
        c.groupBy("classe")
        .agg(F.max_by(F.struct(*rest), F.struct("_ord", *rest)).alias("_v"))
        .select("classe", "_v.*")
        .orderBy("classe")
    )
