"""Queries of the dimension builders over inputs derived from the driver tables.

The public sources of the two dimensions are not available offline, so their
input shapes are derived: suppliers stand for municipalities (state code =
nation), nations with their region for states, and every part for one record
of the nested activity source (sub-class inside class inside group inside
division inside section). The builders then run unchanged.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from regframe.plans.catalog import query
from regframe.sources import dims
from regframe.sources.starmap import activity_code, read_table

_MUNI_CTES = [
    ("municipios", """
  SELECT CAST(s_suppkey AS VARCHAR) AS siafi_id,
         CAST(3100000 + s_suppkey AS VARCHAR) AS codigo_ibge,
         s_name AS nome, s_nationkey AS codigo_uf,
         (s_suppkey % 25 = 0) AS capital,
         CAST(-(s_suppkey % 30) AS VARCHAR) AS latitude,
         CAST(-(s_suppkey % 70) AS VARCHAR) AS longitude
  FROM supplier"""),
    ("estados", """
  SELECT n_nationkey AS codigo_uf, 'U' || CAST(n_nationkey AS VARCHAR) AS uf, r_name AS regiao
  FROM nation JOIN region ON n_regionkey = r_regionkey"""),
]
_MUNI_SQL = """
SELECT CASE WHEN length(siafi_id) < 4 THEN lpad(siafi_id, 4, '0') ELSE siafi_id END AS codigo_rf,
       codigo_ibge, nome, uf, regiao, CAST(capital AS VARCHAR) AS capital, latitude, longitude
FROM municipios m JOIN estados e ON m.codigo_uf = e.codigo_uf
"""


@query("dims_municipalities", _MUNI_SQL, extra_ctes=_MUNI_CTES)
def dims_municipalities(reg, spark, sf_dir):
    """Municipality dimension builder (A16): join to states, zero-fill, duplicate check."""
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    municipios = s.select(
        k.cast("string").alias("siafi_id"),
        (F.lit(3100000) + k).cast("string").alias("codigo_ibge"),
        F.col("s_name").alias("nome"),
        F.col("s_nationkey").alias("codigo_uf"),
        (k % 25 == 0).alias("capital"),
        (-(k % 30)).cast("string").alias("latitude"),
        (-(k % 70)).cast("string").alias("longitude"),
    )
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    estados = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_nationkey").alias("codigo_uf"),
        F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("uf"),
        F.col("r_name").alias("regiao"),
    )
    return dims.build_municipalities(municipios, estados)


_CLASS_CTES = [
    ("sub", "SELECT p_partkey % 200 AS k FROM part"),
    ("codes", "SELECT lpad(CAST(CAST(1000 + floor(k / 2) * 890 AS INT) AS VARCHAR), 5, '0') AS classe FROM sub"),
]
_CLASS_SQL = """
SELECT DISTINCT classe, 'CLASSE ' || classe AS classe_desc,
       substr(classe, 1, 3) AS grupo, 'GRUPO ' || substr(classe, 1, 3) AS grupo_desc,
       substr(classe, 1, 2) AS divisao, 'DIVISAO ' || substr(classe, 1, 2) AS divisao_desc,
       chr(CAST(65 + CAST(substr(classe, 1, 2) AS INT) % 21 AS INT)) AS secao,
       'SECAO ' || chr(CAST(65 + CAST(substr(classe, 1, 2) AS INT) % 21 AS INT)) AS secao_desc
FROM codes
"""


@query("dims_activity_classes", _CLASS_SQL, extra_ctes=_CLASS_CTES)
def dims_activity_classes(reg, spark, sf_dir):
    """Activity hierarchy builder (A17): nested records flattened, one row per class."""
    p = read_table(spark, sf_dir, "part").select(
        activity_code(F.col("p_partkey") % 200).alias("_code"), F.col("p_name").alias("_name")
    )
    p = p.withColumn("_cls", F.substring("_code", 1, 5))
    p = p.withColumn("_div", F.substring("_cls", 1, 2)).withColumn(
        "_sec", F.expr("chr(65 + CAST(_div AS INT) % 21)")
    )
    cls, div, sec = F.col("_cls"), F.col("_div"), F.col("_sec")
    nested = p.select(
        F.col("_code").alias("id"),
        F.col("_name").alias("descricao"),
        F.struct(
            cls.alias("id"),
            F.concat(F.lit("CLASSE "), cls).alias("descricao"),
            F.struct(
                F.substring(cls, 1, 3).alias("id"),
                F.concat(F.lit("GRUPO "), F.substring(cls, 1, 3)).alias("descricao"),
                F.struct(
                    div.alias("id"),
                    F.concat(F.lit("DIVISAO "), div).alias("descricao"),
                    F.struct(sec.alias("id"), F.concat(F.lit("SECAO "), sec).alias("descricao")).alias(
                        "secao"
                    ),
                ).alias("divisao"),
            ).alias("grupo"),
        ).alias("classe"),
    )
    return dims.build_activity_classes(nested)
