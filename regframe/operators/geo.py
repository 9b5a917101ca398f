"""Coordinates of establishments and the postal-code geocode cache.

The remote lookup service is not part of the engine: its answers arrive as
a DataFrame ``(cep, status, latitude, longitude, municipio_ibge)`` and are
merged into the cache by key, last write wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regframe.bundle import Registry
from regframe.schemas import GEO_CACHE_SCHEMA, GEO_HIT_STATUSES


def with_extras(reg: Registry, est: DataFrame) -> DataFrame:
    """Add external municipality code, activity section/division and coordinates.

    Coordinates: geocoded postal code when cached with status ok, else the
    municipality centroid, else NULL; ``geo_precisao`` says which. Missing
    dimensions degrade to NULL columns.
    """
    if reg.has("municipio_ibge"):
        mi = reg.dim("municipio_ibge").select(
            F.col("codigo_rf").alias("_mi_rf"),
            F.col("codigo_ibge").alias("municipio_ibge"),
            F.col("latitude").alias("_mi_lat"),
            F.col("longitude").alias("_mi_lon"),
        )
        est = est.join(mi, est["municipio"] == mi["_mi_rf"], "left")
    else:
        est = (
            est.withColumn("municipio_ibge", F.lit(None).cast("string"))
            .withColumn("_mi_lat", F.lit(None).cast("double"))
            .withColumn("_mi_lon", F.lit(None).cast("double"))
        )
    if reg.has("cnae_hierarquia"):
        h = reg.dim("cnae_hierarquia").select(
            F.col("cnae").alias("_h_cnae"),
            F.col("secao").alias("cnae_secao"),
            F.col("divisao").alias("cnae_divisao"),
        )
        est = est.join(h, est["cnae_fiscal"] == h["_h_cnae"], "left")
    else:
        est = est.withColumn("cnae_secao", F.lit(None).cast("string")).withColumn(
            "cnae_divisao", F.lit(None).cast("string")
        )
    if reg.has("cep_geo"):
        cg = (
            reg["cep_geo"]
            .where(F.col("status") == "ok")
            .select(
                F.col("cep").alias("_cg_cep"),
                F.col("latitude").alias("_cg_lat"),
                F.col("longitude").alias("_cg_lon"),
            )
        )
        est = est.join(cg, est["cep"] == cg["_cg_cep"], "left")
    else:
        est = est.withColumn("_cg_lat", F.lit(None).cast("double")).withColumn(
            "_cg_lon", F.lit(None).cast("double")
        )
    return (
        est.withColumn("latitude", F.coalesce("_cg_lat", "_mi_lat"))
        .withColumn("longitude", F.coalesce("_cg_lon", "_mi_lon"))
        .withColumn(
            "geo_precisao",
            F.when(F.col("_cg_lat").isNotNull(), "cep").when(
                F.col("_mi_lat").isNotNull(), "municipio"
            ),
        )
    )


EXTRA_COLUMNS = [
    "municipio_ibge",
    "cnae_secao",
    "cnae_divisao",
    "latitude",
    "longitude",
    "geo_precisao",
]


def valid_cep(col: str = "cep"):
    d = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "[^0-9]", "")
    return F.when((F.length(d) == 8) & (d != "00000000"), d)


def pending(ceps: DataFrame, cache: DataFrame | None, *, limite: int | None = None) -> DataFrame:
    """Valid, distinct postal codes not yet answered in the cache.

    ``ceps`` has ``cep`` and an order column ``pos``; the first position of each
    code keeps the input order for the optional ``limite`` cut. Statuses
    ``ok``, ``sem_coordenada`` and ``nao_encontrado`` are hits; ``erro`` is retried.
    """
    c = ceps.select(valid_cep("cep").alias("cep"), "pos").where(F.col("cep").isNotNull())
    first = c.groupBy("cep").agg(F.min("pos").alias("pos"))
    if cache is not None:
        hits = cache.where(F.col("status").isin(*GEO_HIT_STATUSES)).select("cep")
        first = first.join(hits, "cep", "left_anti")
    first = first.orderBy("pos", "cep")
    return first.limit(limite) if limite is not None else first


def merge(cache: DataFrame | None, results: DataFrame, *, fonte: str = "lookup") -> DataFrame:
    """Upsert lookup answers into the cache by ``cep`` (last write wins).

    Within the answers the latest ``atualizado_em`` wins; answers replace cached
    rows through an anti join + union (no full window over the cache).
    """
    spark = results.sparkSession
    r = results
    if "atualizado_em" not in r.columns:
        r = r.withColumn("atualizado_em", F.current_timestamp())
    if "fonte" not in r.columns:
        r = r.withColumn("fonte", F.lit(fonte))
    for f in GEO_CACHE_SCHEMA.fields:
        if f.name not in r.columns:
            r = r.withColumn(f.name, F.lit(None).cast(f.dataType))
    r = r.select(*[F.col(f.name).cast(f.dataType) for f in GEO_CACHE_SCHEMA.fields])
    # latest answer per code, of equal times the greatest by content, so that reruns agree:
    # a grouped max_by (partial aggregation, skew-safe)
    cols = [f.name for f in GEO_CACHE_SCHEMA.fields if f.name != "cep"]
    r = (
        r.groupBy("cep")
        .agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("atualizado_em", F.lit(0).cast("timestamp")), *cols)).alias("_v"))
        .select("cep", "_v.*")
    )
    if cache is None:
        cache = spark.createDataFrame([], GEO_CACHE_SCHEMA)
    kept = cache.join(r.select("cep"), "cep", "left_anti")
    return kept.unionByName(r.select(*kept.columns))


def stats(pend: DataFrame, results: DataFrame) -> DataFrame:
    """Run statistics: pending count and count per answer status (one row)."""
    statuses = ("ok", "sem_coordenada", "nao_encontrado", "erro")
    tagged = pend.select(F.lit(True).alias("_p"), F.lit(None).cast("string").alias("status"))
    tagged = tagged.unionByName(results.select(F.lit(False).alias("_p"), F.col("status")))
    return tagged.agg(
        F.count_if(F.col("_p")).alias("pendentes"),
        *[F.count_if(~F.col("_p") & (F.col("status") == st)).alias(st) for st in statuses],
    )
