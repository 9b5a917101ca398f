"""Queries of the data-quality checks and the geocode cache."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regframe.operators import geo, quality
from regframe.operators.geolog import GeoLog
from regframe.plans.catalog import query
from regframe.plans.oracle_registry import dv_sql
from regframe.session import checkpoint_dir


def _chk(order, name, ok, valor, src=""):
    nivel, detalhe = quality.CHECKS[name]
    return (
        f"SELECT {order} AS ordem, '{name}' AS check_name, {ok} AS ok, '{nivel}' AS nivel, "
        f"'{detalhe}' AS detalhe, COALESCE(CAST({valor} AS VARCHAR), 'None') AS valor {src}"
    )


_FULL = "regexp_full_match(cnpj, '[0-9A-Z]{12}[0-9]{2}')"
#: Activity codes in use that no code table describes.
_ORPHANS = (
    "SELECT cnae_fiscal FROM (SELECT nullif(cnae_fiscal, '') AS cnae_fiscal FROM estabelecimento GROUP BY 1) "
    "ANTI JOIN cnae ON codigo = cnae_fiscal WHERE cnae_fiscal IS NOT NULL"
)
REPORT_SQL = "\nUNION ALL\n".join(
    [
        _chk(0, "tabela_empresas", "true", "NULL"),
        _chk(1, "tabela_estabelecimento", "true", "NULL"),
        _chk(2, "tabela_socios", "true", "NULL"),
        _chk(3, "tabela_cnae", "true", "NULL"),
        _chk(4, "count_estabelecimento", "count(*) > 0", "count(*)", "FROM estabelecimento"),
        _chk(5, "cnpj_preenchido", "count(*) = 0", "count(*)",
             "FROM estabelecimento WHERE cnpj IS NULL OR cnpj = ''"),
        _chk(6, "cnpj_formato", "count(*) = 0", "count(*)",
             f"FROM estabelecimento WHERE NOT {_FULL}"),
        _chk(7, "cnpj_dv", "count(*) = 0", "count(*)",
             f"FROM estabelecimento WHERE {_FULL} AND substr(cnpj, 13, 2) <> {dv_sql('cnpj')}"),
        _chk(8, "cnpj_alfanumerico", "true", "count(*)",
             "FROM estabelecimento WHERE regexp_matches(cnpj, '[A-Z]')"),
        _chk(9, "cnae_orfaos_amostra", "count(*) = 0", "count(*)",
             f"FROM ({_ORPHANS})"),
        _chk(10, "count_empresas", "count(*) > 0", "count(*)", "FROM empresas"),
        _chk(11, "count_socios", "count(*) >= 0", "count(*)", "FROM socios"),
        _chk(12, "count_estabelecimento_cnae", "count(*) > 0", "count(*)", "FROM estabelecimento_cnae"),
        _chk(13, "municipio_ibge_cobertura", "count(*) = 0",
             "CASE WHEN count(*) = 0 THEN '0' ELSE string_agg(codigo, ',' ORDER BY codigo) END",
             "FROM (SELECT codigo FROM municipio ANTI JOIN municipio_ibge ON codigo_rf = codigo) WHERE codigo <> '9707'"),
    ]
)


@query("quality_report", REPORT_SQL)
def quality_report(reg, spark, sf_dir):
    """All checks of the loaded base in one report (one pass over each table)."""
    return quality.report(reg)


@query(
    "quality_overall",
    """SELECT bool_and(ok) FILTER (WHERE nivel = 'erro') AS ok, count(*) AS checks
       FROM (""" + REPORT_SQL + ")",
)
def quality_overall(reg, spark, sf_dir):
    return quality.overall_ok(quality.report(reg))


@query(
    "quality_bad_digits",
    f"SELECT cnpj, {dv_sql('cnpj')} AS dv_esperado FROM estabelecimento "
    f"WHERE {_FULL} AND substr(cnpj, 13, 2) <> {dv_sql('cnpj')}",
)
def quality_bad_digits(reg, spark, sf_dir):
    return quality.bad_digits(reg)


@query("quality_orphans", _ORPHANS)
def quality_orphans(reg, spark, sf_dir):
    return quality.orphan_activities(reg)


# --- geocode cache -------------------------------------------------------------
# The cache starts with every third valid postal code already answered; the
# remote service's answers are a formula of the code (the service itself is
# outside the engine). Both sides derive from the establishment table.

_GEO_CTES = [
    ("geo_in", "SELECT CAST(substr(cnpj, 1, 12) AS BIGINT) AS pos, cep FROM estabelecimento"),
    (
        "geo_valid",
        "SELECT pos, d AS cep FROM (SELECT pos, regexp_replace(COALESCE(cep, ''), '[^0-9]', '', 'g') AS d "
        "FROM geo_in) WHERE length(d) = 8 AND d <> '00000000'",
    ),
    (
        "geo_cache0",
        """SELECT cep,
                  CASE CAST(cep AS BIGINT) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'sem_coordenada'
                       WHEN 2 THEN 'nao_encontrado' ELSE 'erro' END AS status,
                  CASE WHEN CAST(cep AS BIGINT) % 4 = 0 THEN CAST(-(CAST(cep AS BIGINT) % 90) AS DOUBLE) END AS latitude,
                  CASE WHEN CAST(cep AS BIGINT) % 4 = 0 THEN CAST(-(CAST(cep AS BIGINT) % 180) AS DOUBLE) END AS longitude,
                  CAST(NULL AS VARCHAR) AS municipio_ibge, 'cache' AS fonte,
                  '2026-01-01 00:00:00' AS atualizado_em
           FROM (SELECT DISTINCT cep FROM geo_valid) WHERE CAST(cep AS BIGINT) % 3 = 0""",
    ),
    (
        "geo_pending",
        """SELECT cep, min(pos) AS pos FROM geo_valid
           WHERE cep NOT IN (SELECT cep FROM geo_cache0
                             WHERE status IN ('ok', 'sem_coordenada', 'nao_encontrado'))
           GROUP BY cep""",
    ),
    (
        "geo_results",
        """SELECT cep,
                  CASE CAST(cep AS BIGINT) % 5 WHEN 3 THEN 'nao_encontrado' WHEN 4 THEN 'erro' ELSE 'ok' END
                      AS status,
                  CASE WHEN CAST(cep AS BIGINT) % 5 < 3 THEN CAST(-(CAST(cep AS BIGINT) % 33) AS DOUBLE) - 0.5 END
                      AS latitude,
                  CASE WHEN CAST(cep AS BIGINT) % 5 < 3 THEN CAST(-(CAST(cep AS BIGINT) % 70) AS DOUBLE) - 0.25 END
                      AS longitude,
                  CAST(NULL AS VARCHAR) AS municipio_ibge, 'lookup' AS fonte,
                  '2026-06-01 00:00:00' AS atualizado_em
           FROM geo_pending""",
    ),
    (
        "geo_merged",
        """SELECT * FROM geo_cache0 WHERE cep NOT IN (SELECT cep FROM geo_results)
           UNION ALL SELECT * FROM geo_results""",
    ),
]


def _cep_num():
    return F.col("cep").cast("long")


def _geo_inputs(reg):
    est = reg["estabelecimento"]
    ceps = est.select(F.substring("cnpj", 1, 12).cast("long").alias("pos"), "cep")
    valid = ceps.select("pos", geo.valid_cep("cep").alias("cep")).where(F.col("cep").isNotNull())
    n = _cep_num()
    cache0 = (
        valid.select("cep")
        .distinct()
        .where(n % 3 == 0)
        .select(
            "cep",
            F.when(n % 4 == 0, "ok").when(n % 4 == 1, "sem_coordenada")
            .when(n % 4 == 2, "nao_encontrado").otherwise("erro").alias("status"),
            F.when(n % 4 == 0, (-(n % 90)).cast("double")).alias("latitude"),
            F.when(n % 4 == 0, (-(n % 180)).cast("double")).alias("longitude"),
            F.lit(None).cast("string").alias("municipio_ibge"),
            F.lit("cache").alias("fonte"),
            F.lit("2026-01-01 00:00:00").cast("timestamp").alias("atualizado_em"),
        )
    )
    return ceps, cache0


def lookup_answers(pending):
    """Stand-in for the remote geocoder: an answer per pending code, by formula."""
    n = _cep_num()
    ok = n % 5 < 3
    return pending.select(
        "cep",
        F.when(n % 5 == 3, "nao_encontrado").when(n % 5 == 4, "erro").otherwise("ok").alias("status"),
        F.when(ok, (-(n % 33)).cast("double") - 0.5).alias("latitude"),
        F.when(ok, (-(n % 70)).cast("double") - 0.25).alias("longitude"),
        F.lit(None).cast("string").alias("municipio_ibge"),
        F.lit("lookup").alias("fonte"),
        F.lit("2026-06-01 00:00:00").cast("timestamp").alias("atualizado_em"),
    )


def _merged(reg):
    ceps, cache0 = _geo_inputs(reg)
    pend = geo.pending(ceps, cache0)
    return geo.merge(cache0, lookup_answers(pend))


def _ts_text(df):
    return df.withColumn("atualizado_em", F.date_format("atualizado_em", "yyyy-MM-dd HH:mm:ss"))


@query("geo_pending", "SELECT cep, pos FROM geo_pending", extra_ctes=_GEO_CTES)
def geo_pending(reg, spark, sf_dir):
    """Valid distinct postal codes of all establishments not answered in the cache."""
    ceps, cache0 = _geo_inputs(reg)
    return geo.pending(ceps, cache0)


@query(
    "geo_pending_first",
    "SELECT cep, pos FROM geo_pending ORDER BY pos, cep LIMIT 100",
    extra_ctes=_GEO_CTES,
)
def geo_pending_first(reg, spark, sf_dir):
    """The first 100 pending codes in input order (a run's ``limite``)."""
    ceps, cache0 = _geo_inputs(reg)
    return geo.pending(ceps, cache0, limite=100)


@query("geo_merge", "SELECT * FROM geo_merged", extra_ctes=_GEO_CTES)
def geo_merge(reg, spark, sf_dir):
    """Cache after merging the answers by key (answers win)."""
    return _ts_text(_merged(reg))


@query("geo_merge_log", "SELECT * FROM geo_merged", extra_ctes=_GEO_CTES)
def geo_merge_log(reg, spark, sf_dir):
    """The same cache kept as a log: outdated answers, the cache, a compaction, the new answers."""
    ceps, cache0 = _geo_inputs(reg)
    log = GeoLog(spark, f"{checkpoint_dir(spark).rstrip('/')}/regframe-runs/geo-{uuid.uuid4().hex}")
    log.append(cache0.withColumn("status", F.lit("erro")).where("cep like '%3'"))
    log.append(cache0)
    log.compact()
    log.append(lookup_answers(geo.pending(ceps, log.read())))
    log.expire()
    return _ts_text(log.read())


@query(
    "geo_precision",
    """SELECT est.cnpj, est.cep, COALESCE(cg.latitude, mi.latitude) AS latitude,
              COALESCE(cg.longitude, mi.longitude) AS longitude,
              CASE WHEN cg.latitude IS NOT NULL THEN 'cep' WHEN mi.latitude IS NOT NULL THEN 'municipio' END
                  AS geo_precisao
       FROM estabelecimento est
       LEFT JOIN municipio_ibge mi ON mi.codigo_rf = est.municipio
       LEFT JOIN geo_merged cg ON cg.cep = est.cep AND cg.status = 'ok'""",
    extra_ctes=_GEO_CTES,
)
def geo_precision(reg, spark, sf_dir):
    """Coordinates of every establishment: geocoded code first, else centroid."""
    r = reg.with_frames(cep_geo=_merged(reg))
    e = geo.with_extras(r, r["estabelecimento"].select("cnpj", "cep", "municipio", "cnae_fiscal"))
    return e.select("cnpj", "cep", "latitude", "longitude", "geo_precisao")


@query(
    "geo_stats",
    """SELECT (SELECT count(*) FROM geo_pending) AS pendentes,
              count(*) FILTER (WHERE status = 'ok') AS ok,
              count(*) FILTER (WHERE status = 'sem_coordenada') AS sem_coordenada,
              count(*) FILTER (WHERE status = 'nao_encontrado') AS nao_encontrado,
              count(*) FILTER (WHERE status = 'erro') AS erro
       FROM geo_results""",
    extra_ctes=_GEO_CTES,
)
def geo_stats(reg, spark, sf_dir):
    ceps, cache0 = _geo_inputs(reg)
    pend = geo.pending(ceps, cache0)
    return geo.stats(pend, lookup_answers(pend))


@query(
    "geo_cache_by_status",
    "SELECT status, count(*) AS n FROM geo_merged GROUP BY status",
    extra_ctes=_GEO_CTES,
)
def geo_cache_by_status(reg, spark, sf_dir):
    from regframe.operators.analytics import count_by

    return count_by(_merged(reg), "status")
