"""Queries of the aggregates and cohorts."""

from __future__ import annotations

from regframe.operators import analytics
from regframe.plans.catalog import query
from regframe.plans.oracle_registry import label, look

#: Establishments are counted by their own code first; the codes are then put together.
_BY_CODE = "SELECT cnae_fiscal AS codigo, count(*) AS n FROM estabelecimento WHERE situacao_cadastral = '02' GROUP BY ALL"


def _level(name: str) -> str:
    return f"""WITH somas AS ({_BY_CODE}), nomeadas AS (
      SELECT {look('cnae_hierarquia', name, 'cnae', 'codigo')} AS {name},
             {look('cnae_hierarquia', name + '_desc', 'cnae', 'codigo')} AS descricao, n FROM somas)
    SELECT {name}, descricao, CAST(sum(n) AS BIGINT) AS n FROM nomeadas GROUP BY ALL
    ORDER BY n DESC, {name} NULLS FIRST, descricao NULLS FIRST LIMIT 30"""


@query(
    "agg_uf",
    """SELECT est.uf, count(est.cnpj_ordem) AS estabelecimentos FROM estabelecimento AS est
       GROUP BY ALL ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 30""",
)
def agg_uf(reg, spark, sf_dir):
    return analytics.by_state(reg, limit=30)


@query(
    "agg_cnae",
    f"""WITH somas AS (
          SELECT cnae_fiscal AS cnae, count(*) AS n FROM estabelecimento
          WHERE (situacao_cadastral, uf) = ('02', 'U1') GROUP BY ALL)
        SELECT cnae, {look('cnae', 'descricao', 'codigo', 'cnae')} AS descricao, n FROM somas
        ORDER BY 3 DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 30""",
)
def agg_cnae(reg, spark, sf_dir):
    return analytics.by_activity(reg, uf="u1", nivel="subclasse", limit=30)


@query("agg_cnae_class", _level("classe"))
def agg_cnae_class(reg, spark, sf_dir):
    return analytics.by_activity(reg, nivel="classe", limit=30)


@query("agg_cnae_group", _level("grupo"))
def agg_cnae_group(reg, spark, sf_dir):
    return analytics.by_activity(reg, nivel="grupo", limit=30)


@query("agg_cnae_division", _level("divisao"))
def agg_cnae_division(reg, spark, sf_dir):
    return analytics.by_activity(reg, nivel="divisao", limit=30)


@query("agg_cnae_section", _level("secao"))
def agg_cnae_section(reg, spark, sf_dir):
    return analytics.by_activity(reg, nivel="secao", limit=30)


@query(
    "agg_status",
    f"""WITH somas AS (SELECT situacao_cadastral AS situacao, count(*) AS n FROM estabelecimento GROUP BY ALL)
        SELECT *, coalesce({label('status', 'situacao')}, situacao, '') AS situacao_desc FROM somas""",
)
def agg_status(reg, spark, sf_dir):
    return analytics.by_status(reg)


def _cities(only: str = "true", limit: int = 6000) -> str:
    """Active establishments are counted by internal code, then the covered codes are decoded."""
    return f"""SELECT codigo_ibge AS municipio_ibge, nome, uf, latitude, longitude, CAST(sum(total) AS BIGINT) AS n
    FROM (SELECT municipio AS codigo_rf, count(*) AS total FROM estabelecimento
          WHERE situacao_cadastral = '02' AND {only} GROUP BY ALL)
    NATURAL JOIN municipio_ibge GROUP BY ALL ORDER BY n DESC, municipio_ibge NULLS FIRST LIMIT {limit}"""


@query("agg_municipality", _cities())
def agg_municipality(reg, spark, sf_dir):
    return analytics.by_municipality(reg)


@query(
    "agg_municipality_map",
    "SELECT *, sqrt(n) * 40 AS raio FROM (" + _cities() + ") _m",
)
def agg_municipality_map(reg, spark, sf_dir):
    """Municipality aggregate with the marker radius of the map view."""
    return analytics.with_map_radius(analytics.by_municipality(reg))


@query(
    "agg_municipality_filtered",
    _cities(look("cnae_hierarquia", "secao", "cnae", "cnae_fiscal") + " = 'C'", 10),
)
def agg_municipality_filtered(reg, spark, sf_dir):
    return analytics.by_municipality(reg, cnae_secao=" c ", limit=10)


def _cohorts(digits: int, only: str = "true", periods: str = "true") -> str:
    """One event per opening and per closure, then one sum by period."""
    date = "regexp_full_match({}, '[0-9]{{8}}')"
    return f"""WITH eventos AS (
      SELECT data_inicio_atividades[1:{digits}] AS periodo, 1 AS a, 0 AS b, CAST(situacao_cadastral IS NOT DISTINCT FROM '02' AS INT) AS v
      FROM estabelecimento WHERE {date.format('data_inicio_atividades')} AND {only}
      UNION ALL
      SELECT data_situacao_cadastral[1:{digits}], 0, 1, 0
      FROM estabelecimento WHERE {date.format('data_situacao_cadastral')} AND situacao_cadastral = '08' AND {only})
    SELECT periodo, CAST(sum(a) AS BIGINT) AS aberturas, CAST(sum(b) AS BIGINT) AS baixas,
           CAST(sum(a - b) AS BIGINT) AS saldo, CAST(sum(v) AS BIGINT) AS ativas_hoje,
           round(sum(v) / nullif(sum(a), 0), 4) AS taxa_sobrevivencia
    FROM eventos WHERE {periods} GROUP BY periodo ORDER BY periodo"""


@query("cohort_year", _cohorts(4))
def cohort_year(reg, spark, sf_dir):
    return analytics.cohorts(reg, freq="ano")


@query(
    "cohort_month",
    _cohorts(6, periods="periodo BETWEEN '199503' AND '199811'"),
)
def cohort_month(reg, spark, sf_dir):
    return analytics.cohorts(reg, freq="mes", desde="1995-03-17", ate="1998/11")


@query(
    "cohort_filtered",
    _cohorts(
        4,
        "uf = 'U2' AND matriz_filial = '2' AND "
        + look("cnae_hierarquia", "secao", "cnae", "cnae_fiscal") + " = 'M' AND "
        + look("municipio_ibge", "codigo_ibge", "codigo_rf", "municipio") + " = '3500007'",
        "periodo >= '1994'",
    ),
)
def cohort_filtered(reg, spark, sf_dir):
    return analytics.cohorts(
        reg,
        freq="ano",
        desde="1994",
        uf="u2",
        matriz_filial="2",
        cnae_secao="m",
        municipio_ibge="3.500.007",
    )


@query(
    "bridge_by_kind",
    "SELECT tipo, count(*) AS n FROM estabelecimento_cnae GROUP BY tipo",
)
def bridge_by_kind(reg, spark, sf_dir):
    return analytics.bridge_by_kind(reg)


@query(
    "active_by_section",
    f"""SELECT {look('cnae_hierarquia', 'secao', 'cnae', 'codigo')} AS secao, CAST(sum(n) AS BIGINT) AS n
        FROM ({_BY_CODE}) GROUP BY 1""",
)
def active_by_section(reg, spark, sf_dir):
    return analytics.active_by_section(reg)


@query(
    "active_by_external_code",
    f"""WITH somas AS (SELECT municipio, count(*) AS n FROM estabelecimento WHERE situacao_cadastral = '02' GROUP BY ALL)
        SELECT {look('municipio_ibge', 'codigo_ibge', 'codigo_rf', 'municipio')} AS municipio_ibge,
               CAST(sum(n) AS BIGINT) AS n FROM somas GROUP BY 1""",
)
def active_by_external_code(reg, spark, sf_dir):
    return analytics.active_by_external_code(reg)
