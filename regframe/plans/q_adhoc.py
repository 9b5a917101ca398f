"""Queries of guarded ad hoc SQL, table counts and export round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regframe.operators import adhoc, asof, maintain
from regframe.operators import search as S
from regframe.plans.catalog import query
from regframe.session import checkpoint_dir
from regframe.sources import starmap

_TEXTS = {
    "adhoc_group": (
        "SELECT uf, situacao_cadastral, count(*) AS n FROM estabelecimento "
        "GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2"
    ),
    "adhoc_window": (
        "SELECT rn, count(*) AS n FROM (SELECT CAST(row_number() OVER "
        "(PARTITION BY cnpj_basico ORDER BY cnpj) AS BIGINT) AS rn FROM estabelecimento) t GROUP BY rn"
    ),
    "adhoc_rollup": (
        "SELECT uf, matriz_filial, count(*) AS n FROM mv_estabelecimento_ativo "
        "GROUP BY ROLLUP (uf, matriz_filial)"
    ),
    "adhoc_except": (
        "SELECT cnpj_basico FROM empresas EXCEPT SELECT cnpj_basico FROM simples"
    ),
    # function names of the published examples, the same text in both engines
    "adhoc_functions": (
        "SELECT uf, count(*) AS n, "
        "count(*) FILTER (WHERE regexp_full_match(cnpj, '[0-9A-Z]{12}[0-9]{2}')) AS bem_formados, "
        "count(*) FILTER (WHERE list_contains(string_split(cnae_fiscal_secundaria, ','), '0189001')) "
        "AS com_secundaria, "
        "count(*) FILTER (WHERE regexp_matches(nome_fantasia, 'LOJA (URGENT|HIGH)')) AS lojas, "
        "count(*) FILTER (WHERE razao_social ILIKE '%ring%') AS ring "
        "FROM estabelecimento est JOIN empresas e ON e.cnpj_basico = est.cnpj_basico "
        "GROUP BY uf ORDER BY uf"
    ),
    "adhoc_fuzzy": (
        "SELECT porte_empresa, count(*) AS n FROM empresas "
        "WHERE jaro_winkler_similarity(lower(razao_social), 'blue bolts household') >= 0.8 "
        "GROUP BY porte_empresa"
    ),
    "adhoc_join": (
        "SELECT e.porte_empresa, si.opcao_mei, count(*) AS n, round(sum(e.capital_social), 2) AS capital "
        "FROM empresas e LEFT JOIN simples si ON si.cnpj_basico = e.cnpj_basico "
        "WHERE e.razao_social LIKE '%RING%' GROUP BY 1, 2"
    ),
    "adhoc_unnest": (
        "SELECT uf, trim(c) AS codigo, count(*) AS n FROM estabelecimento est, "
        "unnest(string_split(cnae_fiscal_secundaria, ',')) AS u(c) WHERE cnae_fiscal_secundaria <> '' GROUP BY 1, 2"
    ),
}

_VIEW_SQL = [("mv_estabelecimento_ativo", "SELECT * FROM estabelecimento WHERE situacao_cadastral = '02'")]


def _adhoc(name):
    def fn(reg, spark, sf_dir):
        reg.register_views()
        return adhoc.run_sql(spark, _TEXTS[name], limit=None)

    fn.__doc__ = f"Guarded ad hoc SQL: {_TEXTS[name]}"
    return fn


for _name, _text in _TEXTS.items():
    query(_name, f"SELECT * FROM ({_text}) _q", extra_ctes=_VIEW_SQL)(_adhoc(_name))

#: Head offices with their company's partners as they entered: views with one key and time.
_ASOF_VIEWS = [
    ("aberturas", "SELECT cnpj_basico, cnpj, data_inicio_atividades AS dia FROM estabelecimento WHERE data_inicio_atividades <> ''"),
    (
        "entradas",
        "SELECT cnpj_basico, data_entrada_sociedade AS dia, max(nome_socio) AS nome_socio, count(*) AS entraram "
        "FROM socios WHERE data_entrada_sociedade <> '' GROUP BY 1, 2",
    ),
]
_ASOF_TEXT = "SELECT cnpj_basico, cnpj, dia, nome_socio, entraram FROM aberturas ASOF LEFT JOIN entradas USING (cnpj_basico, dia)"


@query("adhoc_asof", f"SELECT * FROM ({_ASOF_TEXT}) _q", extra_ctes=_ASOF_VIEWS)
def adhoc_asof(reg, spark, sf_dir):
    """Each establishment with the latest partners who had entered its company when it opened."""
    reg.register_views()
    for name, text in _ASOF_VIEWS:
        spark.sql(text).createOrReplaceTempView(name)
    return adhoc.run_sql(spark, _ASOF_TEXT, limit=None)


@query(
    "asof_events",
    """SELECT e.event_id, e.user_id, e.ts, p.event_id AS anterior, p.ts AS quando
       FROM (SELECT * FROM events WHERE event_id % 2 = 1) e
       ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2) p
         ON e.user_id = p.user_id AND e.ts > p.ts""",
)
def asof_events(reg, spark, sf_dir):
    """Every odd event with the user's latest even event before it (strictly earlier)."""
    events = starmap.read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    even = events.where("event_id % 2 = 0").select("user_id", F.col("ts").alias("quando"), F.col("event_id").alias("anterior"))
    return asof.asof_join(events.where("event_id % 2 = 1"), even, ["user_id"], "ts", right_on="quando", strict=True)


@query(
    "adhoc_catalogue",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS tabela, CAST(count(*) AS BIGINT) AS colunas, (SELECT count(*) FROM {t}) AS linhas FROM (DESCRIBE SELECT * FROM {t})"
        for t in ("cnae", "cnpj_base2matriz", "simples")
    ),
)
def adhoc_catalogue(reg, spark, sf_dir):
    """The catalogue as ad hoc SQL reads it, beside the tables' row counts."""
    reg.register_views()
    names = "('cnae', 'cnpj_base2matriz', 'simples')"
    counted = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS linhas FROM {t}" for t in ("cnae", "cnpj_base2matriz", "simples"))
    return adhoc.run_sql(
        spark,
        f"SELECT i.table_name AS tabela, count(*) AS colunas, max(n.linhas) AS linhas FROM information_schema.columns i "
        f"JOIN ({counted}) n ON n.t = i.table_name "
        f"WHERE i.table_name IN (SELECT table_name FROM information_schema.tables WHERE table_name IN {names}) GROUP BY i.table_name",
        limit=None,
    )


_COUNT_TABLES = [
    "cnae", "cnae_hierarquia", "cnpj_base2matriz", "empresas", "estabelecimento",
    "estabelecimento_cnae", "motivo", "municipio", "municipio_ibge", "natureza_juridica",
    "pais", "qualificacao_socio", "simples", "socios",
]


@query(
    "table_counts",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS tabela, count(*) AS linhas FROM {t}" for t in _COUNT_TABLES
    ),
)
def table_counts(reg, spark, sf_dir):
    """Row count of every registry table in one job."""
    return maintain.table_counts({t: reg[t] for t in _COUNT_TABLES})


@query(
    "export_roundtrip",
    """SELECT est.cnpj, est.uf, est.cnae_fiscal, e.capital_social, est.data_inicio_atividades
       FROM estabelecimento est JOIN empresas e ON e.cnpj_basico = est.cnpj_basico
       WHERE est.situacao_cadastral = '02'""",
)
def export_roundtrip(reg, spark, sf_dir):
    """Unlimited filtered search written as Parquet and as CSV, read back (the
    CSV copy is checked to hold the same number of rows)."""
    out = S.search(reg, S.SearchSpec(situacao="02", limit=None)).select(
        "cnpj", "uf", "cnae_fiscal", "capital_social", "data_inicio_atividades"
    )
    base = f"{checkpoint_dir(spark).rstrip('/')}/regframe-exports/{uuid.uuid4().hex}"
    S.export(out, f"{base}/busca.parquet")
    S.export(out, f"{base}/busca.csv")
    back = spark.read.parquet(f"{base}/busca.parquet")
    csv_rows = spark.read.option("header", True).csv(f"{base}/busca.csv").count()
    if csv_rows != back.count():
        raise RuntimeError("CSV and Parquet exports differ in row count")
    return back.withColumn("capital_social", F.col("capital_social").cast("double"))
