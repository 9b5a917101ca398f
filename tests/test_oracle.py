"""Every registered query against its SQL text in DuckDB (sf0.001), plus the
entry smoke check and property checks on the derived registry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from mini_fixture import SF_SMALL
from oracle_compare import compare, duck

from regframe.plans import catalog

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    missing = sorted(set(QUERIES) - set(SQL))
    assert missing == [], f"queries without an oracle: {missing}"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert r["rows"][0] == r["rows"][1], r
    assert r["cols_ok"], r
    assert r["hash_ok"], r


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["periodo", "aberturas", "baixas", "saldo", "ativas_hoje", "taxa_sobrevivencia"]
    assert df.count() > 0


def test_properties(spark):
    from regframe.operators import analytics
    from regframe.plans import catalog

    reg = catalog.registry(spark, SF_SMALL)
    est = reg["estabelecimento"]
    active = est.where("situacao_cadastral = '02'").count()
    for level in ("subclasse", "classe", "grupo", "divisao", "secao"):
        total = analytics.by_activity(reg, nivel=level, limit=100000).agg(F.sum("n")).first()[0]
        assert total == active, level
    openings = analytics.cohorts(reg, freq="mes").agg(F.sum("aberturas")).first()[0]
    assert openings == est.where(F.col("data_inicio_atividades").rlike(r"\A[0-9]{8}\z")).count()
    members = est.select(
        F.explode(F.split(F.coalesce("cnae_fiscal_secundaria", F.lit("")), ",")).alias("c")
    ).where(F.trim("c") != "").count()
    principal = est.where("cnae_fiscal IS NOT NULL AND cnae_fiscal <> ''").count()
    assert reg["estabelecimento_cnae"].count() == principal + members
    # head offices are unique here, so enrichment returns one row per position
    from regframe.operators import enrich

    heads = reg["cnpj_base2matriz"]
    assert heads.count() == heads.select("cnpj_basico").distinct().count()
    ent = est.select(F.substring("cnpj", 1, 12).cast("long").alias("pos"), F.col("cnpj_basico").alias("entrada"))
    out = enrich.enrich(reg, ent)
    assert out.count() == ent.count() and out.select("pos").distinct().count() == ent.count()
