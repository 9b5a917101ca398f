"""Queries of the key functions and the derived model."""

from __future__ import annotations

from pyspark.sql import functions as F

from regframe.functions import ids
from regframe.operators import model
from regframe.plans.catalog import query
from regframe.plans.oracle_registry import dv_sql
from regframe.sources.starmap import read_table

# --- key functions over keys built from the order table ---------------------
# A 12-position base with a letter in front: the alphanumeric key format.
_B12_SQL = (
    "chr(65 + CAST(o_orderkey % 26 AS INT)) "
    "|| substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 2, 7) "
    "|| lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')"
)
_KEYS_CTE = [
    ("k0", f"SELECT o_orderkey, {_B12_SQL} AS b12 FROM orders"),
    ("k1", f"SELECT o_orderkey, b12, b12 || {dv_sql('b12')} AS chave FROM k0"),
    (
        "k2",
        """SELECT o_orderkey, chave,
                  CASE o_orderkey % 5
                    WHEN 0 THEN lower(substr(chave, 1, 2) || '.' || substr(chave, 3, 3) || '.'
                                || substr(chave, 6, 3) || '/' || substr(chave, 9, 4) || '-'
                                || substr(chave, 13, 2))
                    WHEN 1 THEN ' ' || substr(chave, 1, 8) || ' '
                    WHEN 2 THEN CAST(o_orderkey * 7919 AS VARCHAR)
                    WHEN 3 THEN substr(chave, 1, 11)
                    ELSE NULL END AS entrada
           FROM k1""",
    ),
    (
        "k3",
        "SELECT o_orderkey, chave, entrada, "
        "regexp_replace(upper(COALESCE(entrada, '')), '[^0-9A-Z]', '', 'g') AS limpo FROM k2",
    ),
]


def _keys(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    b12 = F.concat(
        F.expr("chr(65 + CAST(o_orderkey % 26 AS INT))"),
        F.substring(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), 2, 7),
        F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"),
    )
    k1 = o.select("o_orderkey", b12.alias("b12"))
    k1 = k1.withColumn("chave", F.concat("b12", ids.check_digits("b12")))
    fmt = ids.format_key("chave")
    m = F.col("o_orderkey") % 5
    entrada = (
        F.when(m == 0, F.lower(fmt))
        .when(m == 1, F.concat(F.lit(" "), F.substring("chave", 1, 8), F.lit(" ")))
        .when(m == 2, (F.col("o_orderkey") * 7919).cast("string"))
        .when(m == 3, F.substring("chave", 1, 11))
    )
    return k1.select("o_orderkey", "chave", entrada.alias("entrada"))


@query(
    "ids_check_digits",
    """SELECT o_orderkey, b12, {dv} AS dv, chave,
              regexp_full_match(chave, '[0-9A-Z]{{12}}[0-9]{{2}}') AND substr(chave, 13, 2) = {dv} AS valido
       FROM k1""".format(dv=dv_sql("b12")),
    extra_ctes=_KEYS_CTE[:2],
)
def ids_check_digits(reg, spark, sf_dir):
    """Expected check digits of alphanumeric bases, and the validity of the full key."""
    k = _keys(spark, sf_dir).select("o_orderkey", "chave")
    k = k.withColumn("b12", F.substring("chave", 1, 12))
    return k.select(
        "o_orderkey",
        "b12",
        ids.check_digits("b12").alias("dv"),
        "chave",
        ids.digits_valid("chave").alias("valido"),
    )


@query(
    "ids_normalize",
    """SELECT o_orderkey, entrada, limpo,
              CASE WHEN regexp_full_match(limpo, '[0-9A-Z]{12}[0-9]{2}')
                     OR regexp_full_match(limpo, '[0-9A-Z]{8}') THEN limpo END AS normalizado,
              NOT regexp_full_match(limpo, '[0-9]+') AS alfanumerico,
              regexp_matches(limpo, '[A-Z]') AS tem_letra
       FROM k3""",
    extra_ctes=_KEYS_CTE,
)
def ids_normalize(reg, spark, sf_dir):
    """Cleaning and 8/14 classification of free-form key text."""
    k = _keys(spark, sf_dir).withColumn("limpo", ids.clean("entrada"))
    return k.select(
        "o_orderkey",
        "entrada",
        "limpo",
        ids.normalized_key("limpo").alias("normalizado"),
        ids.is_alphanumeric("limpo").alias("alfanumerico"),
        ids.has_letter("limpo").alias("tem_letra"),
    )


@query(
    "ids_format",
    """SELECT o_orderkey, limpo,
              CASE WHEN length(limpo) = 14 THEN substr(limpo, 1, 2) || '.' || substr(limpo, 3, 3) || '.'
                        || substr(limpo, 6, 3) || '/' || substr(limpo, 9, 4) || '-' || substr(limpo, 13, 2)
                   WHEN length(limpo) = 8 THEN substr(limpo, 1, 2) || '.' || substr(limpo, 3, 3) || '.'
                        || substr(limpo, 6, 3) END AS formatado
       FROM k3""",
    extra_ctes=_KEYS_CTE,
)
def ids_format(reg, spark, sf_dir):
    k = _keys(spark, sf_dir).withColumn("limpo", ids.clean("entrada"))
    return k.select("o_orderkey", "limpo", ids.format_key("limpo").alias("formatado"))


@query(
    "ids_pad",
    """SELECT o_orderkey, entrada,
              CASE WHEN regexp_full_match(limpo, '[0-9]+') AND length(limpo) > 8 AND length(limpo) < 14
                     THEN lpad(limpo, 14, '0')
                   WHEN regexp_full_match(limpo, '[0-9]+') AND length(limpo) < 8 THEN lpad(limpo, 8, '0')
                   ELSE limpo END AS completado
       FROM k3""",
    extra_ctes=_KEYS_CTE,
)
def ids_pad(reg, spark, sf_dir):
    """Leading zeros recovered for digit-only input of 1–7 and 9–13 positions."""
    k = _keys(spark, sf_dir)
    return k.select("o_orderkey", "entrada", ids.pad_zeros("entrada").alias("completado"))


# --- the derived model -----------------------------------------------------


@query("reg_establishments", "SELECT * FROM estabelecimento")
def reg_establishments(reg, spark, sf_dir):
    """Every establishment of the derived registry with its full key."""
    return reg["estabelecimento"]


@query(
    "model_capital",
    "SELECT cnpj_basico, capital_social_str, capital_social FROM empresas",
)
def model_capital(reg, spark, sf_dir):
    return reg["empresas"].select("cnpj_basico", "capital_social_str", "capital_social")


@query("model_head_office", "SELECT * FROM cnpj_base2matriz")
def model_head_office(reg, spark, sf_dir):
    return reg["cnpj_base2matriz"]


@query("model_partners_new", "SELECT * FROM socios")
def model_partners_new(reg, spark, sf_dir):
    """Partners resolved by the current rule (company partners -> head-office key)."""
    return reg["socios"]


@query("model_partners_old", "SELECT * FROM socios_antigos")
def model_partners_old(reg, spark, sf_dir):
    """Partners resolved by the rule of months before the switch."""
    from regframe.sources import starmap

    raw = starmap.raw_partners(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"))
    return model.partners(raw, reg["cnpj_base2matriz"], "202601")


@query("model_bridge", "SELECT * FROM estabelecimento_cnae")
def model_bridge(reg, spark, sf_dir):
    return reg["estabelecimento_cnae"]


@query("model_hierarchy", "SELECT * FROM cnae_hierarquia")
def model_hierarchy(reg, spark, sf_dir):
    return reg["cnae_hierarquia"]


@query("view_active", "SELECT * FROM estabelecimento WHERE situacao_cadastral = '02'")
def view_active(reg, spark, sf_dir):
    return model.view_active(reg)


@query("view_head_office", "SELECT * FROM estabelecimento WHERE matriz_filial = '1'")
def view_head_office(reg, spark, sf_dir):
    return model.view_head_office(reg)


@query(
    "view_mei",
    """SELECT est.* FROM estabelecimento est JOIN simples si ON si.cnpj_basico = est.cnpj_basico
       WHERE UPPER(COALESCE(si.opcao_mei, '')) = 'S'""",
)
def view_mei(reg, spark, sf_dir):
    return model.view_mei(reg)


@query(
    "meta_reference",
    """SELECT * FROM (VALUES ('CNPJ', '25/09/2026'), ('ano_mes', '202609'), ('projeto', 'regframe'),
                             ('fts', '1')) t(referencia, valor)
       UNION ALL SELECT 'cnpj_qtde', CAST(count(*) AS VARCHAR) FROM estabelecimento""",
)
def meta_reference(reg, spark, sf_dir):
    return model.reference_meta(reg, text_index=True)
