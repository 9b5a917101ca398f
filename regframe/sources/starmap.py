"""A registry derived from the driver's star-schema tables.

There is no registry dump offline, so the registry relations are defined over
``customer``, ``orders``, ``lineitem``, ``part``, ``nation`` and ``region``
with plain expressions that an independent SQL engine can repeat (see
:mod:`regframe.plans.oracle`). Work grows with the input tables: one
establishment per order, one partner per line item, one company per customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.bundle import Registry
from regframe.functions import ids
from regframe.operators import model, sequence
from regframe.schemas import (
    COMPANY_COLUMNS,
    ESTABLISHMENT_COLUMNS,
    PARTNER_COLUMNS,
    SIMPLES_COLUMNS,
)

# month of the derived snapshot (after the partner-rule switch)
STARMAP_MONTH = "202609"
STARMAP_DATE = "25/09/2026"
#: Remainders of part keys whose activity codes have no description.
ORPHAN_FROM = 190


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def activity_code(k: Column) -> Column:
    """7-digit activity code of an integer 0..199; its first 5 digits are the class."""
    cls = F.lpad((F.lit(1000) + F.floor(k / 2) * 890).cast("int").cast("string"), 5, "0")
    return F.concat(cls, F.lit("0"), (k % 2).cast("string"))


def _ymd(col: str) -> Column:
    return F.date_format(F.col(col), "yyyyMMdd")


def _s(x: Column) -> Column:
    return x.cast("string")


def _null() -> Column:
    return F.lit(None).cast("string")


def _conform(df: DataFrame, columns) -> DataFrame:
    """The given column list in order, absent ones as NULL text (one projection)."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else _null().alias(c) for c in columns])


def raw_companies(customer: DataFrame, part: DataFrame) -> DataFrame:
    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    p = part.select(F.col("p_partkey").alias("c_custkey"), "p_name")
    size = F.element_at(F.array(*[F.lit(x) for x in ("00", "01", "03", "05")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    # every company has a name: one whose part is missing is named after its key
    name = F.coalesce(F.upper("p_name"), F.concat(F.lit("EMPRESA "), _s(F.col("c_custkey"))))
    out = c.join(p, "c_custkey", "left").select(
        F.lpad(_s(F.col("c_custkey")), 8, "0").alias("cnpj_basico"),
        F.concat(name, F.lit(" "), F.col("c_mktsegment")).alias("razao_social"),
        _s(F.lit(1000) + F.col("c_nationkey")).alias("natureza_juridica"),
        _s(F.lit(49) + F.col("c_custkey") % 5).alias("qualificacao_responsavel"),
        F.translate(_s(F.col("c_acctbal")), ".", ",").alias("capital_social_str"),
        size.alias("porte_empresa"),
        _null().alias("ente_federativo_responsavel"),
    )
    return out.select(*COMPANY_COLUMNS)


def raw_establishments(orders: DataFrame) -> DataFrame:
    """One establishment per order; the n-th order of a customer is branch n.

    The head office (rn = 1) is the customer's first order. Every 97th order
    gets wrong check digits ('00'); every 211th has no start date.
    """
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    # branch n = n-th order of the customer, numbered without one task per customer
    o = sequence.number_within(o, "o_custkey", "o_orderkey", out="_rn")
    k = F.col("o_orderkey")
    o = o.withColumn(
        "_base12",
        F.concat(F.lpad(_s(F.col("o_custkey")), 8, "0"), F.lpad(_s(F.col("_rn")), 4, "0")),
    )
    ymd = _ymd("o_orderdate")
    sec = (
        F.when(
            k % 3 == 0,
            F.concat(activity_code((k * 11) % 200), F.lit(","), activity_code((k * 13) % 200)),
        ).when(k % 3 == 1, activity_code((k * 11) % 200))
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "08")
        .when(F.col("o_orderstatus") == "O", "02")
        .when(F.col("o_orderstatus") == "P", "04")
    )
    cols = {
        "cnpj_basico": F.lpad(_s(F.col("o_custkey")), 8, "0"),
        "cnpj_ordem": F.lpad(_s(F.col("_rn")), 4, "0"),
        "cnpj_dv": F.when(k % 97 == 0, F.lit("00")).otherwise(ids.check_digits("_base12")),
        "matriz_filial": F.when(F.col("_rn") == 1, "1").otherwise("2"),
        "nome_fantasia": F.when(
            k % 5 == 0, F.concat(F.lit("LOJA "), F.upper(F.substring("o_orderpriority", 3, 100)))
        ),
        "situacao_cadastral": status,
        "data_situacao_cadastral": _s(ymd.cast("int") + (k % 4) * 10000),
        "motivo_situacao_cadastral": F.lpad(_s(k % 5), 2, "0"),
        "nome_cidade_exterior": _null(),
        "pais": _null(),
        "data_inicio_atividades": F.when(k % 211 == 0, F.lit("")).otherwise(ymd),
        "cnae_fiscal": activity_code((k * 7) % 200),
        "cnae_fiscal_secundaria": sec,
        "tipo_logradouro": F.lit("RUA"),
        "logradouro": F.lit("PRINCIPAL"),
        "numero": _s(k % 1000),
        "complemento": _null(),
        "bairro": F.lit("CENTRO"),
        "cep": F.lpad(_s((k * 31) % 5000), 8, "0"),
        "uf": F.concat(F.lit("U"), _s((k % 25) % 5)),
        "municipio": F.lpad(_s(k % 25), 4, "0"),
    }
    return o.select(*[cols[c].alias(c) if c in cols else _null().alias(c) for c in ESTABLISHMENT_COLUMNS])


def raw_partners(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    firm = F.col("l_linenumber") % 3 == 0
    # the orders are hashed, so that the line items, many times as many, are not sorted
    out = li.join(o.hint("shuffle_hash"), "l_orderkey", "inner").select(
        F.lpad(_s(F.col("o_custkey")), 8, "0").alias("cnpj_basico"),
        F.when(firm, "1").otherwise("2").alias("identificador_de_socio"),
        F.concat(F.lit("SOCIO "), _s(F.col("l_suppkey"))).alias("nome_socio"),
        F.when(firm, F.lpad(_s(F.col("l_partkey")), 8, "0"))
        .otherwise(F.concat(F.lit("***"), F.lpad(_s(F.col("l_partkey")), 6, "0"), F.lit("**")))
        .alias("cnpj_cpf_socio"),
        _s(F.lit(49) + F.col("l_linenumber") % 5).alias("qualificacao_socio"),
        _ymd("l_shipdate").alias("data_entrada_sociedade"),
    )
    return _conform(out, PARTNER_COLUMNS)


def raw_simples(customer: DataFrame) -> DataFrame:
    # companies of one market segment never opted in: they have no simples row
    c = customer.select("c_custkey", "c_mktsegment").where(F.col("c_mktsegment") != "HOUSEHOLD")
    out = c.select(
        F.lpad(_s(F.col("c_custkey")), 8, "0").alias("cnpj_basico"),
        F.when(F.col("c_custkey") % 4 == 0, "S").otherwise("N").alias("opcao_simples"),
        F.when(F.col("c_custkey") % 10 == 0, "s").otherwise("N").alias("opcao_mei"),
    )
    return _conform(out, SIMPLES_COLUMNS)


def code_tables(part: DataFrame, nation: DataFrame, region: DataFrame) -> dict[str, DataFrame]:
    # One code per remainder of all part keys, described by the least type of its parts.
    # Codes from ORPHAN_FROM on are left without a description, for the orphan check.
    k = F.col("k")
    kinds = part.select((F.col("p_partkey") % 200).alias("k"), "p_type").groupBy("k").agg(F.min("p_type").alias("p_type"))
    cnae = kinds.where(k < ORPHAN_FROM).select(
        activity_code(k).alias("codigo"),
        F.concat(F.col("p_type"), F.lit(" "), _s(k)).alias("descricao"),
    )
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    return {
        "cnae": cnae,
        "municipio": nation.select(
            F.lpad(_s(n), 4, "0").alias("codigo"), F.col("n_name").alias("descricao")
        ),
        "natureza_juridica": nation.select(
            _s(F.lit(1000) + n).alias("codigo"),
            F.concat(F.lit("NATUREZA "), F.col("n_name")).alias("descricao"),
        ),
        "pais": nation.select(
            F.lpad(_s(n), 3, "0").alias("codigo"), F.col("n_name").alias("descricao")
        ),
        "motivo": region.select(
            F.lpad(_s(r), 2, "0").alias("codigo"),
            F.concat(F.lit("MOTIVO "), F.col("r_name")).alias("descricao"),
        ),
        "qualificacao_socio": region.select(
            _s(F.lit(49) + r).alias("codigo"),
            F.concat(F.lit("QUALIFICACAO "), F.col("r_name")).alias("descricao"),
        ),
    }


def activity_classes(cnae: DataFrame) -> DataFrame:
    """Distinct classes of the activity table with group, division and section."""
    c = cnae.select(F.substring("codigo", 1, 5).alias("classe")).distinct()
    div = F.substring("classe", 1, 2)
    sec = F.expr("chr(65 + CAST(substring(classe, 1, 2) AS INT) % 21)")
    return c.select(
        "classe",
        F.concat(F.lit("CLASSE "), F.col("classe")).alias("classe_desc"),
        F.substring("classe", 1, 3).alias("grupo"),
        F.concat(F.lit("GRUPO "), F.substring("classe", 1, 3)).alias("grupo_desc"),
        div.alias("divisao"),
        F.concat(F.lit("DIVISAO "), div).alias("divisao_desc"),
        sec.alias("secao"),
        F.concat(F.lit("SECAO "), sec).alias("secao_desc"),
    )


def municipality_dim(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Municipality dimension; nation 24 is left uncovered on purpose."""
    n = F.col("n_nationkey")
    return (
        nation.where(n != 24)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "inner")
        .select(
            F.lpad(_s(n), 4, "0").alias("codigo_rf"),
            _s(F.lit(3500000) + n).alias("codigo_ibge"),
            F.col("n_name").alias("nome"),
            F.concat(F.lit("U"), _s(n % 5)).alias("uf"),
            F.col("r_name").alias("regiao"),
            (n % 5 == 0).alias("capital"),
            (n - 30).cast("double").alias("latitude"),
            (n - 60).cast("double").alias("longitude"),
        )
    )


def inputs(spark: SparkSession, sf_dir: str) -> dict:
    """Keyword arguments of the model builders: raw tables, code tables, dimensions."""
    t = {n: read_table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "part", "nation", "region")}
    codes = code_tables(t["part"], t["nation"], t["region"])
    raw = {
        "empresas": raw_companies(t["customer"], t["part"]),
        "estabelecimento": raw_establishments(t["orders"]),
        "socios_original": raw_partners(t["lineitem"], t["orders"]),
        "simples": raw_simples(t["customer"]),
    }
    return {
        "raw": raw,
        "codes": codes,
        "data_ref": STARMAP_DATE,
        "municipio_ibge": municipality_dim(t["nation"], t["region"]),
        "cnae_classes": activity_classes(codes["cnae"]),
    }


def load(spark: SparkSession, sf_dir: str, *, ano_mes: str = STARMAP_MONTH) -> Registry:
    """The derived registry over one scale directory (lazy)."""
    a = inputs(spark, sf_dir)
    return model.build_registry(a.pop("raw"), a.pop("codes"), ano_mes=ano_mes, **a)
