"""Company profile (one key) and partner search.

A profile is four lazy DataFrames (company, establishments, partners,
simples) plus key facts computed from the argument. Each frame is a filtered
scan (the key predicate reaches the Parquet reader) joined to broadcast code
dimensions. :func:`profiles` is the bulk form over a DataFrame of keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regframe.bundle import Registry
from regframe.functions import ids
from regframe.functions.labels import branch_label, size_label, status_label
from regframe.functions.text import like_contains
from regframe.operators import geo
from regframe.schemas import DEFAULT_QUERY_LIMIT, MAX_QUERY_LIMIT
from regframe.session import cut_lineage


def _decode(df: DataFrame, dim: DataFrame, col: str, out: str) -> DataFrame:
    d = dim.select(F.col("codigo").alias(f"_{out}_k"), F.col("descricao").alias(out))
    return df.join(d, df[col] == d[f"_{out}_k"], "left").drop(f"_{out}_k")


def companies_decoded(reg: Registry, emp: DataFrame) -> DataFrame:
    e = _decode(emp, reg.dim("natureza_juridica"), "natureza_juridica", "natureza_juridica_desc")
    e = _decode(e, reg.dim("qualificacao_socio"), "qualificacao_responsavel",
                "qualificacao_responsavel_desc")
    return e.withColumn("porte_empresa_desc", size_label("porte_empresa"))


def establishments_decoded(reg: Registry, est: DataFrame) -> DataFrame:
    base_cols = est.columns
    e = _decode(est, reg.dim("cnae"), "cnae_fiscal", "cnae_descricao")
    e = _decode(e, reg.dim("municipio"), "municipio", "municipio_nome")
    e = geo.with_extras(reg, e)
    e = _decode(e, reg.dim("motivo"), "motivo_situacao_cadastral", "motivo_descricao")
    e = _decode(e, reg.dim("pais"), "pais", "pais_nome")
    return e.select(
        *base_cols,
        "cnae_descricao",
        "municipio_nome",
        *geo.EXTRA_COLUMNS,
        "motivo_descricao",
        "pais_nome",
        status_label("situacao_cadastral").alias("situacao_cadastral_desc"),
        branch_label("matriz_filial").alias("matriz_filial_desc"),
    )


def partners_decoded(reg: Registry, soc: DataFrame) -> DataFrame:
    base_cols = soc.columns
    s = _decode(soc, reg.dim("qualificacao_socio"), "qualificacao_socio", "qualificacao_desc")
    s = _decode(s, reg.dim("qualificacao_socio"), "qualificacao_representante_legal",
                "qualificacao_representante_desc")
    s = _decode(s, reg.dim("pais"), "pais", "pais_nome")
    return s.select(*base_cols, "qualificacao_desc", "qualificacao_representante_desc", "pais_nome")


@dataclass
class Profile:
    cnpj_consultado: str
    cnpj_formatado: str
    alfanumerico: bool
    dv_valido: bool | None
    dv_esperado: str | None
    empresas: DataFrame
    estabelecimentos: DataFrame
    socios: DataFrame
    simples: DataFrame


def profile(reg: Registry, key: str) -> Profile:
    """Profile of a base (8) or full (14) key; invalid text raises ValueError.

    14 positions: that establishment and the partners registered under it;
    8 positions: all establishments (head office first) and partners by base.
    Wrong check digits still return what is stored under the key.
    """
    k = ids.py_normalize_key(key)
    base = k[:8]
    emp = companies_decoded(reg, reg.of_company("empresas", base))
    est = reg.of_company("estabelecimento", base)
    soc = reg.of_company("socios", base)
    if len(k) == 14:
        est = establishments_decoded(reg, est.where(F.col("cnpj") == k))
        soc = partners_decoded(reg, soc.where(F.col("cnpj") == k))
    else:
        est = establishments_decoded(reg, est).orderBy("matriz_filial", "cnpj")
        soc = partners_decoded(reg, soc)
    si = reg.of_company("simples", base)
    valid = expected = None
    if len(k) == 14:
        exp = ids.py_check_digits(k[:12])
        valid = exp == k[12:]
        expected = None if valid else exp
    fmt = (
        f"{k[:2]}.{k[2:5]}.{k[5:8]}/{k[8:12]}-{k[12:]}" if len(k) == 14 else f"{k[:2]}.{k[2:5]}.{k[5:8]}"
    )
    return Profile(k, fmt, not k.isdigit(), valid, expected, emp, est, soc, si)


def profiles(reg: Registry, keys: DataFrame, col: str = "chave") -> dict[str, DataFrame]:
    """Bulk profiles: the four frames for every key of a DataFrame (semi joins).

    Full keys select establishments and their partners; base keys select all
    establishments and partners of the company. A full key whose own base key is
    listed too adds nothing, so no establishment or partner comes back twice.
    """
    k = keys.select(ids.normalized_key(col).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    bases = k.select(F.substring("_k", 1, 8).alias("cnpj_basico")).distinct()
    full = k.where(F.length("_k") == 14).select(F.col("_k").alias("cnpj"))
    short = k.where(F.length("_k") == 8).select(F.col("_k").alias("cnpj_basico"))
    full = full.join(short, F.substring(full["cnpj"], 1, 8) == short["cnpj_basico"], "left_anti")
    est = reg["estabelecimento"]
    est_sel = est.join(full, "cnpj", "left_semi").unionByName(
        est.join(short, "cnpj_basico", "left_semi")
    )
    soc = reg["socios"]
    soc_sel = soc.join(full, "cnpj", "left_semi").unionByName(
        soc.join(short, "cnpj_basico", "left_semi")
    )
    return {
        "empresas": companies_decoded(reg, reg["empresas"].join(bases, "cnpj_basico", "left_semi")),
        "estabelecimentos": establishments_decoded(reg, est_sel),
        "socios": partners_decoded(reg, soc_sel),
        "simples": reg["simples"].join(bases, "cnpj_basico", "left_semi"),
    }


PARTNER_COLUMNS_OUT = [
    "cnpj",
    "cnpj_basico",
    "nome_socio",
    "cnpj_cpf_socio",
    "identificador_de_socio",
    "qualificacao_socio",
    "qualificacao_desc",
    "data_entrada_sociedade",
    "razao_social",
    "uf",
    "situacao_cadastral",
]


# the output's partner columns, in output order
_PARTNER_SORT = [
    "cnpj",
    "cnpj_basico",
    "nome_socio",
    "cnpj_cpf_socio",
    "identificador_de_socio",
    "qualificacao_socio",
    "data_entrada_sociedade",
]


def partner_search(
    reg: Registry,
    *,
    nome: str | None = None,
    documento: str | None = None,
    limit: int | None = DEFAULT_QUERY_LIMIT,
) -> DataFrame:
    """Partners by name substring and/or document (cleaned equality or substring).

    Partner predicates are applied to the partner scan before the joins to
    qualification, company and establishment. A document that cleans to ''
    matches every row (NULL documents included), as published.
    """
    if not nome and not documento:
        raise ValueError("give a partner name and/or document")
    s = reg["socios"]
    if nome:
        s = s.where(F.col("nome_socio").ilike(like_contains(nome)))
    if documento:
        doc = ids.py_clean(documento)
        s = s.where((ids.clean("cnpj_cpf_socio") == doc) | F.col("cnpj_cpf_socio").ilike(like_contains(doc)))
    e = reg["empresas"].select(F.col("cnpj_basico").alias("_e_b"), "razao_social")
    est = reg["estabelecimento"].select(F.col("cnpj").alias("_est_cnpj"), "uf", "situacao_cadastral")
    n = None if limit is None else max(1, min(int(limit), MAX_QUERY_LIMIT))
    if n is not None:
        # Every joined column is a function of a partner column (company by
        # base key, establishment by key, label by code), so the order on the
        # partner columns alone already decides the top rows: rows tied on all
        # of them join to the same rows. The top ``n`` partners (a bound set by
        # the clamp) are taken first and the company and establishment tables
        # are reduced to their keys by broadcast semi joins: no shuffle of the
        # big tables, whatever the predicate matches.
        # checkpointed (at most n rows): read three times below, scanned once
        s = cut_lineage(s.orderBy(*[F.asc_nulls_first(c) for c in _PARTNER_SORT]).limit(n))
        e = e.join(F.broadcast(s.select(F.col("cnpj_basico").alias("_e_b"))), "_e_b", "left_semi")
        est = est.join(F.broadcast(s.select(F.col("cnpj").alias("_est_cnpj"))), "_est_cnpj", "left_semi")
    q = reg.dim("qualificacao_socio").select(F.col("codigo").alias("_q"), F.col("descricao").alias("qualificacao_desc"))
    s = s.join(q, s["qualificacao_socio"] == q["_q"], "left")
    s = s.join(e, s["cnpj_basico"] == e["_e_b"], "left")
    s = s.join(est, s["cnpj"] == est["_est_cnpj"], "left")
    out = s.select(*PARTNER_COLUMNS_OUT)
    out = out.orderBy(*[F.asc_nulls_first(c) for c in PARTNER_COLUMNS_OUT])
    if n is not None:
        out = out.limit(n)
    return out
