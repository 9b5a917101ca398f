"""Filtered establishment search (all arguments optional, AND-ed).

One lazy plan (but for a fuzzy name query, which first scores the few names that a
native bound lets through). Every predicate comes
before the join of the two big tables: establishment predicates reach the Parquet
scan, dimension predicates (codes, levels, municipality names) are semi joins to
small frames, simples flags are semi or anti joins on the company key, and company
predicates are on the company side. A name query splits into two filtered joins: the
companies whose name matches with their establishments, and the establishments whose
trade name matches with the other companies.

With a limit, the first keys are found on narrow frames (key, company key and what
the query reads); only those rows, at most the clamp, are fetched in full and decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regframe.bundle import Registry
from regframe.functions.ids import py_digits
from regframe.functions.text import like_contains
from regframe.operators import filters, geo, textsearch
from regframe.schemas import DEFAULT_QUERY_LIMIT, MAX_QUERY_LIMIT
from regframe.session import written

OUTPUT_COLUMNS = [
    "cnpj",
    "razao_social",
    "nome_fantasia",
    "uf",
    "municipio",
    "municipio_nome",
    "cep",
    *geo.EXTRA_COLUMNS,
    "cnae_fiscal",
    "cnae_descricao",
    "cnae_fiscal_secundaria",
    "cnae_origem",
    "situacao_cadastral",
    "matriz_filial",
    "porte_empresa",
    "capital_social",
    "data_inicio_atividades",
]


@dataclass
class SearchSpec:
    uf: str | None = None
    cnae: str | None = None
    incluir_cnae_secundario: bool = True
    municipio: str | None = None
    municipio_nome: str | None = None
    municipio_ibge: str | None = None
    cnae_secao: str | None = None
    cnae_divisao: str | None = None
    q: str | None = None
    situacao: str | None = None
    porte: str | None = None
    matriz_filial: str | None = None
    mei: bool | None = None
    simples: bool | None = None
    capital_min: float | None = None
    capital_max: float | None = None
    data_inicio_de: str | None = None
    data_inicio_ate: str | None = None
    fuzzy: bool = False
    # 'auto': ranked when a text index is given and not fuzzy (as the reference),
    # 'substring', 'ranked' or 'fuzzy' to force a mode
    modo: str = "auto"
    limit: int | None = DEFAULT_QUERY_LIMIT


def clamp(limit: int) -> int:
    return max(1, min(int(limit), MAX_QUERY_LIMIT))


def _flag_true(col: str):
    return F.upper(F.coalesce(F.col(col), F.lit(""))) == "S"


def search(
    reg: Registry,
    spec: SearchSpec,
    *,
    index: textsearch.BM25Index | None = None,
) -> DataFrame:
    """Establishments matching ``spec``; 22 columns (23 with ``_fts_score``).

    Ordered by key (by score then key in ranked mode) so a limit is
    deterministic. ``spec.limit=None`` lifts the limit (exports).
    """
    mode = spec.modo
    if mode == "auto":
        mode = "fuzzy" if spec.fuzzy else ("ranked" if index is not None else "substring")
    est = reg["estabelecimento"]
    code = py_digits(spec.cnae) if spec.cnae else ""

    # establishment-only predicates (pushed to the scan)
    if spec.uf:
        est = est.where(F.col("uf") == spec.uf.upper())
    if code and not spec.incluir_cnae_secundario:
        est = est.where(F.col("cnae_fiscal") == code)
    if spec.municipio:
        m = spec.municipio
        if m.isdigit():
            est = est.where(F.col("municipio") == m)
    if spec.situacao:
        est = est.where(F.col("situacao_cadastral") == spec.situacao)
    if spec.matriz_filial:
        est = est.where(F.col("matriz_filial") == spec.matriz_filial)
    if spec.data_inicio_de:
        est = est.where(F.col("data_inicio_atividades") >= py_digits(spec.data_inicio_de))
    if spec.data_inicio_ate:
        est = est.where(F.col("data_inicio_atividades") <= py_digits(spec.data_inicio_ate))

    # activity with secondaries: semi join to the bridge (or the list fallback)
    if code and spec.incluir_cnae_secundario:
        if reg.has("estabelecimento_cnae"):
            br = reg["estabelecimento_cnae"].where(F.col("cnae") == code).select("cnpj")
            est = est.join(br, "cnpj", "left_semi")
            origin = F.when(F.col("cnae_fiscal") == code, "principal").otherwise("secundario")
        else:
            listed = F.array_contains(
                F.split(F.coalesce(F.col("cnae_fiscal_secundaria"), F.lit("")), ","), code
            )
            est = est.where((F.col("cnae_fiscal") == code) | listed)
            origin = F.when(F.col("cnae_fiscal") == code, "principal").when(listed, "secundario")
    elif code:
        origin = F.lit("principal")
    else:
        origin = F.lit(None).cast("string")

    # dimension predicates as semi joins
    if spec.municipio_ibge:
        rf = filters.municipality_codes(reg, spec.municipio_ibge)
        est = est.join(rf, est["municipio"] == rf["codigo_rf"], "left_semi")
    if spec.cnae_secao or spec.cnae_divisao:
        codes = filters.activity_codes(reg, spec.cnae_secao, spec.cnae_divisao)
        est = est.join(codes, est["cnae_fiscal"] == codes["cnae"], "left_semi")

    # municipality names and simples flags, before the fact join
    names = [n for n in (None if (spec.municipio or "0").isdigit() else spec.municipio, spec.municipio_nome) if n]
    if names:
        m = reg.dim("municipio")
        for n in names:
            m = m.where(F.col("descricao").ilike(like_contains(n)))
        m = m.select(F.col("codigo").alias("_m"))
        est = est.join(m, est["municipio"] == m["_m"], "left_semi")
    for flag, on in (("opcao_mei", spec.mei), ("opcao_simples", spec.simples)):
        if on is not None:
            holders = reg["simples"].where(_flag_true(flag)).select("cnpj_basico")
            est = est.join(holders, "cnpj_basico", "left_semi" if on else "left_anti")

    # company side, filtered before the fact join
    emp = reg["empresas"].select("cnpj_basico", "razao_social", "porte_empresa", "capital_social")
    if spec.porte:
        emp = emp.where(F.col("porte_empresa") == spec.porte)
    if spec.capital_min is not None:
        emp = emp.where(F.col("capital_social") >= float(spec.capital_min))
    if spec.capital_max is not None:
        emp = emp.where(F.col("capital_social") <= float(spec.capital_max))

    score = None
    if spec.q and mode == "ranked":
        if index is None:
            raise ValueError("ranked search needs a text index")
        emp = emp.join(textsearch.scores(index, spec.q).withColumnRenamed(index.key, "cnpj_basico"), "cnpj_basico")
        score = F.col("score")
    by_name = spec.q if mode in ("substring", "fuzzy") else None
    order = ([] if score is None else [F.desc_nulls_last("score")]) + [F.asc("cnpj")]

    n = None if spec.limit is None else clamp(spec.limit)
    if n is None:
        j = _joined(est, emp, by_name, mode)
    else:
        tall = emp.select("cnpj_basico", *(["razao_social"] if by_name else []), *(["score"] if score is not None else []))
        keys = _joined(est.select("cnpj", "cnpj_basico", *(["nome_fantasia"] if by_name else [])), tall, by_name, mode)
        keys = keys.select("cnpj", *(["score"] if score is not None else [])).orderBy(*order).limit(n)
        # at most the clamp's number of rows travel to the scans
        top = est.join(F.broadcast(keys), "cnpj")
        j = emp.drop("score").join(F.broadcast(top), "cnpj_basico")

    mun = reg.dim("municipio").select(
        F.col("codigo").alias("_m_codigo"), F.col("descricao").alias("municipio_nome")
    )
    j = j.join(mun, j["municipio"] == mun["_m_codigo"], "left")
    j = geo.with_extras(reg, j)
    cn = reg.dim("cnae").select(
        F.col("codigo").alias("_c_codigo"), F.col("descricao").alias("cnae_descricao")
    )
    j = j.join(cn, j["cnae_fiscal"] == cn["_c_codigo"], "left")

    cols = [origin.alias("cnae_origem") if c == "cnae_origem" else F.col(c) for c in OUTPUT_COLUMNS]
    if score is not None:
        cols.insert(OUTPUT_COLUMNS.index("cnae_origem") + 1, score.alias("_fts_score"))
    out = j.select(*cols)
    out = out.orderBy(*([F.desc_nulls_last("_fts_score")] if score is not None else []), F.asc("cnpj"))
    return out if n is None else out.limit(n)


def _joined(est: DataFrame, emp: DataFrame, q: str | None, mode: str) -> DataFrame:
    """Establishments with their company, of those where either name matches ``q``."""
    if not q:
        return est.join(emp, "cnpj_basico")
    alike = _alike(est, emp, q) if mode == "fuzzy" else None
    companies = _name_hits(emp, "razao_social", q, alike)
    others = emp.join(companies.select("cnpj_basico"), "cnpj_basico", "left_anti")
    by_company = est.join(companies, "cnpj_basico")
    return by_company.unionByName(_name_hits(est, "nome_fantasia", q, alike).join(others, "cnpj_basico"))


def _alike(est: DataFrame, emp: DataFrame, q: str) -> DataFrame:
    """``_nm``: every name of either kind that is like ``q``, each scored once and kept as a
    table, so that the joins that follow know how few there are."""
    names = est.select(F.col("nome_fantasia").alias("nome")).unionByName(emp.select(F.col("razao_social").alias("nome")))
    return written(textsearch.fuzzy_name_hits(names, "nome", q), "regframe-names")


def _name_hits(df: DataFrame, col: str, q: str, alike: DataFrame | None) -> DataFrame:
    """Rows whose name contains ``q`` or is one of ``alike``. Rows without a name never
    match, so they do not meet on one join key."""
    contains = textsearch.ilike_any(q, col)
    if alike is None:
        return df.where(contains)
    marked = alike.withColumn("_alike", F.lit(True))
    return df.join(marked, F.lower(F.col(col)) == F.col("_nm"), "left").where(contains | F.col("_alike")).drop("_nm", "_alike")


EXPORT_FORMATS = ("csv", "json", "parquet")


def export(
    df: DataFrame,
    path: str,
    formato: str | None = None,
) -> str:
    """Write a result as CSV with header, JSON lines or Parquet (by argument or suffix)."""
    fmt = formato or path.rsplit(".", 1)[-1].lower()
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {', '.join(EXPORT_FORMATS)}")
    options = {"csv": {"header": True}, "json": {"ignoreNullFields": False}}.get(fmt, {})
    df.write.mode("overwrite").options(**options).format(fmt).save(path)
    return path
