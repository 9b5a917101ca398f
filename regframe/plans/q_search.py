"""Queries of the filtered search, ranked and fuzzy text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from regframe.functions.text import tokens_sql
from regframe.operators import search as S
from regframe.operators import textsearch
from regframe.plans.catalog import query
from regframe.plans.oracle_registry import columns, look
from regframe.sources.starmap import read_table


#: Columns of a search result (a ranked one has the score after ``cnae_origem``).
_OUT = (
    "cnpj, razao_social, nome_fantasia, uf, municipio, municipio_nome, cep, municipio_ibge, cnae_secao, cnae_divisao, "
    "latitude, longitude, geo_precisao, cnae_fiscal, cnae_descricao, cnae_fiscal_secundaria, cnae_origem, "
    "situacao_cadastral, matriz_filial, porte_empresa, capital_social, data_inicio_atividades"
)


def _search_sql(only: list[str], *, origin: str = "NULL", limit: int = 1000, ranked: bool = False, dims: bool = True) -> str:
    """Establishments with their company, filtered, then decoded column by column.

    Predicates see the plain columns of both tables (``empresas`` joined by its key).
    Without ``dims`` the optional dimensions are absent: their columns are NULL.
    """
    where = " AND ".join(only) or "true"
    extra = {
        "municipio_ibge": look("municipio_ibge", "codigo_ibge", "codigo_rf", "b.municipio"),
        "latitude": look("municipio_ibge", "latitude", "codigo_rf", "b.municipio"),
        "longitude": look("municipio_ibge", "longitude", "codigo_rf", "b.municipio"),
        "cnae_secao": look("cnae_hierarquia", "secao", "cnae", "b.cnae_fiscal"),
        "cnae_divisao": look("cnae_hierarquia", "divisao", "cnae", "b.cnae_fiscal"),
    }
    decoded = columns(
        municipio_nome=look("municipio", "descricao", "codigo", "b.municipio"),
        cnae_descricao=look("cnae", "descricao", "codigo", "b.cnae_fiscal"),
        cnae_origem=origin,
        **(extra if dims else dict.fromkeys(extra, "NULL")),
    )
    ranks = "JOIN fts USING (cnpj_basico)" if ranked else ""
    score, order = ("round(score, 6) AS _fts_score, ", "score DESC, cnpj") if ranked else ("", "cnpj")
    return f"""SELECT {score}{_OUT} FROM (
      SELECT *, if(latitude IS NULL, NULL, 'municipio') AS geo_precisao FROM (
        SELECT b.*, {decoded} FROM (
          SELECT * FROM estabelecimento JOIN empresas USING (cnpj_basico) {ranks} WHERE {where}) AS b))
    ORDER BY {order} LIMIT {limit}"""


def _has_code(code: str, kind: str = "%") -> str:
    return f"cnpj IN (SELECT cnpj FROM estabelecimento_cnae WHERE cnae = '{code}' AND tipo LIKE '{kind}')"


def _any_origin(code: str) -> str:
    return f"if(cnae_fiscal = '{code}', 'principal', if({_has_code(code, 'secundario')}, 'secundario', NULL))"


def _flag(column: str, on: bool) -> str:
    """The simples flag of the company is (or is not) set; no row is not set."""
    of = f"(SELECT upper(any_value(x.{column})) FROM simples AS x WHERE x.cnpj_basico = estabelecimento.cnpj_basico)"
    return f"{of} IS {'NOT ' if on else ''}DISTINCT FROM 'S'"


def _in_level(level: str, value: str) -> str:
    return f"cnae_fiscal IN (SELECT cnae FROM cnae_hierarquia WHERE {level} = '{value}')"


def _either_name(text: str, test: str = "{} ILIKE '%{}%'") -> str:
    return "(" + " OR ".join(test.format(c, text) for c in ("razao_social", "nome_fantasia")) + ")"


_CODE = "0189001"  # an activity code present as principal and as secondary


def _run(reg, **kw):
    return S.search(reg, S.SearchSpec(**kw))


@query("search_cnae_any", _search_sql(["uf = 'U3'", _has_code(_CODE)], origin=_any_origin(_CODE)))
def search_cnae_any(reg, spark, sf_dir):
    """State + activity as principal or secondary (bridge), with the origin label."""
    return _run(reg, uf="u3", cnae="01.890-01")


@query("search_cnae_main", _search_sql([f"cnae_fiscal = '{_CODE}'"], origin="'principal'"))
def search_cnae_main(reg, spark, sf_dir):
    return _run(reg, cnae=_CODE, incluir_cnae_secundario=False)


_LISTED = f"list_contains(string_split(coalesce(cnae_fiscal_secundaria, ''), ','), '{_CODE}')"


@query(
    "search_without_bridge",
    _search_sql(
        ["uf = 'U3'", f"(cnae_fiscal = '{_CODE}' OR {_LISTED})"],
        origin=f"if(cnae_fiscal = '{_CODE}', 'principal', if({_LISTED}, 'secundario', NULL))",
    ),
)
def search_without_bridge(reg, spark, sf_dir):
    """The same search over a base without the activity bridge: the list column decides."""
    return _run(reg.with_frames(estabelecimento_cnae=None), uf="u3", cnae=_CODE)


@query("search_without_dimensions", _search_sql(["situacao_cadastral = '08'"], dims=False))
def search_without_dimensions(reg, spark, sf_dir):
    """A base without the optional dimensions: their columns are there, and NULL."""
    return _run(reg.with_frames(municipio_ibge=None, cnae_hierarquia=None, cep_geo=None), situacao="08")


@query("search_section", _search_sql([_in_level("secao", "J"), "situacao_cadastral = '02'"]))
def search_section(reg, spark, sf_dir):
    return _run(reg, cnae_secao=" j", situacao="02")


@query("search_division", _search_sql([_in_level("divisao", "04")]))
def search_division(reg, spark, sf_dir):
    return _run(reg, cnae_divisao="4")


@query(
    "search_municipality_code",
    _search_sql(
        ["municipio IN (SELECT codigo_rf FROM municipio_ibge WHERE codigo_ibge = '3500011')", "matriz_filial = '1'"]
    ),
)
def search_municipality_code(reg, spark, sf_dir):
    return _run(reg, municipio_ibge="3500011", matriz_filial="1")


@query(
    "search_municipality_name",
    _search_sql(["municipio IN (SELECT codigo FROM municipio WHERE descricao ILIKE '%tion_1%')", "municipio = '0012'"]),
)
def search_municipality_name(reg, spark, sf_dir):
    """Name substring (case-insensitive) together with an internal code."""
    return _run(reg, municipio_nome="TION_1", municipio="0012")


@query("search_size_capital", _search_sql(["porte_empresa = '03'", "capital_social BETWEEN 1000.5 AND 5000"]))
def search_size_capital(reg, spark, sf_dir):
    return _run(reg, porte="03", capital_min=1000.5, capital_max=5000)


@query("search_mei_true", _search_sql([_flag("opcao_mei", True), _flag("opcao_simples", True)]))
def search_mei_true(reg, spark, sf_dir):
    return _run(reg, mei=True, simples=True)


@query(
    "search_mei_false",
    _search_sql([_flag("opcao_mei", False), "uf = 'U4'", _flag("opcao_simples", False)]),
)
def search_mei_false(reg, spark, sf_dir):
    return _run(reg, mei=False, simples=False, uf="U4")


@query("search_dates", _search_sql(["data_inicio_atividades BETWEEN '19960101' AND '19960331'"]))
def search_dates(reg, spark, sf_dir):
    return _run(reg, data_inicio_de="1996-01-01", data_inicio_ate="1996-03-31")


@query("search_substring", _search_sql([_either_name("ring_f")]))
def search_substring(reg, spark, sf_dir):
    """Substring on company or trade name; the caller's ``_`` is a wildcard."""
    return _run(reg, q="RING_F", modo="substring")


@query("search_trade_name", _search_sql([_either_name("loja urg"), "situacao_cadastral = '04'"]))
def search_trade_name(reg, spark, sf_dir):
    return _run(reg, q="loja URG", situacao="04", modo="substring")


_FUZZY_Q = "blue bolts household"


@query(
    "fuzzy_names",
    _search_sql(
        ["(" + _either_name(_FUZZY_Q) + " OR "
         + _either_name(_FUZZY_Q, "jaro_winkler_similarity(lower(coalesce({}, '')), '{}') >= 0.85") + ")"],
        limit=10000,
    ),
)
def fuzzy_names(reg, spark, sf_dir):
    """Jaro-Winkler >= 0.85 on either name, or substring; every company considered."""
    return _run(reg, q=_FUZZY_Q, fuzzy=True, limit=10000)


# --- BM25 -------------------------------------------------------------------


def _bm25_sql(table: str, key: str, text: str, q: str) -> list[tuple[str, str]]:
    from regframe.functions.text import py_tokens

    terms = ", ".join(f"'{t}'" for t in sorted(set(py_tokens(q))))
    return [
        ("bm_docs", f"SELECT {key} AS k, {tokens_sql(text)} AS toks FROM {table}"),
        ("bm_stats", "SELECT count(*) AS n_docs, CAST(avg(len(toks)) AS DOUBLE) AS avgdl FROM bm_docs"),
        ("bm_post", "SELECT t AS term, k, len(toks) AS len, count(*) AS tf "
                    "FROM bm_docs, UNNEST(toks) AS u(t) GROUP BY ALL"),
        ("bm_terms", "SELECT term, count(*) AS df FROM bm_post GROUP BY term"),
        ("bm_scores", f"""SELECT p.k, sum(log10((s.n_docs - t.df + 0.5) / (t.df + 0.5) + 1)
                    * p.tf * (1.2 + 1) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.len / s.avgdl))) AS score
                 FROM bm_post p JOIN bm_terms t ON t.term = p.term, bm_stats s
                 WHERE p.term IN ({terms}) GROUP BY p.k"""),
    ]


_NAMES_Q = "Red Widget automobile ring"
_DOCS_Q = "the ouè qui eau edonre würde muy"


@query(
    "bm25_names",
    _search_sql([], ranked=True),
    extra_ctes=_bm25_sql("empresas", "cnpj_basico", "razao_social", _NAMES_Q)
    + [("fts", "SELECT k AS cnpj_basico, score FROM bm_scores")],
)
def bm25_names(reg, spark, sf_dir):
    """Ranked search over company names (index built over all companies), joined
    to establishments after scoring; score rounded to 6 decimals for the check."""
    idx = textsearch.build_index(reg["empresas"], "cnpj_basico", "razao_social")
    out = S.search(reg, S.SearchSpec(q=_NAMES_Q, limit=None), index=idx)
    out = out.withColumn("_fts_score", F.round("_fts_score", 6))
    return out.orderBy(F.desc_nulls_last("_fts_score"), "cnpj").limit(1000)


@query(
    "bm25_documents",
    "SELECT k AS doc_id, round(score, 6) AS score FROM bm_scores "
    "ORDER BY round(score, 6) DESC, doc_id LIMIT 1000",
    extra_ctes=_bm25_sql("documents", "doc_id", "text", _DOCS_Q),
)
def bm25_documents(reg, spark, sf_dir):
    """Top 1000 documents by BM25 over whole texts of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    idx = textsearch.build_index(docs, "doc_id", "text")
    s = textsearch.scores(idx, _DOCS_Q).select("doc_id", F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(1000)
