"""Queries of the profile, partner search and list enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from regframe.functions import ids
from regframe.operators import enrich as EN
from regframe.operators import profile as P
from regframe.plans.catalog import query
from regframe.plans.oracle_registry import columns, dv_sql, label, look

_BASE = "00000001"
_FULL = "00000001000136"  # head office of company 00000001

_GEO = ("latitude", "longitude")


def _places(est: str) -> dict[str, str]:
    """Decoded place and activity of an establishment, one small lookup a column."""
    city, code = f"{est}.municipio", f"{est}.cnae_fiscal"
    return {
        "cnae_descricao": look("cnae", "descricao", "codigo", code),
        "municipio_nome": look("municipio", "descricao", "codigo", city),
        "municipio_ibge": look("municipio_ibge", "codigo_ibge", "codigo_rf", city),
        "cnae_secao": look("cnae_hierarquia", "secao", "cnae", code),
        "cnae_divisao": look("cnae_hierarquia", "divisao", "cnae", code),
        **{c: look("municipio_ibge", c, "codigo_rf", city) for c in _GEO},
    }


_PRECISION = "if(latitude IS NULL, NULL, 'municipio') AS geo_precisao"


def establishments_sql(where: str) -> str:
    found = columns(
        **_places("u"),
        motivo_descricao=look("motivo", "descricao", "codigo", "u.motivo_situacao_cadastral"),
        pais_nome=look("pais", "descricao", "codigo", "u.pais"),
        situacao_cadastral_desc=f"coalesce({label('status', 'u.situacao_cadastral')}, u.situacao_cadastral, '')",
        matriz_filial_desc=f"coalesce({label('branch', 'u.matriz_filial')}, u.matriz_filial, '')",
    )
    return f"SELECT *, {_PRECISION} FROM (SELECT u.*, {found} FROM estabelecimento AS u WHERE {where})"


def _partners(where: str) -> str:
    found = columns(
        qualificacao_desc=look("qualificacao_socio", "descricao", "codigo", "p.qualificacao_socio"),
        qualificacao_representante_desc=look("qualificacao_socio", "descricao", "codigo", "p.qualificacao_representante_legal"),
        pais_nome=look("pais", "descricao", "codigo", "p.pais"),
    )
    return f"SELECT p.*, {found} FROM socios AS p WHERE {where}"


_COMPANY_SQL = "SELECT c.*, " + columns(
    natureza_juridica_desc=look("natureza_juridica", "descricao", "codigo", "c.natureza_juridica"),
    qualificacao_responsavel_desc=look("qualificacao_socio", "descricao", "codigo", "c.qualificacao_responsavel"),
    porte_empresa_desc=f"coalesce({label('size', 'c.porte_empresa')}, c.porte_empresa)",
) + f" FROM empresas AS c WHERE c.cnpj_basico = '{_BASE}'"


@query("profile_company", _COMPANY_SQL)
def profile_company(reg, spark, sf_dir):
    """Company part of the profile of a formatted base key."""
    return P.profile(reg, "00.000.001").empresas


@query("profile_establishments", establishments_sql(f"u.cnpj_basico = '{_BASE}'"))
def profileestablishments_sql(reg, spark, sf_dir):
    """All establishments of a base key, head office first, fully decoded."""
    return P.profile(reg, _BASE).estabelecimentos


@query("profile_partners", _partners(f"p.cnpj = '{_FULL}'"))
def profile_partners(reg, spark, sf_dir):
    """Partners registered under one full key."""
    return P.profile(reg, "00.000.001/0001-36").socios


@query("profile_simples", f"SELECT * FROM simples WHERE cnpj_basico = '00000010'")
def profile_simples(reg, spark, sf_dir):
    return P.profile(reg, "00000010").simples


@query(
    "profile_bulk_establishments",
    establishments_sql("u.cnpj IN (SELECT cnpj FROM cnpj_base2matriz)"),
)
def profile_bulkestablishments_sql(reg, spark, sf_dir):
    """Bulk profile over a frame of keys: every head office, decoded."""
    keys = reg["cnpj_base2matriz"].select(F.col("cnpj").alias("chave"))
    return P.profiles(reg, keys)["estabelecimentos"]


#: Output of the partner search; also its order, NULLs first.
_PARTNER_OUT = (
    "cnpj, cnpj_basico, nome_socio, cnpj_cpf_socio, identificador_de_socio, qualificacao_socio, "
    "qualificacao_desc, data_entrada_sociedade, razao_social, uf, situacao_cadastral"
)


def _partner_search(where: str, limit: int = 1000) -> str:
    found = columns(
        qualificacao_desc=look("qualificacao_socio", "descricao", "codigo", "p.qualificacao_socio"),
        razao_social=look("empresas", "razao_social", "cnpj_basico", "p.cnpj_basico"),
        uf=look("estabelecimento", "uf", "cnpj", "p.cnpj"),
        situacao_cadastral=look("estabelecimento", "situacao_cadastral", "cnpj", "p.cnpj"),
    )
    order = ", ".join(f"{c} NULLS FIRST" for c in _PARTNER_OUT.split(", "))
    return f"SELECT {_PARTNER_OUT} FROM (SELECT p.*, {found} FROM socios AS p WHERE {where}) ORDER BY {order} LIMIT {limit}"


def _document(cleaned: str) -> str:
    """The partner's document equals or contains the cleaned text."""
    return (
        f"(contains(lower(p.cnpj_cpf_socio), lower('{cleaned}')) OR "
        f"regexp_replace(upper(coalesce(p.cnpj_cpf_socio, '')), '[^0-9A-Z]', '', 'g') = '{cleaned}')"
    )


@query("partner_by_name", _partner_search("contains(lower(p.nome_socio), 'socio 7')"))
def partner_by_name(reg, spark, sf_dir):
    return P.partner_search(reg, nome="socio 7")


@query("partner_by_document", _partner_search(_document("000123"), 10000))
def partner_by_document(reg, spark, sf_dir):
    """Masked person documents and company keys containing the cleaned digits."""
    return P.partner_search(reg, documento="000.123", limit=10000)


@query(
    "partner_company_document",
    _partner_search("contains(lower(p.nome_socio), 'socio 1') AND " + _document("00000173000100")),
)
def partner_company_document(reg, spark, sf_dir):
    """A company partner found by its formatted head-office key, and a name."""
    return P.partner_search(reg, nome="SOCIO 1", documento="00.000.173/0001-00")


@query("partner_empty_document", _partner_search("contains(lower(p.nome_socio), 'socio 42') AND " + _document("")))
def partner_empty_document(reg, spark, sf_dir):
    """A document that cleans to nothing matches every row (published behaviour)."""
    return P.partner_search(reg, nome="socio 42", documento="--")


# --- enrichment ---------------------------------------------------------------


def _entries(reg):
    est = reg["estabelecimento"]
    pos = F.substring("cnpj", 1, 12).cast("long")
    m = pos % 7
    entrada = (
        F.when(m == 0, ids.format_key("cnpj"))
        .when(m == 1, F.col("cnpj_basico"))
        .when(m == 2, F.regexp_replace("cnpj", "^0+", ""))
        .when(m == 3, F.concat(F.lit("xx"), F.substring("cnpj", 1, 5)))
        .when(m == 4, F.concat(F.substring("cnpj", 1, 12), F.lit("99")))
        .when(m == 6, F.concat(F.lit(" "), F.regexp_replace("cnpj_basico", "^0+", ""), F.lit(" ")))
    )
    return est.select(pos.alias("pos"), entrada.alias("entrada"))


_INVALID = "formato inválido (esperado 8 ou 14 posições)"

_ENT_CTES = [
    (
        # the list: each establishment key rewritten by the remainder of its number
        "lista",
        """SELECT pos, trim(coalesce([
               concat_ws('/', concat_ws('.', cnpj[1:2], cnpj[3:5], cnpj[6:8]), cnpj[9:12] || '-' || cnpj[13:14]),
               cnpj_basico, ltrim(cnpj, '0'), 'xx' || cnpj[1:5], cnpj[1:12] || '99', NULL, ltrim(cnpj_basico, '0')
             ][pos % 7 + 1], '')) AS entrada
           FROM (SELECT CAST(cnpj[1:12] AS BIGINT) AS pos, cnpj, cnpj_basico FROM estabelecimento)""",
    ),
    (
        # what a list entry may be written as, and the establishment it stands for
        "nomes",
        """SELECT cnpj AS nome, cnpj AS alvo FROM estabelecimento
           UNION ALL BY NAME SELECT cnpj_basico AS nome, cnpj AS alvo FROM cnpj_base2matriz""",
    ),
    (
        "chaves",
        """SELECT pos, entrada, if(regexp_full_match(cheia, '[0-9A-Z]{8}|[0-9A-Z]{12}[0-9]{2}'), cheia, NULL) AS chave
           FROM (SELECT *, if(regexp_full_match(limpa, '[0-9]{1,13}'),
                              lpad(limpa, if(length(limpa) > 8, 14, 8), '0'), limpa) AS cheia
                 FROM (SELECT *, regexp_replace(upper(entrada), '[^0-9A-Z]', '', 'g') AS limpa FROM lista))""",
    ),
    (
        "en_out",
        f"SELECT *, {_PRECISION} FROM (SELECT pos, entrada, chave AS cnpj_normalizado, u.cnpj IS NOT NULL AS encontrado, u.cnpj, "
        + ", ".join(f"{look('empresas', c, 'cnpj_basico', 'u.cnpj_basico')} AS {c}" for c in
                    ("razao_social", "natureza_juridica", "porte_empresa", "capital_social"))
        + ", " + ", ".join(f"u.{c}" for c in (
            "nome_fantasia", "matriz_filial", "situacao_cadastral", "data_situacao_cadastral", "data_inicio_atividades",
            "cnae_fiscal", "cnae_fiscal_secundaria", "uf", "municipio", "cep", "tipo_logradouro", "logradouro", "numero",
            "complemento", "bairro"))
        + ", " + columns(
            **_places("u"),
            natureza_juridica_desc=look(
                "natureza_juridica", "descricao", "codigo", look("empresas", "natureza_juridica", "cnpj_basico", "u.cnpj_basico")
            ),
            **{c: look("simples", c, "cnpj_basico", "u.cnpj_basico") for c in ("opcao_simples", "opcao_mei")},
            erro=f"if(chave IS NULL, '{_INVALID}', NULL)",
            dv_valido=f"if(length(chave) = 14, chave[13:14] = {dv_sql('chave')}, NULL)",
            situacao_cadastral_desc=f"coalesce({label('status', 'u.situacao_cadastral')}, nullif(u.situacao_cadastral, ''))",
        )
        + " FROM chaves LEFT JOIN nomes ON nome = chave LEFT JOIN estabelecimento AS u ON u.cnpj = alvo)",
    ),
]


@query("enrich_list", "SELECT * FROM en_out ORDER BY pos", extra_ctes=_ENT_CTES)
def enrich_list(reg, spark, sf_dir):
    """Every establishment key, rewritten seven ways (formatted, base, lost zeros,
    invalid, wrong digits, NULL, padded base), enriched in input order."""
    return EN.enrich(reg, _entries(reg))


@query(
    "enrich_found_ratio",
    """SELECT CAST(sum(CAST(encontrado AS INT)) AS BIGINT) AS encontrados, count(encontrado) AS total,
              round(avg(CAST(encontrado AS INT)), 4) AS taxa FROM en_out""",
    extra_ctes=_ENT_CTES,
)
def enrich_found_ratio(reg, spark, sf_dir):
    return EN.found_ratio(EN.enrich(reg, _entries(reg)))
