"""Fixed layouts of the registry dump and code labels.

The column lists below are the positional layout of the public registry
files (no header, ``;`` separated). They are fixed values: the files carry no
names, so the order must be exactly this one.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: positional layout of each raw file kind -----------------
COMPANY_COLUMNS = [
    "cnpj_basico",
    "razao_social",
    "natureza_juridica",
    "qualificacao_responsavel",
    "capital_social_str",
    "porte_empresa",
    "ente_federativo_responsavel",
]

ESTABLISHMENT_COLUMNS = [
    "cnpj_basico",
    "cnpj_ordem",
    "cnpj_dv",
    "matriz_filial",
    "nome_fantasia",
    "situacao_cadastral",
    "data_situacao_cadastral",
    "motivo_situacao_cadastral",
    "nome_cidade_exterior",
    "pais",
    "data_inicio_atividades",
    "cnae_fiscal",
    "cnae_fiscal_secundaria",
    "tipo_logradouro",
    "logradouro",
    "numero",
    "complemento",
    "bairro",
    "cep",
    "uf",
    "municipio",
    "ddd1",
    "telefone1",
    "ddd2",
    "telefone2",
    "ddd_fax",
    "fax",
    "correio_eletronico",
    "situacao_especial",
    "data_situacao_especial",
]

PARTNER_COLUMNS = [
    "cnpj_basico",
    "identificador_de_socio",
    "nome_socio",
    "cnpj_cpf_socio",
    "qualificacao_socio",
    "data_entrada_sociedade",
    "pais",
    "representante_legal",
    "nome_representante",
    "qualificacao_representante_legal",
    "faixa_etaria",
]

SIMPLES_COLUMNS = [
    "cnpj_basico",
    "opcao_simples",
    "data_opcao_simples",
    "data_exclusao_simples",
    "opcao_mei",
    "data_opcao_mei",
    "data_exclusao_mei",
]

CODE_COLUMNS = ["codigo", "descricao"]

# file-name suffix -> code table
CODE_TABLES = [
    (".CNAECSV", "cnae"),
    (".MOTICSV", "motivo"),
    (".MUNICCSV", "municipio"),
    (".NATJUCSV", "natureza_juridica"),
    (".PAISCSV", "pais"),
    (".QUALSCSV", "qualificacao_socio"),
]

# raw kind -> (file glob, columns)
RAW_KINDS = {
    "empresas": ("*.EMPRECSV", COMPANY_COLUMNS),
    "estabelecimento": ("*.ESTABELE", ESTABLISHMENT_COLUMNS),
    "socios_original": ("*.SOCIOCSV", PARTNER_COLUMNS),
    "simples": ("*SIMPLES.CSV*", SIMPLES_COLUMNS),
}

# --- fixed values: code labels ----------------------------------------------
STATUS_LABELS = {
    "01": "Nula",
    "02": "Ativa",
    "03": "Suspensa",
    "04": "Inapta",
    "08": "Baixada",
}

SIZE_LABELS = {
    "00": "Não informado",
    "01": "Microempresa (ME)",
    "03": "Empresa de pequeno porte (EPP)",
    "05": "Demais",
}

BRANCH_LABELS = {"1": "Matriz", "2": "Filial"}

# municipality code exempt from the coverage check (abroad)
ABROAD_MUNICIPALITY = "9707"

# partner resolution switches to head-office keys from this month on
PARTNER_RULE_MONTH = "202608"

# activity hierarchy levels, finest first
ACTIVITY_LEVELS = ("subclasse", "classe", "grupo", "divisao", "secao")

# row limits of interactive queries: default / maximum
DEFAULT_QUERY_LIMIT = 1000
MAX_QUERY_LIMIT = 10000


def text_schema(columns: list[str]) -> T.StructType:
    """All-text schema for a positional file."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


MUNICIPALITY_DIM_SCHEMA = T.StructType(
    [
        T.StructField("codigo_rf", T.StringType()),
        T.StructField("codigo_ibge", T.StringType()),
        T.StructField("nome", T.StringType()),
        T.StructField("uf", T.StringType()),
        T.StructField("regiao", T.StringType()),
        T.StructField("capital", T.BooleanType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

ACTIVITY_CLASS_COLUMNS = [
    "classe",
    "classe_desc",
    "grupo",
    "grupo_desc",
    "divisao",
    "divisao_desc",
    "secao",
    "secao_desc",
]

GEO_CACHE_SCHEMA = T.StructType(
    [
        T.StructField("cep", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("municipio_ibge", T.StringType()),
        T.StructField("fonte", T.StringType()),
        T.StructField("atualizado_em", T.TimestampType()),
    ]
)

# geocode statuses that count as a cache hit; 'erro' is retried
GEO_HIT_STATUSES = ("ok", "sem_coordenada", "nao_encontrado")
