"""The derived registry written as plain SQL common table expressions.

This is the independent side of the correctness check: the same definitions
as :mod:`regframe.sources.starmap` and :mod:`regframe.operators.model`, in SQL
text that DuckDB runs over the driver tables (``customer``, ``orders`` ...).
"""

from __future__ import annotations

#: Check-digit weights (fixed values, written out on the SQL side).
WEIGHTS_FIRST = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
WEIGHTS_SECOND = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def code_sql(k: str) -> str:
    return (
        f"(lpad(CAST(CAST(1000 + FLOOR(({k}) / 2) * 890 AS INT) AS VARCHAR), 5, '0') "
        f"|| '0' || CAST(({k}) % 2 AS VARCHAR))"
    )


def dv_sql(col: str) -> str:
    """Two expected check digits of the first 12 characters of ``col``."""
    vals = [f"(ascii(substr({col}, {i + 1}, 1)) - 48)" for i in range(12)]
    t1 = " + ".join(f"{v} * {w}" for v, w in zip(vals, WEIGHTS_FIRST))
    d1 = f"(((11 - ({t1}) % 11) % 11) % 10)"
    t2 = " + ".join(f"{v} * {w}" for v, w in zip(vals, WEIGHTS_SECOND[:12]))
    d2 = f"(((11 - ({t2} + {d1} * {WEIGHTS_SECOND[12]}) % 11) % 11) % 10)"
    return f"(CAST({d1} AS VARCHAR) || CAST({d2} AS VARCHAR))"


#: Code labels (fixed values, written out on the SQL side).
LABELS = {
    "status": "('01', 'Nula'), ('02', 'Ativa'), ('03', 'Suspensa'), ('04', 'Inapta'), ('08', 'Baixada')",
    "size": "('00', 'Não informado'), ('01', 'Microempresa (ME)'), ('03', 'Empresa de pequeno porte (EPP)'), ('05', 'Demais')",
    "branch": "('1', 'Matriz'), ('2', 'Filial')",
}


def look(table: str, value: str, key: str, of: str) -> str:
    """The ``value`` of the row of a small table whose ``key`` equals ``of`` (else NULL)."""
    return f"(SELECT any_value(dim.{value}) FROM {table} AS dim WHERE dim.{key} = {of})"


def label(kind: str, of: str) -> str:
    return look(f"(SELECT * FROM (VALUES {LABELS[kind]}) AS v(codigo, rotulo))", "rotulo", "codigo", of)


def columns(**exprs: str) -> str:
    """``expr AS name`` list."""
    return ",\n       ".join(f"{e} AS {n}" for n, e in exprs.items())


_YMD_O = "strftime(o_orderdate, '%Y%m%d')"

CTES: list[tuple[str, str]] = [
    (
        "cnae",
        f"""SELECT {code_sql('k')} AS codigo, least_type || ' ' || CAST(k AS VARCHAR) AS descricao
            FROM (SELECT p_partkey % 200 AS k, min(p_type) AS least_type FROM part GROUP BY 1)
            WHERE k < 190""",
    ),
    (
        "municipio",
        "SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS codigo, n_name AS descricao FROM nation",
    ),
    (
        "natureza_juridica",
        "SELECT CAST(1000 + n_nationkey AS VARCHAR) AS codigo, 'NATUREZA ' || n_name AS descricao FROM nation",
    ),
    (
        "pais",
        "SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS codigo, n_name AS descricao FROM nation",
    ),
    (
        "motivo",
        "SELECT lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS codigo, 'MOTIVO ' || r_name AS descricao FROM region",
    ),
    (
        "qualificacao_socio",
        "SELECT CAST(49 + r_regionkey AS VARCHAR) AS codigo, 'QUALIFICACAO ' || r_name AS descricao FROM region",
    ),
    (
        "cnae_classes",
        """SELECT classe, 'CLASSE ' || classe AS classe_desc,
                  substr(classe, 1, 3) AS grupo, 'GRUPO ' || substr(classe, 1, 3) AS grupo_desc,
                  substr(classe, 1, 2) AS divisao, 'DIVISAO ' || substr(classe, 1, 2) AS divisao_desc,
                  chr(65 + CAST(substr(classe, 1, 2) AS INT) % 21) AS secao,
                  'SECAO ' || chr(65 + CAST(substr(classe, 1, 2) AS INT) % 21) AS secao_desc
           FROM (SELECT DISTINCT substr(codigo, 1, 5) AS classe FROM cnae)""",
    ),
    (
        "cnae_hierarquia",
        """SELECT c.codigo AS cnae, c.descricao AS cnae_desc, k.classe, k.classe_desc,
                  k.grupo, k.grupo_desc, k.divisao, k.divisao_desc, k.secao, k.secao_desc
           FROM cnae c LEFT JOIN cnae_classes k ON k.classe = substr(c.codigo, 1, 5)""",
    ),
    (
        "municipio_ibge",
        """SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS codigo_rf,
                  CAST(3500000 + n_nationkey AS VARCHAR) AS codigo_ibge,
                  n_name AS nome, 'U' || CAST(n_nationkey % 5 AS VARCHAR) AS uf,
                  r_name AS regiao, (n_nationkey % 5 = 0) AS capital,
                  CAST(n_nationkey - 30 AS DOUBLE) AS latitude,
                  CAST(n_nationkey - 60 AS DOUBLE) AS longitude
           FROM nation JOIN region ON n_regionkey = r_regionkey
           WHERE n_nationkey <> 24""",
    ),
    (
        "empresas",
        """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cnpj_basico,
                  coalesce(upper(p_name), 'EMPRESA ' || c_custkey) || ' ' || c_mktsegment AS razao_social,
                  CAST(1000 + c_nationkey AS VARCHAR) AS natureza_juridica,
                  CAST(49 + c_custkey % 5 AS VARCHAR) AS qualificacao_responsavel,
                  replace(CAST(c_acctbal AS VARCHAR), '.', ',') AS capital_social_str,
                  CASE c_custkey % 4 WHEN 0 THEN '00' WHEN 1 THEN '01' WHEN 2 THEN '03' ELSE '05' END
                      AS porte_empresa,
                  CAST(NULL AS VARCHAR) AS ente_federativo_responsavel,
                  TRY_CAST(replace(replace(CAST(c_acctbal AS VARCHAR), '.', ','), ',', '.') AS DOUBLE)
                      AS capital_social
           FROM customer LEFT JOIN part ON p_partkey = c_custkey""",
    ),
    (
        "est_base",
        """SELECT *, lpad(CAST(o_custkey AS VARCHAR), 8, '0')
                     || lpad(CAST(rn AS VARCHAR), 4, '0') AS base12
           FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
                        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
                 FROM orders)""",
    ),
    (
        "estabelecimento",
        f"""SELECT cnpj_basico, cnpj_ordem, cnpj_dv, matriz_filial, nome_fantasia,
                   situacao_cadastral, data_situacao_cadastral, motivo_situacao_cadastral,
                   nome_cidade_exterior, pais, data_inicio_atividades, cnae_fiscal,
                   cnae_fiscal_secundaria, tipo_logradouro, logradouro, numero, complemento,
                   bairro, cep, uf, municipio, ddd1, telefone1, ddd2, telefone2, ddd_fax, fax,
                   correio_eletronico, situacao_especial, data_situacao_especial,
                   cnpj_basico || cnpj_ordem || cnpj_dv AS cnpj
            FROM (
              SELECT substr(base12, 1, 8) AS cnpj_basico,
                     substr(base12, 9, 4) AS cnpj_ordem,
                     CASE WHEN o_orderkey % 97 = 0 THEN '00' ELSE {dv_sql('base12')} END AS cnpj_dv,
                     CASE WHEN rn = 1 THEN '1' ELSE '2' END AS matriz_filial,
                     CASE WHEN o_orderkey % 5 = 0 THEN 'LOJA ' || upper(substr(o_orderpriority, 3, 100)) END
                         AS nome_fantasia,
                     CASE o_orderstatus WHEN 'F' THEN '08' WHEN 'O' THEN '02' WHEN 'P' THEN '04' END
                         AS situacao_cadastral,
                     CAST(CAST({_YMD_O} AS INT) + (o_orderkey % 4) * 10000 AS VARCHAR)
                         AS data_situacao_cadastral,
                     lpad(CAST(o_orderkey % 5 AS VARCHAR), 2, '0') AS motivo_situacao_cadastral,
                     CAST(NULL AS VARCHAR) AS nome_cidade_exterior,
                     CAST(NULL AS VARCHAR) AS pais,
                     CASE WHEN o_orderkey % 211 = 0 THEN '' ELSE {_YMD_O} END AS data_inicio_atividades,
                     {code_sql('(o_orderkey * 7) % 200')} AS cnae_fiscal,
                     CASE WHEN o_orderkey % 3 = 0
                            THEN {code_sql('(o_orderkey * 11) % 200')} || ',' || {code_sql('(o_orderkey * 13) % 200')}
                          WHEN o_orderkey % 3 = 1 THEN {code_sql('(o_orderkey * 11) % 200')}
                     END AS cnae_fiscal_secundaria,
                     'RUA' AS tipo_logradouro, 'PRINCIPAL' AS logradouro,
                     CAST(o_orderkey % 1000 AS VARCHAR) AS numero,
                     CAST(NULL AS VARCHAR) AS complemento, 'CENTRO' AS bairro,
                     lpad(CAST((o_orderkey * 31) % 5000 AS VARCHAR), 8, '0') AS cep,
                     'U' || CAST((o_orderkey % 25) % 5 AS VARCHAR) AS uf,
                     lpad(CAST(o_orderkey % 25 AS VARCHAR), 4, '0') AS municipio,
                     CAST(NULL AS VARCHAR) AS ddd1, CAST(NULL AS VARCHAR) AS telefone1,
                     CAST(NULL AS VARCHAR) AS ddd2, CAST(NULL AS VARCHAR) AS telefone2,
                     CAST(NULL AS VARCHAR) AS ddd_fax, CAST(NULL AS VARCHAR) AS fax,
                     CAST(NULL AS VARCHAR) AS correio_eletronico,
                     CAST(NULL AS VARCHAR) AS situacao_especial,
                     CAST(NULL AS VARCHAR) AS data_situacao_especial
              FROM est_base)""",
    ),
    (
        "simples",
        """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cnpj_basico,
                  CASE WHEN c_custkey % 4 = 0 THEN 'S' ELSE 'N' END AS opcao_simples,
                  CAST(NULL AS VARCHAR) AS data_opcao_simples,
                  CAST(NULL AS VARCHAR) AS data_exclusao_simples,
                  CASE WHEN c_custkey % 10 = 0 THEN 's' ELSE 'N' END AS opcao_mei,
                  CAST(NULL AS VARCHAR) AS data_opcao_mei,
                  CAST(NULL AS VARCHAR) AS data_exclusao_mei
           FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""",
    ),
    (
        "socios_original",
        """SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS cnpj_basico,
                  CASE WHEN l_linenumber % 3 = 0 THEN '1' ELSE '2' END AS identificador_de_socio,
                  'SOCIO ' || CAST(l_suppkey AS VARCHAR) AS nome_socio,
                  CASE WHEN l_linenumber % 3 = 0 THEN lpad(CAST(l_partkey AS VARCHAR), 8, '0')
                       ELSE '***' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || '**' END AS cnpj_cpf_socio,
                  CAST(49 + l_linenumber % 5 AS VARCHAR) AS qualificacao_socio,
                  strftime(l_shipdate, '%Y%m%d') AS data_entrada_sociedade,
                  CAST(NULL AS VARCHAR) AS pais,
                  CAST(NULL AS VARCHAR) AS representante_legal,
                  CAST(NULL AS VARCHAR) AS nome_representante,
                  CAST(NULL AS VARCHAR) AS qualificacao_representante_legal,
                  CAST(NULL AS VARCHAR) AS faixa_etaria
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    (
        # head offices of companies that exist
        "cnpj_base2matriz",
        """SELECT cnpj_basico, cnpj FROM estabelecimento SEMI JOIN empresas USING (cnpj_basico)
           WHERE matriz_filial = '1' GROUP BY ALL""",
    ),
    (
        "socios_antigos",
        """SELECT m.cnpj, s.* FROM socios_original AS s LEFT JOIN cnpj_base2matriz AS m USING (cnpj_basico)""",
    ),
    (
        # a company partner's document becomes its head-office key; rows of unknown kind go
        "socios",
        """SELECT a.* REPLACE (CASE a.identificador_de_socio WHEN '1' THEN holder.cnpj ELSE a.cnpj_cpf_socio END
                               AS cnpj_cpf_socio)
           FROM socios_antigos AS a
           LEFT JOIN cnpj_base2matriz AS holder
             ON a.identificador_de_socio = '1' AND a.cnpj_cpf_socio = holder.cnpj_basico
           WHERE a.identificador_de_socio IS NOT NULL""",
    ),
    (
        # one list per establishment: the main code in front of the secondary ones
        "estabelecimento_cnae",
        """SELECT cnpj, item.cnae, item.tipo FROM (
             SELECT cnpj, unnest(list_concat(
               [{'cnae': cnae_fiscal, 'tipo': 'principal'}],
               list_transform(string_split(cnae_fiscal_secundaria, ','),
                              lambda c: {'cnae': trim(c), 'tipo': 'secundario'}))) AS item
             FROM estabelecimento)
           WHERE item.cnae <> ''""",
    ),
]


def with_registry(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <registry>, <extra> <body>``: DuckDB inlines only what is used."""
    parts = [f"{name} AS (\n{sql}\n)" for name, sql in CTES + (extra or [])]
    own = body.lstrip()
    # a body with tables of its own adds them to the list
    glue = (",\n" + own.removeprefix("WITH ")) if own.startswith("WITH ") else "\n" + body
    return "WITH " + ",\n".join(parts) + glue
