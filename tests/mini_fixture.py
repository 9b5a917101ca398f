"""A hand-made monthly dump (5 establishments) written as CP1252 files.

Rows follow the published description of the reference's own mini dump; names,
descriptions and centroids are invented.
"""

from __future__ import annotations

import os

from regframe.schemas import ESTABLISHMENT_COLUMNS

#: Smallest of the given data sets.
SF_SMALL = "/root/testdata/sf0.001"

MONTH_TAG = "K3241.K03200Y0.D60925"

COMPANIES = [
    ("12345678", "EMPRESA TESTE LTDA", "2062", "49", "1000,00", "01", ""),
    ("87654321", "OUTRA EMPRESA SA", "2054", "10", "50000,50", "05", ""),
    ("12ABC345", "EMPRESA ALFA LTDA", "2062", "49", "20000,00", "03", ""),
]

# cnpj parts, head/branch, status, status date, start, main, secondary, cep, uf, municipio
_EST = [
    ("12345678", "0001", "95", "1", "02", "20200101", "20200101", "6201501", "4784900,4682600", "01001000", "SP", "7107"),
    ("12345678", "0002", "76", "2", "02", "20210101", "20210101", "4784900", "", "15015000", "SP", "7097"),
    ("87654321", "0001", "98", "1", "02", "20190101", "20190101", "4682600", "6201501", "01310000", "SP", "7107"),
    ("87654321", "0002", "00", "2", "08", "20250310", "20210615", "4682600", "", "20040020", "RJ", "6001"),
    ("12ABC345", "01DE", "35", "1", "02", "20260801", "20260801", "6201501", "", "20040020", "RJ", "6001"),
]

PARTNERS = [
    ("12345678", "2", "JOSE DA SILVA", "***123456**", "49", "20200101", "", "", "", "", "5"),
    ("12345678", "2", "MARIA SOUZA", "***654321**", "22", "20200101", "", "", "", "", "4"),
    ("87654321", "1", "EMPRESA ALFA LTDA", "12ABC345", "22", "20190101", "", "", "", "", "0"),
]

SIMPLES = [
    ("12345678", "S", "20200101", "", "S", "20200101", ""),
    ("87654321", "N", "", "", "", "", ""),
    ("12ABC345", "S", "20260801", "", "N", "", ""),
]

CODES = {
    "F.CNAECSV": [
        ("6201501", "Desenvolvimento de programas de computador sob encomenda"),
        ("4784900", "Comércio varejista de gás liquefeito de petróleo"),
        ("4682600", "Comércio atacadista de gás liquefeito de petróleo"),
    ],
    "F.MOTICSV": [("00", "SEM MOTIVO"), ("01", "EXTINCAO POR ENCERRAMENTO")],
    "F.MUNICCSV": [("7107", "SAO PAULO"), ("7097", "SAO JOSE DO RIO PRETO"), ("6001", "RIO DE JANEIRO"),
                   ("9707", "EXTERIOR")],
    "F.NATJUCSV": [("2062", "Sociedade Empresária Limitada")],
    "F.PAISCSV": [("105", "BRASIL")],
    "F.QUALSCSV": [("49", "Sócio-Administrador"), ("22", "Sócio")],
}

MUNICIPIOS_CSV = """codigo_rf,codigo_ibge,nome,uf,regiao,capital,latitude,longitude
7107,3550308,São Paulo,SP,Sudeste,1,-23.5,-46.6
7097,3549805,São José do Rio Preto,SP,Sudeste,0,-20.8,-49.4
6001,3304557,Rio de Janeiro,RJ,Sudeste,1,-22.9,-43.2
"""

CNAE_CSV = """classe,classe_desc,grupo,grupo_desc,divisao,divisao_desc,secao,secao_desc
62015,Desenvolvimento de software sob encomenda,620,Atividades de TI,62,Serviços de TI,J,Informação e comunicação
46826,Comércio atacadista de combustíveis,468,Comércio atacadista especializado,46,Comércio por atacado,G,Comércio
47849,Comércio varejista de gás,478,Comércio varejista de outros produtos,47,Comércio varejista,G,Comércio
"""


def _line(values) -> str:
    return ";".join(f'"{v}"' if v != "" else "" for v in values)


def establishment_rows() -> list[tuple]:
    rows = []
    for b, o, dv, mf, st, st_date, start, main, sec, cep, uf, mun in _EST:
        v = dict.fromkeys(ESTABLISHMENT_COLUMNS, "")
        v.update(
            cnpj_basico=b, cnpj_ordem=o, cnpj_dv=dv, matriz_filial=mf, situacao_cadastral=st,
            data_situacao_cadastral=st_date, data_inicio_atividades=start, cnae_fiscal=main,
            cnae_fiscal_secundaria=sec, cep=cep, uf=uf, municipio=mun,
            nome_fantasia="LOJA ALFA" if b == "12ABC345" else "",
        )
        rows.append(tuple(v[c] for c in ESTABLISHMENT_COLUMNS))
    return rows


def write_dump(directory: str, *, with_partners: bool = True, month_tag: str = MONTH_TAG) -> str:
    os.makedirs(directory, exist_ok=True)

    def put(name, rows):
        with open(os.path.join(directory, name), "wb") as f:
            f.write(("\n".join(_line(r) for r in rows) + "\n").encode("cp1252"))

    put(f"{month_tag}.EMPRECSV", COMPANIES)
    put(f"{month_tag}.ESTABELE", establishment_rows())
    if with_partners:
        put(f"{month_tag}.SOCIOCSV", PARTNERS)
    put("F.SIMPLES.CSV", SIMPLES)
    for name, rows in CODES.items():
        put(name, rows)
    return directory


def write_dimensions(directory: str) -> tuple[str, str]:
    os.makedirs(directory, exist_ok=True)
    m = os.path.join(directory, "municipios_ibge.csv")
    c = os.path.join(directory, "cnae_classes.csv")
    with open(m, "w", encoding="utf-8") as f:
        f.write(MUNICIPIOS_CSV)
    with open(c, "w", encoding="utf-8") as f:
        f.write(CNAE_CSV)
    return m, c
