"""Shared establishment filters of the aggregates and cohorts.

Dimension filters (external municipality code, activity section/division) are
semi joins to a broadcast dimension instead of driver-side code lists; a
filter that matches nothing yields an empty result by construction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regframe.bundle import Registry
from regframe.functions.ids import py_digits


def require(reg: Registry, name: str, what: str) -> None:
    if not reg.has(name):
        raise ValueError(f"{what} needs the table {name}; build the dimensions first")


def activity_codes(reg: Registry, secao: str | None, divisao: str | None) -> DataFrame:
    """Activity codes of a section and/or division (a small frame of ``cnae``)."""
    require(reg, "cnae_hierarquia", "a section/division filter")
    h = reg.dim("cnae_hierarquia")
    cond = F.lit(True)
    if secao:
        cond = cond & (F.col("secao") == secao.strip().upper())
    if divisao:
        cond = cond & (F.col("divisao") == py_digits(divisao).zfill(2))
    return h.where(cond).select("cnae")


def municipality_codes(reg: Registry, codigo_ibge: str) -> DataFrame:
    """Internal municipality codes of one external code."""
    require(reg, "municipio_ibge", "an external municipality filter")
    mi = reg.dim("municipio_ibge")
    return mi.where(F.col("codigo_ibge") == py_digits(codigo_ibge)).select("codigo_rf")


@dataclass
class EstFilter:
    uf: str | None = None
    municipio: str | None = None
    municipio_ibge: str | None = None
    cnae: str | None = None
    cnae_secao: str | None = None
    cnae_divisao: str | None = None
    matriz_filial: str | None = None


def apply(reg: Registry, est: DataFrame, f: EstFilter) -> DataFrame:
    """AND of the given filters on an establishment frame."""
    if f.uf:
        est = est.where(F.col("uf") == f.uf.upper())
    if f.municipio:
        est = est.where(F.col("municipio") == py_digits(f.municipio))
    if f.cnae:
        est = est.where(F.col("cnae_fiscal") == py_digits(f.cnae))
    if f.matriz_filial:
        est = est.where(F.col("matriz_filial") == f.matriz_filial)
    if f.municipio_ibge:
        rf = municipality_codes(reg, f.municipio_ibge)
        est = est.join(rf, est["municipio"] == rf["codigo_rf"], "left_semi")
    if f.cnae_secao or f.cnae_divisao:
        codes = activity_codes(reg, f.cnae_secao, f.cnae_divisao)
        est = est.join(codes, est["cnae_fiscal"] == codes["cnae"], "left_semi")
    return est
