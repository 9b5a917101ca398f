"""Readers of the raw monthly dump: headerless ``;`` text in CP1252.

Quoted fields may hold newlines; files are cut into blocks all the same
(:mod:`regframe.sources.records`). Short rows are padded with NULL (PERMISSIVE); every
column stays text. The CP1252 charset needs ``spark.sql.legacy.javaCharsets``, which is
switched on for the reader.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.operators import maintain
from regframe.schemas import SIMPLES_COLUMNS, text_schema
from regframe.sources import records

ENCODING = "windows-1252"


#: How one record is read.
CSV_OPTIONS = {"sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}


def enable_charsets(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_files(spark: SparkSession, directory: str, names: list[str], columns: list[str], *, block_bytes: int | None = None) -> DataFrame:
    """The rows of raw files in one batch plan (``columns`` and ``_arquivo``); call its
    actions inside ``records.grid`` with the same ``block_bytes``."""
    enable_charsets(spark)
    with records.grid(spark, block_bytes):
        found = records.lines(spark.read, directory, names)
        got = records.decoded(records.pieces(found, records.block_starts(found)), ENCODING)
    return rows_of(got, columns)


def rows_of(found: DataFrame, columns: list[str]) -> DataFrame:
    """Rows out of pieces (``_arquivo, _bloco, _parte, _texto``): whole records, and those
    joined from fragments."""
    whole = found.where(F.col("_parte") == records.WHOLE).select("_arquivo", "_texto")
    torn = records.joined(found.where(F.col("_parte") != records.WHOLE))
    return records.parsed(whole.unionByName(torn), text_schema(columns), CSV_OPTIONS)


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """File names directly under ``directory`` (driver-side listing, metadata only)."""
    fs, p = maintain._fs(spark, directory)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())


def _glob_to_re(glob: str) -> re.Pattern:
    return re.compile("^" + re.escape(glob).replace(r"\*", ".*") + "$")


def matching(names: list[str], glob: str) -> list[str]:
    """Names matching ``glob``, or, if none does, those ending like it."""
    hits = list(filter(_glob_to_re(glob).match, names))
    return hits or [n for n in names if n.endswith(glob.lstrip("*"))]


def empty_simples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], text_schema(SIMPLES_COLUMNS))


#: The month tag of a raw file: third dot-part, ``D`` + last digit of the year + MMDD.
_MONTH_TAG = re.compile(r"D(\d)(\d\d)(\d\d)")
UNKNOWN_MONTH = "000000"


def tag_of(name: str) -> tuple[str, str] | None:
    """(YYYYMM, dd/mm/yyyy) of a raw file name, or None if it carries no tag.

    The published files give one digit of the year; the decade is 202x.
    """
    pieces = name.split(".")
    hit = _MONTH_TAG.fullmatch(pieces[2]) if len(pieces) > 2 else None
    if hit is None:
        return None
    year, month, day = "202" + hit[1], hit[2], hit[3]
    return year + month, f"{day}/{month}/{year}"


def detect_reference(names: list[str], ano_mes: str | None = None) -> tuple[str, str]:
    """(date text, YYYYMM) of the dump: of ``ano_mes``, else of the newest month that
    the company files name; ('desconhecida', '000000') if they name none."""
    companies = [n for n in names if n.endswith(".EMPRECSV")]
    if not companies:
        raise FileNotFoundError("no company file (*.EMPRECSV) in the dump")
    tags = {t for t in map(tag_of, companies) if t}
    if ano_mes is not None:
        tags = {t for t in tags if t[0] == ano_mes}
        if not tags:
            raise FileNotFoundError(f"no company file of month {ano_mes} in the dump")
    month, date = max(tags, default=(UNKNOWN_MONTH, "desconhecida"))
    return date, month


def of_month(names: list[str], ano_mes: str) -> list[str]:
    """The files that belong to a month: tagged with it, or without a tag."""
    return [n for n in names if (tag_of(n) or (ano_mes,))[0] == ano_mes]
