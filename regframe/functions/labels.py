"""Code -> label Columns (a literal map, evaluated inside codegen)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from regframe.schemas import BRANCH_LABELS, SIZE_LABELS, STATUS_LABELS


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def _label(col: Column, d: dict[str, str], empty_as_null: bool) -> Column:
    code = F.coalesce(col, F.lit(""))
    fallback = F.when(code != "", code) if empty_as_null else code
    return F.coalesce(_map(d)[code], fallback)


def status_label(col: str | Column, *, empty_as_null: bool = False) -> Column:
    """Status text; an unknown code is its own label ('' or NULL when empty)."""
    c = F.col(col) if isinstance(col, str) else col
    return _label(c, STATUS_LABELS, empty_as_null)


def branch_label(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _label(c, BRANCH_LABELS, False)


def size_label(col: str | Column) -> Column:
    """Company size text; falls back to the raw value (NULL stays NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_map(SIZE_LABELS)[F.coalesce(c, F.lit(""))], c)
