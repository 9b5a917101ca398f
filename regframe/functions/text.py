"""Text helpers: LIKE escaping, the index tokenizer, Jaro-Winkler.

The tokenizer is a Column expression (lower-case, decompose and strip accents,
split on anything outside ``a-z``) with a plain-Python twin for the query string.
Jaro-Winkler has no Spark built-in: it runs as an Arrow-batched pandas UDF
over byte strings, applied only to distinct candidate names after a native
length-ratio prune.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _fold_table() -> tuple[str, str]:
    """Accented letters whose canonical decomposition is an ASCII letter and marks, with
    that letter; then the combining marks themselves, which ``translate`` drops."""
    accented, plain, marks = [], [], []
    for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0x10000)]):
        parts = unicodedata.normalize("NFD", c)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(unicodedata.category(m) == "Mn" for m in parts[1:]):
            accented.append(c)
            plain.append(parts[0].lower())
    return "".join(accented + marks), "".join(plain)


ACCENTED, PLAIN = _fold_table()

_SPLIT = "[^a-z]+"


def tokens(col: str | Column) -> Column:
    """array<string> of index terms; no stemming, no stop words."""
    c = F.col(col) if isinstance(col, str) else col
    norm = F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), _SPLIT, " ")
    # runs of separators became one space, so the only empty tokens are those
    # before a leading or after a trailing separator (or of an empty text);
    # array_remove drops them without a lambda and without reading the
    # normalised text twice
    return F.array_remove(F.split(norm, " "), "")


def py_tokens(text: str | None) -> list[str]:
    if not text:
        return []
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return [t for t in re.split(_SPLIT, folded) if t]


def tokens_sql(expr: str) -> str:
    """The tokenizer in SQL text (DuckDB, its own accent folding), as a list expression."""
    return f"list_filter(string_split_regex(strip_accents(lower({expr})), '[^a-z]+'), lambda t: t <> '')"


def like_contains(q: str) -> str:
    """``%q%`` with the caller's ``%``/``_`` kept as wildcards.

    Spark LIKE treats backslash as the escape character; the caller's
    backslashes are doubled so they stay literal.
    """
    return "%" + q.replace("\\", "\\\\") + "%"


def jaro_winkler_bytes(a: bytes, b: bytes) -> float:
    """Jaro-Winkler on byte strings: prefix boost 0.1 per byte (max 4) when Jaro > 0.7.

    Transpositions are the integer half of the out-of-order matched bytes.
    """
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return 0.0
    window = max(max(la, lb) // 2 - 1, 0)
    taken = bytearray(lb)
    a_hits = []
    for i, ch in enumerate(a):
        lo, hi = max(0, i - window), min(lb, i + window + 1)
        for j in range(lo, hi):
            if not taken[j] and b[j] == ch:
                taken[j] = 1
                a_hits.append(ch)
                break
    m = len(a_hits)
    if m == 0:
        return 0.0
    b_hits = [b[j] for j in range(lb) if taken[j]]
    # transpositions: half the out-of-order matches, rounded down (as the
    # oracle engine computes it)
    half_t = sum(1 for x, y in zip(a_hits, b_hits) if x != y) // 2
    jaro = (m / la + m / lb + (m - half_t) / m) / 3.0
    if jaro > 0.7:
        p = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            p += 1
        jaro += p * 0.1 * (1.0 - jaro)
    return jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Vectorised entry point (Arrow batches); NULL input gives NULL."""
    out = [
        None if x is None or y is None else jaro_winkler_bytes(x.encode(), y.encode())
        for x, y in zip(left, right)
    ]
    return pd.Series(out, dtype="float64")
