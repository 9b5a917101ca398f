"""Benchmark decontamination: one Aho-Corasick automaton over normalised items.

Texts are normalised to lower-case words joined by single spaces; every window
of ten item words (a shorter item is one window) is a pattern, fenced by spaces
so that only whole words match. Each document is scanned once and the hits are
mapped back to code points of the original text.

The automaton is built from blocks of patterns of at most ``BLOCK_BYTES`` (the
broadcast bound); a benchmark beyond one block passes the texts through one
automaton per block, each adding its hits to those found so far, and every
``BLOCKS_PER_PASS`` blocks the state is written to the shared folder, which
bounds the automata a task holds.

Defined cases: a null or empty text has no words and no hits; an item without
words has no window; an item whose id is null marks words but is not listed;
repeated items count once by id; repeated documents each get their row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common

WINDOW = 10
#: Pattern bytes of one automaton: at most as many trie nodes, of some 40 bytes each.
BLOCK_BYTES = 4_000_000
BLOCKS_PER_PASS = 2

#: Bytes to normalised bytes: A-Z lower-cased, other ASCII but 0-9 and a-z to a space.
_NORM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: A word of the original text (the same words, before lower-casing).
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_NORM).split() if text else []


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The item's windows, words joined and fenced by single spaces."""
    w = words(text)
    n = min(size, len(w))
    return [b" " + b" ".join(w[i : i + n]) + b" " for i in range(len(w) - n + 1)] if n else []


def patterns(items: DataFrame, *, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per distinct (window, item)."""

    def split(texts: list) -> dict:
        return {"windows": [list(dict.fromkeys(windows(t, size))) for t in texts]}

    out = T.StructType([T.StructField("windows", T.ArrayType(T.BinaryType()))])
    rows = common.map_texts(items, split, out, text=text, carry=[item_id])
    return rows.select(
        F.explode("windows").alias("window"), F.col("row").getField(item_id).cast("string").alias("item")
    ).distinct()


def _automaton(key: str, block: list) -> ahocorasick.Automaton:
    if key not in _AUTOMATA:
        while len(_AUTOMATA) >= BLOCKS_PER_PASS:
            _AUTOMATA.pop(next(iter(_AUTOMATA)))
        a = ahocorasick.Automaton()
        for window, items in block:
            # latin-1 gives one character per byte, on both sides
            a.add_word(window.decode("latin-1"), (window.count(b" ") - 1, items))
        if block:
            a.make_automaton()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


def _scan(automaton: ahocorasick.Automaton, text: str | None, known: list, items: set) -> tuple[int, list]:
    """Number of words and the hit word ranges [start, end) merged with ``known``."""
    w = words(text)
    ranges = list(known)
    if w and len(automaton):
        flat = (b" " + b" ".join(w) + b" ").decode("latin-1")
        ends = None
        for at, (n, names) in automaton.iter(flat):
            if ends is None:
                ends = np.cumsum(np.fromiter((len(x) + 1 for x in w), np.int64, len(w)))
            last = int(np.searchsorted(ends, at))  # the word that ends before this space
            ranges.append((last - n + 1, last + 1))
            items.update(names)
    merged: list = []
    for s, e in sorted(ranges):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return len(w), merged


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("ranges", _RANGES),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", _RANGES),
    ]
)


def spans_of(text: str | None, ranges: list) -> list:
    """Word ranges as code-point spans of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in ranges]


def scan(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: struct ``row`` (the ``carry`` columns), ``n_words``, ``ranges``
    (hit word ranges), ``items`` (ids with occurring windows, sorted as strings)
    and ``hit_spans`` (code points of the original, end exclusive)."""
    spark = docs.sparkSession
    pats = patterns(items, size=size)
    total = pats.agg(F.coalesce(F.sum(F.length("window")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // block_bytes))
    grouped = pats.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    state: DataFrame | None = None
    for k in range(n_blocks):
        rows = grouped.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k).collect()
        block = spark.sparkContext.broadcast([(bytes(r[0]), list(r[1])) for r in rows])
        state = _pass(docs, state, block, text, list(carry))
        if n_blocks > 1 and k % BLOCKS_PER_PASS == BLOCKS_PER_PASS - 1:
            state = common.written(state, "decontaminate")
    return state.select("row", "n_words", "ranges", "items", "hit_spans")


def _pass(docs: DataFrame, state: DataFrame | None, block, text: str, carry: list[str]) -> DataFrame:
    """One automaton over all texts, on top of what ``state`` already holds."""
    spark = docs.sparkSession
    common.short_batches(spark)
    if state is None:
        src = docs.select(
            F.struct(*[docs[f"`{c}`"].alias(c) for c in carry]).alias("row"),
            docs[f"`{text}`"].cast("string").alias("text"),
            F.lit(None).cast(_RANGES).alias("ranges"),
            F.lit(None).cast("array<string>").alias("items"),
        )
    else:
        src = state.select("row", "text", "ranges", "items")
    schema = T.StructType([src.schema["row"], T.StructField("text", T.StringType()), *_OUT.fields])
    names = schema.names
    arrow = common.to_arrow_schema(T.StructType(_OUT.fields))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, block.value)
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in arrow}
            for t, r, i in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                found = set(i or ())
                n, ranges = _scan(automaton, t, [(x["start"], x["end"]) for x in r or ()], found)
                out["n_words"].append(n)
                out["ranges"].append([{"start": s, "end": e} for s, e in ranges])
                out["items"].append(sorted(found))
                out["hit_spans"].append([{"start": s, "end": e} for s, e in spans_of(t, ranges)])
            cols = [b.column(0), b.column(1)] + [pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)
