"""Importance resampling toward a target distribution, over hashed word runs.

*Batch concatenation.* The texts of a batch are joined with a separator that is no
word character, one regex pass over the joined bytes finds all words, and a search of
each word's start among the document offsets says whose word it is. A run of words
counts only where its first and last word are of one document, which masks the runs
across a separator; one ``bincount`` then counts the buckets of the whole batch, a
second one sums the gains of its documents.

A run's bucket is the CRC of its bytes modulo ``BUCKETS``. The CRC of a run goes on
from that of the run one word shorter, so no run is ever put together as a string.

*Counts.* Each task counts all its rows into one array and gives it away in
``SLICES`` slices, which are added up by slice: what moves is one array a task, whatever
the corpus holds. The driver gets two arrays of ``BUCKETS`` numbers.

*Draw.* Scores are whole numbers between bounds that the buckets' gains and the noise
have (some 100,000 values at most), so a count by score is small whatever the corpus:
its running sum finds the score where the draw ends and the rank before each score.
Rows of one score are ranked by id in parallel; documents are never sorted as a whole.

Defined cases: null and empty texts have no words, weight 0 and no rank; a null id is
drawn by the noise of an empty id and stands behind other ids of its score; rows that
repeat an id have its noise and take neighbouring ranks if their scores tie; an empty
target has no counts (its smoothed share is even); no rows give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common

BUCKETS = 10_000
#: Longest run of words.
GRAMS = 2
#: Slices of one task's counts (each is one row).
SLICES = 40
#: Bytes of texts joined at a time (and at least one whole text).
JOINED = 1 << 20

#: UTF-8 bytes from 0x80 on are all part of characters that count as word characters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SEPARATOR = b"\n"

#: What one byte of each value makes of the CRC's state.
_STEP = np.array([~zlib.crc32(bytes([b]), 0xFFFFFFFF) & 0xFFFFFFFF for b in range(256)], np.uint32)


def _after_space(crc: np.ndarray) -> np.ndarray:
    """CRCs of the strings with these CRCs and a space behind them."""
    state = ~crc
    return ~(_STEP[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def _joined(texts: list) -> Iterator[list[bytes]]:
    """The texts as lower-cased bytes, in groups of about ``JOINED`` bytes."""
    held, size = [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass").translate(_LOWER) if t else b""
        if held and size + len(b) > JOINED:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


def runs(group: list[bytes], grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document (position in the group) of every run, and words by document."""
    offsets = np.concatenate([[0], np.cumsum([len(b) + len(_SEPARATOR) for b in group])])
    words, starts = [], []
    for m in _WORD.finditer(_SEPARATOR.join(group)):
        words.append(m.group())
        starts.append(m.start())
    of = np.searchsorted(offsets, np.array(starts, np.int64), "right") - 1
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    buckets, docs = [crc % np.uint32(BUCKETS)], [of]
    for n in range(2, grams + 1):
        if len(words) < n:
            break
        begun = _after_space(crc[: len(words) - n + 1]).tolist()
        crc = np.fromiter(map(zlib.crc32, words[n - 1 :], begun), np.uint32, len(begun))
        whole = of[n - 1 :] == of[: len(begun)]
        buckets.append(crc[whole] % np.uint32(BUCKETS))
        docs.append(of[: len(begun)][whole])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(docs), np.bincount(of, minlength=len(group))


def count(docs: DataFrame, *, text: str = "text", grams: int = GRAMS) -> np.ndarray:
    """How many runs of all texts fall into each bucket."""
    common.short_batches(docs.sparkSession)
    width = -(-BUCKETS // SLICES)
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    names = schema.names

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        parts = [pa.array(list(total), pa.int32()), pa.array([c.tolist() for c in total.values()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(parts, names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLICES * width, np.int64)
        for b in batches:
            for group in _joined(b.column(0).to_pylist()):
                total += np.bincount(runs(group, grams)[0], minlength=len(total))
        yield rows(dict(enumerate(total.reshape(SLICES, width))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total[k] + np.array(c) if k in total else np.array(c)
        yield rows(total)

    mine = docs.select(docs[f"`{text}`"].cast("string").alias("text")).mapInArrow(gather, schema)
    out = np.zeros((SLICES, width), np.int64)
    for r in mine.repartition("slice").mapInArrow(add, schema).collect():
        out[r["slice"]] += np.array(r["counts"], np.int64)
    return out.ravel()[:BUCKETS]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over source share, by bucket."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


_WEIGHED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])


def weigh(docs: DataFrame, gain: np.ndarray, *, doc_id: str = "doc_id", text: str = "text", grams: int = GRAMS) -> DataFrame:
    """Per document: ``doc_id, n_words, n_features, weight`` (floored mean gain)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def fn(texts: list) -> dict:
        cols: list[list] = [[], [], []]
        for group in _joined(texts):
            buckets, of, n_words = runs(group, grams)
            n = np.bincount(of, minlength=len(group))
            # sums of whole numbers, exact in doubles up to 2^53
            sums = np.bincount(of, weights=shared.value[buckets], minlength=len(group)).astype(np.int64)
            for col, v in zip(cols, (n_words, n, sums // np.maximum(n, 1))):
                col.append(v)
        return {k: pa.array(np.concatenate(c), pa.int64()) for k, c in zip(_WEIGHED.names, cols)}

    got = common.map_texts(docs, fn, _WEIGHED, text=text, carry=[doc_id])
    return got.select(F.col("row").getField(doc_id).alias("doc_id"), *_WEIGHED.names)


def _noise(doc_id: str, seed: int):
    """Gumbel noise in thousandths, from a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int) -> DataFrame:
    """Rows (doc_id, score, fit, ...) with ``rank``: 1, 2, 3... by falling score for the
    ``percent`` highest of the rows that are ``fit``, else null."""
    by_score = scored.where("fit").groupBy("score").agg(F.count("*").alias("n"))
    # at most some 100,000 rows: one a score
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    cut = by_score.select(
        F.col("score").alias("drawn"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.floor(F.lit(percent) * F.sum("n").over(Window.partitionBy()) / 100).alias("drawn_rows"),
    ).where("before < drawn_rows")
    near = scored.join(F.broadcast(cut), F.col("fit") & (F.col("score") == F.col("drawn")), "left")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())) + F.col("before")
    ranked = near.where("drawn is not null").withColumn("place", place)
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= F.col("drawn_rows"), F.col("place").cast("long")))
    rest = near.where("drawn is null").withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    grams: int = GRAMS,
) -> DataFrame:
    """Per document: ``doc_id, n_words, n_features, weight, score, rank``.

    ``percent`` of the documents with ``least_words`` words or more are drawn, those with
    the highest weight plus Gumbel noise, which is a draw without replacement in
    proportion to the exponential of the weight.
    """
    gain = gains(count(docs, text=text, grams=grams), count(target, text=target_text, grams=grams))
    scored = weigh(docs, gain, doc_id=doc_id, text=text, grams=grams)
    scored = scored.withColumn("score", F.col("weight") + _noise("doc_id", seed)).withColumn("fit", F.col("n_words") >= least_words)
    return draw(common.written(scored, "scores"), percent).drop("fit")


def chosen(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", **how: Callable) -> DataFrame:
    """The rows of ``docs`` that are drawn, as they are (ids must be unique)."""
    drawn = resample(docs, target, doc_id=doc_id, **how).where("rank is not null").select(F.col("doc_id").alias("drawn_id"))
    return docs.join(drawn, docs[f"`{doc_id}`"] == F.col("drawn_id"), "left_semi")
