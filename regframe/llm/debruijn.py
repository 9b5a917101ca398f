"""Repeated passages of words by De Bruijn compaction: the first copy stays.

An edge is a run of ``K`` words (a window), a node the ``K - 1`` words that two edges
share. A word is removed if it lies under an edge that also starts earlier: in a document
before it, or earlier in the same one.

*Edges by anchors.* The anchor of an edge is the run of ``GRAM`` words in it with the least
hash (the last of equals), so equal edges have equal anchors. Edges in a row with one
anchor are a *segment*, a path of some eight edges that is compacted before anything
moves. A segment whose anchor is found once in the corpus holds no repeated edge, which
ends the work for text that does not repeat.

*Compaction.* Segments that remain are named by their anchor and all their words.
Where every copy of one segment is followed by the same next one, and every copy of that
comes after it, the node between them does not branch: a join of the segments with
their only successors finds these, and each document's segments in a row are put together
along them. Such a path is named by its first segment; one row stands for each copy.

*Coordinates.* The least place (document, word) at which a path starts is its source. Every
copy elsewhere is removed whole. A source keeps its words, unless some edge of it is part
of another segment with the same anchor that begins earlier: where an anchor has several
segments, one copy of each is cut into its edges, edges are counted by 128-bit hash over
the corpus, and those with an earlier place are removed from the source too.

So rows go by segments, hashes spread the edges, and the hottest paths and edges are
looked up by broadcast (``common.lookup``): no group is brought together in one task.

Defined cases: a null text has no words; texts shorter than ``K`` words lose nothing; windows
never cross documents; repeated ids are told apart by a row number, and null ids come
first (``earlier`` then goes by id and text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common

K = 20
GRAM = 6

_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _inverses(n: int) -> list[np.ndarray]:
    """Powers of the inverses of both bases modulo 2^64, up to n, and of the bases."""
    global _POWERS
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(1 << 15, 1 << n.bit_length())
        _POWERS = []
        for base in _P:
            for x in (int(base), pow(int(base), -1, 2**64)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def words(data: bytes) -> list[bytes]:
    """The words of UTF-8 text (bytes are split at the six white space characters)."""
    return data.split()


class Hashes:
    """Hashes of any runs of words of one document, two of 64 bits each."""

    def __init__(self, ws: list[bytes]):
        self.words = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
        self.powers = _inverses(len(ws) + 1)
        self.sums: dict[int, np.ndarray] = {}

    def _sums(self, k: int) -> np.ndarray:
        if k not in self.sums:
            s = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(_mix(self.words + _P[k]) * self.powers[2 * k][: len(self.words)], out=s[1:])
            self.sums[k] = s
        return self.sums[k]

    def of(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        s = self._sums(k)
        return _mix((s[end] - s[start]) * self.powers[2 * k + 1][start] + (end - start).astype(np.uint64) * _M2)

    def all(self, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words, in order."""
        s = self._sums(0)
        return _mix((s[n:] - s[: len(s) - n]) * self.powers[1][: len(s) - n] + np.uint64(n) * _M2)


def segments(h: Hashes, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first edge and number of edges of the segments, in order."""
    at = np.arange(n_words - GRAM + 1)
    grams = h.all(GRAM)
    # least of K - GRAM + 1 grams in a row, the last of equals: hash above, place below
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | (0xFFFFFFFF - at).astype(np.uint64)
    span, step = K - GRAM + 1, 1
    while step * 2 <= span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if span > step:
        key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
    anchor = 0xFFFFFFFF - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    return grams[anchor[start]], start, np.diff(np.append(start, len(anchor)))


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _unpack(packed: bytes) -> list[bytes]:
    return words(zstandard.ZstdDecompressor().decompress(packed))


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind)))


def _anchors(docs: DataFrame) -> DataFrame:
    """``rid, qs``: the anchors of each document's segments, in order."""

    def fn(texts: list) -> dict:
        out = []
        for t in texts:
            ws = words(_bytes(t))
            out.append(segments(Hashes(ws), len(ws))[0].view(np.int64) if len(ws) >= K else np.zeros(0, np.int64))
        return {"qs": _lists(out)}

    rows = common.map_texts(docs, fn, T.StructType([T.StructField("qs", T.ArrayType(T.LongType()))]), carry=["rid"])
    return rows.select("row.rid", "qs")


def _packed(docs: DataFrame) -> DataFrame:
    def fn(texts: list) -> dict:
        pack = zstandard.ZstdCompressor(level=3)
        return {"packed": [pack.compress(_bytes(t)) for t in texts]}

    out = T.StructType([T.StructField("packed", T.BinaryType())])
    return common.map_texts(docs, fn, out, carry=["rid"]).select("row.rid", "packed")


_SEGMENT = T.StructType([T.StructField(n, T.LongType()) for n in ("rid", "q", "c")] + [T.StructField(n, T.IntegerType()) for n in ("start", "n")])


def _segments(texts: DataFrame) -> DataFrame:
    """``rid, q, c, start, n``: the segments ``of`` rows (rid, packed, of) with a hash ``c`` of all
    their words."""
    arrow = common.to_arrow_schema(_SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in _SEGMENT.names]
            for rid, packed, of in zip(*(c.to_pylist() for c in b.columns)):
                ws = _unpack(packed)
                h = Hashes(ws)
                q, start, n = segments(h, len(ws))
                k = np.sort(np.array(of, np.int64))
                q, start, n = q[k].view(np.int64), start[k], n[k]
                c = h.of(start, start + n - 1 + K, 1).view(np.int64)
                for col, v in zip(cols, (np.full(len(k), rid), q, c, start, n)):
                    col.append(v)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(flat, arrow)], names=_SEGMENT.names)

    return texts.select("rid", "packed", "of").mapInArrow(run, _SEGMENT)


def _neighbours(repeated: DataFrame) -> DataFrame:
    """Repeated segments with the names of the repeated segment right before (``bq, bc``) and
    right after (``aq, ac``) in the document, else null."""
    place = Window.partitionBy("rid").orderBy("start")
    end = F.col("start") + F.col("n")
    follows, goes_before = F.lag(end).over(place) == F.col("start"), F.lead("start").over(place) == end
    beside = lambda c, step, near: F.when(near, step(c).over(place))
    return repeated.select(
        "*", beside("q", F.lag, follows).alias("bq"), beside("c", F.lag, follows).alias("bc"),
        beside("q", F.lead, goes_before).alias("aq"), beside("c", F.lead, goes_before).alias("ac"),
    )


def _names(repeated: DataFrame, several: DataFrame) -> DataFrame:
    """Per repeated segment (q, c): ``copies``, whether it ``goes_on`` with its only
    predecessor, and whether its anchor has other segments too (``unsure``)."""

    def only(*cols: str):
        """The columns' values where all copies have one and the same, else null."""
        one = F.lit(True)
        for c in cols:
            one = one & (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
        return [F.when(one, F.min(c)).alias(c) for c in cols]

    names = common.written(
        repeated.groupBy("q", "c").agg(F.count("*").alias("copies"), *only("bq", "bc"), *only("aq", "ac")), "segment-names"
    )
    # keys of both segments of a node: no branching node is a hot key
    left = names.where("aq is not null").select(F.col("q").alias("q0"), F.col("c").alias("c0"), "aq", "ac")
    right = names.where("bq is not null").select("q", "c", "bq", "bc")
    tied = right.join(
        left, (F.col("bq") == F.col("q0")) & (F.col("bc") == F.col("c0")) & (F.col("q") == F.col("aq")) & (F.col("c") == F.col("ac"))
    ).select(F.col("q").alias("tq"), F.col("c").alias("tc"))
    unsure = common.lookup(names.select("q", "c"), several, ["q"], ["sq"], "segments").select(F.col("q").alias("uq"), F.col("c").alias("uc"))
    full = names.join(tied, (F.col("q") == F.col("tq")) & (F.col("c") == F.col("tc")), "left")
    full = full.join(unsure, (F.col("q") == F.col("uq")) & (F.col("c") == F.col("uc")), "left")
    return full.select(
        F.col("q").alias("nq"), F.col("c").alias("nc"), "copies", F.col("tq").isNotNull().alias("goes_on"), F.col("uq").isNotNull().alias("unsure")
    )


def _paths(repeated: DataFrame, several: DataFrame) -> DataFrame:
    """Copies of non-branching paths: ``q, c`` (of the first segment), ``rid, start, n`` (edges)
    and ``unsure`` (q, start, n), the segments whose anchors have others too."""
    names = common.written(_names(repeated, several), "segment-flags")
    marked = common.lookup(repeated.select("rid", "q", "c", "start", "n"), names, ["q", "c"], ["nq", "nc"], "copies")
    place = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    number = marked.withColumn("path", F.sum((~F.col("goes_on")).cast("int")).over(place))
    first = F.min(F.struct("start", "q", "c"))
    doubt = F.collect_list(F.when(F.col("unsure"), F.struct("q", "start", "n")))
    rows = number.groupBy("rid", "path").agg(first.alias("first"), F.max(F.col("start") + F.col("n")).alias("end"), doubt.alias("unsure"))
    return rows.select("first.q", "first.c", "rid", "first.start", (F.col("end") - F.col("first.start")).alias("n"), "unsure")


def _edges(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``q, e, rid, at``: every edge of the segments ``wanted`` (rid, q, start, n), one row each."""
    per_doc = wanted.groupBy(F.col("rid").alias("r")).agg(F.collect_list(F.struct("q", "start", "n")).alias("want"))
    src = texts.join(per_doc, F.col("rid") == F.col("r")).select("rid", "packed", "want")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("q", "e", "rid")] + [T.StructField("at", T.IntegerType())])
    arrow = common.to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for rid, packed, want in zip(*(c.to_pylist() for c in b.columns)):
                h = Hashes(_unpack(packed))
                q, start, n = (np.array([x[f] for x in want], np.int64) for f in ("q", "start", "n"))
                at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
                for col, v in zip(cols, (np.repeat(q, n), h.of(at, at + K, 1).view(np.int64), np.full(len(at), rid), at)):
                    col.append(v)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(v).cast(f.type) for v, f in zip(flat, arrow)], names=arrow.names)

    return src.mapInArrow(run, schema)


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (rid, text), rids in the order of documents: ``rid, packed`` of the documents
    with repeats, all copies of repeated paths, and the edges that begin earlier elsewhere
    as runs ``rid, start, n``."""
    anchors = common.written(_anchors(docs), "anchors")
    rows = anchors.select("rid", F.posexplode("qs").alias("at", "q"))
    often = common.written(rows.groupBy(F.col("q").alias("often")).agg(F.count("*").alias("x")).where("x > 1"), "repeated-anchors")
    mine = common.lookup(rows, often, ["q"], ["often"], "x").groupBy(F.col("rid").alias("r")).agg(F.collect_list("at").alias("of"))
    texts = common.written(_packed(docs).join(mine, F.col("rid") == F.col("r")).drop("r"), "repeat-texts")
    common.dropped(anchors)
    common.dropped(often)
    found = common.written(_segments(texts), "segments")
    place = [F.min(c).alias(c) for c in ("rid", "start", "n")]  # of a segment found once, its own
    counted = common.written(found.groupBy("q", "c").agg(F.count("*").alias("copies"), *place), "segment-copies")
    several = counted.groupBy(F.col("q").alias("sq")).agg(F.count("*").alias("segments")).where("segments > 1")
    several = common.written(several, "segment-anchors")
    often = counted.where("copies > 1").select(F.col("q").alias("oq"), F.col("c").alias("oc"), "copies")
    again = common.written(_neighbours(common.lookup(found, often, ["q", "c"], ["oq", "oc"], "copies")), "repeated-segments")
    common.dropped(found)
    paths = common.written(_paths(again, several), "paths")
    common.dropped(again)
    sources = common.written(
        paths.groupBy(F.col("q").alias("sq"), F.col("c").alias("sc")).agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start")).alias("source")),
        "path-sources",
    )
    told = common.written(common.lookup(paths, sources.withColumn("n_copies", F.col("copies")), ["q", "c"], ["sq", "sc"], "copies"), "path-copies")
    common.dropped(paths)
    is_source = (F.col("rid") == F.col("source.rid")) & (F.col("start") == F.col("source.start"))
    # one copy of each segment whose anchor has others: those found once, and those of sources
    wanted = told.where(is_source).select("rid", F.explode("unsure").alias("u")).select("rid", "u.q", "u.start", "u.n")
    wanted = wanted.unionByName(counted.where("copies = 1").select("rid", "q", "start", "n"))
    edges = common.written(_edges(wanted, texts), "edges")
    twice = edges.groupBy(F.col("q").alias("eq"), F.col("e").alias("ee")).agg(F.count("*").alias("copies")).where("copies > 1")
    same = common.written(common.lookup(edges, common.written(twice, "edge-copies"), ["q", "e"], ["eq", "ee"], "copies"), "repeated-edges")
    common.dropped(edges)
    earliest = same.groupBy(F.col("q").alias("eq"), F.col("e").alias("ee")).agg(F.count("*").alias("copies"), F.min(F.struct("rid", "at")).alias("source"))
    later = common.lookup(same, common.written(earliest, "edge-sources"), ["q", "e"], ["eq", "ee"], "copies").where("rid <> source.rid or at <> source.at")
    removed = told.where(~is_source).select("rid", "start", "n").unionByName(later.select("rid", F.col("at").alias("start"), F.lit(1).alias("n")))
    return texts, told.where("n_copies > 1"), removed


def spans(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of words under edges (start, number of starts in a row)."""
    out: list[list[int]] = []
    for s, n in sorted(edges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + K)
        else:
            out.append([s, s + n - 1 + K])
    return [(s, e) for s, e in out]


def ordered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``rid, doc_id, text`` with unique long ``rid`` in the order of ids: the id where it is
    one, else numbers of a written copy dealt by ranges of (id, text)."""
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    if isinstance(rows.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        worst = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.max(F.col("doc_id").isNull()).alias("x")).first()
        if not worst["x"] and (worst["n"] or 0) <= 1:
            return rows.withColumn("rid", F.col("doc_id").cast("long"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return common.written(dealt.withColumn("rid", F.monotonically_increasing_id()), "ordered")


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``rid, doc_id, n_words, n_removed, kept_sha256`` and ``removed``, the word
    spans (start, end) that lie under edges which begin earlier."""
    rows = ordered(docs, doc_id, text)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", span)]
    )
    arrow = common.to_arrow_schema(out)

    def digest(ws: list[bytes], edges: list[tuple[int, int]]) -> tuple:
        cut = spans(edges)
        kept, last = [], 0
        for s, e in cut:
            kept += ws[last:s]
            last = e
        kept += ws[last:]
        return len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": s, "end": e} for s, e in cut]

    def table_of(got: list[tuple]) -> list[pa.Array]:
        return [pa.array([g[i] for g in got], f.type) for i, f in enumerate(arrow)]

    texts, _, removed = repeated(rows.select("rid", "text"))
    whole = lambda ts: dict(zip(arrow.names, table_of([digest(words(_bytes(t)), []) for t in ts])))
    plain = common.map_texts(rows, whole, out, carry=["rid", "doc_id"])
    schema = T.StructType([T.StructField("r", T.LongType()), *[T.StructField("x_" + f.name, f.dataType) for f in out.fields]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [digest(_unpack(t), [(x["start"], x["n"]) for x in e]) for t, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *table_of(got)], names=schema.names)

    per_doc = removed.groupBy(F.col("rid").alias("w")).agg(F.collect_list(F.struct("start", "n")).alias("edges"))
    changed = texts.select("rid", "packed").join(per_doc, F.col("rid") == F.col("w")).select("rid", "packed", "edges").mapInArrow(cut, schema)
    both = plain.select("row.rid", "row.doc_id", *out.names).join(changed, F.col("rid") == F.col("r"), "left")
    return both.select("rid", "doc_id", *[F.coalesce(F.col("x_" + n), F.col(n)).alias(n) for n in out.names])


def passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All copies of repeated non-branching paths: ``doc_id, start, end`` (words), ``path`` (the
    same for all copies), ``n_copies``, and whether the copy ``is_source``."""
    rows = ordered(docs, doc_id, text)
    _, copies, _ = repeated(rows.select("rid", "text"))
    copies = copies.select(
        F.col("rid").alias("r"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") - 1 + K).cast("long").alias("end"),
        F.concat_ws(":", F.hex("q"), F.hex("c")).alias("path"), "n_copies",
        ((F.col("rid") == F.col("source.rid")) & (F.col("start") == F.col("source.start"))).alias("is_source"),
    )
    return copies.join(rows.select("rid", "doc_id"), F.col("r") == F.col("rid")).select("doc_id", "start", "end", "path", "n_copies", "is_source")
