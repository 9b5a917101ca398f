"""Repeated passages by prefix-free parsing.

A byte is removed if some ``LENGTH``-byte string over it starts anywhere else too.

*Parsing.* A rolling hash runs over ``GRAM`` bytes; a position is a trigger if it has
the least hash of some ``SPAN`` positions in a row (the rightmost of equals). Whether
a trigger counts inside a window of ``LENGTH`` bytes depends on the window's bytes
alone, and every window holds two triggers at least, so equal windows hold the same
phrases (from one trigger to the end of the next) at the same offsets. The longest
phrase of a window (of equals the one with the greater hash, then the rightmost) is
its anchor. Windows in a row with one anchor are a piece, about 80 of them.

*Dictionary.* Anchors are counted over the corpus. A piece whose anchor is found once
holds no repeat; for text that seldom repeats, that ends nearly all the work.

*Parse.* Pieces that remain are named by their anchor and all their bytes (their
context). Contexts found twice are repeats as a whole; an anchor with one context
needs no more.

*Order.* Where one anchor has several contexts, one copy of each context is brought
together and their windows are put into suffix order (by their first eight bytes,
equal beginnings by a 128-bit hash of the window); equal neighbours are repeats. An
anchor with more than ``ORDERED`` contexts would be a hot group: the windows of ``CELL``
neighbouring places from the anchor are counted by the bytes they all share, then by all
their bytes, and only where the first agree and the second differ by their own 128-bit
hash, which spreads them.

So a corpus-wide suffix array is built only over one copy of each context whose
anchor is ambiguous; nothing is put in order that the dictionary or the parse decides.
A context is told from another by the anchor's hash and a hash of all its bytes with
another base, 128 bits together. Texts travel compressed.

Defined cases: a null text has no bytes; texts shorter than ``LENGTH`` lose nothing;
matches never cross documents; repeated rows are repeats of each other; ids that are
null or not unique are replaced by row numbers in a written copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common

LENGTH = 200
GRAM = 16
SPAN = 88
#: Contexts of one parse that are ordered in one task; beyond, windows are counted by hash.
ORDERED = 2048
#: Neighbouring windows that are counted by what they share, where contexts are counted.
CELL = 16
#: Context bytes that are ordered at a time (and at least one whole anchor).
ORDERED_BYTES = 1_000_000

#: A window of LENGTH bytes holds this many runs of SPAN positions; over SPAN of them, so two triggers.
assert LENGTH - GRAM + 1 - SPAN + 1 > SPAN
_BACK = SPAN + GRAM - 1 - LENGTH  # a trigger counts from the window start (its first run + _BACK) on

_TABLE = np.random.default_rng(20240607).integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo 2^64, up to n."""
    global _POWERS
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(1 << 17, 1 << n.bit_length())
        full = []
        for base in _BASES:
            for x in (base, pow(base, -1, 2**64)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                full.append(np.multiply.accumulate(p))
        _POWERS = full
    return _POWERS


class Hashes:
    """Hashes of any slices of a byte string, from running sums."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.powers = _powers(len(data) + 1)
        self.sums: dict[int, np.ndarray] = {}

    def _sums(self, k: int) -> np.ndarray:
        if k not in self.sums:
            s = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[k][self.data] * self.powers[2 * k][: len(self.data)], out=s[1:])
            self.sums[k] = s
        return self.sums[k]

    def of(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        s = self._sums(k)
        return _scattered((s[end] - s[start]) * self.powers[2 * k + 1][start], (end - start).astype(np.uint64))

    def all(self, n: int) -> np.ndarray:
        """Hashes of all slices of ``n`` bytes, in order."""
        s = self._sums(0)
        return _scattered((s[n:] - s[: len(s) - n]) * self.powers[1][: len(s) - n], np.uint64(n))


def _scattered(h: np.ndarray, n) -> np.ndarray:
    h = h + n * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Parse:
    """Triggers of one text: positions and the first and last run each is least of."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        self.size = len(b)
        self.hashes = Hashes(b)
        at = np.arange(len(b) - GRAM + 1)
        key = self.hashes.all(GRAM) & np.uint64(0xFFFFFFFF00000000)
        key |= (0xFFFFFFFF - at).astype(np.uint64)
        step = 1
        while step * 2 <= SPAN:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if SPAN > step:
            key = np.minimum(key[: len(key) - (SPAN - step)], key[SPAN - step :])
        least = 0xFFFFFFFF - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(least[1:] != least[:-1]) + 1
        self.first = np.concatenate([[0], edge])
        self.last = np.concatenate([edge - 1, [len(least) - 1]])
        self.at = least[self.first]

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, first window, number of windows and place of the anchor of the
        pieces, in order."""
        windows = self.size - LENGTH + 1
        starts = np.unique(np.concatenate([[0], self.last + 1, self.first + _BACK]))
        starts = starts[(starts >= 0) & (starts < windows)]
        # the triggers that count in the windows from each start on: a to b
        a = np.searchsorted(self.last, starts, "left")
        b = np.searchsorted(self.first + _BACK, starts, "right") - 1
        h = self.hashes.of(self.at[:-1], self.at[1:] + GRAM)
        rank = (np.diff(self.at).astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
        best = a.copy()
        for d in range(1, int((b - a).max())):
            k = np.minimum(a + d, b - 1)
            best = np.where(rank[k] >= rank[best], k, best)
        new = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        first = starts[new]
        return h[best[new]], first, np.diff(np.append(first, windows)), self.at[best[new]]


def parse(text: str | None) -> Parse | None:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return Parse(data) if len(data) >= LENGTH else None


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in names])


def _pieces(docs: DataFrame) -> DataFrame:
    """``rid`` and lists ``q, start, n`` of all pieces: anchor, first window, number of windows."""

    def fn(texts: list) -> dict:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        got = [none if p is None else p.pieces() for p in map(parse, texts)]
        return {"q": _lists([g[0].view(np.int64) for g in got]), "start": _lists([g[1] for g in got]), "n": _lists([g[2] for g in got])}

    return common.map_texts(docs, fn, _longs("q", "start", "n"), carry=["rid"]).select("row.rid", "q", "start", "n")


def _candidates(pieces: DataFrame) -> DataFrame:
    """``r, of``: the documents with pieces whose anchor is found again, and those pieces."""
    p = pieces.select("rid", F.explode(F.arrays_zip("q", "start", "n")).alias("p")).select("rid", "p.q", "p.start", "p.n")
    often = p.groupBy(F.col("q").alias("often")).agg(F.count("*").alias("asked")).where("asked > 1")
    mine = common.lookup(p, common.written(often, "repeat-anchors"), ["q"], ["often"], "asked")
    return mine.groupBy(F.col("rid").alias("r")).agg(F.collect_list(F.struct("q", "start", "n")).alias("of"))


def _packed(docs: DataFrame) -> DataFrame:
    """``rid, packed``: texts as compressed UTF-8, which is what is shuffled."""

    def fn(texts: list) -> dict:
        pack = zstandard.ZstdCompressor(level=3)
        return {"packed": [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]}

    out = T.StructType([T.StructField("packed", T.BinaryType())])
    return common.map_texts(docs, fn, out, carry=["rid"]).select("row.rid", "packed")


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _contexts(texts: DataFrame) -> DataFrame:
    """``rid, q, c, start, n``: the pieces ``of`` rows (rid, packed, of) with a hash of their bytes."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("rid", "q", "c")] + [T.StructField(n, T.IntegerType()) for n in ("start", "n")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for rid, packed, of in zip(*(c.to_pylist() for c in b.columns)):
                h = Hashes(np.frombuffer(unpack(packed), np.uint8))
                q, s, n = (np.array([x[k] for x in of], np.int64) for k in ("q", "start", "n"))
                c = h.of(s, s + n - 1 + LENGTH, 1).view(np.int64)
                for col, v in zip(cols, (np.full(len(s), rid), q, c, s, n)):
                    col.append(v)
            flat = [np.concatenate(c) for c in cols] if cols[0] else [np.zeros(0, np.int64)] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.astype(np.int64 if k < 3 else np.int32)) for k, v in enumerate(flat)], names=names
            )

    return texts.select("rid", "packed", "of").mapInArrow(run, schema)


def _with_bytes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``wanted`` with the bytes of their context out of ``texts``."""
    per_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("q", "c", "many", "crowd", "start", "n")).alias("want"))
    src = texts.select(F.col("rid").alias("r"), "packed").join(per_doc, F.col("r") == F.col("rid")).select("packed", "want")
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("q", "c")]
        + [T.StructField(n, T.BooleanType()) for n in ("many", "crowd")]
        + [T.StructField("data", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for packed, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = unpack(packed)
                out += [(x["q"], x["c"], x["many"], x["crowd"], data[x["start"] : x["start"] + x["n"] - 1 + LENGTH]) for x in want]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*out), common.to_arrow_schema(schema))], names=schema.names
                )

    return src.mapInArrow(run, schema)


def order_windows(contexts: list[bytes], many: list[bool], anchors: list[int]) -> list[np.ndarray]:
    """For each context, the windows in it that another context of its anchor (or, if it
    is found ``many`` times, another copy) holds too.

    All windows are put into suffix order within their anchor: by their first eight
    bytes, equal beginnings by two hashes of the window, so that equal windows are
    neighbours.
    """
    sizes = np.array([len(c) - LENGTH + 1 for c in contexts])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(ends[-1]) - (ends - sizes)[owner]
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])[:-1]
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    at = base[owner] + offset
    hashes = Hashes(flat)
    head = np.lib.stride_tricks.sliding_window_view(flat, 8)[at].view(">u8").ravel().astype(np.uint64)
    keys = (hashes.of(at, at + LENGTH, 1), hashes.of(at, at + LENGTH), head, np.array(anchors, np.int64)[owner])
    order = np.lexsort(keys)
    differs = np.zeros(len(at), bool)
    differs[0] = True
    for k in keys:
        k = k[order]
        differs[1:] |= k[1:] != k[:-1]
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(differs) - 1
    hit = np.bincount(group, weights=np.where(many, 2, 1)[owner])[group] > 1
    return [offset[s:e][hit[s:e]] for s, e in zip(ends - sizes, ends)]


_HITS = T.StructType(
    [T.StructField("q", T.LongType()), T.StructField("c", T.LongType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))]
)


def _ordered(rows: DataFrame) -> DataFrame:
    """``q, c, offsets`` of contexts found once, by suffix order within an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solve() -> pa.RecordBatch:
            hits = order_windows([h[3] for h in held], [h[2] for h in held], [h[0] for h in held])
            out = [(h[0], h[1], x.tolist()) for h, x in zip(held, hits) if not h[2] and len(x)]
            arrow = common.to_arrow_schema(_HITS)
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], arrow[k].type) for k in range(3)], names=arrow.names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                # whole anchors are ordered together, many small ones at a time
                if size >= ORDERED_BYTES and row[0] != held[-1][0]:
                    yield solve()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve()

    dealt = rows.select("q", "c", "many", "data").repartition("q").sortWithinPartitions("q")
    return dealt.mapInArrow(run, _HITS)


_KERNEL = T.StructType([T.StructField(n, T.LongType()) for n in ("q", "c", "cell", "w", "u1", "u2", "first", "last", "weight")])
_WINDOW = T.StructType([T.StructField(n, T.LongType()) for n in ("w1", "w2", "q", "c", "at", "weight")])


def _kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts (q, c, many, data): the kernels and hulls of their cells and the windows in each."""
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in _KERNEL.names]
        for q, c, many, data in zip(*(x.to_pylist() for x in b.columns)):
            p = Parse(data)
            anchor = int(p.pieces()[3][0])
            cell = np.arange(-anchor // CELL, (len(data) - LENGTH - anchor) // CELL + 1)
            w = p.hashes.of(anchor + (cell + 1) * CELL - 1, anchor + cell * CELL + LENGTH)
            first = np.maximum(anchor + cell * CELL, 0)
            last = np.minimum(anchor + (cell + 1) * CELL - 1, len(data) - LENGTH)
            u = [p.hashes.of(first, last + LENGTH, k).view(np.int64) for k in range(2)]
            full = lambda v: np.full(len(cell), v, np.int64)  # noqa: E731, B023
            for col, v in zip(cols, (full(q), full(c), cell, w.view(np.int64), *u, first, last, full(1 + many))):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in cols], names=_KERNEL.names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts (q, c, data, parts): every window of their parts."""
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in _WINDOW.names]
        for q, c, data, parts in zip(*(x.to_pylist() for x in b.columns)):
            h = Hashes(np.frombuffer(data, np.uint8))
            at = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in parts])
            weight = np.repeat([x["weight"] for x in parts], [x["last"] - x["first"] + 1 for x in parts])
            full = lambda v: np.full(len(at), v, np.int64)  # noqa: E731, B023
            values = (h.of(at, at + LENGTH).view(np.int64), h.of(at, at + LENGTH, 1).view(np.int64), full(q), full(c), at, weight)
            for col, v in zip(cols, values):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in cols], names=_WINDOW.names)


def _counted(rows: DataFrame) -> DataFrame:
    """``q, c, offsets`` of contexts found once, by counting hashes.

    Windows at neighbouring places from their anchor share a kernel, the bytes that all
    ``CELL`` of them hold, and lie in a hull, the bytes that any of them holds. Kernels are
    counted first. A hull found twice is a repeat as a whole. Only where a kernel lies in
    hulls that differ are windows counted themselves, once for each such hull.
    """
    kernels = common.written(rows.select("q", "c", "many", "data").mapInArrow(_kernels, _KERNEL), "kernels")
    often = kernels.groupBy("q", "cell", "w").agg(F.sum("weight").alias("asked")).where("asked > 1")
    often = common.written(often.select(F.col("q").alias("kq"), F.col("cell").alias("kc"), F.col("w").alias("kw"), "asked"), "repeat-kernels")
    found = common.written(common.lookup(kernels, often, ["q", "cell", "w"], ["kq", "kc", "kw"], "asked"), "repeat-cells")
    hulls = found.groupBy("q", "cell", "w", "u1", "u2").agg(F.sum("weight").alias("asked"), F.min(F.struct("c", "first", "last")).alias("one"))
    hulls = common.written(hulls, "repeat-hulls")
    same = hulls.where("asked > 1").select(*[F.col(n).alias("h" + n) for n in ("q", "cell", "u1", "u2")], "asked")
    whole = common.lookup(found.where("weight = 1"), same, ["q", "cell", "u1", "u2"], ["hq", "hcell", "hu1", "hu2"], "asked")
    differ = hulls.groupBy(F.col("q").alias("kq"), F.col("cell").alias("kc"), F.col("w").alias("kw")).agg(F.count("*").alias("kinds")).where("kinds > 1")
    unsure = common.lookup(hulls, common.written(differ, "unsure-kernels"), ["q", "cell", "w"], ["kq", "kc", "kw"], "kinds")
    part = F.struct("one.first", "one.last", F.least("asked", F.lit(2)).alias("weight"))
    per_context = unsure.groupBy(F.col("q").alias("fq"), F.col("one.c").alias("fc")).agg(F.collect_list(part).alias("parts"))
    src = rows.join(per_context, (F.col("q") == F.col("fq")) & (F.col("c") == F.col("fc"))).select("q", "c", "data", "parts")
    windows = common.written(src.mapInArrow(_windows, _WINDOW), "repeat-windows")
    twice = windows.groupBy(F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(F.sum("weight").alias("asked")).where("asked > 1")
    hits = common.lookup(windows.where("weight = 1"), common.written(twice, "windows-twice"), ["w1", "w2"], ["v1", "v2"], "asked")
    runs = whole.select("q", "c", F.sequence("first", "last").alias("run")).unionByName(hits.select("q", "c", F.array("at").alias("run")))
    offsets = F.array_sort(F.flatten(F.collect_list("run"))).cast("array<int>")
    return runs.groupBy("q", "c").agg(offsets.alias("offsets"))


def covered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (rid, text): candidate documents (rid, packed) and, by rid, the windows
    repeated elsewhere as ``windows``: structs (start, n) of window starts in a row."""
    docs = docs.select("rid", "text")
    parsed = common.written(_pieces(docs), "parse")
    found = _packed(docs).join(_candidates(parsed), F.col("rid") == F.col("r")).drop("r")
    texts = common.written(found, "repeat-texts")
    common.dropped(parsed)
    pieces = common.written(_contexts(texts), "repeat-pieces")
    contexts = common.written(
        pieces.groupBy("q", "c").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start", "n")).alias("one")), "repeat-contexts"
    )
    anchors = contexts.groupBy(F.col("q").alias("p")).agg(F.count("*").alias("asked"), F.min("copies").alias("fewest")).where("asked > 1 and fewest = 1")
    anchors = common.written(anchors.select("p", "asked", (F.col("asked") > ORDERED).alias("crowd")), "unsure-anchors")
    unsure = common.lookup(contexts, anchors, ["q"], ["p"], "asked").select(
        "q", "c", (F.col("copies") > 1).alias("many"), "crowd", "one.rid", "one.start", "one.n"
    )
    data = common.written(_with_bytes(unsure, texts), "repeat-bytes")
    some = common.written(_ordered(data.where("not crowd")).unionByName(_counted(data.where("crowd"))), "repeat-hits")
    whole = contexts.where("copies > 1").select("q", "c", F.lit(None).cast("array<int>").alias("offsets"), "copies")
    hits = whole.unionByName(some.withColumn("copies", F.lit(1).cast("long"))).select(F.col("q").alias("h1"), F.col("c").alias("h2"), "offsets", "copies")
    of = common.lookup(pieces, common.written(hits, "context-hits"), ["q", "c"], ["h1", "h2"], "copies")
    runs = F.when(F.col("offsets").isNull(), F.array(F.struct(F.col("start"), F.col("n")))).otherwise(
        F.transform("offsets", lambda o: F.struct((F.col("start") + o).alias("start"), F.lit(1).alias("n")))
    )
    return texts, of.groupBy("rid").agg(F.flatten(F.collect_list(runs)).alias("windows"))


def spans(size: int, windows: list) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows (start, number of starts in a row)."""
    out: list[list[int]] = []
    for s, n in sorted(windows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + LENGTH)
        else:
            out.append([s, s + n - 1 + LENGTH])
    return [(s, e) for s, e in out]


_DIGEST = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and
    ``removed``, the byte spans (start, end) that repeat elsewhere."""
    rows = common.numbered(docs.select(doc_id, text), doc_id, text)
    rows = rows.select("rid", F.col("row").getField(doc_id).alias("doc_id"), "text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([*_DIGEST.fields, T.StructField("removed", span)])
    kind = common.to_arrow_schema(out).field("removed").type

    def digest(data: bytes, windows: list) -> tuple:
        cut = spans(len(data), windows)
        kept, last = hashlib.sha256(), 0
        for s, e in cut:
            kept.update(data[last:s])
            last = e
        kept.update(data[last:])
        return len(data), sum(e - s for s, e in cut), len(cut), kept.hexdigest(), [{"start": s, "end": e} for s, e in cut]

    def table_of(got: list[tuple]) -> dict:
        names = [f.name for f in out.fields]
        cols = {n: [g[i] for g in got] for i, n in enumerate(names)}
        return cols | {"removed": pa.array(cols["removed"], kind)}

    texts, windows = covered(rows)
    plain = common.map_texts(rows, lambda ts: table_of([digest(t.encode("utf-8", "surrogatepass") if t else b"", []) for t in ts]), out, carry=["rid", "doc_id"])

    schema = T.StructType([T.StructField("r", T.LongType()), *[T.StructField("x_" + f.name, f.dataType) for f in out.fields]])
    arrow = common.to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [digest(unpack(t), [(x["start"], x["n"]) for x in w]) for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = table_of(got)
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], a.type) for f, a in zip(out.fields, list(arrow)[1:])],
                names=arrow.names,
            )

    with_windows = texts.select("rid", "packed").join(windows.withColumnRenamed("rid", "w"), F.col("rid") == F.col("w")).select("rid", "packed", "windows")
    changed = with_windows.mapInArrow(cut, schema)
    both = plain.select("row.rid", "row.doc_id", *out.names).join(changed, F.col("rid") == F.col("r"), "left")
    return both.select("rid", "doc_id", *[F.coalesce(F.col("x_" + n), F.col(n)).alias(n) for n in out.names])
