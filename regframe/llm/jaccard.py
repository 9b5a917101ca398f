"""N-gram Jaccard join: links of 0.75 or more between sets of five-word shingles.

Equal sets (by size and a 128-bit hash) are one class, named by its least document.
Candidates come from prefix filtering, which is exact for any one order of the
shingles: two sets that link share a shingle among the first ``n - ceil(3n/4) + 1`` of
each. The order puts frequent shingles last (at most ``FREQUENT`` of them, which bounds
the broadcast), then goes by hash. It only decides how many candidates there are, never
which links.

A shingle's place in the order bounds what is left: if a pair's first shingle in common
has ``rest`` shingles from it on in each set, the overlap is at most the lesser ``rest``. A
pair is only proposed where that leaves a link possible, which holds at its first
shingle in common if it is one. Shingles of a document's own come first, so sets that are
somewhat alike but do not link are mostly told apart by this alone.

Near copies share many prefix shingles, so one group of classes comes once for each of
them: of groups with the same members (by their number, least and hash) the one of the
first shingle in order stays, where every member has the greatest rest.

A group is first checked against a pivot of the group (linear in its size), round after
round with another pivot, as long as at least ``WORTH`` of the pairs compared are links.
Groups that still hold two components or more go to signature trees: classes are leaves,
nodes hold the union of the token bitmaps, the size range and the component below them,
and the tree is walked against itself. A node pair is dropped if the sizes cannot match,
if both hold one and the same component, or if the greatest possible overlap (bits in
common plus the tokens that share a bit) is less than a link needs. What is left is
compared exactly. A large group is cut into blocks of ``BLOCK`` rows and walked by pairs
of blocks. Groups with the same least class are walked in the same task (spread over
``SPREAD`` tasks), which proposes a pair once however many of them hold it.

All pairs of a group are never made, and no link between different sets is lost:
two sets of one component need no further link between them.

Defined cases: a document without words has an empty set, no links, and is its own
component; fewer than five words are one shingle; equal texts are one class; a null
doc_id is ignored when the smallest id of a component is taken (null if all are); rows
that repeat an id count as documents of their own; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common, graph

SHINGLE = 5
#: At most so many shingles are ordered last (the bound of the broadcast, 8 bytes each):
#: those found more than ``LEAST_FREQUENT`` times, of too many the most frequent.
FREQUENT = 1 << 21
LEAST_FREQUENT = 4
#: Shingles counted together before the rare ones are let go (counts only steer the order).
COUNT_CHUNK = 8_000_000
COUNT_LEAST = 2
#: Bitmaps have eight to sixteen bits a shingle, a power of two between these.
LEAST_BITS, MOST_BITS = 1 << 9, 1 << 16
FANOUT = 16
#: Rows of small groups that are compared together.
POOL = 8192
BLOCK = 2048
#: Members of a pivot that are compared in one task.
PART = 256
#: Tasks over which the groups of one least class are spread.
SPREAD = 32
#: Pairs that a task remembers to have proposed; then it starts anew (a pair may come twice).
REMEMBERED = 1 << 21
#: Another round of pivots is made while at least this share of the pairs compared link.
WORTH = 0.1

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashed shingles of the text, sorted."""
    return np.unique(_hashed(text, size))


def _hashed(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashed shingles of the text, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * _P + w[j : len(w) - n + 1 + j]
    return _mix(h)


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit hashes of sets, as two signed numbers each."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bitmap(s: np.ndarray) -> np.ndarray:
    size = min(MOST_BITS, max(LEAST_BITS, 1 << int(8 * len(s) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def _fold(bits: np.ndarray) -> np.ndarray:
    """The bitmap of half the size: positions modulo a power of two fall together."""
    half = len(bits) // 2
    return bits[:half] | bits[half:]


def _frequent(docs: DataFrame, text: str) -> np.ndarray:
    """The most frequent shingles, at most ``FREQUENT``, sorted.

    Each task counts chunks and lets go what a chunk holds fewer than ``COUNT_LEAST``
    times; the sums by shingle are exact enough to order by.
    """
    common.short_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= COUNT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(_signed(t[keep])), pa.array(n[keep])], names=names)

        for b in batches:
            for t in b.column(0).to_pylist():
                s = _hashed(t)  # a shingle twice in a text counts twice
                held.append(s)
                size += len(s)
                if size >= COUNT_CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(docs[f"`{text}`"].cast("string").alias("text")).mapInArrow(run, schema)
    sums = common.written(rows.groupBy("token").agg(F.sum("n").alias("n")), "shingle-counts")
    # how many shingles have each order of magnitude of counts, in steps of a quarter
    step = F.floor(F.log2("n") * 4).cast("int")
    steps = sorted(sums.where(F.col("n") > LEAST_FREQUENT).groupBy(step.alias("step")).count().collect(), reverse=True)
    limit, room = float(LEAST_FREQUENT), FREQUENT
    for r in steps:
        room -= r["count"]
        if room < 0:
            limit = max(limit, 2 ** ((r["step"] + 1) / 4) - 1e-6)
            break
    found = sums.where(F.col("n") > limit).select("token").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(3n/4) + 1`` shingles: rare ones first, then by hash."""
    k = len(s) - (3 * len(s) + 3) // 4 + 1 if len(s) else 0
    if len(frequent) and k:
        at = np.searchsorted(frequent, s)
        often = frequent[np.minimum(at, len(frequent) - 1)] == s
        s = s[np.argsort(often, kind="stable")]
    return s[:k]


def signatures(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per row (rid, text): ``rid, n, k0, k1`` (the set's name) and ``prefix``."""
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(frequent))
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("n", "k0", "k1")] + [T.StructField("prefix", T.ArrayType(T.LongType()))])

    def fn(texts: list) -> dict:
        sets = [shingles(t) for t in texts]
        heads = [_signed(prefix(s, shared.value)) for s in sets]
        ends = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
        flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        names = _names(sets)
        return {
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "k0": pa.array(names[:, 0]),
            "k1": pa.array(names[:, 1]),
            "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
        }

    got = common.map_texts(rows, fn, out, carry=["rid"])
    return got.select("row.rid", "n", "k0", "k1", "prefix")


def _texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, packed``: the compressed text of each class in ``keys`` (column ``g``).

    A text is a third of its hashed shingles, so it is texts that travel to be compared.
    """

    def fn(texts: list) -> dict:
        pack = zstandard.ZstdCompressor(level=3)
        return {"packed": pa.array([pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())}

    packed = common.map_texts(rows, fn, T.StructType([T.StructField("packed", T.BinaryType())]), carry=["rid"])
    return packed.select(F.col("row.rid").alias("key"), "packed").join(keys, F.col("key") == F.col("g"), "left_semi")


def _unpack(packed: bytes) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the written ``pairs`` (a, b) those that link, compared exactly.

    The members a of each b travel to b; a b with many members is cut into parts of
    about ``PART`` members, each with its own copy of b. A task holds one set of b at
    a time and streams its members past it.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = pairs.join(sizes.withColumnRenamed("b", "s"), F.col("b") == F.col("s")).select(
        F.col("a").alias("at"), F.struct("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member")).alias("to")
    )
    owners = sizes.select(F.col("b").alias("at"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        "at", F.struct("b", "part", F.lit(0).alias("member")).alias("to")
    )
    rows = texts.join(members.unionByName(owners), F.col("key") == F.col("at")).select("to.b", "to.part", "to.member", "key", "packed")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for b, member, key, packed in zip(*(c.to_pylist() for c in batch.columns)):
                s = _unpack(packed)
                if not member:
                    own = s
                    continue
                i = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * i >= 75 * (len(own) + len(s) - i):
                    out.append((key, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], names=["a", "b"]
            )

    dealt = rows.repartition("b", "part").sortWithinPartitions("b", "part", "member")
    return dealt.select("b", "member", "key", "packed").mapInArrow(run, schema)


class _Level:
    """Nodes of one level: union bitmaps, size range, tokens beyond bits, greatest rest, and
    labels (rows of one array): a label that all leaves below share, or -1. Nodes with the
    same label hold no pair that is asked for."""

    def __init__(self, bits, low, high, excess, rest, labels):
        self.bits, self.low, self.high, self.excess, self.rest, self.labels = bits, low, high, excess, rest, labels

    def above(self) -> _Level:
        starts = np.arange(0, len(self.low), FANOUT)
        least, most = (f.reduceat(self.labels, starts, axis=1) for f in (np.minimum, np.maximum))
        return _Level(
            np.bitwise_or.reduceat(self.bits, starts, axis=0),
            np.minimum.reduceat(self.low, starts),
            np.maximum.reduceat(self.high, starts),
            np.maximum.reduceat(self.excess, starts),
            np.maximum.reduceat(self.rest, starts),
            np.where(least == most, least, -1),
        )

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (4 * self.high[a] >= 3 * self.low[b]) & (4 * self.high[b] >= 3 * self.low[a])
        ok &= np.minimum(self.rest[a], self.rest[b]) * 7 >= 3 * (self.low[a] + self.low[b])
        ok &= ((self.labels[:, a] != self.labels[:, b]) | (self.labels[:, a] < 0)).all(0)
        k = np.flatnonzero(ok)
        overlap = np.bitwise_count(self.bits[a[k]] & self.bits[b[k]]).sum(1, dtype=np.int64)
        overlap += np.minimum(self.excess[a[k]], self.excess[b[k]])
        ok[k] = overlap * 7 >= 3 * (self.low[a[k]] + self.low[b[k]])
        return ok


def tree_pairs(bits: np.ndarray, n: np.ndarray, rest: np.ndarray, *labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that may link and differ in every label, by walking the tree against
    itself. ``bits``: one bitmap a row, all of one size; ``rest``: the most that each row
    can have in common with another."""
    if len(n) < 2:
        return
    table = np.array([np.unique(x, return_inverse=True)[1] for x in labels]).reshape(len(labels), len(n))
    order = np.lexsort((n, *table[::-1]))
    words = np.ascontiguousarray(bits[order]).view(np.uint64)
    excess = n[order] - np.bitwise_count(words).sum(1, dtype=np.int64)
    levels = [_Level(words, n[order], n[order], excess, rest[order], table[:, order])]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above())
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    kids = np.arange(FANOUT)
    while todo:
        depth, a, b = todo.pop()
        ok = levels[depth].may_link(a, b)
        if depth == 0:
            ok &= a < b
            if ok.any():
                yield order[a[ok]], order[b[ok]]
            continue
        a, b = a[ok], b[ok]
        below = len(levels[depth - 1].low)
        for s in range(0, len(a), 64):  # at most 64 * FANOUT * FANOUT node pairs at a time
            x = (a[s : s + 64, None, None] * FANOUT + kids[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
            y = (b[s : s + 64, None, None] * FANOUT + kids[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
            x, y = x.ravel(), y.ravel()
            k = (x < below) & (y < below) & (x <= y)
            todo.append((depth - 1, x[k], y[k]))


def group_pairs(bits: list[bytes], n: np.ndarray, rest: np.ndarray, *labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`tree_pairs` over bitmaps of several sizes: sets that link are at most a
    third apart, so their bitmaps are of one size or of neighbouring sizes; each size is
    walked with the next larger one folded to it."""
    sizes = np.array([len(x) for x in bits])
    for size in np.unique(sizes):
        own, next_up = np.flatnonzero(sizes == size), np.flatnonzero(sizes == 2 * size)
        next_up = next_up[3 * n[next_up] <= 4 * n[own].max()]
        rows = np.concatenate([own, next_up])
        maps = [np.frombuffer(bits[i], np.uint8) for i in own] + [_fold(np.frombuffer(bits[i], np.uint8)) for i in next_up]
        # pairs of two larger ones come with their own size: one label for all of these
        larger = np.concatenate([1 + np.arange(len(own)), np.zeros(len(next_up), np.int64)])
        for i, j in tree_pairs(np.array(maps), n[rows], rest[rows], larger, *[x[rows] for x in labels]):
            yield rows[i], rows[j]


def leaf_pairs(group: np.ndarray, bits: list[bytes], n: np.ndarray, rest: np.ndarray, *labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`group_pairs` for many groups of at most ``FANOUT`` rows at once: the trees
    that are a single node. Rows of a group stand together."""
    sizes = np.array([len(x) for x in bits])
    for d in range(1, FANOUT):
        i = np.flatnonzero(group[d:] == group[:-d])
        j = i + d
        ok = (4 * n[i] >= 3 * n[j]) & (4 * n[j] >= 3 * n[i])
        ok &= np.minimum(rest[i], rest[j]) * 7 >= 3 * (n[i] + n[j])
        for x in labels:
            ok &= (x[i] != x[j]) | (x[i] < 0)
        i, j = i[ok], j[ok]
        least = np.minimum(sizes[i], sizes[j])
        for size in np.unique(least):
            k = np.flatnonzero(least == size)
            sides = []
            for rows in (i[k], j[k]):
                maps = [np.frombuffer(bits[r], np.uint8) for r in rows]
                sides.append(np.array([m if len(m) == size else _fold(m) for m in maps]).view(np.uint64))
            a, b = sides
            count = lambda m: np.bitwise_count(m).sum(1, dtype=np.int64)
            overlap = count(a & b) + np.minimum(n[i[k]] - count(a), n[j[k]] - count(b))
            fits = k[overlap * 7 >= 3 * (n[i[k]] + n[j[k]])]
            if len(fits):
                yield i[fits], j[fits]


def _tree_candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b) that may link, from rows ``token, least, x, y, key, n, rest, comp, bits``: block x
    of a group against block y of it. Dealt by the group's least class, so that groups
    which hold the same pair meet in one task, where it is proposed once."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        small: list[tuple] = []
        proposed: set[tuple[int, int]] = set()
        name, number = None, 0

        def batch(rows: list[tuple], pairs) -> Iterator[pa.RecordBatch]:
            key = np.array([r[0] for r in rows], np.int64)
            for i, j in pairs:
                if len(proposed) > REMEMBERED:
                    proposed.clear()
                lo, hi = np.minimum(key[i], key[j]).tolist(), np.maximum(key[i], key[j]).tolist()
                new = set(zip(lo, hi)) - proposed
                proposed.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def columns(rows: list[tuple]) -> tuple:
            _, n, rest, comp, block, bits, *group = zip(*rows)
            numbers = [np.array(x, np.int64) for x in (n, rest, comp, block)]
            return bits, *numbers, np.array(group).ravel()

        def flush() -> Iterator[pa.RecordBatch]:
            bits, n, rest, comp, block, group = columns(small)
            # components are any 64-bit numbers: name them from 0 on
            yield from batch(small, leaf_pairs(group, bits, n, rest, np.unique(comp, return_inverse=True)[1], block))
            small.clear()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            across = name[1] != name[2]  # block x against block y: only pairs between them
            if len(held) <= FANOUT:
                number += 1
                small.extend((*r[:4], r[4] if across else -1, r[5], number) for r in held)
                if len(small) >= POOL:
                    yield from flush()
            else:
                bits, n, rest, comp, block, _ = columns(held)
                yield from batch(held, group_pairs(bits, n, rest, comp, *([block] if across else [])))

        for b in batches:
            for token, x, y, block, key, n, rest, comp, bits in zip(*(c.to_pylist() for c in b.columns)):
                if (token, x, y) != name:
                    if held:
                        yield from close()
                    held, name = [], (token, x, y)
                held.append((key, n, rest, comp, block, bits))
        if held:
            yield from close()
        if small:
            yield from flush()

    part = F.pmod(F.xxhash64("token"), F.lit(SPREAD))
    dealt = members.repartition("least", "x", "y", part).sortWithinPartitions("token", "x", "y")
    return dealt.select("token", "x", "y", "block", "key", "n", "rest", "comp", "bits").mapInArrow(run, schema).distinct()


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id``."""
    rows = common.numbered(docs.select(doc_id, text), doc_id, text)
    rows = rows.select("rid", F.col("row").getField(doc_id).alias("doc_id"), "text")
    signed = common.written(signatures(rows, _frequent(rows, "text")), "signatures")
    name = ["k0", "k1", "n"]
    classes = common.written(
        signed.where("n > 0").groupBy(*[F.col(c).alias(f"c_{c}") for c in name]).agg(F.min("rid").alias("key"), F.count("*").alias("copies")), "classes"
    )
    reps = signed.select("rid", "n", "prefix").join(classes.select("key"), F.col("rid") == F.col("key"))
    postings = reps.select("key", "n", F.posexplode("prefix").alias("at", "token")).select("token", "key", "n", (F.col("n") - F.col("at")).alias("rest"))
    shared = postings.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("g"), F.min("n").alias("smallest")).where("g > 1")
    # what a member needs at least, its partner being no smaller than the smallest member
    possible = F.col("rest") * 28 >= 3 * (4 * F.col("n") + F.greatest(3 * F.col("n"), 4 * F.col("smallest")))
    groups = postings.join(shared, F.col("token") == F.col("t")).where(possible).select("token", "key", "n", "rest")
    groups = common.written(groups, "groups")
    names = common.written(signed.select("rid", *name), "set-names")
    common.dropped(signed)
    labels = _linked(rows, groups)
    if labels is None:
        known = classes.withColumn("comp", F.col("key"))
    else:
        known = classes.join(labels, F.col("key") == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("comp", "key"))
    return _spread(rows.select("rid", "doc_id"), names, known)


def _spread(ids: DataFrame, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Per document its component's least doc_id, from classes (c_k0, c_k1, c_n, key, copies, comp)."""
    full = signed.join(ids.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r")).drop("r")
    alone = full.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    some = common.written(full.where("n > 0"), "set-names")
    name = ["c_k0", "c_k1", "c_n"]
    least = some.groupBy(F.col("k0").alias("d0"), F.col("k1").alias("d1"), F.col("n").alias("dn")).agg(F.min("doc_id").alias("first"))
    named = classes.join(least, (F.col("c_k0") == F.col("d0")) & (F.col("c_k1") == F.col("d1")) & (F.col("c_n") == F.col("dn"))).select(*name, "copies", "comp", "first")
    named = common.written(named, "class-ids")
    tops = common.written(named.groupBy(F.col("comp").alias("top")).agg(F.min("first").alias("component_id"), F.count("*").alias("classes")), "component-ids")
    of = common.written(common.lookup(named, tops, ["comp"], ["top"], "classes").select(*name, "copies", "component_id"), "class-components")
    got = common.lookup(some, of, ["k0", "k1", "n"], name, "copies")
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def _linked(rows: DataFrame, groups: DataFrame) -> DataFrame | None:
    """``node, comp`` of the classes that link, from their groups (token, key, n, rest); None if no
    two classes share a prefix shingle."""
    in_groups = groups.select(F.col("key").alias("g")).distinct()
    texts = common.written(_texts(rows, in_groups), "class-texts")
    maps = common.written(_bitmaps(texts), "bitmaps")
    links: DataFrame | None = None
    labels: DataFrame | None = None
    turn, worth = 0, True
    while True:
        mixed = common.written(_mixed(groups.select("token", "key", "n", "rest"), labels), "mixed")
        common.dropped(groups)
        groups = mixed
        left = not groups.isEmpty()
        if not left or not worth:
            break  # the last pivots joined little: the trees do the rest
        pairs = common.written(_possible(_star(groups, turn), maps), "pivots")
        new = common.written(_verify(pairs, texts), "links")
        worth = new.count() > WORTH * pairs.count()
        common.dropped(pairs)
        links = _with(links, new)
        labels = _relabelled(links, labels)
        turn += 1
    if left:
        pairs = common.written(_by_trees(groups, maps), "pairs")
        links = _with(links, common.written(_verify(pairs, texts), "links"))
        labels = _relabelled(links, labels)
    return labels


def _with(links: DataFrame | None, new: DataFrame) -> DataFrame:
    if links is None:
        return new
    both = common.written(links.unionByName(new), "links")
    common.dropped(links)
    common.dropped(new)
    return both


def _relabelled(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    got = graph.components(links)
    if labels is not None:
        common.dropped(labels)
    return got


def _mixed(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The groups (token, key, n, rest) that hold two components or more, one of each set of
    members: with ``comp``, the number of members ``g`` and the ``least`` member."""
    whole = [F.count("*").alias("g"), F.min("key").alias("least"), F.sum("rest").alias("rests"), F.bit_xor(F.xxhash64("key")).alias("h")]
    if labels is None:
        members = groups.withColumn("comp", F.col("key"))
        of = members.groupBy("token").agg(*whole).where("g > 1")
    else:
        members = groups.join(labels, F.col("key") == F.col("node"), "left").select("token", "key", "n", "rest", F.coalesce("comp", "key").alias("comp"))
        of = members.groupBy("token").agg(*whole, F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    # members are told by their number, the least and a hash of all
    once = of.groupBy("h", "g", "least").agg(F.max_by("token", F.struct("rests", "token")).alias("t"))
    return members.join(once.select("t", "g", "least"), F.col("token") == F.col("t")).drop("t")


def _star(groups: DataFrame, turn: int) -> DataFrame:
    """Each member of a group against the group's pivot, where they are of different components."""
    rank = F.xxhash64(F.col("key"), F.lit(turn))
    pivots = groups.groupBy("token").agg(F.min_by(F.struct("key", "n", "rest", "comp"), rank).alias("p")).select(F.col("token").alias("t"), "p")
    pairs = groups.join(pivots, F.col("token") == F.col("t")).where(
        "comp <> p.comp and 4 * n >= 3 * p.n and 4 * p.n >= 3 * n and least(rest, p.rest) * 7 >= 3 * (n + p.n)"
    )
    return pairs.select(F.col("key").alias("a"), F.col("p.key").alias("b")).distinct()


def _bitmaps(texts: DataFrame) -> DataFrame:
    """``k, n, bits`` of rows (key, packed): size and token bitmap of each class."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_unpack(x) for x in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_bitmap(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "n", "bits"])

    return texts.select("key", "packed").mapInArrow(run, schema)


def _possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave a link possible."""
    two = pairs.join(maps.select(F.col("k").alias("ka"), F.col("n").alias("na"), F.col("bits").alias("ba")), F.col("a") == F.col("ka"))
    two = two.join(maps.select(F.col("k").alias("kb"), F.col("n").alias("nb"), F.col("bits").alias("bb")), F.col("b") == F.col("kb"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (a, b)
                for a, b, na, nb, ba, bb in zip(*(c.to_pylist() for c in batch.columns))
                if next(group_pairs([ba, bb], np.array([na, nb]), np.array([na, nb])), None) is not None
            ]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return two.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, schema)


def _by_trees(groups: DataFrame, maps: DataFrame) -> DataFrame:
    """Candidate pairs of the groups (token, least, key, n, rest, comp, g) by signature trees."""
    n_blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    cut = groups.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    return _tree_candidates(cut.join(maps.select("k", "bits"), F.col("key") == F.col("k")))
