"""Prefix trie of conversations, with a count-min screen of prefix digests.

A node is a distinct sequence of first turns. Texts never travel: a turn is named by a
128-bit digest of its role and text, a prefix by the digest of its parent's digest and
its last turn's.

*Screen.* Every task counts the prefix digests of its conversations into the cells of a
count-min sketch (``ROWS`` rows; counts of two or more are the same here, so what is kept
of a cell in the end is one bit). An estimate is never too low, so an estimate of one
proves a singleton: below a proven singleton every prefix belongs to the same
conversation, and these tails are complete rows on the spot, without a shuffle.

*Exact grouping.* Only prefixes that may be shared are grouped by digest. A singleton
below a shared parent is handed to that parent once (its child and its leaf). What the
sketch takes for shared wrongly is grouped like the rest, so results never hang on the
sketch's width. The sketch has some four cells a prefix and row, at most ``MOST_CELLS``
in all (64 MB of bits, the bound of the broadcast); beyond some 70 million prefixes the
screen lets more and more through, and the grouping does more of the work.

*Subtree sums.* Nodes know the digests of their ancestors at distances 1, 2, 4, ...
(taken from their own conversation), so sums over a subtree take as many rounds as the
depth has bits: each round hands what a node has gathered to the ancestor twice as far.

Parents are found by a join in which the parents with the most children are broadcast
(``common.lookup``). A conversation's turns are held in its task by their digests, 24
bytes a turn. The list of ends of one node is hashed in order, which is one stream; it
comes as joined pieces of up to ``END_SPAN`` ids.

Defined cases: null roles and texts are empty; turns are ordered by turn (null first),
ties by role and then by digest; rows without a conv_id belong to no conversation; no
conversations, no nodes; a conversation without turns is a member and an end of the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common

ROWS = 2
#: Cells of the sketch, all rows together: a power of two.
MOST_CELLS = 1 << 29
BLOCK = 1 << 16
#: Cells that a task holds before it gives them away.
HELD_CELLS = 1 << 22
#: Consecutive ids of ends that are joined in one piece.
END_SPAN = 4096
WIDTH = 16
ROOT = bytes(WIDTH)

_STEPS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("digests", T.BinaryType()), T.StructField("chars", T.ArrayType(T.LongType()))]
)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))


def _digest(role: str, text: str):
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)).cast("binary")))


def _turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    src = turns.where(turns[f"`{conv_id}`"].isNotNull()).select(
        turns[f"`{conv_id}`"].cast("long").alias("conv_id"),
        turns[f"`{turn}`"].alias("turn"),
        F.coalesce(turns[f"`{role}`"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[f"`{text}`"].cast("string"), F.lit("")).alias("text"),
    )
    return src.withColumn("digest", _digest("role", "text"))


def steps(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``conv_id, digests`` (of its turns in order, joined) and ``chars``."""
    rows = _turns(turns, conv_id, turn, role, text).select("conv_id", "turn", "role", "digest", F.length("text").cast("long").alias("n"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").select("conv_id", "digest", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digests, chars = None, [], []

        def row() -> tuple:
            return name, b"".join(digests), np.concatenate(chars)

        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            flat = b"".join(b.column(1).to_pylist())
            cut = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
            out = []
            for s, e in zip(cut[:-1], cut[1:]):
                if ids[s] != name:
                    if digests:
                        out.append(row())
                    name, digests, chars = int(ids[s]), [], []
                digests.append(flat[s * WIDTH : e * WIDTH])
                chars.append(n[s:e])
            yield batch(out)
        if digests:
            yield batch([row()])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), _lists([o[2] for o in out])], names=_STEPS.names
        )

    return dealt.mapInArrow(run, _STEPS)


def _prefixes(convs: DataFrame) -> DataFrame:
    """The steps with prefix digests in place of turn digests."""

    def chain(digests: bytes) -> bytes:
        out, last = [], ROOT
        for i in range(0, len(digests), WIDTH):
            last = hashlib.blake2b(last + digests[i : i + WIDTH], digest_size=WIDTH).digest()
            out.append(last)
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([chain(d) for d in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), got, b.column(2)], names=_STEPS.names)

    return convs.select(*_STEPS.names).mapInArrow(run, _STEPS)


def _cells(digests: bytes, width: int) -> np.ndarray:
    """Cell numbers of prefix digests, one line a row of the sketch."""
    halves = np.frombuffer(digests, "<u8").reshape(-1, ROWS) & np.uint64(width - 1)
    return halves.T.astype(np.int64) + np.arange(ROWS)[:, None] * width


def sketch(paths: DataFrame) -> tuple[np.ndarray, int]:
    """One bit a cell (counted twice or more), and the width of a row."""
    n = paths.agg(F.sum(F.octet_length("digests") / WIDTH)).first()[0] or 0
    width = min(MOST_CELLS // ROWS, max(BLOCK, 1 << (4 * int(n)).bit_length()))
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    names = schema.names

    def rows(blocks: list[int], cells: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            cells = np.repeat(cells, np.minimum(n, 2))  # a cell counted twice is listed twice
            block = cells // BLOCK
            at = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(cells)]])
            low = (cells % BLOCK).astype(np.uint16)
            return rows([int(block[s]) for s in at[:-1]], [low[s:e].tobytes() for s, e in zip(at[:-1], at[1:])])

        for b in batches:
            for d in b.column(0).to_pylist():
                if d:
                    held.append(_cells(d, width).ravel())
                    size += len(held[-1])
                if size >= HELD_CELLS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, np.zeros(BLOCK, np.int64)
        for b in batches:
            blocks, bits = [], []
            for block, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != name:
                    if name is not None:
                        blocks.append(name)
                        bits.append(np.packbits(total > 1).tobytes())
                    name, total = block, np.zeros(BLOCK, np.int64)
                total += np.bincount(np.frombuffer(cells, np.uint16), minlength=BLOCK)
            yield rows(blocks, bits)
        if name is not None:
            yield rows([name], [np.packbits(total > 1).tobytes()])

    dealt = paths.select("digests").mapInArrow(count, schema).repartition("block").sortWithinPartitions("block")
    bits = np.zeros((ROWS * width // BLOCK, BLOCK // 8), np.uint8)
    for r in dealt.mapInArrow(merge, schema).toLocalIterator():
        bits[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    return bits.ravel(), width


def _estimates_more(bits: np.ndarray, width: int, digests: bytes) -> np.ndarray:
    """Whether the estimate of each prefix digest is more than one."""
    cells = _cells(digests, width)
    return ((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(0)


_SCREENED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("depth", T.LongType()),
        T.StructField("chars", T.LongType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("lone", T.BooleanType()),
        T.StructField("lone_parent", T.BooleanType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("parent", T.BinaryType()),
        T.StructField("above", T.BinaryType()),
    ]
)


def _screened(paths: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """One row a prefix: proven singletons are ``lone``; digests only where they are needed
    (``above``: those of the ancestors at distances 2, 4, 8, ..., joined)."""
    shared = paths.sparkSession.sparkContext.broadcast(bits)
    arrow = common.to_arrow_schema(_SCREENED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, digests, chars in zip(*(c.to_pylist() for c in b.columns)):
                more = [True, *_estimates_more(shared.value, width, digests).tolist()]
                at = lambda d: digests[(d - 1) * WIDTH : d * WIDTH] if d else ROOT  # noqa: E731, B023
                depth = len(chars)
                for d in range(depth + 1):
                    lone, lone_parent = not more[d], d > 0 and not more[d - 1]
                    above = b"".join(at(d - (1 << k)) for k in range(1, d.bit_length()) if (1 << k) <= d)
                    out.append(
                        (conv, d, chars[d - 1] if d else 0, d == depth, lone, lone_parent, None if lone else at(d),
                         None if lone_parent or not d else at(d - 1), None if lone else above)
                    )
                if len(out) > 50_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], names=arrow.names)

    return paths.select(*_STEPS.names).mapInArrow(run, _SCREENED)


def _ends(rows: DataFrame) -> DataFrame:
    """``node, ends``: digest of the ids that end in each node, in numeric order."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = rows.groupBy("digest", F.floor(F.col("conv_id") / END_SPAN).alias("span")).agg(piece.alias("ids"))
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("ends", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None
        for b in batches:
            out = []
            for node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if node != name:
                    if name is not None:
                        out.append((name, total.hexdigest()))
                    name, total = node, hashlib.sha256(ids.encode())
                else:
                    total.update(b"," + ids.encode())
            yield batch(out)
        if name is not None:
            yield batch([(name, total.hexdigest())])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=schema.names)

    dealt = pieces.repartition("digest").sortWithinPartitions("digest", "span").select("digest", "ids")
    return dealt.mapInArrow(run, schema)


def _subtree_sums(own: DataFrame) -> DataFrame:
    """``node, leaves, saved`` summed over subtrees of rows (node, depth, parent, above, leaves, saved)."""
    total = common.written(own, "trie-sums")
    deepest = total.agg(F.max("depth")).first()[0] or 0
    for k in range(int(deepest).bit_length()):
        far = F.col("parent") if k == 0 else F.substring("above", WIDTH * (k - 1) + 1, WIDTH)
        given = total.where(F.col("depth") >= (1 << k)).groupBy(far.alias("to")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        got = total.join(given, F.col("node") == F.col("to"), "left")
        new = got.select(
            "node", "depth", "parent", "above",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        last, total = total, common.written(new, "trie-sums")
        common.dropped(last)
    return total.select("node", "leaves", "saved")


def _sha_of(conv, last):
    return F.sha2(F.when(last, conv.cast("string")).otherwise(F.lit("")).cast("binary"), 256)


def nodes(convs: DataFrame) -> DataFrame:
    """Per node of the trie over ``convs`` (the rows of :func:`steps`): ``conv_id`` (least
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``
    (code points of last turns that members share, over the subtree), ``ends_sha256``."""
    paths = common.written(_prefixes(convs), "trie-paths")
    rows = common.written(_screened(paths, *sketch(paths)), "trie-screened")
    tails = rows.where("lone and lone_parent")
    heads = rows.where("lone and not lone_parent")
    grouped = common.written(
        rows.where("not lone")
        .groupBy(F.col("digest").alias("node"), "depth", "chars", "parent", "above", "lone_parent")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")),
        "trie-nodes",
    )
    children = grouped.where("parent is not null").select("parent", (F.col("n_convs") == 1).cast("long").alias("lone"))
    children = children.unionByName(heads.select("parent", F.lit(1).cast("long").alias("lone")))
    kids = children.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"), F.sum("lone").alias("lone_children"))
    known = grouped.join(kids, F.col("node") == F.col("of"), "left").drop("of")
    known = common.written(known.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-known")
    shared = known.where("n_convs > 1").select(
        "node", "depth", "parent", "above",
        (F.coalesce("lone_children", F.lit(0)) + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    sums = _subtree_sums(shared).withColumnRenamed("node", "of")
    ends = _ends(rows.where("not lone and last")).withColumnRenamed("node", "ended")
    full = known.join(sums, F.col("node") == F.col("of"), "left").join(ends, F.col("node") == F.col("ended"), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    result = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    full = full.select(
        "parent", "lone_parent", "conv_id", "depth", "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends", none).alias("ends_sha256"),
    )

    def single(part: DataFrame, *also: str) -> DataFrame:
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        return part.select(
            *also, "conv_id", "depth", one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
            one.alias("n_leaves"), zero.alias("saved_tokens"), _sha_of(F.col("conv_id"), F.col("last")).alias("ends_sha256"),
        )

    asking = common.written(full.where("parent is not null").select("parent", *result).unionByName(single(heads, "parent")), "trie-asking")
    parents = known.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = parents.where("n_children > 0").withColumnRenamed("n_children", "asked")
    found = common.lookup(asking, parents, ["parent"], ["of"], "asked").select(*result, "parent_conv_id")
    # below a proven singleton the parent is the conversation's own, the root has none
    own = full.where("parent is null").withColumn("parent_conv_id", F.when(F.col("lone_parent"), F.col("conv_id")))
    alone = single(tails).withColumn("parent_conv_id", F.col("conv_id"))
    out = found.unionByName(own.select(*found.columns)).unionByName(alone.select(*found.columns))
    return out.select("conv_id", "depth", "parent_conv_id", *result[2:])


def with_texts(found: DataFrame, turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes with ``role`` and ``text`` of their last turn (the root: null), for nodes
    of conversations as they stand in ``turns``."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    at = _turns(turns, conv_id, turn, role, text).withColumn("at", F.row_number().over(order))
    at = at.select(F.col("conv_id").alias("of"), "at", "role", "text")
    return found.join(at, (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("at")), "left").drop("of", "at")
