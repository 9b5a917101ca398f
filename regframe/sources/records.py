"""Records of quoted delimited text, cut inside files.

A quoted field may hold line breaks, so a cut of a file may fall inside a record. The
text source cuts files into blocks of bytes and gives physical lines; two passes make
records of them, both in as many tasks as there are blocks:

1. *Parity.* Each block's quotes are counted. Quotes are balanced in a record (one
   inside a field is doubled), so a block begins inside a record if the blocks before it
   in its file hold an odd number of quotes: a sum over one row per block.
2. *Records.* Each task goes through its blocks' lines with that state. Lines that open
   and close are records at once; others are joined until the quotes close. What a block
   holds of a record that began or ends in another one is a fragment, at most two a
   block, and fragments are joined afterwards by file and block.

Blocks lie on a fixed grid (:func:`grid`, :func:`grid_session`), so that both passes, and a stream and a batch,
see the same ones. A line break inside a field is kept as it is; a carriage return before
the line break that ends a record is dropped; blank lines are no records.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, HEAD, TAIL, MIDDLE = range(4)

_OUT = T.StructType(
    [
        T.StructField("_arquivo", T.StringType()),
        T.StructField("_bloco", T.LongType()),
        T.StructField("_parte", T.IntegerType()),
        T.StructField("_bytes", T.BinaryType()),
    ]
)


def _grid_keys(block_bytes: int | None) -> dict[str, str]:
    keys = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.maxPartitionNum": str(2**31 - 1)}
    return keys | ({"spark.sql.files.maxPartitionBytes": str(block_bytes)} if block_bytes else {})


@contextlib.contextmanager
def grid(spark: SparkSession, block_bytes: int | None = None):
    """While it lasts, files are cut at multiples of one size whatever else is read with
    them (the number of task slots has no say): ``block_bytes``, else the session's."""
    keys = _grid_keys(block_bytes)
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def grid_session(spark: SparkSession, block_bytes: int | None = None) -> SparkSession:
    """A session with the settings of ``spark`` in which :func:`grid` always holds. A stream
    cuts its files when it plans a batch, by the settings its reader's session has then,
    so the two passes agree only if nobody sets these back meanwhile."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    for k, v in _grid_keys(block_bytes).items():
        own.conf.set(k, v)
    return own


def lines(reader, directory: str, names: list[str]) -> DataFrame:
    """Physical lines of the named files: ``file, block, odd`` (quotes) and ``value`` (bytes).
    ``reader`` is ``spark.read`` or ``spark.readStream``."""
    src = reader.format("text").option("lineSep", "\n").option("pathGlobFilter", "{" + ",".join(names) + "}").load(directory)
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return src.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (quotes % 2 == 1).alias("odd"),
        F.col("value").cast("binary").alias("value"),
    )


def block_starts(found: DataFrame) -> DataFrame:
    """``in_file, in_block, inside``: whether each block of ``lines`` begins inside a record."""
    blocks = found.groupBy("file", "block").agg((F.count_if(F.col("odd")) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    return blocks.select(F.col("file").alias("in_file"), F.col("block").alias("in_block"), inside.alias("inside"))


def pieces(found: DataFrame, starts: DataFrame) -> DataFrame:
    """``_arquivo, _bloco, _parte, _bytes``: whole records and fragments of ``lines``.

    ``starts`` has one row a block (some 60 bytes for every block of text), so it is
    broadcast: a shuffle would tear the lines of a block apart.
    """
    known = found.join(F.broadcast(starts), (F.col("file") == F.col("in_file")) & (F.col("block") == F.col("in_block")), "left")
    return known.select("file", "block", "inside", "odd", "value").mapInArrow(_assemble, _OUT)


class _Block:
    """The record that is open in the block being read."""

    def __init__(self, name: tuple[str, int], inside: bool):
        if inside is None:
            raise RuntimeError(f"block {name[1]} of {name[0]} was not there when its state was computed")
        self.name, self.open, self.from_before = name, inside, inside
        self.held: list[bytes] = []

    def closed(self) -> tuple[str, int, int, bytes]:
        """The open record, which ends here."""
        part = HEAD if self.from_before else WHOLE
        out = (*self.name, part, b"\n".join(self.held))
        self.held, self.from_before, self.open = [], False, False
        return out

    def rest(self) -> list[tuple[str, int, int, bytes]]:
        """What the block's end leaves open."""
        return [(*self.name, MIDDLE if self.from_before else TAIL, b"\n".join(self.held))] if self.open and self.held else []


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: _Block | None = None
    for b in batches:
        if not b.num_rows:
            continue
        file, block, inside, odd, value = b.columns
        f = file.dictionary_encode().indices.to_numpy()
        k = block.to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((f[1:] != f[:-1]) | (k[1:] != k[:-1])) + 1, [len(k)]])
        flips = odd.to_numpy(zero_copy_only=False).astype(np.int64)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            name = (file[s].as_py(), int(k[s]))
            out: list[tuple] = []
            if at is None or at.name != name:
                out += at.rest() if at else []
                at = _Block(name, inside[s].as_py())
            after = (int(at.open) + np.cumsum(flips[s:e])) % 2
            before = np.concatenate([[int(at.open)], after[:-1]])
            alone = (before == 0) & (after == 0)
            yield _whole(name, value.slice(s, e - s).filter(pa.array(alone)))
            for i in np.flatnonzero(~alone).tolist():
                at.open = True
                at.held.append(value[s + i].as_py())
                if not after[i]:
                    out.append(at.closed())
            yield _rows(out)
    if at:
        yield _rows(at.rest())


def _whole(name: tuple[str, int], value: pa.Array) -> pa.RecordBatch:
    n = len(value)
    cols = [pa.array([name[0]] * n, pa.string()), pa.array([name[1]] * n, pa.int64()), pa.array([WHOLE] * n, pa.int32()), value]
    return pa.RecordBatch.from_arrays(cols, names=_OUT.names)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=_OUT.names)


def decoded(found: DataFrame, encoding: str) -> DataFrame:
    """``_bytes`` as text ``_texto`` (a single-byte encoding: fragments decode apart)."""
    return found.withColumn("_texto", F.decode("_bytes", encoding)).drop("_bytes")


def joined(fragments: DataFrame) -> DataFrame:
    """Records ``_arquivo, _texto`` out of the fragments of all blocks of their files."""
    # a fragment that goes on with a record of an earlier block comes before the block's own
    order = Window.partitionBy("_arquivo").orderBy("_bloco", F.col("_parte") == TAIL)
    chain = F.count_if(F.col("_parte") == TAIL).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.struct("_bloco", "_texto")))
    found = fragments.withColumn("_chain", chain).groupBy("_arquivo", "_chain").agg(parts.alias("_parts"))
    return found.select("_arquivo", F.array_join(F.transform("_parts", lambda p: p["_texto"]), "\n").alias("_texto"))


def parsed(found: DataFrame, schema: T.StructType, options: dict[str, str], *, keep=None) -> DataFrame:
    """The columns of records ``_texto`` beside the other columns; blank ones are left out
    (but for rows that ``keep`` holds for)."""
    text = F.regexp_replace("_texto", r"\r\z", "")
    rest = [c for c in found.columns if c != "_texto"]
    some = F.col("_texto") != ""
    rows = found.withColumn("_texto", text).where(some if keep is None else some | keep)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.select(*rest, F.from_csv("_texto", columns, options).alias("_r")).select("_r.*", *rest)
