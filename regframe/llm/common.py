"""Shared helpers: table access, tables written to the shared folder, and text
batches handed to Arrow functions with any other columns carried along."""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regframe.session import checkpoint_dir

#: Keys of a lookup that are broadcast: those with the most rows.
HEAVY = 1 << 16
#: Rows of one Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Short Arrow batches for functions over whole texts (bounded worker memory)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again.

    Cuts the lineage on shared storage, so a lost executor costs no rerun of
    what came before. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made, once nothing reads it."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def lookup(rows: DataFrame, table: DataFrame, key: Sequence[str], at: Sequence[str], asked: str) -> DataFrame:
    """``rows`` joined with the row of ``table`` whose unique ``at`` columns are their ``key``.

    ``asked`` says how many rows want each row of ``table``. The ``HEAVY`` most wanted are
    broadcast; any other is wanted by less than one in ``HEAVY`` of the rows, so no task
    of the shuffle gets a hot key. Both sides are read twice: written tables, best.
    """
    same = functools.reduce(operator.and_, [F.col(k) == F.col(a) for k, a in zip(key, at)])
    heavy = table.orderBy(F.desc(asked), *at).limit(HEAVY).drop(asked)
    rest = rows.join(F.broadcast(heavy.select(*at)), same, "left_anti")
    near = rows.join(F.broadcast(heavy), same)
    return near.unionByName(rest.join(table.drop(asked), same)).drop(*at)


def map_texts(
    df: DataFrame,
    fn: Callable[[list], dict],
    out: T.StructType,
    *,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``fn`` over batches of texts; returns struct ``row`` (the ``carry`` columns)
    beside the columns of ``out``. As the carried columns sit inside a struct, no
    name of theirs can clash with a result column.
    """
    short_batches(df.sparkSession)
    src = df.select(
        F.struct(*[df[f"`{c}`"].alias(c) for c in carry]).alias("row"),
        df[f"`{text}`"].cast("string").alias("text"),
    )
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), *out.fields])
    arrow = to_arrow_schema(T.StructType(out.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            got = fn(b.column(1).to_pylist())
            cols = [b.column(0)] + [
                got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["row", *arrow.names])

    return src.mapInArrow(run, schema)


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns), ``rid`` and ``text`` with a unique long ``rid``: the id
    where it is one, else row numbers, kept in a written copy so that they stay."""
    src = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"),
        docs[f"`{doc_id}`"].alias("rid"),
        docs[f"`{text}`"].cast("string").alias("text"),
    )
    if isinstance(src.schema["rid"].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        n = src.groupBy("rid").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.max(F.col("rid").isNull()).alias("x")).first()
        if not n["x"] and (n["n"] or 0) <= 1:
            return src.withColumn("rid", F.col("rid").cast("long"))
    return written(src.withColumn("rid", F.monotonically_increasing_id()), "numbered")
