"""Per-key sequence numbers that stay balanced when one key is hot.

``row_number() OVER (PARTITION BY key ORDER BY o)`` sends every row of a key
to one task: a key holding a third of all rows becomes a third of the job in
one sort. Here the rows of a key are cut into buckets of a numeric, unique
ordering column (``floor(o / width)``); each (key, bucket) is numbered on its
own, in parallel, and gets the count of the key's earlier buckets as offset.
The offsets come from one row per (key, bucket), so even the hot key has few
rows at that step. Every step depends only on the data (no partition ids),
so a retried task computes the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 1 << 16


def number_within(
    df: DataFrame, key: str, order: str, *, out: str = "rn", width: int = BUCKET_WIDTH
) -> DataFrame:
    """``df`` plus ``out`` = 1-based position of the row among rows of its ``key``
    ordered by ``order`` (numeric, unique within a key)."""
    b = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)))
    local = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order))
    b = b.withColumn("_local", local)
    sizes = b.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        b.join(offsets, [key, "_bucket"], "inner")
        .withColumn(out, (F.col("_off") + F.col("_local")).cast("int"))
        .drop("_bucket", "_local", "_off")
    )
