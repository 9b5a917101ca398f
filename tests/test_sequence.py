"""Skew-safe per-key numbering equals row_number over the key."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F


def test_number_within_matches_row_number(spark):
    from regframe.operators.sequence import number_within

    rnd = random.Random(7)
    keys = list(range(1, 301))
    rows = []
    for order in rnd.sample(range(100000), 3000):
        # key 0 holds about a third of the rows
        rows.append((0 if rnd.random() < 0.34 else rnd.choice(keys), order))
    df = spark.createDataFrame(rows, "k long, o long")
    got = number_within(df, "k", "o", out="rn", width=37)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert got.count() == df.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
