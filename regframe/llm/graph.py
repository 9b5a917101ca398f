"""Connected components of a link table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regframe.llm import common


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (the smallest node reachable) for the nodes of ``links`` (a, b).

    Each round takes the least label among neighbours (partial aggregates, so a node
    with many links is no hot task), then follows labels twice; rounds grow with the
    logarithm of the longest chain. Labels are written to the shared folder.
    """
    both = common.written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    lab = common.written(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "labels"
    )
    while True:
        near = both.join(lab, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        step = lab.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")
        )
        up = step.select(F.col("node").alias("up"), F.col("comp").alias("up_comp"))
        new = common.written(
            step.join(up, F.col("comp") == F.col("up")).select("node", "was", F.least("comp", "up_comp").alias("comp")), "labels"
        )
        common.dropped(lab)
        lab = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            common.dropped(both)
            return lab
