"""Mixing sources to target weights by hash-threshold histograms.

Targets: the sources share all words by weight; a target stops at ``max_epochs``
times its source's size and the excess is shared again by weight until none is
above (water-filling). A source whose target exceeds its size is taken whole as
often as fits; the rest of the target is a budget for a part of it.

The part is found without sorting documents: each has a 60-bit hash of its id;
words are summed by source and the top 12 bits, the running sum gives the bucket
in which the budget ends, and only that bucket is split by the next 12 bits, to
the last bit. What remains is a threshold per source; a filter on the hash
applies it. The hash at which the budget ends is taken if that comes nearer.

Sums by (source, bucket) have at most 4096 rows a source and level, whatever
the number of documents, and are pre-aggregated before the shuffle, so a hot
source is no hot task. The result depends on the rows alone: reruns agree.

Defined cases: null text has size 0; the null source comes last; rows that share
a doc_id (or a null one) share a hash and go together; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regframe.llm import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
LEVEL_BITS = 12
HASH_BITS = 60


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5, as a long."""
    h = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(h, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, target, epochs, budget``.

    ``sizes`` has one row per source (``source, source_size``). The windows below
    order those rows only; documents never meet in one task.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.array(*[F.lit(int(x)) for x in weights])
    s = sizes.withColumn("weight", F.get(w, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    # Sources reach their cap in the order of cap/weight. With the k first capped, the
    # level is (total - their caps) / (other weights); a source is capped if its own
    # cap/weight lies below the level that holds with all before it capped.
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("total", F.sum("source_size").over(every))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("rest") <= (F.col("total") - F.col("caps")) * F.col("weight"))
    )
    s = (
        s.withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("w_sum", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
                (F.col("total") - F.col("cap_sum")) * F.col("weight") / F.col("w_sum")
            ),
        )
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return s.withColumn("epochs", epochs.cast("long")).select(
        "source",
        "source_size",
        "target",
        "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the hash limit: documents with a hash below ``limit`` go in.

    ``rows``: ``source, size, h``. Each level sums words by the next bits inside the
    boundary bucket of the level before.
    """
    state = plan.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        part = rows.select("source", "size", F.shiftright("h", shift).alias("bucket"))
        st = state.select(F.col("source").alias("s_source"), "budget", "prefix", "below")
        if level:
            # Only the boundary bucket of each source is read on.
            part = part.join(
                st.select("s_source", "prefix"),
                _same(F.col("source"), F.col("s_source")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("prefix")),
            ).drop("s_source", "prefix")
        hist = part.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run))
        hist = hist.join(st, _same(F.col("source"), F.col("s_source"))).drop("s_source")
        # The first bucket with which the running sum passes the budget, and what lies below it.
        passed = F.col("below") + F.col("upto") > F.col("budget")
        edge = hist.groupBy("source").agg(
            F.first("budget").alias("budget"),
            F.min(F.when(passed, F.struct("bucket", (F.col("below") + F.col("upto") - F.col("words")).alias("b"), "words"))).alias("e"),
        )
        # A source whose budget is never passed keeps no boundary: all of it goes in.
        state = edge.where("e is not null").select(
            "source", "budget", F.col("e.bucket").alias("prefix"), F.col("e.b").alias("below"), F.col("e.words").alias("words")
        )
        state = common.written(state, "mix-level")
    # At the last level a bucket is one hash; it goes in if that comes nearer to the budget.
    nearer = (F.col("below") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return state.select("source", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("limit"))


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies,
    taken`` and struct ``row`` if columns are to be carried.

    ``copies`` is how often the mix takes the document, ``taken`` its words times that.
    """
    rows = docs.select(
        docs[f"`{doc_id}`"].alias("doc_id"),
        docs[f"`{source}`"].cast("string").alias("source"),
        n_words(docs[f"`{text}`"]).alias("size"),
        id_hash(docs[f"`{doc_id}`"]).alias("h"),
        *([F.struct(*[docs[f"`{c}`"].alias(c) for c in carry]).alias("row")] if carry else []),
    )
    if not carry:
        rows = common.written(rows, "mix-rows")  # texts are read once
    narrow = rows.select("source", "size", "h") if not carry else common.written(rows.select("source", "size", "h"), "mix-rows")
    plan = common.written(
        targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-plan"
    )
    limits = thresholds(narrow, plan)
    per_source = plan.alias("p").join(limits.alias("l"), _same(F.col("p.source"), F.col("l.source")), "left").select(
        F.col("p.source").alias("p_source"), "source_size", "target", "epochs", "limit"
    )
    # A source without a limit never passed its budget: its whole remainder goes in, which
    # happens only where nothing remains (budget equal to size is a whole epoch) or size is 0.
    extra = F.when(F.col("limit").isNull(), F.lit(0)).otherwise((F.col("h") < F.col("limit")).cast("long"))
    return (
        rows.join(per_source, _same(F.col("source"), F.col("p_source")))
        .withColumn("copies", F.col("epochs") + extra)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *(["row"] if carry else []))
    )
