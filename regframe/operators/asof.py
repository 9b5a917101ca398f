"""As-of join: each left row with the latest right row of its key at or before its time.

Neither side is joined by key and time: both go into one stream of rows (a union), sorted
by key and time, in which the last right row seen is carried forward. A key's rows would
be one task, so time is cut at quantiles of the right side, every (key, slice) is sorted
and carried on its own, and what a slice inherits from the slices before it comes from one
row per (key, slice): the last right row in it. A hot key is spread over its slices; the
work grows with the rows, not with the pairs of a key.

Defined cases: a null key or time matches nothing (such left rows stay in an outer join);
of right rows with one key and time the greatest in all its columns counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slices of time: quantiles of the right side's times, a small array of literals.
SLICES = 64
_ACCURACY = 10_000


def _number(df: DataFrame, on: str) -> Column:
    """A time as a number that sorts like it."""
    kind = df.schema[on].dataType
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.col(on).cast("timestamp").cast("double")
    return F.col(on).try_cast("double")


def _cuts(right: DataFrame, on: str, slices: int) -> list:
    """Times that cut the right side into slices of about equal rows (a sketch, some KB)."""
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    got = right.agg(F.percentile_approx(_number(right, on), shares, F.lit(_ACCURACY)).alias("q")).first()["q"]
    return sorted(set(got or []))


def _slice(rows: DataFrame, cuts: list) -> Column:
    """How many cuts lie at or before a row's time."""
    steps = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)")
    return F.size(F.filter(steps, lambda c: c <= _number(rows, "_t")))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    *,
    right_on: str | None = None,
    strict: bool = False,
    outer: bool = False,
    suffix: str = "_direita",
    slices: int = SLICES,
) -> DataFrame:
    """Columns of ``left``, then those of the matching ``right`` row but for its key and (if
    both sides name it alike) its time; clashing names get ``suffix``.

    ``on`` is a number, a date, a timestamp or fixed-width digits (``YYYYMMDD``), which sort
    like the numbers they are. ``strict``: the right time must be earlier. ``outer``: left
    rows without a match stay.
    """
    at = right_on or on
    rest = [c for c in right.columns if c not in by and (c != at or at != on)]
    names = {c: c + suffix if c in left.columns else c for c in rest}
    cuts = _cuts(right, at, slices)
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    keys = [f"_k{i}" for i in range(len(by))]
    usable = F.col("_t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()

    here = left.select(*key, F.col(on).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    there = right.select(*key, F.col(at).alias("_t"), F.struct(*[F.col(c).alias(names[c]) for c in rest]).alias("_r")).where(usable)
    there = there.groupBy(*keys, "_t").agg(F.max("_r").alias("_r"))
    none = {"_l": here.schema["_l"].dataType, "_r": there.schema["_r"].dataType}
    rows = here.where(usable).withColumn("_r", F.lit(None).cast(none["_r"])).withColumn("_side", F.lit(0 if strict else 1))
    rows = rows.unionByName(there.withColumn("_l", F.lit(None).cast(none["_l"])).withColumn("_side", F.lit(1 if strict else 0)))
    rows = rows.withColumn("_s", _slice(rows, cuts))

    inside = Window.partitionBy(*keys, "_s").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(inside)).where("_l is not null")

    # what each slice inherits: one row per (key, slice) of the right side, in order of slices
    ends = there.withColumn("_s", _slice(there, cuts)).groupBy(*keys, "_s").agg(F.max_by("_r", "_t").alias("_e"))
    wanted = seen.where("_r is null").select(*keys, "_s").distinct().withColumn("_e", F.lit(None).cast(none["_r"])).withColumn("_ask", F.lit(0))
    steps = ends.withColumn("_ask", F.lit(1)).unionByName(wanted)
    earlier = Window.partitionBy(*keys).orderBy("_s", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    carried = steps.withColumn("_e", F.last("_e", ignorenulls=True).over(earlier)).where("_ask = 0").drop("_ask")

    found = seen.where("_r is not null").select("_l", "_r")
    late = seen.where("_r is null").drop("_r").join(carried, [*keys, "_s"], "left").select("_l", F.col("_e").alias("_r"))
    out = found.unionByName(late)
    if outer:
        out = out.unionByName(here.where(~usable).select("_l", F.lit(None).cast(none["_r"]).alias("_r")))
    else:
        out = out.where("_r is not null")
    return out.select("_l.*", *[F.col("_r").getField(names[c]).alias(names[c]) for c in rest])
