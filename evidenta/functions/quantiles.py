"""Exact quantiles and running totals that gather no group, and no run of ties, in one task's memory."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Equal parts of a quantile's bracket; only the levels of one or two of them are ordered.
PARTS = 4096
#: A sketch of this accuracy misses a rank by at most a 10,000th of the rows; the bracket leaves five times that.
ACCURACY, SLACK = 10_000, 0.0005
#: A running total has SPLITS * SPLITS range buckets, as edges of edges.
SPLITS = 32


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def exact_quantile(df: DataFrame, value: str, q: float = 0.5, by: list[str] | None = None, name: str = "quantile") -> DataFrame:
    """One row per group with the interpolated quantile (the same as ``percentile``) and the count ``n``.

    A mergeable sketch brackets the quantile; rows below the bracket are only counted.  The rows inside become levels
    (value, count), so ties cost nothing, and are counted in PARTS equal parts of the bracket; the levels of the part
    that holds the quantile are ordered.  Should the sketch miss, the bracket is the whole range.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("qv"))
    keys = by
    if not by:
        rows, keys = rows.withColumn("one", F.lit(0)), ["one"]
    k1, k2, k3 = ([f"{p}_{b}" for b in keys] for p in ("k", "c", "w"))

    def named(other: list[str]) -> list[Column]:
        return [F.col(b).alias(o) for b, o in zip(keys, other, strict=True)]

    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("qv", F.array(F.lit(max(q - SLACK, 0.0)), F.lit(min(q + SLACK, 1.0))), ACCURACY).alias("edges"),
        F.count(F.lit(1)).alias("n"), F.min("qv").alias("least"), F.max("qv").alias("most"),
    )
    sketch = sketch.select(*named(k1), "n", "least", "most", F.col("edges")[0].alias("lo"), F.col("edges")[1].alias("hi"))
    place = (F.col("n") - 1) * F.lit(q)
    counted = (
        rows.join(sketch, _same(keys, k1))
        .groupBy(*keys, "n", "least", "most", "lo", "hi")
        .agg(F.count(F.when(F.col("qv") < F.col("lo"), 1)).alias("below"), F.count(F.when(F.col("qv") <= F.col("hi"), 1)).alias("upto"))
        .withColumn("fits", (F.col("below") <= F.floor(place)) & (F.col("upto") > F.ceil(place)))
    )
    bounds = counted.select(
        *named(k2), "n", F.when(F.col("fits"), F.col("lo")).otherwise(F.col("least")).alias("lo"),
        F.when(F.col("fits"), F.col("hi")).otherwise(F.col("most")).alias("hi"), F.when(F.col("fits"), F.col("below")).otherwise(0).alias("below"),
    )
    at = F.least(F.lit(PARTS - 1), F.floor((F.col("qv") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS))
    part = F.when(F.col("hi") > F.col("lo"), at).otherwise(0).cast("int")
    inside = rows.join(bounds, _same(keys, k2)).where(F.col("qv").between(F.col("lo"), F.col("hi")))
    levels = inside.groupBy(*keys, "n", "below", part.alias("part"), "qv").agg(F.count(F.lit(1)).alias("m"))
    sums = levels.groupBy(*keys, "n", "below", "part").agg(F.sum("m").alias("s"))
    ahead = F.sum("s").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below") - F.col("s")
    wanted = sums.withColumn("ahead", ahead).where((F.col("ahead") <= F.ceil(place)) & (F.col("ahead") + F.col("s") > F.floor(place)))
    wanted = wanted.select(*named(k3), F.col("part").alias("w_part"), "ahead")
    upto = F.col("ahead") + F.sum("m").over(Window.partitionBy(*keys, "part").orderBy("qv").rowsBetween(Window.unboundedPreceding, 0))
    found = levels.join(wanted, _same([*keys, "part"], [*k3, "w_part"])).withColumn("upto", upto)
    low, high = F.min(F.when(F.col("upto") > F.floor(place), F.col("qv"))), F.min(F.when(F.col("upto") > F.ceil(place), F.col("qv")))
    out = found.groupBy(*keys, "n").agg(low.alias("low"), high.alias("high"))
    weight = place - F.floor(place)
    return out.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * weight).alias(name), "n")


def running_total(levels: DataFrame, key: str, m: str) -> DataFrame:
    """``levels`` (one row per key) with ``upto``: the sum of ``m`` over keys up to this one.

    Keys fall into SPLITS * SPLITS range buckets (edges of a mergeable sketch; any edges give the right totals, even
    ones balance the work).  A window orders the keys of one bucket, another one the buckets' sums.
    """
    shares = [i / SPLITS**2 for i in range(1, SPLITS**2)]
    edges = levels.agg(F.percentile_approx(key, F.lit(shares), 4 * SPLITS**2).alias("edges")).first()["edges"] or []  # at most 1,023 numbers
    coarse, every = (F.lit(np.array(x, dtype=np.float64)) for x in (edges[SPLITS - 1 :: SPLITS], edges))
    placed = levels.withColumn("first", F.size(F.filter(coarse, lambda e: e < F.col(key))))
    fine = F.size(F.filter(F.slice(every, F.col("first") * SPLITS + 1, F.lit(SPLITS - 1)), lambda e: e < F.col(key)))
    keyed = placed.withColumn("bucket", F.col("first") * SPLITS + fine).drop("first")
    sums = keyed.groupBy("bucket").agg(F.sum(m).alias("bs"))
    offsets = sums.select(F.col("bucket").alias("b2"), (F.sum("bs").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bs")).alias("before"))
    inside = F.sum(m).over(Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return keyed.withColumn("inside", inside).join(F.broadcast(offsets), F.col("bucket") == F.col("b2")).withColumn("upto", F.col("before") + F.col("inside")).drop("bucket", "b2", "before", "inside")
