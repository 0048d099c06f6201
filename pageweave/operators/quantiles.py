"""Exact percentiles of groups of any size, without a group's values in one buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ranges of equal width into which a group's values fall; only those that hold the rank are looked at singly.
RANGES = 1024


def exact_percentile(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """keys and ``name``, the percentile of a group's values by linear interpolation; nulls don't count, groups without values, and those with a null key, have no row.

    Counts by range, with partial aggregation, tell in which ranges the two ranks about the percentile lie; the different values of those alone, with
    their counts, are put in order. So the task of a group of a third of all rows gets a few of its values.
    """
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    ends = v.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    # halves first: the difference of two values may not fit
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES), F.lit(RANGES - 1)))
    placed = v.join(ends, keys).select(*keys, "v", "n", place.cast("int").alias("part"))
    counted = placed.groupBy(*keys, "part", "v").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    by_part = counted.groupBy(*keys, "part").agg(F.sum("k").alias("k"), F.max("n").alias("n"))
    ahead = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    low = F.floor((F.col("n") - 1) * share)
    ranked = by_part.withColumn("before", F.coalesce(F.sum("k").over(ahead), F.lit(0))).withColumn("low", low)
    near = ranked.where((F.col("before") <= F.least(F.col("low") + 1, F.col("n") - 1)) & (F.col("before") + F.col("k") > F.col("low"))).select(*keys, "part", "before", "low")
    inside = counted.join(near, [*keys, "part"])
    upto = W.partitionBy(*keys, "part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = inside.withColumn("to", F.col("before") + F.sum("k").over(upto)).withColumn("from", F.col("to") - F.col("k"))
    rank = lambda r: (F.col("from") <= r) & (F.col("to") > r)
    high = F.least(F.col("low") + 1, F.col("n") - 1)
    by = told.groupBy(*keys).agg(F.max(F.when(rank(F.col("low")), F.col("v"))).alias("a"), F.max(F.when(rank(high), F.col("v"))).alias("b"), F.max("n").alias("n"), F.max("low").alias("low"))
    part = (F.col("n") - 1) * share - F.col("low")
    return by.select(*keys, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias(name))
