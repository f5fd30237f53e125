"""Exact percentiles of any number of rows by counting.

A percentile lies between two ranks.  Each is looked for in a histogram of the
range that holds it; the bucket with the rank, cut to its least and largest
value, is the next range.  A round is one aggregate, combined before the
shuffle, whose rows are keys times buckets: no task ever holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.session import written

BUCKETS = 1024


def percentile(df: DataFrame, value: str | Column, share: float, keys: list[str] | None = None, name: str = "percentile") -> DataFrame:
    """(keys, name): the interpolated percentile of ``value`` in each group, as
    ``percentile`` gives it.  NULL and NaN values do not count; a group without
    others has no row, and nor has an empty table.  Groups with a NULL key are
    groups.  Rounds end when every rank's range is one value: a range shrinks to
    a thousandth each time, two or three rounds for values of like size, and one
    for each three decimal places that they span."""
    keys = keys or []
    value = F.col(value) if isinstance(value, str) else value
    place = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    rows = df.select(place.alias("_k"), value.cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    at = F.col("n") - 1
    ranks = F.array(F.floor(at * share), F.least(F.floor(at * share) + 1, at))
    whole = rows.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    state = written(whole.select("_k", "n", "low", "high", F.posexplode(ranks).alias("side", "rank"), F.lit(0).cast("long").alias("before")), "ranks")
    while state.where("low < high").limit(1).count():
        # a join keeps NULL keys, for they are wrapped
        inside = rows.join(state.where("low < high"), "_k").where(F.col("_v").between(F.col("low"), F.col("high")))
        bucket = F.least(F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS), F.lit(BUCKETS - 1))
        counted = inside.groupBy("_k", "n", "side", "rank", "before", bucket.alias("b")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.col("before") + F.sum("c").over(W.partitionBy("_k", "side").orderBy("b"))
        found = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        found = found.select("_k", "n", "low", "high", "side", "rank", (F.col("upto") - F.col("c")).alias("before"))
        state = written(found.unionByName(state.where("low = high")), "ranks")
    two = state.groupBy("_k", "n").agg(F.max(F.when(F.col("side") == 0, F.col("low"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("low"))).alias("b"))
    exact = F.col("a") + (F.col("b") - F.col("a")) * (F.lit(share) * at - F.floor(at * share))
    return two.select(*[F.col("_k")[k].alias(k) for k in keys], exact.alias(name))
