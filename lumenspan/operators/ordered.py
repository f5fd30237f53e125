"""Ordered analytics: streaks, rolling medians, cursors and tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_as_null(depth: Column) -> Column:
    """Depth that is not finite or not above zero is missing."""
    return F.when((depth > 0) & ~F.isnan(depth) & (depth < float("inf")), depth)


def median_of(values: Column) -> Column:
    """Median of an array, NULLs left out; NULL if none is left."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)


def rolling_median(df: DataFrame, value: str, keys: list[str], order: list[str], rows: int, out: str) -> DataFrame:
    """Median of the last ``rows`` values that are not missing; 0 if all are."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("_win", F.collect_list(missing_as_null(F.col(value))).over(w)).withColumn(out, F.coalesce(median_of(F.col("_win")), F.lit(0.0))).drop("_win")


def streak(df: DataFrame, ok: Column, keys: list[str], order: list[str], out: str = "streak") -> DataFrame:
    """Length of the run of passing rows that ends at each row."""
    w = W.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_ok", F.coalesce(ok, F.lit(False)).cast("int")).withColumn("_island", F.sum(1 - F.col("_ok")).over(w))
    run = W.partitionBy(*keys, "_island").orderBy(*order)
    return df.withColumn(out, F.sum("_ok").over(run).cast("long")).drop("_ok", "_island")


def first_streak(df: DataFrame, ok: Column, keys: list[str], order: str, need: int, attempts: int) -> DataFrame:
    """Per key the first row, of ``attempts`` at most, that ends ``need``
    passing rows in sequence; NULL if none does."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = streak(df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= attempts), ok, keys, [order])
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("streak") >= need, F.col(order))).alias("ready_at"), F.count("*").alias("evaluated"))


def before_first_failure(df: DataFrame, failed: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows up to and with the first failure of each key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(failed.cast("int")).over(w), F.lit(0))).where("_before = 0").drop("_before")


def best(df: DataFrame, keys: list[str], by: list[Column], what: list[str]) -> DataFrame:
    """The row of each key with the largest ``by`` (a struct: ties are settled
    by its later fields)."""
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*what), F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)])).alias("_row"))
    return got.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in what])
