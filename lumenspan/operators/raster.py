"""Patch grids and masks as tables of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def positions(length: int, patch: int, stride: int, strict: bool = True) -> list[int]:
    """Starts of patches along a side.  A side shorter than a patch is an
    error, or without ``strict`` has none."""
    if length < patch:
        if strict:
            raise ValueError(f"side {length} is shorter than patch {patch}")
        return []
    return list(range(0, length - patch + 1, stride))


def position_array(length: Column, patch: int, stride: int) -> Column:
    """Column form; empty where the side is shorter than a patch."""
    return F.when(length >= patch, F.sequence(F.lit(0).cast("long"), length.cast("long") - patch, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def grid_positions(spark: SparkSession, width: int, height: int, patch: int, stride: int) -> DataFrame:
    """(patch_index, x, y), row by row."""
    nx = len(positions(width, patch, stride))
    n = nx * len(positions(height, patch, stride))
    return spark.range(n).select(F.col("id").alias("patch_index"), (F.col("id") % nx * stride).alias("x"), (F.floor(F.col("id") / nx) * stride).alias("y"))


def coverage(pixels: DataFrame, grid: DataFrame, patch: int, stride: int) -> DataFrame:
    """Share of each patch's pixels with ``hit``.  A pixel lists the starts of
    the patches over it, so the join is on equal starts."""
    def over(c: str) -> Column:
        top = F.floor(F.col(c) / stride) * stride
        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(patch // stride)), lambda k: top - k * stride), lambda s: (s >= 0) & (s > F.col(c) - patch))

    p = pixels.withColumn("x", F.explode(over("u"))).withColumn("y", F.explode(over("v")))
    return p.join(F.broadcast(grid), ["x", "y"]).groupBy("patch_index", "x", "y").agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("coverage"))
