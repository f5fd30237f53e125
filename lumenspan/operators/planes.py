"""Grouping of planes that are one surface."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest angle in degrees and distance in millimetres of one surface (fixed values).
ANGLE_DEG, DISTANCE_MM = 2.0, 5.0
#: A run of so many planes is compared whole.
FEW = 64


def same_plane(planes: DataFrame, run: str = "run", angle: float = ANGLE_DEG, distance: float = DISTANCE_MM, few: int = FEW) -> DataFrame:
    """(run, a, b), a < b: pairs of a run's planes (idx, normal, centre) whose
    normals, up to their sign, and symmetric centre distances agree.

    Planes of a run of up to ``few`` meet each other at once.  Those of a larger
    run meet by cells: normals on a grid twice as wide as their largest
    difference, so that each lies near eight cells at most, and within a cell in
    bands along the cell's direction.  A band is wide enough for what the limits
    and the run's extent let two agreeing centres differ by, so no pair is lost,
    and the exact test follows.  Both sides come together by a merge join: their
    rows grow with the planes, which the size of the table's files does not tell.
    """
    near = 2 * math.sin(math.radians(angle) / 2) * (1 + 1e-9) + 1e-12  # between unit normals
    cell, half = 2 * near, math.sqrt(3) * near  # a cell's width, and the way from its middle to a corner
    axes = range(3)
    dot = lambda x, y: sum((x[i] * y[i] for i in axes), F.lit(0.0))
    normal = [F.col("normal")[i] for i in axes]
    size = F.sqrt(dot(normal, normal))
    p = planes.select(run, "idx", *[(normal[i] / size).alias(f"n{i}") for i in axes], *[F.col("centre")[i].alias(f"c{i}") for i in axes])
    extent = F.sqrt(sum((F.max(f"c{i}") - F.min(f"c{i}")) ** 2 for i in axes))
    # a pair's centres differ along the middle of a cell by what they do along
    # their own normals, and the extent times how far these are from the middle
    wide = p.groupBy(run).agg((distance + extent * (half + near) + 1e-6).alias("w"), (F.count("*") <= few).alias("few"))
    p = p.join(wide.hint("merge"), run)

    def met(side: str, reach: float, spread: float) -> DataFrame:
        """A plane's rows by cell and band: its own, or all within reach."""
        rows = p.withColumn("sign", F.explode(F.when(~F.col("few") & F.lit(reach > 0), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))))
        for i in axes:
            at = lambda off, i=i: F.floor((F.col("sign") * F.col(f"n{i}") + off) / cell).cast("long")
            rows = rows.withColumn(f"g{i}", F.explode(F.when(F.col("few"), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(at(-reach), at(reach))))))
        middle = sum(((F.col(f"g{i}") + 0.5) * cell * F.col(f"c{i}") for i in axes), F.lit(0.0)) / (2 * F.col("w"))
        low, high = (F.floor(middle + s * spread).cast("long") for s in (-0.5, 0.5))
        rows = rows.withColumn("band", F.explode(F.when(F.col("few"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(low, high))))
        return rows.select(run, "g0", "g1", "g2", "band", *[F.col(c).alias(f"{c}_{side}") for c in ("idx", "sign", "n0", "n1", "n2", "c0", "c1", "c2")])

    both = met("a", 0.0, 0.0).join(met("b", near, 1.0).hint("merge"), [run, "g0", "g1", "g2", "band"]).where("idx_a < idx_b")
    n_a, n_b = ([F.col(f"n{i}_{s}") for i in axes] for s in "ab")
    delta, across = [F.col(f"c{i}_b") - F.col(f"c{i}_a") for i in axes], dot(n_a, n_b)
    between = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(across))))
    apart = F.greatest(F.abs(dot(delta, n_a)), F.abs(dot(delta, n_b)))
    return both.where((between <= angle) & (apart <= distance)).select(run, F.col("idx_a").alias("a"), F.col("idx_b").alias("b")).distinct()


def plane_groups(planes: DataFrame, links: DataFrame, run: str = "run") -> DataFrame:
    """(run, idx, group): the smallest index that links reach inside the run,
    however long the chain.  A run's links are folded once: each gives the two
    labels that it joins the smaller of them."""
    # the planes of a run are few: each row carries the run's links and folds over them
    per = links.groupBy(run).agg(F.collect_list(F.struct("a", "b")).alias("links"))
    own = planes.groupBy(run).agg(F.sort_array(F.collect_set("idx")).alias("members")).join(per, run, "left")
    none = F.array().cast(per.schema["links"].dataType)

    def joined(labels, link):
        ends = F.array(F.element_at(labels, F.array_position("members", link["a"]).cast("int")), F.element_at(labels, F.array_position("members", link["b"]).cast("int")))
        both = F.array_sort(ends)
        relabelled = F.transform(labels, lambda v: F.when(v == both[1], both[0]).otherwise(v))
        return F.when(both[0] == both[1], labels).otherwise(relabelled)

    out = own.withColumn("label", F.aggregate(F.coalesce("links", none), F.col("members"), joined))
    return out.select(run, F.explode(F.arrays_zip("members", "label")).alias("m")).select(run, F.col("m.members").alias("idx"), F.col("m.label").alias("group"))
