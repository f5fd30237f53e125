"""Masks as tables: a mask is the set pixels (frame, u, v) of any number of
frames, and its operators are joins, groupings and windows on them.

Frames are as high and wide as ``shape`` says.  Each operator deals rows by
frame and pixel; only the labels of components are found frame by frame, by a
kernel that holds one frame's set pixels.  The same operators on runs of pixels
(``intervals``) need far fewer rows and shuffles: queries use those, tests hold
the two against each other; density and warping work on pixels.  An empty mask stays empty; pixels outside
the frame are never made; frames without a set pixel have no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.session import written

PIXEL = ["frame", "u", "v"]
MASK = "frame long, u long, v long"


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets (du, dv) of an elliptical element of 2 * radius + 1 rows: a row's
    half width is rounded."""
    if radius == 0:
        return [(0, 0)]
    half = {dv: round(radius * (1 - (dv / radius) ** 2) ** 0.5) for dv in range(-radius, radius + 1)}
    return [(du, dv) for dv, x in half.items() for du in range(-x, x + 1)]


def box(radius: int) -> list[tuple[int, int]]:
    side = range(-radius, radius + 1)
    return [(du, dv) for dv in side for du in side]


@dataclass(frozen=True)
class Shape:
    height: int
    width: int

    def holds(self, u: Column, v: Column) -> Column:
        return u.between(0, self.width - 1) & v.between(0, self.height - 1)

    def border(self, margin: int = 0) -> Column:
        """Pixels within ``margin`` of the frame's edge."""
        return ~(F.col("u").between(margin + 1, self.width - margin - 2) & F.col("v").between(margin + 1, self.height - margin - 2))


def _moved(mask: DataFrame, offsets: list[tuple[int, int]], shape: Shape) -> DataFrame:
    """A row for each pixel and offset whose sum lies in the frame."""
    steps = F.array(*[F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv")) for du, dv in offsets])
    rows = mask.select("*", F.explode(steps).alias("_o")).withColumns({"u": F.col("u") + F.col("_o.du"), "v": F.col("v") + F.col("_o.dv")})
    return rows.where(shape.holds(F.col("u"), F.col("v"))).drop("_o")


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], shape: Shape) -> DataFrame:
    return _moved(mask, offsets, shape).select(*PIXEL).distinct()


def erode(mask: DataFrame, offsets: list[tuple[int, int]], shape: Shape, outside: bool = True) -> DataFrame:
    """Pixels all of whose neighbours are set; those outside the frame count as
    set, or as unset."""
    found = _moved(mask.select(*PIXEL), [(-du, -dv) for du, dv in offsets], shape).groupBy(*PIXEL).agg(F.count("*").alias("n"))
    need = F.lit(len(offsets))
    if outside:
        steps = F.array(*[F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv")) for du, dv in offsets])
        need = F.size(F.filter(steps, lambda o: shape.holds(F.col("u") + o["du"], F.col("v") + o["dv"])))
    return found.where(F.col("n") == need).select(*PIXEL)


def erode_box(mask: DataFrame, radius: int, shape: Shape) -> DataFrame:
    """Erosion by a box of any size in two windows, along rows and along
    columns; pixels outside the frame count as set."""
    out = mask.select(*PIXEL)
    for a, b, size in (("u", "v", shape.width), ("v", "u", shape.height)):
        near = F.count("*").over(W.partitionBy("frame", b).orderBy(a).rangeBetween(-radius, radius))
        full = F.least(F.col(a) + radius, F.lit(size - 1)) - F.greatest(F.col(a) - radius, F.lit(0)) + 1
        out = out.withColumn("_n", near).where(F.col("_n") == full).drop("_n")
    return out


def complement(mask: DataFrame, frames: DataFrame, shape: Shape) -> DataFrame:
    """The pixels of ``frames`` (frame) that are not set."""
    side = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    whole = frames.select("frame", side(shape.height).alias("v")).select("frame", side(shape.width).alias("u"), "v")
    return whole.join(mask, PIXEL, "left_anti")


def labels(mask: DataFrame, shape: Shape, connectivity: int = 8) -> DataFrame:
    """(frame, u, v, label): the first pixel, row by row, of each component, as
    v * width + u.  One frame's set pixels are held at once; the result is a
    written table, for it is read more than once."""
    steps = [(1, 0), (0, 1), (1, 1), (-1, 1)][: 4 if connectivity == 8 else 2]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort((pdf["v"] * shape.width + pdf["u"]).to_numpy())
        label, links = at.copy(), []
        for du, dv in steps:
            u, to = at % shape.width + du, at + dv * shape.width + du
            where = np.minimum(np.searchsorted(at, to), len(at) - 1)
            ok = (u >= 0) & (u < shape.width) & (at[where] == to)
            links.append(np.stack([np.flatnonzero(ok), where[ok]]))
        a, b = np.concatenate(links, axis=1)
        root = np.arange(len(at))
        while True:  # each takes the least of its neighbours, then its root's root
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        label = at[root]
        return pd.DataFrame({"frame": pdf["frame"].iloc[0], "u": at % shape.width, "v": at // shape.width, "label": label})

    return written(mask.select(*PIXEL).groupBy("frame").applyInPandas(run, MASK + ", label long"), "labels")


def areas(labelled: DataFrame) -> DataFrame:
    """(frame, label, area, cx, cy) of each component."""
    return labelled.groupBy("frame", "label").agg(F.count("*").alias("area"), F.avg("u").alias("cx"), F.avg("v").alias("cy"))


def best(labelled: DataFrame, score: Column, allowed: Column) -> DataFrame:
    """Each frame's component of largest ``score`` (of area, cx, cy) among those
    allowed; ties go to the lowest label."""
    top = areas(labelled).where(allowed).groupBy("frame").agg(F.max_by("label", F.struct(score.alias("s"), (-F.col("label")).alias("l"))).alias("label"))
    return labelled.join(top, ["frame", "label"], "left_semi").select(*PIXEL)


def largest(mask: DataFrame, shape: Shape) -> DataFrame:
    return best(labels(mask, shape), F.col("area"), F.lit(True))


def holes(mask: DataFrame, frames: DataFrame, shape: Shape, connectivity: int = 8, most: int | None = None) -> DataFrame:
    """Background that does not reach the frame's edge, of ``most`` pixels a
    piece if given.  With connectivity 8 a diagonal gap opens a hole."""
    bg = labels(complement(mask, frames, shape), shape, connectivity)
    closed = bg.groupBy("frame", "label").agg(F.bool_or(shape.border()).alias("_open"), F.count("*").alias("_n")).where(~F.col("_open"))
    closed = closed if most is None else closed.where(F.col("_n") <= most)
    return bg.join(closed, ["frame", "label"], "left_semi").select(*PIXEL)


def density(mask: DataFrame, radius: int, least: float, shape: Shape) -> DataFrame:
    """Pixels whose surrounding box is set to a share of ``least``; beyond the
    frame's edge it is mirrored, the edge included.  Sums run along rows, then
    along columns."""
    side, out = range(-radius, radius + 1), mask.select(*PIXEL, F.lit(1).cast("long").alias("n"))
    for c, size in (("u", shape.width), ("v", shape.height)):
        images = F.array(F.col(c), -1 - F.col(c), 2 * size - 1 - F.col(c))
        out = out.withColumn(c, F.explode(images)).where(F.col(c).between(-radius, size - 1 + radius))
        out = out.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in side]))).where(F.col(c).between(0, size - 1)).groupBy(*PIXEL).agg(F.sum("n").alias("n"))
    return out.where(F.col("n") >= least * (2 * radius + 1) ** 2).select(*PIXEL)


def inverse(matrix) -> tuple:
    """The inverse of a homography, up to its scale (the adjugate)."""
    m = np.asarray(matrix, float)
    return tuple(map(tuple, np.stack([np.cross(m[1], m[2]), np.cross(m[2], m[0]), np.cross(m[0], m[1])], axis=1).tolist()))


def warp(mask: DataFrame, matrix, shape: Shape) -> DataFrame:
    """Nearest pixels of masks seen through a 3 x 3 homography that maps places
    of the result to places of the mask."""
    spark = mask.sparkSession
    grid = spark.range(shape.height * shape.width).select((F.col("id") % shape.width).alias("x"), F.floor(F.col("id") / shape.width).alias("y"))
    at = [sum((F.lit(float(k)) * c for k, c in zip(row, (F.col("x"), F.col("y"), F.lit(1.0)), strict=True)), F.lit(0.0)) for row in matrix]
    grid = grid.select("x", "y", F.rint(at[0] / at[2]).cast("long").alias("u"), F.rint(at[1] / at[2]).cast("long").alias("v"))
    return mask.join(F.broadcast(grid), ["u", "v"]).select("frame", F.col("x").alias("u"), F.col("y").alias("v"))  # one row a pixel of a frame
