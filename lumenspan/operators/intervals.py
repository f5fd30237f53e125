"""Masks as runs: (frame, v, u0, u1), set pixels of a row from u0 to u1; runs of
a row neither touch nor overlap.

A frame of any size has a few runs a row, so frames are dealt once (``dealt``)
and every operator here keeps a frame where it is: it groups and orders by
(frame, ...) and needs no further shuffle but after labels.  Erosion, dilation and set algebra
are sweeps over the ends of runs.  Only the labels of components leave the
expressions: they take a frame's runs as arrays.  Frames without a set pixel
have no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.operators.pixels import Shape
from lumenspan.session import parts_of

RUN = ["frame", "v", "u0", "u1"]


def _row(order: str):
    return W.partitionBy("frame", "v").orderBy(order)


def dealt(df: DataFrame) -> DataFrame:
    """Rows by frame, in as many parts as the session shuffles into: runs take few
    bytes, so parts joined by their bytes would leave all steps' work, and the
    memory of their sorts, to one or two tasks."""
    return df.repartition(parts_of(df.sparkSession), "frame")


def from_pixels(mask: DataFrame) -> DataFrame:
    """Runs of distinct pixels (frame, u, v), best dealt by frame before."""
    at = mask.select("frame", "u", "v", (F.col("u") - F.row_number().over(_row("u"))).alias("_g"))
    return at.groupBy("frame", "v", "_g").agg(F.min("u").cast("long").alias("u0"), F.max("u").cast("long").alias("u1")).select(F.col("frame").cast("long").alias("frame"), F.col("v").cast("long").alias("v"), "u0", "u1")


def to_pixels(runs: DataFrame) -> DataFrame:
    return runs.select("frame", F.explode(F.sequence("u0", "u1")).alias("u"), "v")


def length() -> Column:
    return F.col("u1") - F.col("u0") + 1


def sweep(rows: DataFrame, inside: Column, tags: dict[str, Column] | None = None) -> DataFrame:
    """Runs of the places at which ``inside`` holds, a condition on how many
    rows (frame, v, u0, u1, in any number over each other) cover them: ``n``, or
    the sums of ``tags``."""
    tags = tags or {"n": F.lit(1)}
    ends = F.array(*[F.struct(at.alias("u"), *[(c * sign).cast("long").alias(t) for t, c in tags.items()]) for at, sign in ((F.col("u0"), 1), (F.col("u1") + 1, -1))])
    events = rows.select("frame", "v", F.explode(ends).alias("e")).groupBy("frame", "v", F.col("e.u").alias("u")).agg(*[F.sum(f"e.{t}").alias(t) for t in tags])
    order = _row("u")
    depth = events.select("frame", "v", "u", *[F.sum(t).over(order).alias(t) for t in tags]).withColumn("_in", inside)
    turns = depth.withColumn("_was", F.lag("_in", 1, False).over(order)).where(F.col("_in") != F.col("_was"))
    runs = turns.select("frame", "v", F.col("u").alias("u0"), (F.lead("u").over(order) - 1).alias("u1"), "_in")
    return runs.where("_in").select(*RUN)


def rows_of(offsets: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(dv, first du, last du) of an element whose rows have no gap."""
    rows: dict[int, list[int]] = {}
    for du, dv in offsets:
        rows.setdefault(dv, []).append(du)
    for dv, us in rows.items():
        if max(us) - min(us) + 1 != len(set(us)):
            raise ValueError(f"row {dv} of the element has a gap")
    return sorted((dv, min(us), max(us)) for dv, us in rows.items())


def _steps(rows: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("dv", "lo", "hi"), r, strict=True)]) for r in rows])


def _spread(runs: DataFrame, steps: Column, shape: Shape) -> DataFrame:
    """The runs moved and widened by each row of an element, inside the frame."""
    o = runs.select(*RUN, F.explode(steps).alias("o"))
    moved = o.select("frame", (F.col("v") + F.col("o.dv")).alias("v"), F.greatest(F.col("u0") + F.col("o.lo"), F.lit(0)).alias("u0"), F.least(F.col("u1") + F.col("o.hi"), F.lit(shape.width - 1)).alias("u1"))
    return moved.where(F.col("v").between(0, shape.height - 1) & (F.col("u0") <= F.col("u1")))


def dilate(runs: DataFrame, offsets: list[tuple[int, int]], shape: Shape) -> DataFrame:
    return sweep(_spread(runs, _steps(rows_of(offsets)), shape), F.col("n") > 0)


def dilate_by(runs: DataFrame, radius: Column, elements: list[list[tuple[int, int]]], shape: Shape) -> DataFrame:
    """Dilation by ``elements[radius]``, where radius is a number a run."""
    steps = F.get(F.array(*[_steps(rows_of(e)) for e in elements]), F.col("_r"))
    return sweep(_spread(runs.withColumn("_r", radius.cast("int")), steps, shape), F.col("n") > 0)


def erode(runs: DataFrame, offsets: list[tuple[int, int]], shape: Shape) -> DataFrame:
    """Pixels all of whose neighbours are set; those outside the frame count as
    set.  Each row of the element shrinks the runs of one row, and a pixel stays
    where as many shrunk rows cover it as the frame has for its own row."""
    rows = rows_of(offsets)
    o = runs.select(*RUN, F.explode(_steps(rows)).alias("o"))
    left = F.when(F.col("u0") > 0, F.col("u0") - F.col("o.lo")).otherwise(F.greatest(F.lit(0), -F.col("o.hi")))
    right = F.when(F.col("u1") < shape.width - 1, F.col("u1") - F.col("o.hi")).otherwise(F.lit(shape.width - 1) - F.greatest(F.lit(0), F.col("o.lo")))
    shrunk = o.select("frame", (F.col("v") - F.col("o.dv")).alias("v"), F.greatest(left, F.lit(0)).alias("u0"), F.least(right, F.lit(shape.width - 1)).alias("u1"))
    shrunk = shrunk.where(F.col("v").between(0, shape.height - 1) & (F.col("u0") <= F.col("u1")))
    need = F.lit(0)
    for dv, _, _ in rows:
        need = need + (F.col("v") + dv).between(0, shape.height - 1).cast("int")
    return sweep(shrunk, F.col("n") == need)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(dealt(a.select(*RUN).union(b.select(*RUN))), F.col("n") > 0)


def _tagged(a: DataFrame, b: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    both = a.select(*RUN, F.lit(1).alias("_a")).union(b.select(*RUN, F.lit(0).alias("_a")))
    return dealt(both), {"a": F.col("_a"), "b": 1 - F.col("_a")}


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    rows, tags = _tagged(a, b)
    return sweep(rows, (F.col("a") > 0) & (F.col("b") > 0), tags)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    rows, tags = _tagged(a, b)
    return sweep(rows, (F.col("a") > 0) & (F.col("b") == 0), tags)


def tiled(runs: DataFrame, shape: Shape) -> DataFrame:
    """The runs, and those of the unset pixels of their frames: RUN and ``on``."""
    order = W.partitionBy("frame").orderBy("v", "u0")
    last_v, next_v, next_u = F.lag("v").over(order), F.lead("v").over(order), F.lead("u0").over(order)
    whole, width = F.lit(shape.width - 1).cast("long"), F.lit(shape.width).cast("long")
    near = runs.select(*RUN, F.coalesce(last_v, F.lit(-1)).alias("_last"), F.coalesce(next_v, F.lit(shape.height)).alias("_next"), F.when(next_v == F.col("v"), next_u).otherwise(width).alias("_to"))
    tile = lambda v, a, b, on: F.struct(v.alias("v"), a.cast("long").alias("u0"), b.cast("long").alias("u1"), F.lit(on).alias("on"))
    none = F.array().cast("array<struct<v:bigint,u0:bigint,u1:bigint,on:boolean>>")

    def between(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda v: tile(v, F.lit(0), whole, False))).otherwise(none)

    v = F.col("v")
    here = F.array(tile(v, F.col("u0"), F.col("u1"), True), tile(v, F.col("u1") + 1, F.col("_to") - 1, False))
    first = F.when(F.col("_last") < v, F.concat(F.array(tile(v, F.lit(0), F.col("u0") - 1, False)), between(F.col("_last") + 1, v - 1))).otherwise(none)
    end = F.when(F.col("_next") == shape.height, between(v + 1, F.lit(shape.height - 1).cast("long"))).otherwise(none)
    return near.select("frame", F.explode(F.concat(here, first, end)).alias("t")).select("frame", "t.*").where("u0 <= u1")


def components(v: list[np.ndarray], u0: list[np.ndarray], u1: list[np.ndarray], on: list[np.ndarray], width: int, reach: int) -> list[np.ndarray]:
    """Per frame a label for each run of ``on``: the component's first pixel,
    row by row, as v * width + u; -1 for the others.  Runs overlap (``reach``
    0) or also touch at corners (1); each takes the least label of those beside
    it, then that run's own, until none changes."""
    size = np.array([len(x) for x in v], np.int64)
    out = np.full(size.sum(), -1, np.int64)
    frame = np.repeat(np.arange(len(size)), size)
    v, u0, u1, on = (np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in (v, u0, u1, on))
    at = np.flatnonzero(on)
    row = frame[at] * (int(v.max(initial=0)) + 3) + v[at]
    order = np.lexsort((u0[at], row))
    at, row = at[order], row[order]
    span = width + 4
    begin, end = row * span + u0[at] + 2, row * span + u1[at] + 2
    lo = np.searchsorted(end, begin + span - reach)  # the first run of the next row that ends late enough
    hi = np.searchsorted(begin, end + span + reach, "right")
    many = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(at)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    root = np.arange(len(at))  # in the order of first pixels
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root[a], low[a])
        np.minimum.at(low, root[b], low[b])
        low = low[low]
        if (low == root).all():
            break
        root = low
    out[at] = (v[at] * width + u0[at])[root]
    return np.split(out, np.cumsum(size)[:-1])


def labels(tiles: DataFrame, shape: Shape, connectivity: int = 8) -> DataFrame:
    """``tiles`` (RUN and on) with ``label``: of each run that is on, its
    component; -1 for the others.  A frame's runs are held at once, as arrays."""
    reach, width = int(connectivity == 8), shape.width

    @F.pandas_udf("array<bigint>")
    def label(v: pd.Series, u0: pd.Series, u1: pd.Series, on: pd.Series) -> pd.Series:
        return pd.Series(components(list(v), list(u0), list(u1), list(on), width, reach), dtype=object)

    listed = tiles.groupBy("frame").agg(F.collect_list(F.struct("v", "u0", "u1", "on")).alias("t"))
    column = lambda c: F.transform("t", lambda x: x[c])
    told = listed.select("frame", "t", label(column("v"), column("u0"), column("u1"), column("on")).alias("l"))
    return dealt(told.select("frame", F.explode(F.arrays_zip("t", "l")).alias("z")).select("frame", "z.t.*", F.col("z.l").alias("label")))  # Python forgets how rows are dealt


def labelled(runs: DataFrame, shape: Shape, connectivity: int = 8) -> DataFrame:
    return labels(runs.select(*RUN, F.lit(True).alias("on")), shape, connectivity)


def _measures(part: W) -> dict[str, Column]:
    """Area and centre of the runs of a window."""
    area = F.sum(length()).over(part)
    return {"area": area, "cx": F.sum((F.col("u0") + F.col("u1")) * length() / 2).over(part) / area, "cy": F.sum(F.col("v") * length()).over(part) / area}


def areas(found: DataFrame) -> DataFrame:
    """(frame, label, area, cx, cy) of each component."""
    n = F.sum(length())
    return found.groupBy("frame", "label").agg(n.alias("area"), (F.sum((F.col("u0") + F.col("u1")) * length() / 2) / n).alias("cx"), (F.sum(F.col("v") * length()) / n).alias("cy"))


def best(runs: DataFrame, shape: Shape, score: Column, allowed: Column) -> DataFrame:
    """Each frame's component of largest ``score`` (of area, cx, cy) among those
    allowed; ties go to the lowest label."""
    rated = labelled(runs, shape).withColumns(_measures(W.partitionBy("frame", "label")))
    rated = rated.where(allowed).withColumn("_s", F.struct(score.cast("double").alias("s"), (-F.col("label")).alias("l")))
    return rated.withColumn("_top", F.max("_s").over(W.partitionBy("frame"))).where(F.col("_s") == F.col("_top")).select(*RUN)


def largest(runs: DataFrame, shape: Shape) -> DataFrame:
    return best(runs, shape, F.col("area"), F.lit(True))


def _closed(runs: DataFrame, shape: Shape, connectivity: int, most: int | None) -> DataFrame:
    """The tiles of the runs' frames, those off with ``_hole``: do they belong
    to background that does not reach the edge (and has ``most`` pixels at
    most)."""
    bg = labels(tiled(runs, shape).select(*RUN, (~F.col("on")).alias("on")), shape, connectivity)
    piece = W.partitionBy("frame", "label")
    edge = (F.col("u0") == 0) | (F.col("u1") == shape.width - 1) | F.col("v").isin(0, shape.height - 1)
    hole = F.col("on") & ~F.bool_or(edge).over(piece)
    return bg.withColumn("_hole", hole if most is None else hole & (F.sum(length()).over(piece) <= most))


def holes(runs: DataFrame, shape: Shape, connectivity: int = 8, most: int | None = None) -> DataFrame:
    """Background that does not reach the frame's edge, of ``most`` pixels a
    piece if given.  With connectivity 8 a diagonal gap opens a hole."""
    return _closed(runs, shape, connectivity, most).where("_hole").select(*RUN)


def filled(runs: DataFrame, shape: Shape, connectivity: int = 8, most: int | None = None) -> DataFrame:
    """The runs and their holes."""
    return sweep(_closed(runs, shape, connectivity, most).where("_hole or not on"), F.col("n") > 0)


def _chain(points: Column, way: int) -> Column:
    """Convex chain of points (u, v) in order of v: the outer one to the left
    (way 1) or to the right (-1).  A stack folded over the points: each drops
    the end of the stack from which it bends inwards.  What it drops is an end,
    for a chain is convex, so the rest is found by counting."""
    cross = lambda a, b, p: (b["u"] - a["u"]) * (p["v"] - a["v"]) - (b["v"] - a["v"]) * (p["u"] - a["u"])

    def push(stack, p):
        inner = F.sequence(F.lit(2), F.size(stack))
        stays = F.when(F.size(stack) < 2, F.size(stack)).otherwise(1 + F.size(F.filter(inner, lambda i: cross(F.get(stack, i - 2), F.get(stack, i - 1), p) * way < 0)))
        return F.concat(F.slice(stack, F.lit(1), stays), F.array(p))

    return F.aggregate(points, F.filter(points, lambda p: F.lit(False)), push)


def convex(runs: DataFrame) -> DataFrame:
    """Runs of the pixels inside or on the convex hull of each frame's pixels:
    the chains over the first and the last pixels of its rows, and the scan
    lines between them."""
    ends = runs.groupBy("frame", "v").agg(F.min("u0").alias("a"), F.max("u1").alias("b"))
    rows = ends.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("v", "a", "b"))).alias("r"))
    points = lambda c: F.transform("r", lambda x: F.struct(x[c].alias("u"), x["v"].alias("v")))
    edges = lambda c, way: F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.struct(F.lit(way).alias("way"), F.get(c, i).alias("p"), F.coalesce(F.get(c, i + 1), F.get(c, i)).alias("q")))
    chains = rows.select("frame", _chain(points("a"), 1).alias("left"), _chain(points("b"), -1).alias("right"))
    e = chains.select("frame", F.explode(F.concat(edges(F.col("left"), 1), edges(F.col("right"), -1))).alias("e")).select("frame", "e.*")
    lines = e.select("frame", "way", "p", "q", F.explode(F.sequence("p.v", F.greatest(F.col("p.v"), F.col("q.v") - 1))).alias("v"))
    rise, down = (F.col("q.u") - F.col("p.u")) * (F.col("v") - F.col("p.v")), F.greatest(F.col("q.v") - F.col("p.v"), F.lit(1))
    whole = F.floor(F.when(F.col("way") == 1, rise + down - 1).otherwise(rise) / down)  # rounded inwards
    exact = F.col("p.u") + whole.cast("long")
    out = lines.select("frame", "v", "way", exact.alias("u")).groupBy("frame", "v").agg(F.max(F.when(F.col("way") == 1, F.col("u"))).alias("u0"), F.min(F.when(F.col("way") == -1, F.col("u"))).alias("u1"))
    return out.where("u0 <= u1").select(*RUN)


def polygons(edges: DataFrame, shape: Shape) -> DataFrame:
    """Runs inside or on closed polygons (frame, au, av, bu, bv: edges between
    places with whole coordinates), concave or touching themselves, by parity:
    a scan line meets edges at places, and each pair in order holds a run.
    Edges count with their upper, then with their lower end left out; what lies
    level or on an end is added, so that outlines are inside."""
    e = edges.select("frame", *[F.col(c).cast("long").alias(c) for c in ("au", "av", "bu", "bv")])
    low, high = F.least("av", "bv"), F.greatest("av", "bv")
    line = e.select("frame", "au", "av", "bu", "bv", F.explode(F.sequence(low, high)).alias("v"))
    slope = (F.col("v") - F.col("av")) / (F.col("bv") - F.col("av"))
    x = F.when(F.col("av") == F.col("bv"), F.lit(None)).otherwise(F.col("au") + (F.col("bu") - F.col("au")) * slope)
    sides = F.filter(F.array(F.when(F.col("v") < high, 0), F.when(F.col("v") > low, 1)), lambda s: s.isNotNull())
    met = line.select("frame", "v", x.alias("x"), F.explode(sides).alias("side")).where("x is not null")
    order = W.partitionBy("frame", "v", "side").orderBy("x")
    pairs = met.withColumn("k", F.row_number().over(order)).withColumn("to", F.lead("x").over(order)).where("k % 2 = 1")
    tiny = 1e-9  # places are fractions of small whole numbers
    inside = pairs.select("frame", "v", F.ceil(F.col("x") - tiny).alias("u0"), F.floor(F.col("to") + tiny).alias("u1"))
    on = line.where("av = bv").select("frame", "v", F.least("au", "bu").alias("u0"), F.greatest("au", "bu").alias("u1"))
    spot = line.where("av <> bv").select("frame", "v", x.alias("x")).where(F.abs(F.col("x") - F.round("x")) < tiny).select("frame", "v", F.round("x").cast("long").alias("u0"), F.round("x").cast("long").alias("u1"))
    rows = inside.union(on).union(spot).select("frame", "v", F.greatest(F.col("u0"), F.lit(0)).alias("u0"), F.least(F.col("u1"), F.lit(shape.width - 1)).alias("u1"))
    return sweep(dealt(rows.where(F.col("v").between(0, shape.height - 1) & (F.col("u0") <= F.col("u1")))), F.col("n") > 0)
