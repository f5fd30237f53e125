"""Interval masks against pixel tables and plain definitions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import intervals as I
from lumenspan.operators import pixels as P

SHAPE = P.Shape(20, 26)


@pytest.fixture(scope="module")
def masks(spark):
    """Random frames: sparse, dense, blobs, full, one pixel, touching edges."""
    rng = np.random.default_rng(3)
    frames = [rng.random((20, 26)) < p for p in (0.05, 0.3, 0.5, 0.7, 0.95)] + [np.ones((20, 26), bool)]
    yy, xx = np.mgrid[:20, :26]
    frames += [(yy - 9) ** 2 + (xx - 12) ** 2 < 50, (abs(yy - 9) + abs(xx - 3) < 6) ^ ((yy - 9) ** 2 + (xx - 3) ** 2 < 4)]
    one = np.zeros((20, 26), bool)
    one[19, 25] = True
    frames += [one, np.eye(20, 26, dtype=bool)]
    rows = [(i, int(u), int(v)) for i, m in enumerate(frames) for v, u in np.argwhere(m)]
    return spark.createDataFrame(rows, "frame long, u long, v long").cache()


def same(runs, pixels):
    got = sorted(map(tuple, I.to_pixels(runs).select("frame", "u", "v").collect()))
    assert got == sorted(map(tuple, pixels.select("frame", "u", "v").collect()))
    rows = sorted(map(tuple, runs.select("frame", "v", "u0", "u1").collect()))
    assert all(a[:2] != b[:2] or a[3] + 1 < b[2] for a, b in zip(rows, rows[1:], strict=False))  # neither touch nor overlap


@pytest.mark.parametrize("element", [P.ellipse(1), P.ellipse(3), P.box(2), [(0, 0), (1, 0), (2, 0), (0, 1)]])
def test_erosion_and_dilation(masks, element):
    runs = I.from_pixels(I.dealt(masks))
    same(runs, masks)
    same(I.dilate(runs, element, SHAPE), P.dilate(masks, element, SHAPE))
    same(I.erode(runs, element, SHAPE), P.erode(masks, element, SHAPE))


def test_set_algebra(masks):
    other = masks.select(F.pmod(F.col("frame") + 1, F.lit(10)).alias("frame"), "u", "v")
    a, b = I.from_pixels(masks), I.from_pixels(other)
    same(I.union(a, b), masks.union(other).distinct())
    same(I.both(a, b), masks.join(other, P.PIXEL, "left_semi"))
    same(I.minus(a, b), masks.join(other, P.PIXEL, "left_anti"))
    frames = masks.select("frame").distinct()
    same(I.tiled(a, SHAPE).where("not on"), P.complement(masks, frames, SHAPE))


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_and_holes(masks, connectivity):
    runs, frames = I.from_pixels(masks), masks.select("frame").distinct()
    want = P.labels(masks, SHAPE, connectivity)
    got = I.labelled(runs, SHAPE, connectivity).select("frame", "label", F.explode(F.sequence("u0", "u1")).alias("u"), "v")
    assert sorted(map(tuple, got.select("frame", "u", "v", "label").collect())) == sorted(map(tuple, want.select("frame", "u", "v", "label").collect()))
    for most in (None, 2):
        holes = P.holes(masks, frames, SHAPE, connectivity, most)
        same(I.holes(runs, SHAPE, connectivity, most), holes)
        same(I.filled(runs, SHAPE, connectivity, most), masks.union(holes).distinct())
    same(I.largest(runs, SHAPE), P.largest(masks, SHAPE))


def inside_hull(points):
    """Places of the box that no line through two points parts from all."""
    out = set()
    us, vs = [u for u, _ in points], [v for _, v in points]
    lines = [(a, b) for a in points for b in points if a != b and all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in points)]
    for u in range(min(us), max(us) + 1):
        for v in range(min(vs), max(vs) + 1):
            if all((b[0] - a[0]) * (v - a[1]) - (b[1] - a[1]) * (u - a[0]) >= 0 for a, b in lines):
                out.add((u, v))
    return out


def test_hull(spark):
    rng = np.random.default_rng(5)
    sets = [{(int(u), int(v)) for u, v in rng.integers(0, rng.integers(2, 18), (rng.integers(1, 14), 2))} for _ in range(60)] + [{(3, 4)}, {(2, 2), (5, 2)}, {(2, 2), (2, 9)}, {(0, 0), (4, 8), (2, 4)}, {(0, 0), (3, 7)}]
    mask = spark.createDataFrame([(i, u, v) for i, s in enumerate(sets) for u, v in s], "frame long, u long, v long")
    got = {i: set() for i in range(len(sets))}
    for r in I.to_pixels(I.convex(I.from_pixels(mask))).collect():
        got[r.frame].add((r.u, r.v))
    assert got == {i: inside_hull(sorted(s)) for i, s in enumerate(sets)}


def inside_polygon(edges, u, v):
    """On an edge, or an odd number of edges to the right."""
    odd = False
    for au, av, bu, bv in edges:
        cross = (bu - au) * (v - av) - (bv - av) * (u - au)
        if cross == 0 and min(au, bu) <= u <= max(au, bu) and min(av, bv) <= v <= max(av, bv):
            return True
        if (av <= v) != (bv <= v) and (cross > 0) == (bv > av):
            odd = not odd
    return odd


def test_polygons(spark):
    """Concave, self-touching, self-crossing, outside the frame, and a line."""
    rng = np.random.default_rng(6)
    shapes = [[(2, 2), (20, 3), (9, 9), (22, 17), (3, 15)], [(1, 1), (9, 1), (5, 5), (9, 9), (1, 9), (5, 5)], [(2, 2), (20, 14), (20, 2), (2, 14)], [(-5, -5), (40, 5), (10, 30)], [(3, 3), (9, 6)], [(4, 4), (12, 4)], [(7, 7)]]
    shapes += [[tuple(map(int, p)) for p in rng.integers(0, (26, 20), (rng.integers(3, 8), 2))] for _ in range(30)]
    edges = [[(*a, *b) for a, b in zip(s, s[1:] + s[:1], strict=True)] for s in shapes]
    rows = [(i, *e) for i, es in enumerate(edges) for e in es]
    got = {(r.frame, r.u, r.v) for r in I.to_pixels(I.polygons(spark.createDataFrame(rows, "frame long, au int, av int, bu int, bv int"), SHAPE)).collect()}
    assert got == {(i, u, v) for i, es in enumerate(edges) for u in range(26) for v in range(20) if inside_polygon(es, u, v)}


def test_a_frame_of_full_size(spark):
    """1280 x 800 pixels in seconds: closed, largest, filled, hull, eroded."""
    shape = P.Shape(800, 1280)
    grid = spark.range(800 * 1280).select(F.lit(0).cast("long").alias("frame"), (F.col("id") % 1280).alias("u"), F.floor(F.col("id") / 1280).alias("v"))
    disc = "(u - 640) * (u - 640) + (v - 400) * (v - 400)"
    mask = grid.where(f"{disc} between 10000 and 90000 and (xxhash64(u, v) % 50 <> 0)")
    begin = time.time()
    runs = I.from_pixels(I.dealt(mask))
    closed = I.erode(I.dilate(runs, P.ellipse(3), shape), P.ellipse(3), shape)
    full = I.filled(I.largest(closed, shape), shape)
    hull = I.convex(full)
    area, hull_area = (m.agg(F.sum("u1") - F.sum("u0") + F.count("*")).first()[0] for m in (I.erode(full, P.ellipse(10), shape), hull))
    assert time.time() - begin < 60
    assert abs(area / (np.pi * 290**2) - 1) < 0.01 and abs(hull_area / (np.pi * 300**2) - 1) < 0.01


def test_shuffles_of_many_steps(masks):
    """Frames are dealt once, and once after the labels of each of two steps."""
    runs = I.from_pixels(I.dealt(masks))
    out = I.erode(I.filled(I.largest(I.dilate(runs, P.ellipse(2), SHAPE), SHAPE), SHAPE), P.ellipse(1), SHAPE)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3


def test_frames_are_dealt_to_all_tasks(spark):
    """Parts of few bytes were joined into one before, and all sorts were one task's."""
    runs = spark.range(64).select(F.col("id").alias("frame"), F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("u0"), F.lit(3).cast("long").alias("u1"))
    at = I.dealt(runs).withColumn("part", F.spark_partition_id())
    assert at.select("part").distinct().count() == 4
    assert at.select("frame", "part").distinct().count() == 64
