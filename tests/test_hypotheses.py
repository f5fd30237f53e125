"""Planes by votes against literals, numpy and what was planted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import hypotheses as V

SCHEMA = "key long, id long, x double, y double, z double"


def table(spark, groups):
    return spark.createDataFrame([(k, i, *map(float, p)) for k, ps in groups.items() for i, p in enumerate(ps)], SCHEMA)


def test_metric_planes_among_outliers(spark):
    rng = np.random.default_rng(2)
    groups, truth = {}, {}
    for k in range(12):
        n = rng.normal(size=3)
        n /= np.linalg.norm(n)
        n = n * (-1 if n[2] > 0 else 1)
        basis = np.linalg.svd(n[None])[2][1:]
        on = rng.uniform(-100, 100, (300, 2)) @ basis + n * (-400) + rng.normal(0, 0.3, (300, 1)) * n
        groups[k] = np.concatenate([on, rng.uniform(-300, 300, (90, 3))])
        truth[k] = n
    got = {r.key: r for r in V.planes(table(spark, groups), V.METRIC, tolerance=2.5, least=50).collect()}
    for k, n in truth.items():
        r = got[k]
        assert np.degrees(np.arccos(min(1, abs(n @ (r.a, r.b, r.c))))) < 0.2 and abs(np.linalg.norm((r.a, r.b, r.c)) - 1) < 1e-9
        assert 300 <= r.inliers < 320 and 0.1 < r.residual < 0.4 and r.c < 0
        inside = groups[k][np.abs(groups[k] @ (r.a, r.b, r.c) - r.d) <= 2.5]
        assert len(inside) == r.inliers


def test_fit_equals_least_squares(spark):
    """All points vote, so the fit is that of numpy on all of them."""
    rng = np.random.default_rng(3)
    xy = rng.uniform(-1, 1, (400, 2))
    depth = 1 / (xy @ (0.0001, -0.00008) + 0.002) + rng.normal(0, 0.2, 400)
    (r,) = V.planes(table(spark, {5: np.c_[xy, depth]}), V.INVERSE, tolerance=2.5, least=50).collect()
    want, *_ = np.linalg.lstsq(np.c_[xy, np.ones(400)], 1 / depth, rcond=None)
    assert np.allclose((r.a, r.b, r.c), want, rtol=1e-6) and r.inliers == r.n == 400
    assert r.residual == pytest.approx(np.median(np.abs(1 / (np.c_[xy, np.ones(400)] @ want) - depth)), rel=1e-6)
    xyz = np.c_[xy * 50, 500 + xy @ (3, 4) + rng.normal(0, 0.1, 400)]
    (m,) = V.planes(table(spark, {5: xyz}), V.METRIC, tolerance=5, least=50).collect()
    axis = np.linalg.svd(xyz - xyz.mean(0))[2][2]
    assert abs(abs(axis @ (m.a, m.b, m.c)) - 1) < 1e-9


def test_sequential_planes(spark):
    rng = np.random.default_rng(4)
    level = lambda n, z: np.c_[rng.uniform(0, 100, (n, 2)), np.full(n, z)]
    groups = {1: np.concatenate([level(200, 500.0), level(120, 600.0), level(60, 700.0)]), 2: level(90, 400.0), 3: rng.uniform(0, 900, (20, 3)), 4: np.zeros((3, 3))}
    got = sorted((r.key, r.no, r.inliers, round(r.d / r.c)) for r in V.sequential(table(spark, groups), V.METRIC, 3, tolerance=2.5, least=50).collect())
    assert got == [(1, 1, 200, 500), (1, 2, 120, 600), (1, 3, 60, 700), (2, 1, 90, 400)]


def test_hypotheses_name_three_places():
    env = {"least": min, "greatest": max}
    for m in (3, 4, 7, 500):
        for k in range(160):
            first = (k * 7919 + V.SEED) * 31 % 1000003 % m
            second = (first + 1 + (k * 104729 + V.SEED) * 17 % 1000003 % (m - 1)) % m
            step = (k * 15485863 + V.SEED) * 13 % 1000003 % (m - 2)
            third = step + (step >= min(first, second))
            third += third >= max(first, second)
            assert len({first, second, third}) == 3 and max(first, second, third) < m
    assert env


def test_points_of_a_large_frame_are_voted_on_in_parts(spark):
    """1280 x 800 points of one key, dealt over tasks: votes are combined before
    the shuffle, so no task reads the frame."""
    side = spark.range(0, 1280 * 800, 1, 8).select(F.lit(1).cast("long").alias("key"), "id", ((F.col("id") % 1280) / 1279 * 2 - 1).alias("x"), (F.floor(F.col("id") / 1280) / 799 * 2 - 1).alias("y"))
    points = side.withColumn("z", 1 / (F.lit(0.0001) * F.col("x") + F.lit(0.00005) * F.col("y") + F.lit(0.002)) + F.when(F.xxhash64("id") % 4 == 0, 60.0).otherwise(F.col("id") % 3 / 2))
    (r,) = V.planes(points, V.INVERSE, tolerance=2.5, least=500, rounds=40).collect()
    assert r.n == 1280 * 800 and 0.74 < r.inliers / r.n < 0.76 and 1 / r.c == pytest.approx(500.5, abs=0.1)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.planes(none, V.METRIC, tolerance=2.5, least=50).count() == 0
    assert V.planes(table(spark, {1: [(1, 1, 1)] * 60}), V.METRIC, tolerance=2.5, least=50).count() == 0  # no three of them span a plane


def test_no_row_of_a_round_carries_the_pool(spark, monkeypatch):
    """Each of 160 rounds copied its group's pool of about 512 points before."""
    kept, write = {}, V.written

    def written(df, name):
        node = df._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "Generate":
            node = node.children().head()
        kept[name] = node.requiredChildOutput().mkString(",")
        return write(df, name)

    rng = np.random.default_rng(6)
    monkeypatch.setattr(V, "written", lambda df, name: written(df, name) if name == "hypotheses" else write(df, name))
    assert V.planes(table(spark, {7: rng.uniform(0, 1, (90, 3))}), V.METRIC, tolerance=2.5, least=50).count() == 1
    assert kept["hypotheses"].startswith("key#") and "pool" not in kept["hypotheses"]
