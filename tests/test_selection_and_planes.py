"""Percentiles by counting, and plane pairs by cells, against plain definitions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators.planes import same_plane
from lumenspan.operators.selection import percentile


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_percentiles_equal_the_aggregate(spark, share):
    rng = np.random.default_rng(1)
    groups = {0: rng.normal(size=500), 1: rng.integers(0, 4, 300), 2: [7.5], 3: np.exp(rng.normal(0, 30, 400)), 4: [1e300, -1e300, 5.0], 5: [2.0] * 9 + [3.0], None: [1.0, 2.0, 9.0], 6: [float("nan")] * 2, 7: [0.0, -0.0, 1e-300]}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(8, None), (0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r.k: r.percentile for r in percentile(df, "x", share, ["k"]).collect()}
    assert set(got) == set(groups) - {6}
    for k, x in got.items():
        assert x == pytest.approx(np.quantile(np.asarray(groups[k], float), share), rel=1e-12, abs=1e-12)
    whole = [x for _, x in rows if x is not None and x == x]
    assert percentile(df, F.col("x"), share).first()[0] == pytest.approx(np.quantile(whole, share), rel=1e-12)
    assert percentile(df.limit(0), "x", share, ["k"]).count() == 0


def pairs(data, angle=2.0, distance=5.0):
    out = set()
    for run, i, n, c in data:
        for run2, j, m, d in data:
            if run == run2 and i < j:
                n_, m_ = (np.array(x) / np.linalg.norm(x) for x in (n, m))
                delta = np.array(d) - c
                if np.degrees(np.arccos(min(1, abs(n_ @ m_)))) <= angle and max(abs(delta @ n_), abs(delta @ m_)) <= distance:
                    out.add((run, i, j))
    return out


def test_plane_pairs_equal_all_pairs(spark):
    """Random directions, near ones on both sides of cells, opposite signs,
    equal planes, far centres, repeated rows."""
    rng = np.random.default_rng(2)
    data = []
    for run in range(6):
        base = rng.normal(size=(3, 3))
        base[2] = [(0, 0, 1), (1, 0, 0), (0, -1, 0), (1, 1, 0), (0.0349, 0, 1), (1, 1, 1)][run]
        for i in range(60):
            n = base[rng.integers(3)] * rng.choice([1, -1]) * rng.uniform(0.5, 3)
            n = n + np.linalg.norm(n) * rng.normal(0, 0.012, 3)
            data.append((run, i, [float(x) for x in n], [float(x) for x in rng.normal(0, [3, 30, 300][run % 3], 3)]))
    data += [(9, 1, [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]), (9, 2, [0.0, 0.0, -2.0], [9.0, 9.0, 5.0]), (9, 2, [0.0, 0.0, -2.0], [9.0, 9.0, 5.0]), (10, 1, [1.0, 0.0, 0.0], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(data, "run int, idx int, normal array<double>, centre array<double>")
    got = [tuple(r) for r in same_plane(df).collect()]
    want = pairs(data)
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_plane_pairs_of_a_large_run(spark):
    """50,000 planes of one run: all pairs would be 1.25 thousand million."""
    n = spark.range(0, 50_000, 1, 8)
    half = F.floor(F.col("id") / 2)
    part = lambda k: F.pmod(F.xxhash64(half, F.lit(k)), F.lit(100003)) / 100003.0 - 0.5
    df = n.select(F.lit(1).alias("run"), F.col("id").alias("idx"), F.array(*[part(k) for k in range(3)]).alias("normal"), F.array(*[F.lit(0.0), F.lit(0.0), half * 1000.0]).alias("centre"))
    begin = time.time()
    got = same_plane(df).where("a div 2 = b div 2").count()
    assert got == 25_000 and time.time() - begin < 120
