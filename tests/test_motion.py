"""Completion of commands: literals, a restart, and nothing left behind."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenspan.streaming import motion

SCHEMA = "device long, seq long, ts timestamp, command boolean, target double, z double, stable boolean"
WAIT = motion.Wait(timeout=10_000, guard=500, observe=1_000, samples=3)


def row(device, seq, ms, command=False, target=None, z=0.0, stable=True):
    return (device, seq, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms), command, target, z, stable)


def add(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, *parts, wait=WAIT):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in parts:
        add(spark, src, rows)
        got = motion.run(motion.completions(spark.readStream.schema(SCHEMA).parquet(src), wait), out)
    return sorted(map(tuple, got.collect()))


def test_outcomes(spark, tmp_path):
    late = [row(99, 1, 60_000)]  # time goes on
    moved = [row(1, 1, 0, True)] + [row(1, 2 + i, 600 + 100 * i, stable=i > 1) for i in range(6)]
    still = [row(2, 1, 0, True)] + [row(2, 2 + i, 600 + 200 * i) for i in range(8)]  # never moves: only once observed
    guarded = [row(3, 1, 0, True)] + [row(3, 2 + i, 100 * i) for i in range(5)]  # all inside the guard, then silence
    silent = [row(4, 1, 0, True)]
    elsewhere = [row(5, 1, 0, True, target=7.0)] + [row(5, 2 + i, 600 + 100 * i, z=5.0 if i < 3 else 7.02) for i in range(7)]
    replaced = [row(6, 1, 0, True), row(6, 2, 700, stable=False), row(6, 3, 800, True)] + [row(6, 4 + i, 1400 + 100 * i, stable=i > 0) for i in range(5)]
    tardy = [row(7, 1, 0, True), row(7, 2, 700, stable=False)] + [row(7, 3 + i, 10_000 + 100 * i) for i in range(4)]  # stable after the deadline
    broken = [row(8, 1, 0, True)] + [row(8, 2 + i, 600 + 100 * i, stable=i % 3 != 2) for i in range(12)]
    got = run(spark, tmp_path, moved + still + guarded + silent + elsewhere + replaced + tardy + broken, late)
    assert got == [(1, 1, "STABLE", 6), (2, 1, "STABLE", 7), (3, 1, "TIMEOUT", 6), (4, 1, "TIMEOUT", None), (5, 1, "STABLE", 7), (6, 1, "REPLACED", 3), (6, 3, "STABLE", 7), (7, 1, "TIMEOUT", 2), (8, 1, "TIMEOUT", 13)]


def test_restart_from_the_checkpoint(spark, tmp_path):
    """Each part is a run of its own: streaks, times and timers go on."""
    parts = [[row(1, 1, 0, True), row(2, 1, 0, True)], [row(1, 2, 700, stable=False), row(1, 3, 800)], [row(1, 4, 900)], [row(1, 5, 1000)], [row(3, 1, 30_000)]]
    assert run(spark, tmp_path, *parts) == [(1, 1, "STABLE", 5), (2, 1, "TIMEOUT", None)]


def test_no_state_is_left(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, src, [row(d, 1, 0, True) for d in range(20)] + [row(d, 2 + i, 600 + 100 * i, stable=i > 0) for d in range(10) for i in range(4)])
    stream = lambda: motion.completions(spark.readStream.schema(SCHEMA).parquet(src), WAIT)
    motion.run(stream(), out)
    pending = lambda: spark.read.format("statestore").option("path", f"{out}/state").option("stateVarName", "pending").load().count()
    assert pending() == 10
    add(spark, src, [row(99, 1, 60_000)])
    got = motion.run(stream(), out)
    assert pending() == 0 and got.count() == 20 and spark.conf.get(motion.PROVIDER, None) is None


def test_waits_that_cannot_be(spark):
    for bad in ({"samples": 0}, {"guard": -1}, {"timeout": 500, "guard": 500}):
        with pytest.raises(ValueError, match="a wait needs"):
            motion.Wait(**bad)
    assert F.lit(1) is not None
