"""Literal inputs with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenspan.functions import gates, text
from lumenspan.operators import control, evaluators, geometry, hypotheses, intervals, kernels, ordered, pixels, planes, raster
from lumenspan.sources import files, sinks
from lumenspan.streaming import telemetry


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"]).select(column.alias("x")).first().x


@pytest.mark.parametrize("line", ["", "Z=1", "TLM:Z=nope", "TLM:Z=1,R=2", "TLM:Z=1,R=2,P=3,S=1,S=1", "TLM:Z=1,R=2,P=3,S=1.5", "TLM:Z=nan,R=2,P=3,S=1", "TLM:Z=1,R=2,P=3,S", "TLM:Z=1,R=2,P=3,S=1,=4"])
def test_malformed_telemetry(spark, line):
    assert one(spark, text.parse_telemetry(F.col("line")), line=line) is None


def test_telemetry(spark):
    t = one(spark, text.parse_telemetry(F.col("line")), line="TLM:Z=20.00,R=1.25,P=-0.42,S=1,M1=0,M2=0,M3=0,H=0,G=1,C=1,VR=0.02,VP=-0.01")
    assert (t.z, t.roll, t.pitch, t.stable, t.homing, t.vr, t.vp) == (20.0, 1.25, -0.42, True, False, 0.02, -0.01)


def test_commands(spark):
    assert one(spark, text.pose_command(F.lit(20.0), F.lit(23.0), F.lit(0.0))) == "Z:20.00 R:23.00 P:0.00\r\n"
    assert one(spark, text.fixed(F.lit(0.125))) == "0.12"
    assert one(spark, text.z_directory(F.lit(-17.5))) == "z_minus_17_5"


def test_best_z(spark):
    rows = [("a", 20.0, 0.1, False), ("a", 20.5, 0.68, True), ("a", 21.0, 0.81, True), ("a", 21.5, 0.87, True), ("a", 22.0, 0.74, True), ("tie", 22.0, 0.8, True), ("tie", 21.0, 0.8, True), ("none", 20.0, 0.5, False)]
    df = spark.createDataFrame(rows, "pose string, z double, q double, gate boolean").where("gate")
    got = {r.pose: r.z for r in ordered.best(df, ["pose"], [F.col("q"), -F.col("z")], ["z"]).collect()}
    assert got == {"a": 21.5, "tie": 21.0}


@pytest.mark.parametrize(("z", "limit"), [(17.0, 20.0), (19.5, 22.5), (25.0, 25.0), (10.0, 20.0), (20.5, 24.0)])
def test_envelope(spark, z, limit):
    assert one(spark, geometry.max_tilt(F.lit(z))) == pytest.approx(limit)


@pytest.mark.parametrize(("r", "p", "tilt"), [(25.0, 0.0, 25.0), (20.0, 20.0, 27.9909), (25.0, 25.0, 34.7754)])
def test_combined_tilt(spark, r, p, tilt):
    assert one(spark, geometry.combined_tilt(F.lit(r), F.lit(p))) == pytest.approx(tilt, abs=1e-4)
    scale = one(spark, geometry.tilt_scale(F.lit(r), F.lit(p), F.lit(22.0)))
    tight = lambda s: math.degrees(math.acos(math.cos(math.radians(r * s)) * math.cos(math.radians(p * s))))
    assert tight(scale) == pytest.approx(22.0, abs=1e-6)


def test_positions():
    assert len(raster.positions(1280, 64, 32)) * len(raster.positions(800, 64, 32)) == 936
    assert raster.positions(50, 64, 32, strict=False) == []
    with pytest.raises(ValueError):
        raster.positions(50, 64, 32)


@pytest.mark.parametrize(("hit", "full"), [("v < 64", 3), ("true", 9), ("u <> 63 or v <> 63", 5)])
def test_patches_of_a_mask(spark, hit, full):
    """A half mask has 3 full patches, a whole one 9; one bad pixel spoils
    each of the patches over it."""
    px = spark.range(128 * 128).select((F.col("id") % 128).alias("u"), F.floor(F.col("id") / 128).alias("v")).withColumn("hit", F.expr(hit))
    c = raster.coverage(px, raster.grid_positions(spark, 128, 128, 64, 32), 64, 32)
    assert c.where("coverage = 1").count() == full


def test_readiness(spark):
    c = lambda v: F.lit(v)
    assert one(spark, gates.readiness(c(0.6), c(0.8), c(1.0), c(100), c(80), c(20), c(False))) == []
    got = one(spark, gates.readiness(c(0.1), c(0.2), c(float("inf")), c(0), c(0), c(3), c(True)))
    assert got == ["Depth valid low (10.0% < 25%)", "Plane inlier low (20.0% < 25%)", "Plane residual high (inf mm > 2.0 mm)", "Object surface not found", "Surface-only mask not found", "Too few valid patches (3 < 20)", "Object too close to image edge / FOV"]


@pytest.mark.parametrize(("ok", "ready"), [([0, 0, 1, 1, 1, 1], 6), ([1, 1, 0, 1, 1, 1], None), ([0] * 5 + [1] * 4, None), ([1] * 4, 4)])
def test_streak_and_its_stream(spark, tmp_path, ok, ready):
    df = spark.createDataFrame([(1, i + 1, bool(x)) for i, x in enumerate(ok)], "device long, seq long, ok boolean")
    assert ordered.first_streak(df, F.col("ok"), ["device"], "seq", 4, 8).first().ready_at == ready
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = telemetry.stable_streaks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 4, 8)
    got = telemetry.run_to_end(stream, spark, "streak").collect()
    assert [r.ready_at for r in got] == ([ready] if ready else [])


def test_streams_take_rows_in_order_whatever_their_chunks(spark, tmp_path):
    """A device's rows in many small chunks and out of order within a trigger."""
    ok = [0, 1, 0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([(1, i + 1, bool(x)) for i, x in enumerate(ok)][::-1], "device long, seq long, ok boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert [r.ready_at for r in telemetry.run_to_end(telemetry.stable_streaks(read(), 3), spark, "chunks").collect()] == [6]
        assert [r.at for r in telemetry.run_to_end(telemetry.first_seen(read()), spark, "first").collect()] == [2]
        kept = telemetry.run_to_end(telemetry.ring_buffer(read().select("device", "seq"), 3), spark, "ring").collect()
        assert [list(r.kept) for r in kept] == [[6, 7, 8]]
        acks = read().select("device", "seq", (F.col("seq") == 3).alias("is_ack"), F.col("seq").isin(2, 5, 7).alias("is_done"))
        assert [(r.ack, r.done) for r in telemetry.run_to_end(telemetry.acknowledged(acks), spark, "ack").collect()] == [(3, 5)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stream_joins_and_watermarks(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([(i, t + dt.timedelta(seconds=i)) for i in range(5)], "c_id long, c_ts timestamp")
    d = spark.createDataFrame([(i, t + dt.timedelta(seconds=i + 1)) for i in range(3, 8)], "d_id long, d_ts timestamp")
    c.write.parquet(str(tmp_path / "c"))
    d.write.parquet(str(tmp_path / "d"))
    read = lambda x, n: spark.readStream.schema(x.schema).parquet(str(tmp_path / n))
    got = telemetry.run_to_end(telemetry.paired(read(c, "c"), read(d, "d")), spark, "paired")
    assert sorted(r.c_id for r in got.collect()) == [3, 4]
    assert telemetry.resample(read(c, "c").select(F.col("c_ts").alias("ts"), F.col("c_id").cast("double").alias("value")), "2 seconds", "1 second").isStreaming


def test_strict_telemetry_fails(spark):
    lines = spark.createDataFrame([("TLM:Z=1",), ("hello",)], "line string")
    assert telemetry.telemetry(lines).count() == 0 and telemetry.malformed(lines).count() == 1
    with pytest.raises(Exception, match="malformed telemetry"):
        telemetry.telemetry(lines, strict=True).collect()


def test_metric_plane_recovers_tilt(spark):
    u, v = np.meshgrid(np.arange(100), np.arange(80))
    groups = {}
    for roll in (0, 12):
        n = np.array([math.tan(math.radians(roll)), 0.0, -1.0])
        ray = np.stack([(u - 49.5) / 500, (v - 39.5) / 500, np.ones_like(u, float)], axis=-1)
        groups[roll] = (ray * (-500 / (ray @ n))[..., None]).reshape(-1, 3)
    rows = [(k, i, *map(float, p)) for k, ps in groups.items() for i, p in enumerate(ps)]
    got = hypotheses.planes(spark.createDataFrame(rows, "key long, id long, x double, y double, z double"), hypotheses.METRIC, tolerance=2.5, least=50).collect()
    assert {r.key: round(math.degrees(math.atan2(r.a, -r.c)), 2) for r in got} == {0: 0.0, 12: 12.0}


def test_inverse_depth_plane(spark):
    rows = [(1, v * 80 + u, u / 79 * 2 - 1, v / 59 * 2 - 1, 500.0 + 0.3 * u + 0.1 * v) for v in range(60) for u in range(80)]
    (r,) = hypotheses.planes(spark.createDataFrame(rows, "key long, id long, x double, y double, z double"), hypotheses.INVERSE, tolerance=2.5, least=500).collect()
    assert r.inliers / r.n > 0.95 and r.residual < 1.5


def plane_rows(spark, rows):
    return spark.createDataFrame([(1, i, list(n), list(c)) for i, (n, c) in enumerate(rows)], "run long, idx long, normal array<double>, centre array<double>")


def test_groups_of_long_chains_in_any_order(spark):
    import random

    for seed in range(4):
        order = random.Random(seed).sample(range(20), 20)
        p = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 5)], "run long, idx long")
        chain = [(1, min(a, b), max(a, b)) for a, b in zip(order, order[1:])]
        got = planes.plane_groups(p, spark.createDataFrame(chain, "run long, a long, b long")).collect()
        assert {(r.run, r.group) for r in got} == {(1, 0), (2, 5)} and len(got) == 21


@pytest.mark.parametrize(("rows", "groups"), [
    ([((0.1, 0, -1), (0, 0, 500)), ((0.1, 0, -1), (10, 0, 501))], 1),
    ([((0.1, 0, -1), (0, 0, 500)), ((0.1, 0, -1), (0, 0, 520))], 2),
    ([((0.1, 0, -1), (0, 0, 500))] * 3, 1),
    ([((0, 0, -1), (0, 0, 500 + 4 * i)) for i in range(20)], 1),
])
def test_plane_groups(spark, rows, groups):
    p = plane_rows(spark, [(tuple(map(float, n)), tuple(map(float, c))) for n, c in rows])
    got = planes.plane_groups(p, planes.same_plane(p)).collect()
    assert len({r.group for r in got}) == groups and len(got) == len(rows)


def test_cloud_types(spark):
    names = {"a_with_floor.ply": "OBJECT_PLATFORM_FLOOR", "X_Object+Platform.ply": "OBJECT_AND_PLATFORM", "object_only_1.ply": "OBJECT_ONLY", "final_dc_mask_phase.ply": "OBJECT_ONLY", "segmented.ply": "UNKNOWN"}
    for name, kind in names.items():
        assert one(spark, gates.cloud_type(F.lit(name))) == kind


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (4, 6, 3))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PNG").write_bytes(files.png_bytes(grey))
    (tmp_path / "sub" / "b.png").write_bytes(files.png_bytes(colour))
    (tmp_path / "c.tiff").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"x")
    assert files.image_files(spark, str(tmp_path)).count() == 3
    got = files.decode_images(files.image_files(spark, str(tmp_path), files.INFERENCE_SUFFIXES)).orderBy("path").collect()
    assert [(r.height, r.width, r.channels) for r in got] == [(5, 7, 1), (4, 6, 3)]
    assert bytes(got[1].pixels) == colour.astype(np.uint8).tobytes()


def test_arrays_and_manifests(spark, tmp_path):
    np.save(tmp_path / "d.npy", np.arange(6.0).reshape(2, 3))
    got = files.npy_values(spark.read.format("binaryFile").load(str(tmp_path / "d.npy"))).orderBy("v", "u").collect()
    assert [(r.v, r.u, r.value) for r in got][-1] == (1, 2, 5.0)
    (tmp_path / "m.csv").write_bytes("﻿path,split,label,session,regions,material,view,notes\na.png,val,normal,s,,m,,\n/b.png,train,defect,s,,m,,\n".encode())
    m = files.manifest(spark, str(tmp_path / "m.csv"))
    assert files.manifest_paths(m, "val", "/root").first().path == "/root/a.png"
    with pytest.raises(Exception, match="only normal"):
        files.manifest_paths(m, "train", "/root").collect()
    with pytest.raises(Exception, match="no rows of split"):
        files.manifest_split(m, "test").collect()
    sinks.write_manifest(m, str(tmp_path / "out"))
    assert files.manifest(spark, str(tmp_path / "out")).count() == 2


def test_ply(spark, tmp_path):
    (tmp_path / "p.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5\n6 7 8\n")
    got = files.ply_points(spark, str(tmp_path / "p.ply")).orderBy("pos").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(1.0, 2.0, 3.0), (6.0, 7.0, 8.0)]


def mask_rows(spark, *masks):
    return spark.createDataFrame([(k, int(u), int(v)) for k, m in enumerate(masks) for v, u in np.argwhere(m)], "frame long, u long, v long")


def as_arrays(df, n, shape):
    out = np.zeros((n, *shape), bool)
    for r in df.collect():
        assert not out[r.frame, r.v, r.u]  # a pixel has one row
        out[r.frame, r.v, r.u] = True
    return out


def test_morphology(spark):
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[4, 4] = False
    leak = m.copy()
    leak[4, 4], leak[3, 3], leak[2, 2], leak[1, 1] = False, False, False, False  # a diagonal gap to the outside
    shape, df = pixels.Shape(9, 9), mask_rows(spark, m, leak)
    frames = spark.createDataFrame([(0,), (1,)], "frame long")
    size = lambda x: [int(k.sum()) for k in as_arrays(x, 2, (9, 9))]
    assert size(pixels.holes(df, frames, shape)) == [1, 0]
    assert size(pixels.holes(df, frames, shape, connectivity=4)) == [1, 2]
    assert size(pixels.holes(df, frames, shape, most=0)) == [0, 0]
    full = df.union(pixels.holes(df, frames, shape)).distinct()
    assert size(pixels.erode(full, pixels.ellipse(1), shape))[0] == 9
    assert intervals.to_pixels(intervals.convex(intervals.from_pixels(df))).where("frame = 0").count() == 25
    two = np.zeros((9, 9), bool)
    two[1:3, 1:3] = two[1:3, 6:8] = True
    got = as_arrays(pixels.largest(mask_rows(spark, two, np.eye(9)), shape), 2, (9, 9))
    assert got[0][1, 1] and not got[0][1, 6] and got[1].sum() == 9
    assert sorted((r.frame, r.label, r.area) for r in pixels.areas(pixels.labels(mask_rows(spark, two, np.eye(9)), shape)).collect()) == [(0, 10, 4), (0, 15, 4), (1, 0, 9)]
    assert pixels.labels(mask_rows(spark), shape).count() == 0


def test_morphology_equals_arrays(spark):
    """Random frames against definitions pixel by pixel."""
    rng = np.random.default_rng(3)
    shape, masks = (11, 14), [rng.random((11, 14)) < d for d in (0.35, 0.6, 0.9)]
    df, sh = mask_rows(spark, *masks), pixels.Shape(*shape)

    def near(m, offsets, empty):
        at = lambda v, u: m[v, u] if 0 <= v < shape[0] and 0 <= u < shape[1] else empty
        return lambda fn: np.array([[fn(at(v + dv, u + du) for du, dv in offsets) for u in range(shape[1])] for v in range(shape[0])])

    for offsets in (pixels.ellipse(1), pixels.ellipse(2), pixels.box(1), [(0, 0), (1, 2)]):
        back = [(-du, -dv) for du, dv in offsets]
        assert (as_arrays(pixels.dilate(df, offsets, sh), 3, shape) == [near(m, back, False)(any) for m in masks]).all()
        assert (as_arrays(pixels.erode(df, offsets, sh), 3, shape) == [near(m, offsets, True)(all) for m in masks]).all()
        assert (as_arrays(pixels.erode(df, offsets, sh, outside=False), 3, shape) == [near(m, offsets, False)(all) for m in masks]).all()
    for r in (1, 2):
        assert (as_arrays(pixels.erode_box(df, r, sh), 3, shape) == [near(m, pixels.box(r), True)(all) for m in masks]).all()
        wide = [np.pad(m, r, mode="symmetric") for m in masks]
        share = [np.array([[w[v : v + 2 * r + 1, u : u + 2 * r + 1].mean() for u in range(shape[1])] for v in range(shape[0])]) for w in wide]
        assert (as_arrays(pixels.density(df, r, 0.5, sh), 3, shape) == [x >= 0.5 for x in share]).all()
    assert pixels.ellipse(2)[:6] == [(0, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1)]


def test_equalisation_and_filters():
    flat = np.full((24, 32), 100)
    assert (kernels.preprocess(flat) == kernels.preprocess(flat)[0, 0]).all()
    assert (kernels.gaussian(flat, 1.0) == 100).all()
    ramp = np.tile(np.arange(64) * 4, (64, 1))
    got = kernels.equalize_tiles(ramp, (2, 2), 40.0)
    assert (np.diff(got[0].astype(int)) >= 0)[:20].all() and got.shape == ramp.shape
    assert kernels.gamma_table(0.82)[[0, 255]].tolist() == [0, 255]
    spike = np.zeros((9, 9))
    spike[4, 4] = 255
    assert kernels.gaussian(spike, 1.0)[4, 4] == pytest.approx(255 * 0.39905**2, abs=1)


def test_alignment():
    mode, target, rest = kernels.align_within([(5, -5), (40, 0)], np.eye(2), [(0, 0)] * 2, [(-5, 5), (-40, 0)])
    assert mode.tolist() == ["FULL", "PARTIAL"] and target[0].tolist() == [-5, 5]
    assert target[1, 0] == -30 and rest[1] == pytest.approx(10, abs=0.01)
    rng = np.random.default_rng(1)
    camera, jacobian = rng.uniform(-50, 50, (20, 2)), np.array([[1.0, 0.05], [0.04, 1.0]])
    _, target, rest = kernels.align_within(camera, jacobian, np.zeros((20, 2)), -1.5 * camera)
    side = np.linspace(-30, 30, 241)
    grid = np.concatenate([[(s, x), (x, s)] for s in (-30, 30) for x in side])
    for i in np.flatnonzero((np.abs(1.5 * camera) > 30).any(axis=1)):
        a = np.radians(camera[i] + grid @ jacobian.T)
        assert rest[i] <= np.degrees(np.arctan(np.hypot(*np.tan(a).T))).min() + 1e-6


def test_golden_minimum(spark):
    at = geometry.golden_minimum(lambda x: F.pow(x - F.col("c"), 2) + 1, -60, 60)
    assert one(spark, at, c=12.25) == pytest.approx(12.25, abs=1e-5)
    assert one(spark, at, c=99.0) == pytest.approx(60, abs=1e-5)


def test_autoencoder():
    w = [(np.zeros((2, 1, 4, 4)), np.zeros(2)), (np.zeros((2, 1, 4, 4)), np.zeros(1))]
    assert np.allclose(kernels.autoencode(np.ones((1, 8, 8)), w), 0.5)


def control_rows(**columns):
    n = len(next(iter(columns.values())))
    base = {"err_phi": [0.0] * n, "err_theta": [0.0] * n, "rate_phi": [0.0] * n, "rate_theta": [0.0] * n, "tick": [20 * (i + 1) for i in range(n)], "mode": [0] * n, "imu": [0] * n, "z_term": [0] * n, "command": [0] * n}
    return pd.DataFrame(base | columns)


def test_attitude_control():
    """Inside the deadband the proportional term rests, the others do not."""
    (out,) = control.attitude(control_rows(err_theta=[1.0]))
    assert out == (90.0, -45.0, -45.0)
    assert control.attitude(control_rows(err_phi=[0.05], mode=[0]))[0] == (0.0, 0.0, 0.0)
    a, b = control.attitude(control_rows(err_phi=[0.05, 0.08], mode=[1, 1]))
    assert b[2] == pytest.approx((0.08 - 0.05) * 12.0 * 0.866)
    a, b = control.attitude(control_rows(err_phi=[0.05, 0.05], mode=[2, 2], tick=[100, 5000]))
    assert b[2] == pytest.approx(0.05 * (0.020 + 0.100) * 31.0 * 0.866)
    a, b = control.attitude(control_rows(err_phi=[0.05, 0.05], mode=[2, 2], tick=[100, 5000], command=[0, 1]))
    assert b[2] == pytest.approx(0.05 * 0.020 * 31.0 * 0.866)  # a command forgets the integral and the time
    full = control.attitude(control_rows(err_phi=[4.0] * 200, mode=[2] * 200))
    assert full[-1][2] == pytest.approx((4.0 * 105 + 200) * 0.866)
    assert control.attitude(control_rows(err_phi=[1.0], rate_phi=[2.0], mode=[1], imu=[1]))[0][2] == pytest.approx((105 - 2 * 3.30) * 0.866)


@pytest.mark.parametrize(("output", "command"), [
    ([0.4, -0.5], [0, 0]), ([50.0, -80.5, 9999.0], [220, -250, 700]), ([40.0] * 6, [0, 0, 220, 220, 0, 220]), ([40.0, 40.0, 40.0, -60.0], [0, 0, 220, 220]), ([1.0] * 12, [0] * 9 + [220, 220, 0]),
])
def test_pulses(output, command):
    assert [x for (x,) in control.pulses(pd.DataFrame({"output": output}))] == command


def test_sleeping():
    tick = [100 * (i + 1) for i in range(8)]
    get = lambda **c: [x for (x,) in control.sleeping(control_rows(tick=tick, **c))]
    assert get(err_phi=[0.1] * 8) == [False] * 3 + [True] * 5
    assert get(err_phi=[0.1] * 5 + [0.2, 0.26, 0.1]) == [False] * 3 + [True] * 3 + [False] * 2
    assert get(err_phi=[0.1, 0.1, 0.16] + [0.1] * 5) == [False] * 6 + [True] * 2
    assert get(err_theta=[0.1] * 8, z_term=[0, 0, 0, 0, 1, 0, 0, 0]) == [False] * 3 + [True] + [False] * 4  # a move wakes and begins anew
    assert get(err_theta=[0.1] * 8, z_term=[0, 1] + [0] * 6) == [False] * 5 + [True] * 3
    assert get(err_phi=[0.1] * 8, z_term=[-1] * 8) == [False] * 8
    assert get(err_phi=[0.1] * 8, command=[0, 0, 0, 0, 1, 0, 0, 0]) == [False] * 3 + [True] + [False] * 3 + [True]


def test_rolling_median_skips_missing(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([0.0, 5.0, float("nan"), 7.0, 9.0, -1.0, 11.0])], "k int, i int, d double")
    got = [r.m for r in ordered.rolling_median(df, "d", ["k"], ["i"], 3, "m").orderBy("i").collect()]
    assert got == [0.0, 5.0, 5.0, 6.0, 8.0, 8.0, 10.0]


def test_plane_documents_hold_every_key(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(1, "COMPLETED", None, 17.5), (2, None, "NG", None)], "plane_index long, status string, quality_judgement string, best_z double")
    sinks.write_json(sinks.plane_documents(rows), str(tmp_path / "out"), nulls=True)
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda d: d["plane_index"])
    assert all(list(d) == sinks.PLANE_KEYS for d in got)
    assert (got[0]["status"], got[0]["quality_judgement"], got[0]["best_z"], got[0]["final_depth_path"]) == ("COMPLETED", "RECHECK", 17.5, None)
    assert (got[1]["status"], got[1]["quality_judgement"], got[1]["aruco_marker_ids"], got[1]["pose_metadata"], got[1]["final_capture_attempts"]) == ("PENDING", "NG", [], {}, 0)
    with pytest.raises(ValueError, match="no keys"):
        sinks.plane_documents(rows.withColumnRenamed("status", "state"))


def test_evaluators_must_name_their_result(spark):
    rows = spark.createDataFrame([(1, 2.0)], "id int, depth double")
    for bad, match in (({"score": F.lit(1)}, "must name"), ({"score": F.lit(1), "accepted": F.lit(True), "depth": F.lit(0)}, "may not replace")):
        with pytest.raises(ValueError, match=match):
            evaluators.evaluate(rows, lambda bad=bad: bad)
    assert evaluators.evaluate_groups(rows, ["id"], lambda: {"score": F.sum("depth"), "accepted": F.lit(True)}).collect() == [(1, 2.0, True)]
