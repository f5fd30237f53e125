"""Whole-frame operators: one row a frame, by kernels that see one frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.operators import evaluators as E
from lumenspan.operators import hypotheses as V
from lumenspan.operators import kernels as K
from lumenspan.operators.geometry import golden_minimum
from lumenspan.plans.kernels import H, PIXELS, W_, _mask, points, points_sql, rasters
from lumenspan.plans.proxies import FRAMES, frames, load
from lumenspan.registry import query
from lumenspan.session import scratch
from lumenspan.sources import files


def _grey(pdf: pd.DataFrame) -> np.ndarray:
    g = np.zeros((H, W_))
    g[pdf["v"], pdf["u"]] = (pdf["d"] // 100) % 256
    return g


def per_frame(spark, sf, fn: Callable[[pd.DataFrame], dict], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["v", "u"])
        got = fn(pdf)
        return pd.DataFrame([[int(pdf["frame"].iloc[0]), *[got[n] for n in names]]], columns=["frame", *names])

    return rasters(spark, sf).groupBy("frame").applyInPandas(run, f"frame long, {columns}")


@query("mor18_preprocessing")
def mor18(spark, sf):
    return per_frame(spark, sf, lambda p: {"mean": float(K.preprocess(_grey(p)).mean())}, "mean double")


@query("mor19_surface_preprocessing")
def mor19(spark, sf):
    return per_frame(spark, sf, lambda p: {"mean": float(K.preprocess(_grey(p), gamma=1.0, tiles=(4, 4)).mean())}, "mean double")


@query("mth14_golden_minimum", "select p_partkey, least(40.0, p_size)::double as at from part")
def mth14(spark, sf):
    """Where a function of a column is least between limits, for all rows."""
    at = golden_minimum(lambda x: (x - F.col("size")) * (x - F.col("size")), -60.0, 40.0)
    part = load(spark, sf, "part").select("p_partkey", "p_size")
    # the search is one of a size, not of a part, and sizes repeat
    found = part.select(F.col("p_size").alias("size")).distinct().select("size", F.round(at, 5).alias("at"))
    return part.join(found, F.col("p_size").eqNullSafe(F.col("size"))).select("p_partkey", "at")


#: Back-projected places of a tilted board with something on it, and what a
#: frame needs for a pose.
_BACK = {"x": "(u - 15.5) * (500 + 0.2 * u + d % 1.5) / 500", "y": "(v - 11.5) * (500 + 0.2 * u + d % 1.5) / 500", "z": "500 + 0.2 * u + d % 1.5 - case when u between 10 and 20 and v between 8 and 15 then 30 else 0 end"}
_POSE, LEAST_POINTS = {"tolerance": 2.5, "least": 15}, 20
_STATUS = f"case when points < {LEAST_POINTS} then 'INSUFFICIENT' when n is null then 'REJECTED' else 'METRIC_VALID' end"


def _pose_sql(where: str = "true") -> str:
    return f"""with {PIXELS}, {points_sql(_BACK, where)}, {", ".join(V.planes_sql("pt", V.METRIC, "t", **_POSE))},
s as (select key as frame, count(*) as points from pt group by key)
select frame, {_STATUS} as status, round(degrees(atan2(a, -c)), 4) as roll, round(degrees(atan2(b, -c)), 4) as pitch, round(inliers / n, 6) as inlier_ratio, round(residual, 6) as residual from s left join tplanes on key = frame"""


def _pose(spark, sf, where: str = "true"):
    at = points(rasters(spark, sf), _BACK, where)
    got = at.groupBy("key").agg(F.count("*").alias("points")).join(V.planes(at, V.METRIC, **_POSE), "key", "left")
    tilt = lambda c: F.round(F.degrees(F.atan2(c, -F.col("c"))), 4)
    return got.select(F.col("key").alias("frame"), F.expr(_STATUS).alias("status"), tilt("a").alias("roll"), tilt("b").alias("pitch"), F.round(F.col("inliers") / F.col("n"), 6).alias("inlier_ratio"), F.round("residual", 6).alias("residual"))


@query("mth23_metric_pose", _pose_sql())
def mth23(spark, sf):
    """Back-projection, plane, tilts, coverage and status of each frame."""
    return _pose(spark, sf)


_LEVELS = {"x": "u * 5.0", "y": "v * 5.0", "z": "case when `set` then 500.0 when u < 16 then 600.0 else 640.0 end + d % 1"}


@query("mth24_sequential_planes", f"""with {PIXELS}, {points_sql(_LEVELS).replace("`", '"')}, {", ".join(V.sequential_sql("pt", V.METRIC, "t", 3, tolerance=2.5, least=10))}
select key as frame, no, inliers, round(residual, 6) as residual, round(d / c, 3) as depth from tall""")
def mth24(spark, sf):
    """Up to three planes of each frame, each among what the others left: its
    voters, their median distance, and the depth over the origin."""
    got = V.sequential(points(rasters(spark, sf), _LEVELS), V.METRIC, 3, tolerance=2.5, least=10)
    return got.select(F.col("key").alias("frame"), "no", "inliers", F.round("residual", 6).alias("residual"), F.round(F.col("d") / F.col("c"), 3).alias("depth"))


@query("ext01_frame_evaluator", f"with {FRAMES} select event_id, round(case when stable then 100 - abs(depth - 60) else 0 end, 6) as score, stable and depth between 20 and 100 as accepted, case when not stable then 'UNSTABLE' when depth < 20 then 'NEAR' when depth > 100 then 'FAR' end as reason from frames")
def ext01(spark, sf):
    """Frames with the score, verdict and reason of an evaluator's columns."""
    depth = F.col("depth")

    def evaluator():
        reason = F.when(~F.col("stable"), "UNSTABLE").when(depth < 20, "NEAR").when(depth > 100, "FAR")
        return {"score": F.round(F.when(F.col("stable"), 100 - F.abs(depth - 60)).otherwise(0), 6), "accepted": F.col("stable") & depth.between(20, 100), "reason": reason}

    return E.evaluate(frames(spark, sf).select("event_id", "depth", "stable"), evaluator).drop("depth", "stable")


@query("ext02_candidate_evaluator", f"with {FRAMES} select device, count(*) as frames, round(avg(depth), 6) as score, count(*) filter (stable) * 10 >= count(*) * 9 and stddev_pop(depth) < 60 as accepted, max_by(seq, (depth, -seq)) as best from frames group by device")
def ext02(spark, sf):
    """Candidates, each by an evaluator's aggregates over its frames."""
    depth = F.col("depth")
    rows = frames(spark, sf).select("device", "seq", "depth", "stable")
    return E.evaluate_groups(rows, ["device"], lambda: {"frames": F.count("*"), "score": F.round(F.avg("depth"), 6), "accepted": (F.count_if("stable") * 10 >= F.count("*") * 9) & (F.stddev_pop(depth) < 60), "best": F.max_by("seq", F.struct(depth, -F.col("seq")))})


@query("ext08_patch_dataset")
def ext08(spark, sf):
    """Patches as rows, their pixels as binary."""

    def run(pdf):
        g, rows = _grey(pdf).astype(np.uint8), []
        for i, (y, x) in enumerate((y, x) for y in range(0, H - 7, 8) for x in range(0, W_ - 7, 8)):
            rows.append((int(pdf["frame"].iloc[0]), i, x, y, g[y : y + 8, x : x + 8].tobytes()))
        return pd.DataFrame(rows, columns=["frame", "patch_index", "x", "y", "pixels"])

    return rasters(spark, sf).groupBy("frame").applyInPandas(run, "frame long, patch_index long, x long, y long, pixels binary")


@query("aux02_alignment_per_plane", """with t as (select o_orderkey, o_orderkey % 90 - 45.0 as r, o_custkey % 60 - 30.0 as p from orders where o_orderstatus = 'P'),
x as (select *, degrees(atan(sqrt(power(tan(radians(r + least(30, greatest(-30, -r)))), 2) + power(tan(radians(p + least(30, greatest(-30, -p)))), 2)))) as rest from t)
select o_orderkey, case when rest > 10 then 'REJECTED' when abs(r) <= 30 and abs(p) <= 30 then 'FULL' else 'PARTIAL' end as mode from x""")
def aux02(spark, sf):
    """Each plane's alignment inside the limits; what leaves too much tilt is
    rejected.  Tilts follow targets one to one here, so that SQL can say it."""

    @F.pandas_udf("string")
    def mode(roll: pd.Series, pitch: pd.Series) -> pd.Series:
        camera = np.column_stack([roll, pitch])
        mode, _, rest = K.align_within(camera, np.eye(2), np.zeros_like(camera), -camera)
        return pd.Series(np.where(rest > 10, "REJECTED", mode))

    return load(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", mode(F.col("o_orderkey") % 90 - 45.0, F.col("o_custkey") % 60 - 30.0).alias("mode"))


@query("aux16_region_crops")
def aux16(spark, sf):
    return ext08(spark, sf).where("x between 8 and 16").select("frame", "x", "y", F.length("pixels").alias("size"))


#: The part of a frame in which the aligned board is measured.
_CENTRE = f"u between 4 and {W_ - 5} and v between 3 and {H - 4} and not (u between 10 and 20 and v between 8 and 15)"


@query("aux20_depth_plane_measurement", f"select frame, roll, pitch, round(sqrt(roll * roll + pitch * pitch), 3) as tilt, residual from ({_pose_sql(_CENTRE)}) where status = 'METRIC_VALID'")
def aux20(spark, sf):
    """Tilts of the board measured in the middle of each frame, beside what lies
    on it; frames without a valid plane have no row."""
    tilt = F.round(F.sqrt(F.col("roll") * F.col("roll") + F.col("pitch") * F.col("pitch")), 3)
    return _pose(spark, sf, _CENTRE).where("status = 'METRIC_VALID'").select("frame", "roll", "pitch", tilt.alias("tilt"), "residual")


@query("aux21_masked_scores")
def aux21(spark, sf):
    """Scores averaged over the patches on a pixel, inside the mask only."""

    def fn(pdf):
        m, x = _mask(pdf), _grey(pdf)
        total, n = np.zeros((H, W_)), np.zeros((H, W_))
        for y in range(0, H - 7, 4):
            for u in range(0, W_ - 7, 4):
                if m[y : y + 8, u : u + 8].mean() >= 0.5:
                    total[y : y + 8, u : u + 8] += x[y : y + 8, u : u + 8].std()
                    n[y : y + 8, u : u + 8] += 1
        return {"mean": float((total / np.maximum(n, 1) * m).mean())}

    return per_frame(spark, sf, fn, "mean double")


def images(spark, sf):
    """Frames as PNG files' bytes."""

    def run(pdf):
        return pd.DataFrame([(f"frame_{int(pdf['frame'].iloc[0]):03d}.png", bytearray(files.png_bytes(_grey(pdf))))], columns=["path", "content"])

    return rasters(spark, sf).groupBy("frame").applyInPandas(run, "path string, content binary")


@query("src05_image_decode")
def src05(spark, sf):
    return files.decode_images(images(spark, sf)).select("path", "height", "width", "channels", F.md5("pixels").alias("digest"), "error")


@query("src18_arrays")
def src18(spark, sf):
    """.npy bytes to (v, u, value)."""
    import io

    def run(pdf):
        b = io.BytesIO()
        np.save(b, _grey(pdf)[:4, :4])
        return pd.DataFrame([(str(int(pdf["frame"].iloc[0])), b.getvalue())], columns=["path", "content"])

    return files.npy_values(rasters(spark, sf).groupBy("frame").applyInPandas(run, "path string, content binary"))


@query("src30_model_weights")
def src30(spark, sf):
    """Weights kept as a table, read for a broadcast."""
    out = scratch(spark, "weights")
    rng = np.random.default_rng(0)
    rows = [(f"layer{i}", [4, 1, 4, 4], rng.normal(0, 0.3, 64).tolist()) for i in range(4)]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").write.parquet(out)
    return spark.read.parquet(out).select("name", F.size("data").alias("n"))
