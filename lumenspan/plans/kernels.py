"""Kernels over frames: each frame is a group, dealt by its key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenspan.operators import hypotheses as V
from lumenspan.operators import kernels as K
from lumenspan.plans.proxies import load
from lumenspan.registry import query
from lumenspan.session import written

H, W_ = 24, 32


def rasters(spark, sf):
    """Small masks and depths: orders as pixels of frames.

    Each block of 2 * H * W_ order keys makes two frames, one for even and one
    for odd customers: frames grow in number with the table, and about a
    quarter of each has no pixel.
    """
    key = F.floor(F.col("o_orderkey") / (2 * H * W_)) * 2 + F.col("o_custkey") % 2
    p = load(spark, sf, "orders").select(key.alias("frame"), (F.col("o_orderkey") % W_).alias("u"), (F.floor(F.col("o_orderkey") / W_) % H).alias("v"), F.col("o_totalprice").alias("d"), (F.col("o_orderstatus") != "O").alias("set"))
    return p.groupBy("frame", "u", "v").agg(F.max("d").alias("d"), F.bool_or("set").alias("set"))


def _mask(pdf: pd.DataFrame) -> np.ndarray:
    m = np.zeros((H, W_), bool)
    on = pdf[pdf["set"]]
    m[on["v"], on["u"]] = True
    return m


@query("mor16_board_quad", "select o_custkey as board, case when count(distinct o_orderkey % 8) filter (o_orderkey % 8 < 4) = 4 then min(o_orderkey) filter (o_orderkey % 8 = 0) end as tl from orders group by all")
def mor16(spark, sf):
    """Corners by four required markers, NULL if one is missing."""
    m = F.col("o_orderkey") % 8
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("board")).agg(F.when(F.countDistinct(F.when(m < 4, m)) == 4, F.min(F.when(m == 0, F.col("o_orderkey")))).alias("tl"))


#: The same frames in SQL.
PIXELS = "px as materialized (select (o_orderkey // 1536) * 2 + o_custkey % 2 as frame, o_orderkey % 32 as u, o_orderkey // 32 % 24 as v, max(o_totalprice) as d, bool_or(o_orderstatus <> 'O') as \"set\" from orders group by all)"

@query("mor04_workspace", f"with {PIXELS} select frame, count(*) filter (u between 4 and 27 and v between 3 and 20) as pixels from px group by frame")
def mor04(spark, sf):
    """Pixels inside the workspace rectangle of each frame."""
    return rasters(spark, sf).groupBy("frame").agg(F.count_if(F.col("u").between(4, 27) & F.col("v").between(3, 20)).alias("pixels"))


@query("mor29_candidate_mask", f"with {PIXELS} select frame, count(*) filter (d < f - 1000) as pixels from (select *, median(d) over (partition by frame) as f from px) group by frame")
def mor29(spark, sf):
    """Pixels nearer than the floor of their frame, the median of its depths."""
    r = written(rasters(spark, sf), "pixels")
    floor = r.groupBy("frame").agg(F.median("d").alias("f"))
    return r.join(floor, "frame").groupBy("frame").agg(F.count_if(F.col("d") < F.col("f") - 1000).alias("pixels"))


#: Places scaled to -1 to 1, and a depth over a tilted board.
_SCALED = {"x": f"u / {W_ - 1}e0 * 2 - 1", "y": f"v / {H - 1}e0 * 2 - 1", "z": "500 + 0.5 * u + d % 3"}
_INVERSE = {"tolerance": 2.5, "least": 50}


def points_sql(columns: dict[str, str], where: str = "true") -> str:
    return f"pt as materialized (select frame as key, v * {W_} + u as id, {', '.join(f'{e} as {c}' for c, e in columns.items())} from px where {where})"


def points(px, columns: dict[str, str], where: str = "true"):
    at = px.where(where).select(F.col("frame").alias("key"), (F.col("v") * W_ + F.col("u")).alias("id"), *[F.expr(e).cast("double").alias(c) for c, e in columns.items()])
    return written(at, "points")


@query("mth21_inverse_depth_plane", f"""with {PIXELS}, {points_sql(_SCALED)}, {", ".join(V.planes_sql("pt", V.INVERSE, "t", **_INVERSE))}
select key as frame, round(inliers / n, 6) as inlier_ratio, round(residual, 6) as residual, round(1 / c, 4) as centre from tplanes""")
def mth21(spark, sf):
    """Plane of each frame in inverse depth: share of its voters, their median
    distance, and the depth in the middle."""
    got = V.planes(points(rasters(spark, sf), _SCALED), V.INVERSE, **_INVERSE)
    return got.select(F.col("key").alias("frame"), F.round(F.col("inliers") / F.col("n"), 6).alias("inlier_ratio"), F.round("residual", 6).alias("residual"), F.round(1 / F.col("c"), 4).alias("centre"))


_METRIC = {"tolerance": 2.5, "least": 50}


@query("mth22_metric_plane", f"""with pt as materialized (select l_suppkey as key, concat_ws('-', l_orderkey, l_linenumber, l_partkey) as id, l_quantity::double as x, l_linenumber * 10.0::double as y, 500 + 0.1::double * l_quantity + 60 * l_tax::double as z from lineitem),
{", ".join(V.planes_sql("pt", V.METRIC, "t", **_METRIC))}
select key as cloud, round(degrees(atan2(a, -c)), 4) as camera_roll, round(residual, 6) as residual, round(inliers / t.n, 6) as inlier_ratio from (select distinct key from pt) left join tplanes t using (key)""")
def mth22(spark, sf):
    """Metric plane of each cloud, its tilt and quality; NULLs without one."""
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_linenumber") * 10.0).alias("y"), (500 + 0.1 * F.col("l_quantity").cast("double") + 60 * F.col("l_tax").cast("double")).alias("z"))
    rows = written(rows, "points")
    got = rows.select("key").distinct().join(V.planes(rows, V.METRIC, **_METRIC), "key", "left")
    return got.select(F.col("key").alias("cloud"), F.round(F.degrees(F.atan2("a", -F.col("c"))), 4).alias("camera_roll"), F.round("residual", 6).alias("residual"), F.round(F.col("inliers") / F.col("n"), 6).alias("inlier_ratio"))


@query("mth15_alignment")
def mth15(spark, sf):
    """Target inside the limits, or the best on the box."""

    @F.pandas_udf("struct<mode:string,roll:double,pitch:double,residual:double>")
    def plan(roll: pd.Series, pitch: pd.Series) -> pd.DataFrame:
        camera = np.column_stack([roll, pitch])
        mode, target, rest = K.align_within(camera, ((1.0, 0.05), (0.04, 1.0)), np.zeros_like(camera), -1.5 * camera)
        return pd.DataFrame({"mode": mode, "roll": target[:, 0], "pitch": target[:, 1], "residual": rest})

    return load(spark, sf, "part").select("p_partkey", plan(F.col("p_size") - 25.0, (F.col("p_retailprice") - 950.0) / 4).alias("a")).select("p_partkey", "a.*")


@query("mth44_autoencoder_scores")
def mth44(spark, sf):
    """Residual scores of patches under a small autoencoder with fixed weights."""
    rng = np.random.default_rng(0)
    weights = [(rng.normal(0, 0.3, s), np.zeros(n)) for s, n in (((4, 1, 4, 4), 4), ((8, 4, 4, 4), 8), ((8, 4, 4, 4), 4), ((4, 1, 4, 4), 1))]
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for pdf in batches:
            out = []
            for v in pdf["embedding"]:
                x = 1 / (1 + np.exp(-8 * np.asarray(v, float).reshape(1, 8, 8)))
                out.append(float(((K.autoencode(x, w) - x) ** 2).mean()))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "score": out})

    return load(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, score double")
