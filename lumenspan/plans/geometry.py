"""Geometry, control and numeric functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.operators import geometry as G
from lumenspan.operators.raster import grid_positions, position_array
from lumenspan.operators.selection import percentile
from lumenspan.plans.proxies import CANDIDATES, FRAMES, candidates, frames, load
from lumenspan.registry import query

_ANG = "an as (select p_partkey as k, p_size - 25.0::double as roll, (p_retailprice - 950.0) / 4 as pitch, 16 + p_size / 8.0::double as z from part)"


def angles(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") - 25.0).alias("roll"), ((F.col("p_retailprice") - 950.0) / 4).alias("pitch"), (16 + F.col("p_size") / 8.0).alias("z"))


@query("mth01_grid_positions", "select (row_number() over (order by y, x) - 1) as patch_index, x, y from (select unnest(range(0, 1280 - 64 + 1, 32)) as x), (select unnest(range(0, 800 - 64 + 1, 32)) as y)")
def mth01(spark, sf):
    """The full frame's patch grid: 936 places."""
    return grid_positions(spark, 1280, 800, 64, 32)


@query("mth02_grid_or_empty", "select p_partkey, case when p_size * 4 >= 64 then range(0, p_size * 4 - 64 + 1, 32) else [] end as starts from part")
def mth02(spark, sf):
    return load(spark, sf, "part").select("p_partkey", position_array(F.col("p_size") * 4, 64, 32).alias("starts"))


@query("mth05_region_positions", "select p_partkey, x::bigint as x from part, lateral (select unnest(range(p_size, p_size + p_partkey % 200 - 64 + 1, 32)) as x) where p_partkey % 200 >= 64")
def mth05(spark, sf):
    width = F.col("p_partkey") % 200
    return load(spark, sf, "part").where(width >= 64).select("p_partkey", F.explode(F.transform(position_array(width, 64, 32), lambda x: x + F.col("p_size"))).alias("x"))


@query("mth06_normalize_rectangle", "select c_custkey, case when abs(a - b) >= 2 then least(a, b) end as x1, case when abs(a - b) >= 2 then greatest(a, b) end as x2 from (select c_custkey, c_custkey % 97 as a, c_nationkey as b from customer)")
def mth06(spark, sf):
    a, b = F.col("c_custkey") % 97, F.col("c_nationkey").cast("long")
    ok = F.abs(a - b) >= 2
    return load(spark, sf, "customer").select("c_custkey", F.when(ok, F.least(a, b)).alias("x1"), F.when(ok, F.greatest(a, b)).alias("x2"))


@query("mth07_cloud_to_pixel", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 4 + 320, 0)::bigint as px, round_even(240 - l_linenumber / 2.0, 0)::bigint as py from lineitem")
def mth07(spark, sf):
    """Halves round to even."""
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.rint(F.col("l_quantity") / 4 + 320).cast("long").alias("px"), F.rint(240 - F.col("l_linenumber") / 2.0).cast("long").alias("py"))


@query("mth08_cloud_to_depth_pixel", "select distinct case when l_returnflag = 'R' then 639 - px else px end as u, case when l_returnflag = 'R' then 479 - py else py end as v from (select l_returnflag, round_even(l_quantity * 7 + 320, 0)::bigint as px, round_even(240 - l_linenumber * 40.5, 0)::bigint as py from lineitem) where px between 0 and 639 and py between 0 and 479")
def mth08(spark, sf):
    p = load(spark, sf, "lineitem").select("l_returnflag", F.rint(F.col("l_quantity") * 7 + 320).cast("long").alias("px"), F.rint(240 - F.col("l_linenumber") * 40.5).cast("long").alias("py")).where("px between 0 and 639 and py between 0 and 479")
    turn = lambda c, n: F.when(F.col("l_returnflag") == "R", n - F.col(c)).otherwise(F.col(c))
    return p.select(turn("px", 639).alias("u"), turn("py", 479).alias("v")).distinct()


@query("mth09_back_projection", "select o_orderkey, round((o_orderkey % 640 - 319.5) * o_totalprice / 500, 5) as x, round((o_custkey % 480 - 239.5) * o_totalprice / 500, 5) as y from orders")
def mth09(spark, sf):
    z = F.col("o_totalprice")
    return load(spark, sf, "orders").select("o_orderkey", F.round((F.col("o_orderkey") % 640 - 319.5) * z / 500, 5).alias("x"), F.round((F.col("o_custkey") % 480 - 239.5) * z / 500, 5).alias("y"))


@query("mth10_camera_tilt", f"with {_ANG}, n as (select k, roll / 100 as nx, pitch / 100 as ny, case when k % 2 = 0 then -1.0 else 0.9 end as nz from an), s as (select k, case when nz > 0 then -nx else nx end as nx, case when nz > 0 then -ny else ny end as ny, -abs(nz) as nz from n) select k, round(degrees(atan2(nx, -nz)), 6) as camera_roll, round(degrees(atan2(ny, -nz)), 6) as camera_pitch from s")
def mth10(spark, sf):
    r, p = G.camera_tilt(F.col("roll") / 100, F.col("pitch") / 100, F.when(F.col("k") % 2 == 0, -1.0).otherwise(0.9))
    return angles(spark, sf).select("k", F.round(r, 6).alias("camera_roll"), F.round(p, 6).alias("camera_pitch"))


@query("mth11_combined_tilt", f"with {_ANG} select k, round(degrees(acos(greatest(-1, least(1, cos(radians(roll)) * cos(radians(pitch)))))), 6) as tilt from an")
def mth11(spark, sf):
    return angles(spark, sf).select("k", F.round(G.combined_tilt(F.col("roll"), F.col("pitch")), 6).alias("tilt"))


_LIM = "case when z <= 17 then 20 when z >= 21 then 25 when z <= 20 then z + 3 else 23 + (z - 20) * 2 end"


@query("mth12_adaptive_scale", f"""with {_ANG}, c as (select k, greatest(-30, least(30, roll)) as roll, greatest(-30, least(30, pitch)) as pitch, {_LIM} as lim from an),
s as (select *, list_reduce(range(1, 61), lambda acc, i: acc) as _ from c), r as (select k, roll, pitch, lim, degrees(acos(cos(radians(roll)) * cos(radians(pitch)))) <= lim as free from s)
select k, free, round(lim, 6) as allowed from r""")
def mth12(spark, sf):
    """Scale that keeps the combined tilt within the envelope; here whether
    none is needed, and the limit (the bisection itself is tested in numpy)."""
    roll, pitch = G.clamp(F.col("roll"), 30.0), G.clamp(F.col("pitch"), 30.0)
    lim = G.max_tilt(F.col("z"))
    return angles(spark, sf).select("k", (G.tilt_scale(roll, pitch, lim) == 1.0).alias("free"), F.round(lim, 6).alias("allowed"))


@query("mth13_residual_angle", f"with {_ANG} select k, round(degrees(atan(sqrt(tan(radians(roll)) * tan(radians(roll)) + tan(radians(pitch)) * tan(radians(pitch))))), 6) as residual from an")
def mth13(spark, sf):
    return angles(spark, sf).select("k", F.round(G.residual_angle(F.col("roll"), F.col("pitch")), 6).alias("residual"))


@query("mth16_calibrated_target", f"with {_ANG}, t as (select k, 1.5 - roll + 0.05 * pitch as r, -0.5 + 0.04 * roll - pitch as p from an) select k, round(r, 6) as target_roll, round(p, 6) as target_pitch, abs(r) <= 30 + 1e-9 and abs(p) <= 30 + 1e-9 as reachable from t")
def mth16(spark, sf):
    r, p, ok = G.calibrated_target(F.col("roll"), F.col("pitch"), F.lit(1.5), F.lit(-0.5))
    return angles(spark, sf).select("k", F.round(r, 6).alias("target_roll"), F.round(p, 6).alias("target_pitch"), ok.alias("reachable"))


@query("mth17_board_normal", f"with {_ANG}, n as (select k, tan(radians(roll)) as x, tan(radians(pitch)) as y from an) select k, round(x / sqrt(x * x + y * y + 1), 6) as nx, round(y / sqrt(x * x + y * y + 1), 6) as ny, round(-1 / sqrt(x * x + y * y + 1), 6) as nz from n")
def mth17(spark, sf):
    x, y = F.tan(F.radians("roll")), F.tan(F.radians("pitch"))
    size = F.sqrt(x * x + y * y + 1)
    return angles(spark, sf).select("k", F.round(x / size, 6).alias("nx"), F.round(y / size, 6).alias("ny"), F.round(-1 / size, 6).alias("nz"))


@query("mth18_inverse_check", f"with {_ANG}, j as (select k, 1 + roll / 1000 as a, 0.05 as b, 0.04 as c, 1 + pitch / 1000 as d from an) select k, abs(a * d - b * c) > 1e-9 as regular, round(-d / (a * d - b * c), 6) as k00, round(b / (a * d - b * c), 6) as k01 from j")
def mth18(spark, sf):
    """Minus the inverse of a 2 x 2 matrix in closed form."""
    a, b, c, d = 1 + F.col("roll") / 1000, F.lit(0.05), F.lit(0.04), 1 + F.col("pitch") / 1000
    det = a * d - b * c
    return angles(spark, sf).select("k", (F.abs(det) > 1e-9).alias("regular"), F.round(-d / det, 6).alias("k00"), F.round(b / det, 6).alias("k01"))


@query("mth19_normal_angle", "with a as (select vec_id, list_transform(embedding[1:3], lambda x: x::double) as a, list_transform(embedding[4:6], lambda x: x::double) as b from embeddings) select vec_id, round(degrees(acos(greatest(-1, least(1, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))))))), 6) as angle from a")
def mth19(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return load(spark, sf, "embeddings").select("vec_id", F.round(G.normal_angle(F.slice(e, 1, 3), F.slice(e, 4, 3)), 6).alias("angle"))


@query("mth20_plane_least_squares", """with s as (select l_suppkey, count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(z) as sz, sum(x * x) as xx, sum(x * y) as xy, sum(y * y) as yy, sum(x * z) as xz, sum(y * z) as yz from (select l_suppkey, l_quantity as x, l_discount * 100 as y, l_extendedprice / 1000 as z from lineitem) group by all),
d as (select *, xx * (yy * n - sy * sy) - xy * (xy * n - sy * sx) + sx * (xy * sy - yy * sx) as det from s)
select l_suppkey, round((xz * (yy * n - sy * sy) - xy * (yz * n - sy * sz) + sx * (yz * sy - yy * sz)) / det, 5) as a, round((xx * (yz * n - sy * sz) - xz * (xy * n - sy * sx) + sx * (xy * sz - yz * sx)) / det, 5) as b from d""")
def mth20(spark, sf):
    """A plane by its normal equations: nine sums a group, no rows gathered."""
    p = load(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    s = p.groupBy("l_suppkey").agg(F.count("*").cast("double").alias("n"), *[F.sum(v).alias(k) for k, v in {"sx": x, "sy": y, "sz": z, "xx": x * x, "xy": x * y, "yy": y * y, "xz": x * z, "yz": y * z}.items()])
    n, sx, sy, sz, xx, xy, yy, xz, yz = (F.col(c) for c in ("n", "sx", "sy", "sz", "xx", "xy", "yy", "xz", "yz"))
    det = xx * (yy * n - sy * sy) - xy * (xy * n - sy * sx) + sx * (xy * sy - yy * sx)
    a = (xz * (yy * n - sy * sy) - xy * (yz * n - sy * sz) + sx * (yz * sy - yy * sz)) / det
    b = (xx * (yz * n - sy * sz) - xz * (xy * n - sy * sx) + sx * (xy * sz - yz * sx)) / det
    return s.select("l_suppkey", F.round(a, 5).alias("a"), F.round(b, 5).alias("b"))


@query("mth25_plane_render", "select x::bigint as u, y::bigint as v, round(500 / (0.05 * (x - 80) / 500 - 0.02 * (y - 48) / 500 + 1), 6) as depth from (select unnest(range(0, 160, 8)) as x), (select unnest(range(0, 96, 8)) as y)")
def mth25(spark, sf):
    """Depth of a plane along each pixel's ray."""
    px = spark.range(240).select((F.col("id") % 20 * 8).alias("u"), (F.floor(F.col("id") / 20) * 8).alias("v"))
    return px.select("u", "v", F.round(500 / (0.05 * (F.col("u") - 80) / 500 - 0.02 * (F.col("v") - 48) / 500 + 1), 6).alias("depth"))


@query("mth26_height_above_plane", f"with {FRAMES} select event_id, round(300 - depth, 6) as height, 300 - depth between 4 and 250 as is_object from frames")
def mth26(spark, sf):
    h = 300 - F.col("depth")
    return frames(spark, sf).select("event_id", F.round(h, 6).alias("height"), h.between(4, 250).alias("is_object"))


@query("mth27_signed_distance_class", f"with {CANDIDATES} select pose_id, seq, case when 0.1 * area / 1000 - residual > 3 then 'OBJECT' when abs(0.1 * area / 1000 - residual) <= 1 then 'BOARD' else 'UNKNOWN' end as kind from cand")
def mth27(spark, sf):
    d = 0.1 * F.col("area") / 1000 - F.col("residual")
    return candidates(spark, sf).select("pose_id", "seq", F.when(d > 3, "OBJECT").when(F.abs(d) <= 1, "BOARD").otherwise("UNKNOWN").alias("kind"))


@query("mth28_lab_distance", "select vec_id, sqrt(pow(100 * embedding[1]::double, 2) + pow(100 * embedding[2]::double - 5, 2) + pow(100 * embedding[3]::double, 2)) >= 20 as far from embeddings")
def mth28(spark, sf):
    e = F.transform("embedding", lambda x: 100 * x.cast("double"))
    return load(spark, sf, "embeddings").select("vec_id", (F.sqrt(F.pow(e[0], 2) + F.pow(e[1] - 5, 2) + F.pow(e[2], 2)) >= 20).alias("far"))


@query("mth29_background_difference", f"with {FRAMES}, m as (select device, median(depth) as med, greatest(1.4826 * mad(depth), 2) as sigma from frames group by device) select event_id, abs(depth - med) > greatest(10, 3 * sigma) as foreground from frames join m using (device)")
def mth29(spark, sf):
    f = frames(spark, sf)
    m = f.groupBy("device").agg(F.median("depth").alias("med"))
    s = f.join(m, "device").groupBy("device", "med").agg(F.greatest(F.lit(1.4826) * F.median(F.abs(F.col("depth") - F.col("med"))), F.lit(2.0)).alias("sigma"))
    return f.join(s, "device").select("event_id", (F.abs(F.col("depth") - F.col("med")) > F.greatest(F.lit(10.0), 3 * F.col("sigma"))).alias("foreground"))


@query("mth30_weighted_score", f"with {CANDIDATES} select pose_id, seq, case when gate then round(0.5 * depth_valid + 0.3 * inlier + 0.2 * coalesce(case when residual > 0 then residual end, 0), 6) end as score from cand")
def mth30(spark, sf):
    """Weighted sum over the metrics that are known; NULL when rejected."""
    weights = {"depth_valid": 0.5, "inlier": 0.3, "residual": 0.2}
    metrics = F.create_map(F.lit("depth_valid"), F.col("depth_valid"), F.lit("inlier"), F.col("inlier"), F.lit("residual"), F.when(F.col("residual") > 0, F.col("residual")))
    total = sum(F.coalesce(metrics[k] * w, F.lit(0.0)) for k, w in weights.items())
    return candidates(spark, sf).select("pose_id", "seq", F.when(F.col("gate"), F.round(total, 6)).alias("score"))


@query("mth31_coverage_score", f"with {CANDIDATES}, m as (select *, max(case when gate then area end) over (partition by pose_id) as ma, max(case when gate then depth_valid end) over (partition by pose_id) as md from cand) select pose_id, seq, case when gate then round((0.6 * area / ma + 0.4 * depth_valid / md) / 1.0, 6) end as score from m")
def mth31(spark, sf):
    w = W.partitionBy("pose_id")
    top = lambda c: F.max(F.when(F.col("gate"), F.col(c))).over(w)
    return candidates(spark, sf).select("pose_id", "seq", F.when(F.col("gate"), F.round(0.6 * F.col("area") / top("area") + 0.4 * F.col("depth_valid") / top("depth_valid"), 6)).alias("score"))


@query("mth32_coarse_candidates", "select p_partkey, list_transform(case when (p_size * 10 - 170) % 20 = 0 or p_size < 17 then range(p_size * 10, 169, -20) else list_append(range(p_size * 10, 169, -20), 170) end, lambda x: x / 10.0) as z from part where p_size >= 17")
def mth32(spark, sf):
    """Down from the start by steps of 2, the end always included."""
    start = F.col("p_size") * 10
    down = F.sequence(start, start - F.floor((start - 170) / 20).cast("int") * 20, F.lit(-20))
    return load(spark, sf, "part").where("p_size >= 17").select("p_partkey", F.transform(F.array_distinct(F.concat(down, F.array(F.lit(170)))), lambda x: x / 10.0).alias("z"))


@query("mth33_fine_candidates", "select p_partkey, list_transform(range(p_size * 10 + 5, p_size * 10 + 20, 5), lambda x: x / 10.0) as z from part")
def mth33(spark, sf):
    lo = F.col("p_size") * 10
    return load(spark, sf, "part").select("p_partkey", F.transform(F.sequence(lo + 5, lo + 15, F.lit(5)), lambda x: x / 10.0).alias("z"))


@query("mth34_heatmap_normalise", "with q as (select quantile_cont(l_extendedprice, 0.01) filter (l_linestatus = 'F') as lo, greatest(quantile_cont(l_extendedprice, 0.99) filter (l_linestatus = 'O'), quantile_cont(l_extendedprice, 0.99) filter (l_linestatus = 'F')) as hi from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(1, (l_extendedprice - lo) / greatest(hi - lo, 1e-12))), 6) as heat from lineitem, q where l_linestatus = 'O'")
def mth34(spark, sf):
    l = load(spark, sf, "lineitem")
    hi = percentile(l.where("l_linestatus in ('F', 'O')"), "l_extendedprice", 0.99, ["l_linestatus"], "hi").agg(F.max("hi").alias("hi"))
    lo = percentile(l.where("l_linestatus = 'F'"), "l_extendedprice", 0.01, name="lo").agg(F.max("lo").alias("lo"))
    q = lo.crossJoin(hi)
    heat = (F.col("l_extendedprice") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    return l.where("l_linestatus = 'O'").crossJoin(F.broadcast(q)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), heat)), 6).alias("heat"))


@query("mth35_odd_kernel", "select p_partkey, case when p_size % 2 = 0 then p_size + 1 else p_size end as kernel from part")
def mth35(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("kernel"))


@query("mth37_gyro_low_pass", f"with recursive {FRAMES}, t(device, seq, r) as (select device, seq, 0.15 * depth / 7 from frames where seq = 1 union all select f.device, f.seq, t.r + 0.15 * (f.depth / 7 - t.r) from t join frames f on f.device = t.device and f.seq = t.seq + 1) select device, seq, round(r, 6) as rate from t")
def mth37(spark, sf):
    """r += 0.15 (x - r) in order, as a fold over a bounded run of each device's
    samples: the weight of a sample 200 back is below 1e-14."""
    w = W.partitionBy("device").orderBy("seq").rowsBetween(-200, 0)
    return frames(spark, sf).withColumn("x", F.collect_list("depth").over(w)).select("device", "seq", F.round(F.aggregate("x", F.lit(0.0), lambda r, x: r + 0.15 * (x / 7 - r)), 6).alias("rate"))


@query("mth39_dead_reckoning", "select p_partkey, round(case when abs(p_size - 20) <= 25 * 0.2 then p_size else 20 + sign(p_size - 20) * 25 * 0.2 end, 6) as z from part")
def mth39(spark, sf):
    """Height after 25 ticks of at most 0.2 towards the target."""
    target = F.col("p_size").cast("double")
    z = F.aggregate(F.sequence(F.lit(1), F.lit(25)), F.lit(20.0), lambda z, _: F.when(F.abs(target - z) <= 0.2, target).otherwise(z + F.signum(target - z) * 0.2))
    return load(spark, sf, "part").select("p_partkey", F.round(z, 6).alias("z"))


@query("mth41_phase_pattern", "select y::bigint as y, p::bigint as phase, round_even(128 + 127 * cos(2 * pi() * y / 80 + radians(p)), 0)::bigint as value from (select unnest(range(0, 160)) as y), (select unnest([0, 90, 180, 270]) as p) where abs(128 + 127 * cos(2 * pi() * y / 80 + radians(p)) * 1.0 - floor(128 + 127 * cos(2 * pi() * y / 80 + radians(p))) - 0.5) > 1e-6")
def mth41(spark, sf):
    """Four phase patterns of period 80."""
    g = spark.range(640).select((F.col("id") % 160).alias("y"), (F.floor(F.col("id") / 160) * 90).alias("phase"))
    v = 128 + 127 * F.cos(2 * F.pi() * F.col("y") / 80 + F.radians("phase"))
    return g.where(F.abs(v - F.floor(v) - 0.5) > 1e-6).select("y", "phase", F.rint(v).cast("long").alias("value"))


@query("mth42_preview_scaling", f"with {FRAMES}, q as (select device, quantile_cont(depth, 0.02) as lo, quantile_cont(depth, 0.98) as hi from frames group by device) select event_id, round(greatest(0, least(255, (depth - lo) * 255 / greatest(hi - lo, 1e-12))), 5) as grey from frames join q using (device)")
def mth42(spark, sf):
    f = frames(spark, sf)
    q = f.groupBy("device").agg(F.percentile("depth", 0.02).alias("lo"), F.percentile("depth", 0.98).alias("hi"))
    return f.join(q, "device").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("depth") - F.col("lo")) * 255 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)))), 5).alias("grey"))


@query("mth43_threshold_heat", f"with {CANDIDATES} select pose_id, seq, round(greatest(0, least(1, depth_valid * (inlier / 0.8) / 1.5)), 6) as heat from cand")
def mth43(spark, sf):
    return candidates(spark, sf).select("pose_id", "seq", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("depth_valid") * (F.col("inlier") / 0.8) / 1.5)), 6).alias("heat"))
