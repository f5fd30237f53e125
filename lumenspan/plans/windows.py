"""Window functions and ordered choices."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.operators import ordered as O
from lumenspan.plans.proxies import CANDIDATES, FRAMES, RESIDUALS, candidates, frames, load, residuals
from lumenspan.registry import query


@query("win01_rolling_median", f"""with {FRAMES}, f as (select *, case when depth > 100 then depth end as d from frames)
select device, seq, round(coalesce(median(d) over (partition by device order by seq rows 4 preceding), 0), 6) as median5 from f""")
def win01(spark, sf):
    f = frames(spark, sf).withColumn("d", F.when(F.col("depth") > 100, F.col("depth")))
    return O.rolling_median(f, "d", ["device"], ["seq"], 5, "m").select("device", "seq", F.round("m", 6).alias("median5"))


@query("win02_temporal_median", f"""with {FRAMES} select device, round(coalesce(median(case when depth > 100 then depth end), 0), 6) as median_depth, count(*) as frames from frames where seq <= 9 group by device""")
def win02(spark, sf):
    d = F.when(F.col("depth") > 100, F.col("depth"))
    return frames(spark, sf).where("seq <= 9").groupBy("device").agg(F.round(F.coalesce(F.median(d), F.lit(0.0)), 6).alias("median_depth"), F.count("*").alias("frames"))


_STREAK = """i as (select *, sum(case when ok then 0 else 1 end) over (partition by device order by seq) as island from s),
r as (select *, sum(case when ok then 1 else 0 end) over (partition by device, island order by seq)::bigint as streak from i)"""


@query("win03_ready_streak", f"""with {FRAMES}, s as (select *, stable and depth > 20 as ok from frames where seq <= 8), {_STREAK}
select device, min(case when streak >= 4 then seq end) as ready_at, count(*) as evaluated from r group by device""")
def win03(spark, sf):
    return O.first_streak(frames(spark, sf), F.col("stable") & (F.col("depth") > 20), ["device"], "seq", 4, 8)


@query("win04_stable_after_guard", f"""with {FRAMES}, g as (select *, min(ts) over (partition by device) as t0 from frames),
s as (select device, seq, ts, t0, stable, stable and depth < 250 as ok from g where ts >= t0 + interval 1 hour), {_STREAK},
m as (select *, bool_or(not ok) over (partition by device order by seq) as moved from r)
select device, min(case when streak >= 3 and (moved or ts >= t0 + interval 5 hour) then seq end) as done_at from m group by device""")
def win04(spark, sf):
    """After a guard time, three stable samples at the target in sequence, once
    motion was seen or the deadband time is over."""
    whole = W.partitionBy("device")
    g = frames(spark, sf).withColumn("t0", F.min("ts").over(whole)).where("ts >= t0 + interval 1 hour").withColumn("ok", F.col("stable") & (F.col("depth") < 250))
    r = O.streak(g, F.col("ok"), ["device"], ["seq"]).withColumn("moved", F.bool_or(~F.col("ok")).over(whole.orderBy("seq")))
    return r.groupBy("device").agg(F.min(F.when((F.col("streak") >= 3) & (F.col("moved") | F.expr("ts >= t0 + interval 5 hour")), F.col("seq"))).alias("done_at"))


@query("win05_manual_streak", f"""with {FRAMES}, s as (select *, depth > 50 as ok from frames), {_STREAK} select device, seq, streak from r""")
def win05(spark, sf):
    return O.streak(frames(spark, sf), F.col("depth") > 50, ["device"], ["seq"]).select("device", "seq", "streak")


@query("win06_frame_delta", f"""with {FRAMES}, d as (select device, abs(depth - lag(depth) over (partition by device order by seq)) as delta from frames)
select device, round(median(delta), 6) as median_delta from d group by device""")
def win06(spark, sf):
    w = W.partitionBy("device").orderBy("seq")
    return frames(spark, sf).withColumn("delta", F.abs(F.col("depth") - F.lag("depth").over(w))).groupBy("device").agg(F.round(F.median("delta"), 6).alias("median_delta"))


@query("win07_top_patches", f"""with {RESIDUALS}, s as (select vec_id, list_sum(residual) / 64 as score from res where label >= 5),
r as (select vec_id, score, row_number() over (order by round(score, 9) desc, vec_id) as rank from s) select rank, vec_id, round(score, 6) as score from r where rank <= 10""")
def win07(spark, sf):
    mean = F.aggregate("residual", F.lit(0.0), lambda a, x: a + x) / 64
    s = residuals(spark, sf).where("label >= 5").select("vec_id", mean.alias("score")).orderBy(F.round("score", 9).desc(), "vec_id").limit(10)
    return s.select(F.row_number().over(W.orderBy(F.round("score", 9).desc(), "vec_id")).cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query("win08_patch_index", "select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as patch_index from embeddings")
def win08(spark, sf):
    w = W.partitionBy("label").orderBy("vec_id")
    return load(spark, sf, "embeddings").select("vec_id", "label", (F.row_number().over(w) - 1).cast("long").alias("patch_index"))


@query("win09_streak_representative", f"""with {CANDIDATES}, i as (select *, sum(case when gate then 0 else 1 end) over (partition by pose_id order by seq) as island from cand),
l as (select *, max(island) over (partition by pose_id) as last_island from i),
r as (select *, row_number() over (partition by pose_id order by area desc, depth_valid desc, inlier desc, residual, seq desc) as k from l where gate and island = last_island)
select pose_id, seq, area, round(depth_valid, 6) as depth_valid from r where k = 1""")
def win09(spark, sf):
    """Best frame inside the final passing streak."""
    w = W.partitionBy("pose_id")
    c = candidates(spark, sf).withColumn("island", F.sum(F.when(F.col("gate"), 0).otherwise(1)).over(w.orderBy("seq"))).withColumn("last_island", F.max("island").over(w)).where("gate and island = last_island")
    got = O.best(c, ["pose_id"], [F.col("area"), F.col("depth_valid"), F.col("inlier"), -F.col("residual"), F.col("seq")], ["seq", "area", "depth_valid"])
    return got.withColumn("depth_valid", F.round("depth_valid", 6))


@query("win10_stop_after_failure", f"""with {CANDIDATES}, b as (select *, coalesce(sum(case when gate then 0 else 1 end) over (partition by pose_id order by seq rows between unbounded preceding and 1 preceding), 0) as failed from cand)
select pose_id, count(*) as evaluated, count(*) filter (gate) as passed from b where failed = 0 group by pose_id""")
def win10(spark, sf):
    return O.before_first_failure(candidates(spark, sf), ~F.col("gate"), ["pose_id"], ["seq"]).groupBy("pose_id").agg(F.count("*").alias("evaluated"), F.count_if("gate").alias("passed"))


@query("win11_replay_cursor", f"""with {FRAMES} select device, seq, kind from frames where seq > 3 and ts <= timestamp '2024-01-15 00:00:00'""")
def win11(spark, sf):
    """Events behind a cursor: not yet shown, and due."""
    return frames(spark, sf).where("seq > 3 and ts <= timestamp_ntz'2024-01-15 00:00:00'").select("device", "seq", "kind")


@query("win12_segments", """with p as (select * from (values (17.0, 20.0), (18.0, 21.0), (19.0, 22.0), (20.0, 23.0), (21.0, 25.0)) t(z, lim))
select z::double as z0, lead(z) over (order by z)::double as z1, lim::double as limit0, lead(lim) over (order by z)::double as limit1 from p qualify z1 is not null""")
def win12(spark, sf):
    from lumenspan.operators.geometry import envelope_segments

    return envelope_segments(spark)


@query("win13_held_state", f"""with recursive {FRAMES}, t(device, seq, held) as (
  select device, seq, depth from frames where seq = 1
  union all select f.device, f.seq, case when f.depth between 0.5 * t.held and 2 * t.held then f.depth else t.held end from t join frames f on f.device = t.device and f.seq = t.seq + 1)
select device, seq, round(held, 6) as held from t""")
def win13(spark, sf):
    """A tracked value is replaced only if the new one passes the guard (area
    ratio 0.5 to 2), else held: a fold over each device's ordered samples."""
    import pandas as pd

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out, held = [], None
        for x in pdf["depth"]:
            held = x if held is None or 0.5 * held <= x <= 2 * held else held
            out.append(held)
        return pd.DataFrame({"device": pdf["device"], "seq": pdf["seq"], "held": out})

    got = frames(spark, sf).select("device", "seq", "depth").groupBy("device").applyInPandas(hold, "device long, seq long, held double")
    return got.withColumn("held", F.round("held", 6))


@query("win14_normalise_by_max", f"""with {CANDIDATES} select pose_id, seq, round(area / max(case when gate then area end) over (partition by pose_id), 6) as area_norm,
  round(depth_valid / max(case when gate then depth_valid end) over (partition by pose_id), 6) as depth_norm from cand""")
def win14(spark, sf):
    w = W.partitionBy("pose_id")
    top = lambda c: F.max(F.when(F.col("gate"), F.col(c))).over(w)
    return candidates(spark, sf).select("pose_id", "seq", F.round(F.col("area") / top("area"), 6).alias("area_norm"), F.round(F.col("depth_valid") / top("depth_valid"), 6).alias("depth_norm"))


# ---- ordered choices ---------------------------------------------------------


@query("ord01_best_z", f"""with {CANDIDATES}, r as (select *, row_number() over (partition by pose_id order by depth_valid desc, z, seq) as k from cand where gate)
select pose_id, z as best_z, round(depth_valid, 6) as best_quality from r where k = 1""")
def ord01(spark, sf):
    """Largest quality of the passing samples; a tie goes to the lower Z."""
    got = O.best(candidates(spark, sf).where("gate"), ["pose_id"], [F.col("depth_valid"), -F.col("z")], ["z", "depth_valid"])
    return got.select("pose_id", F.col("z").alias("best_z"), F.round("depth_valid", 6).alias("best_quality"))


@query("ord02_dominant_plane", """select o_custkey as plan_id, max_by(o_orderkey, (round(o_totalprice)::bigint, -o_orderkey)) as plane, max(round(o_totalprice)::bigint) as points from orders group by all""")
def ord02(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("plane"), F.round("o_totalprice").cast("long").alias("points"))
    return O.best(o, ["plan_id"], [F.col("points"), -F.col("plane")], ["plane", "points"])


@query("ord03_plane_order", """select o_custkey as plan_id, o_orderkey as plane, row_number() over (partition by o_custkey order by o_orderstatus <> 'F', o_totalprice desc, o_orderkey) as position from orders""")
def ord03(spark, sf):
    """Dominant planes first, then by points, then as listed."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "F", F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("plane"), F.row_number().over(w).cast("long").alias("position"))


@query("ord04_pose_order", """select o_custkey as plan_id, o_orderkey as pose, row_number() over (partition by o_custkey order by o_orderpriority not like '1%', o_orderstatus <> 'F', o_totalprice desc, o_orderkey) as position from orders""")
def ord04(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(~F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") != "F", F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("pose"), F.row_number().over(w).cast("long").alias("position"))


@query("ord05_final_candidates", f"""with {CANDIDATES}, q as (select *, case when gate then depth_valid end as quality from cand),
r as (select *, row_number() over (partition by pose_id order by quality desc nulls last, seq) as rank from q) select pose_id, seq, rank, round(quality, 6) as quality from r where rank <= 3""")
def ord05(spark, sf):
    w = W.partitionBy("pose_id").orderBy(F.desc_nulls_last("quality"), "seq")
    c = candidates(spark, sf).withColumn("quality", F.when(F.col("gate"), F.col("depth_valid")))
    return c.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("pose_id", "seq", "rank", F.round("quality", 6).alias("quality"))


@query("ord06_artifact_priority", """with a as (select label, vec_id, case vec_id % 4 when 0 then 'UNKNOWN' when 1 then 'OBJECT_ONLY' when 2 then 'OBJECT_AND_PLATFORM' else 'OBJECT_PLATFORM_FLOOR' end as kind, 'cloud_' || lpad(vec_id::varchar, 5, '0') || '.ply' as name from embeddings)
select label, min_by(name, (case kind when 'OBJECT_ONLY' then 0 when 'OBJECT_AND_PLATFORM' then 1 else 2 end, name)) as chosen from a where kind <> 'UNKNOWN' group by label""")
def ord06(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("UNKNOWN", "OBJECT_ONLY", "OBJECT_AND_PLATFORM", "OBJECT_PLATFORM_FLOOR"))), (F.col("vec_id") % 4 + 1).cast("int"))
    rank = F.when(kind == "OBJECT_ONLY", 0).when(kind == "OBJECT_AND_PLATFORM", 1).when(kind == "OBJECT_PLATFORM_FLOOR", 2)
    name = F.concat(F.lit("cloud_"), F.lpad(F.col("vec_id").cast("string"), 5, "0"), F.lit(".ply"))
    a = load(spark, sf, "embeddings").select("label", rank.alias("rank"), name.alias("name")).where("rank is not null")
    return a.groupBy("label").agg(F.min_by("name", F.struct("rank", "name")).alias("chosen"))


@query("ord07_recommended_setting", """with g as (select l_suppkey % 10 as setting, l_linenumber as gain, avg(l_quantity) as stable, round(stddev_pop(l_extendedprice), 3) as std, round(avg(l_tax), 9) as delta from lineitem group by all),
k as (select *, max(stable) over (partition by setting) as top from g)
select setting, min_by(gain, (std, delta, -stable))::bigint as gain, min(std) as std from k where stable >= 0.8 * top group by setting""")
def ord07(spark, sf):
    """Of the settings with a stable share near the best, the quietest."""
    g = load(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("setting"), F.col("l_linenumber").cast("long").alias("gain")).agg(
        F.avg("l_quantity").alias("stable"), F.round(F.stddev_pop("l_extendedprice"), 3).alias("std"), F.round(F.avg("l_tax"), 9).alias("delta")
    )
    k = g.withColumn("top", F.max("stable").over(W.partitionBy("setting"))).where("stable >= 0.8 * top")
    return k.groupBy("setting").agg(F.min_by("gain", F.struct("std", "delta", -F.col("stable"))).alias("gain"), F.min("std").alias("std"))


@query("ord08_main_component", """select o_custkey as image, max_by(o_orderkey, (floor(o_totalprice / 1000) - 20 * (o_orderkey % 7), o_orderkey)) as label, max(floor(o_totalprice / 1000) - 20 * (o_orderkey % 7))::double as score from orders group by all""")
def ord08(spark, sf):
    """Area less 20 times the distance from the centre; ties to the highest label."""
    score = (F.floor(F.col("o_totalprice") / 1000) - 20 * (F.col("o_orderkey") % 7)).cast("double")
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("label"), score.alias("score"))
    return O.best(o, ["image"], [F.col("score"), F.col("label")], ["label", "score"])


@query("ord09_largest_component", """select o_custkey as image, max_by(o_orderkey, (floor(o_totalprice / 50000), -o_orderkey)) as label from orders group by all""")
def ord09(spark, sf):
    """Largest area; ties to the lowest label."""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("label"), F.floor(F.col("o_totalprice") / 50000).alias("area"))
    return O.best(o, ["image"], [F.col("area"), -F.col("label")], ["label"])


@query("ord10_central_component", """select o_custkey as image, max_by(o_orderkey, (round(o_totalprice / (1 + 1.6::double * (o_orderkey % 100) / 100), 6), -o_orderkey)) as label from orders where o_totalprice between 1000 and 400000 group by all""")
def ord10(spark, sf):
    score = F.round(F.col("o_totalprice") / (1 + F.lit(1.6) * (F.col("o_orderkey") % 100) / 100), 6)
    o = load(spark, sf, "orders").where("o_totalprice between 1000 and 400000").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("label"), score.alias("score"))
    return O.best(o, ["image"], [F.col("score"), -F.col("label")], ["label"])


@query("ord11_object_component", """select o_custkey as image, max_by(o_orderkey, (round(o_totalprice / (1 + 1.4::double * (o_orderkey % 100) / 100), 6), -o_orderkey)) as label from orders group by all""")
def ord11(spark, sf):
    score = F.round(F.col("o_totalprice") / (1 + F.lit(1.4) * (F.col("o_orderkey") % 100) / 100), 6)
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("label"), score.alias("score"))
    return O.best(o, ["image"], [F.col("score"), -F.col("label")], ["label"])


@query("ord12_plane_hypothesis", f"""with {CANDIDATES} select pose_id, min_by(seq, (round(case when gate then residual else 'infinity'::double end, 3), -inlier, -z, seq)) as hypothesis from cand group by pose_id""")
def ord12(spark, sf):
    """Smallest angle to three decimals, then most inliers, then deepest."""
    angle = F.bround(F.when(F.col("gate"), F.col("residual")).otherwise(float("inf")), 3)
    return candidates(spark, sf).groupBy("pose_id").agg(F.min_by("seq", F.struct(angle.alias("a"), (-F.col("inlier")).alias("b"), (-F.col("z")).alias("c"), "seq")).alias("hypothesis"))


@query("ord13_first_ready_frame", f"""with {CANDIDATES} select pose_id, min(seq) filter (gate and seq <= 8) as frame from cand group by pose_id""")
def ord13(spark, sf):
    return candidates(spark, sf).groupBy("pose_id").agg(F.min(F.when(F.col("gate") & (F.col("seq") <= 8), F.col("seq"))).alias("frame"))


@query("ord14_first_acceptable", f"""with {CANDIDATES}, r as (select *, row_number() over (partition by pose_id order by area desc, seq) as rank from cand where gate)
select pose_id, min(rank) filter (depth_valid >= 0.5) as accepted_rank from r where rank <= 3 group by pose_id""")
def ord14(spark, sf):
    w = W.partitionBy("pose_id").orderBy(F.desc("area"), "seq")
    r = candidates(spark, sf).where("gate").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")
    return r.groupBy("pose_id").agg(F.min(F.when(F.col("depth_valid") >= 0.5, F.col("rank"))).alias("accepted_rank"))


@query("ord15_last_passing", f"""with {CANDIDATES} select pose_id, max_by(z, seq) filter (gate) as z from cand group by pose_id""")
def ord15(spark, sf):
    """The passing candidate that was visited last, not the highest."""
    return candidates(spark, sf).groupBy("pose_id").agg(F.max_by("z", F.when(F.col("gate"), F.col("seq"))).alias("z"))


@query("ord16_warm_up_skip", f"""with {FRAMES} select device, event_id from frames where seq = 6""")
def ord16(spark, sf):
    return frames(spark, sf).where("seq = 5 + 1").select("device", "event_id")


@query("ord17_corner_order", """with p as (select o_custkey as board, o_orderkey % 640 as x, floor(o_totalprice)::bigint % 480 as y, o_orderkey as k from orders)
select board, min_by(k, (x + y, k)) as tl, max_by(k, (x + y, -k)) as br, min_by(k, (y - x, k)) as tr, max_by(k, (y - x, -k)) as bl from p group by board""")
def ord17(spark, sf):
    """Corners by the extremes of x + y and y - x; ties to the first point."""
    p = load(spark, sf, "orders").select(F.col("o_custkey").alias("board"), (F.col("o_orderkey") % 640).alias("x"), (F.floor("o_totalprice") % 480).alias("y"), F.col("o_orderkey").alias("k"))
    s, d, k = F.col("x") + F.col("y"), F.col("y") - F.col("x"), F.col("k")
    st = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return p.groupBy("board").agg(F.min_by("k", st(s, k)).alias("tl"), F.max_by("k", st(s, -k)).alias("br"), F.min_by("k", st(d, k)).alias("tr"), F.max_by("k", st(d, -k)).alias("bl"))


@query("ord18_best_alignment", f"""with {CANDIDATES} select pose_id, min_by(seq, (residual, seq)) as candidate, round(min(residual), 6) as residual from cand group by pose_id""")
def ord18(spark, sf):
    return candidates(spark, sf).groupBy("pose_id").agg(F.min_by("seq", F.struct("residual", "seq")).alias("candidate"), F.round(F.min("residual"), 6).alias("residual"))
