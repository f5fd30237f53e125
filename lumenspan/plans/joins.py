"""Joins, graph grouping, and rules of the production loop."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.operators.geometry import max_tilt
from lumenspan.operators.planes import plane_groups, same_plane
from lumenspan.operators.selection import percentile
from lumenspan.plans.proxies import CANDIDATES, FRAMES, MANIFEST, candidates, frames, load, manifest
from lumenspan.registry import query


@query("join01_image_mask", f"with {MANIFEST} select doc_id, path, '/masks/' || doc_id || '.png' as mask from man join labels using (doc_id)")
def join01(spark, sf):
    masks = load(spark, sf, "labels").select("doc_id", F.concat(F.lit("/masks/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("mask"))
    return manifest(spark, sf).join(masks, "doc_id").select("doc_id", "path", "mask")


@query("join02_region_semi", f"with {MANIFEST} select doc_id, path from man where doc_id in (select doc_id from labels where quality = 1)")
def join02(spark, sf):
    return manifest(spark, sf).join(load(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "path")


@query("join03_patch_source", f"with {MANIFEST}, g as (select unnest([0, 32, 64]) as x) select doc_id, case when doc_id % 4 = 0 then 'mask' when has_regions then 'regions' else 'full' end as source, x::bigint as x from man, g where case when doc_id % 4 = 0 then x < 32 when has_regions then x < 64 else true end")
def join03(spark, sf):
    """Patches of each image: a mask goes before regions, else the whole image."""
    source = F.when(F.col("doc_id") % 4 == 0, "mask").when(F.col("has_regions"), "regions").otherwise("full")
    last = F.when(F.col("doc_id") % 4 == 0, 0).when(F.col("has_regions"), 32).otherwise(64)
    return manifest(spark, sf).select("doc_id", source.alias("source"), F.explode(F.sequence(F.lit(0), last, F.lit(32)).cast("array<bigint>")).alias("x"))


@query("join04_pixel_gather", "select a.o_orderkey, a.u, a.v, b.depth from (select o_orderkey, o_orderkey % 50 as u, o_custkey % 40 as v from orders where o_orderstatus = 'P') a join (select l_suppkey % 50 as u, l_partkey % 40 as v, max(l_extendedprice) as depth from lineitem group by all) b using (u, v)")
def join04(spark, sf):
    px = load(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_orderkey") % 50).alias("u"), (F.col("o_custkey") % 40).alias("v"))
    depth = load(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("u"), (F.col("l_partkey") % 40).alias("v")).agg(F.max("l_extendedprice").alias("depth"))
    return px.join(depth, ["u", "v"]).select("o_orderkey", "u", "v", "depth")


@query("join05_tilt_envelope", """with e(z0, z1, a, b) as (values (17.0, 18.0, 20.0, 21.0), (18.0, 19.0, 21.0, 22.0), (19.0, 20.0, 22.0, 23.0), (20.0, 21.0, 23.0, 25.0)), p as (select p_partkey, 16 + p_size / 8.0::double as z from part)
select p_partkey, round(case when z <= 17 then 20 when z >= 21 then 25 else (select min(a + (z - z0) / (z1 - z0) * (b - a)) from e where z between z0 and z1) end, 6) as max_tilt from p""")
def join05(spark, sf):
    """Interval lookup with interpolation."""
    return load(spark, sf, "part").select("p_partkey", F.round(max_tilt(16 + F.col("p_size") / 8.0), 6).alias("max_tilt"))


_PLANES = "pl as (select o_custkey as run, o_orderkey as idx, [o_orderkey % 3 * 0.02, o_custkey % 3 * 0.01, -1.0]::double[] as n, [o_orderkey % 5 * 10.0, o_custkey % 7 * 10.0, 500 + o_orderkey % 4 * 3.0]::double[] as c from orders)"
_PAIRS = _PLANES + """, un as (select run, idx, list_transform(n, lambda x: x / sqrt(list_dot_product(n, n))) as n, c from pl),
pr as (select a.run, a.idx as a, b.idx as b from un a join un b on a.run = b.run and a.idx < b.idx where degrees(acos(least(1.0, abs(list_dot_product(a.n, b.n))))) <= 2.0
  and greatest(abs(list_dot_product(list_transform(list_zip(b.c, a.c), lambda t: t[1] - t[2]), a.n)), abs(list_dot_product(list_transform(list_zip(b.c, a.c), lambda t: t[1] - t[2]), b.n))) <= 5.0)"""


def planes(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, sf, "orders").select(c.alias("run"), k.alias("idx"), F.array(k % 3 * 0.02, c % 3 * 0.01, F.lit(-1.0)).alias("normal"), F.array(k % 5 * 10.0, c % 7 * 10.0, 500 + k % 4 * 3.0).alias("centre"))


@query("join06_same_plane", f"with {_PAIRS} select run, a, b from pr")
def join06(spark, sf):
    return same_plane(planes(spark, sf))


_GROUPS = "with recursive " + _PAIRS + """, bo as (select run, a, b from pr union select run, b, a from pr), wk(run, idx, r) as (select run, idx, idx from pl union select wk.run, wk.idx, bo.b from wk join bo on bo.run = wk.run and bo.a = wk.r),
gr as (select run, idx, min(r) as grp from wk group by all)"""


@query("set06_plane_groups", f'{_GROUPS} select run, idx, grp as "group" from gr')
def set06(spark, sf):
    p = planes(spark, sf)
    return plane_groups(p, same_plane(p))


@query("join07_group_representative", f"{_GROUPS} select gr.run, grp as representative, count(*) as members, any_value(pl.c[3]) as depth from gr join pl on pl.run = gr.run and pl.idx = gr.grp group by all")
def join07(spark, sf):
    p = planes(spark, sf)
    g = plane_groups(p, same_plane(p)).groupBy("run", F.col("group").alias("representative")).agg(F.count("*").alias("members"))
    return g.join(p.select("run", F.col("idx").alias("representative"), F.col("centre")[2].alias("depth")), ["run", "representative"])


@query("join08_score_threshold", "with t as (select l_returnflag as method, quantile_cont(l_extendedprice, 0.99) as thr from lineitem where l_linestatus = 'F' group by all) select l_returnflag as method, count(*) as patches, count(*) filter (l_extendedprice > thr) as over from lineitem join t on method = l_returnflag where l_linestatus = 'O' group by all")
def join08(spark, sf):
    l = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), "l_linestatus", "l_extendedprice")
    t = percentile(l.where("l_linestatus = 'F'"), "l_extendedprice", 0.99, ["method"], "thr")
    return l.where("l_linestatus = 'O'").join(t, "method").groupBy("method").agg(F.count("*").alias("patches"), F.count_if(F.col("l_extendedprice") > F.col("thr")).alias("over"))


_SEED = "select o_custkey as image, o_orderkey % 9 as label, count(*) as area, count(*) filter (o_orderstatus = 'F') as overlap from orders group by all"


@query("join09_seed_overlap", f"with c as ({_SEED}) select image, max_by(label, (round(overlap + 0.03 * area, 6), -label)) as label from c group by image")
def join09(spark, sf):
    c = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("image"), (F.col("o_orderkey") % 9).alias("label")).agg(F.count("*").alias("area"), F.count_if(F.col("o_orderstatus") == "F").alias("overlap"))
    return c.groupBy("image").agg(F.max_by("label", F.struct(F.round(F.col("overlap") + 0.03 * F.col("area"), 6).alias("s"), (-F.col("label")).alias("k"))).alias("label"))


@query("join10_rgb_seed", f"with c as ({_SEED}) select image, max_by(label, (overlap, area, -label)) as label, max(overlap) as overlap from c where overlap > 0 group by image")
def join10(spark, sf):
    c = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("image"), (F.col("o_orderkey") % 9).alias("label")).agg(F.count("*").alias("area"), F.count_if(F.col("o_orderstatus") == "F").alias("overlap"))
    return c.where("overlap > 0").groupBy("image").agg(F.max_by("label", F.struct("overlap", "area", (-F.col("label")).alias("k"))).alias("label"), F.max("overlap").alias("overlap"))


_BEST = CANDIDATES + ", b as (select pose_id, max_by(z, (depth_valid, -z)) as best_z from cand where gate group by pose_id)"


@query("join11_best_z_lookup", f"with {_BEST} select pose_id, min(seq) as seq from cand join b using (pose_id) where z = best_z and gate group by pose_id")
def join11(spark, sf):
    c = candidates(spark, sf).where("gate")
    b = c.groupBy("pose_id").agg(F.max_by("z", F.struct("depth_valid", -F.col("z"))).alias("best_z"))
    return c.join(b, "pose_id").where("z = best_z").groupBy("pose_id").agg(F.min("seq").alias("seq"))


@query("join12_tolerance_lookup", f"with {_BEST} select pose_id, coalesce(min(seq) filter (abs(z - best_z - 1) <= 1e-9), min(seq)) as seq from cand join b using (pose_id) group by pose_id")
def join12(spark, sf):
    """The candidate within a tolerance of a height, else the first."""
    c = candidates(spark, sf)
    b = c.where("gate").groupBy("pose_id").agg(F.max_by("z", F.struct("depth_valid", -F.col("z"))).alias("best_z"))
    near = F.abs(F.col("z") - F.col("best_z") - 1) <= 1e-9
    return c.join(b, "pose_id").groupBy("pose_id").agg(F.coalesce(F.min(F.when(near, F.col("seq"))), F.min("seq")).alias("seq"))


@query("join13_command_ack", f"with {FRAMES}, a as (select device, min(seq) filter (kind = 'signup') as ack from frames group by device) select device, any_value(ack) as ack, min(seq) filter (kind = 'purchase' and seq > ack) as done from frames join a using (device) group by device")
def join13(spark, sf):
    """The echo first, then the completion mark after it."""
    f = frames(spark, sf)
    ack = F.min(F.when(F.col("kind") == "signup", F.col("seq"))).over(W.partitionBy("device"))
    return f.withColumn("ack", ack).groupBy("device").agg(F.max("ack").alias("ack"), F.min(F.when((F.col("kind") == "purchase") & (F.col("seq") > F.col("ack")), F.col("seq"))).alias("done"))


@query("join14_latest_before", """with q as (select c_custkey, c_custkey % 150 as device, timestamp '2024-01-01 00:00:00' + to_hours((c_custkey % 400)::int) as ts from customer)
select c_custkey, e.event_id, e.value from q asof left join events e on e.user_id = q.device and e.ts <= q.ts""")
def join14(spark, sf):
    """As-of join: both sides in one ordered pass per device, so a device's
    rows are sorted once and never paired."""
    q = load(spark, sf, "customer").select((F.col("c_custkey") % 150).alias("device"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, c_custkey % 400)").alias("ts"), "c_custkey", F.lit(None).cast("struct<event_id:bigint,value:double>").alias("e"), F.lit(1).alias("side"))
    e = load(spark, sf, "events").select(F.col("user_id").alias("device"), "ts", F.lit(None).cast("bigint").alias("c_custkey"), F.struct("event_id", "value").alias("e"), F.lit(0).alias("side"))
    w = W.partitionBy("device").orderBy("ts", "side").rowsBetween(W.unboundedPreceding, 0)
    return q.unionByName(e).withColumn("e", F.last("e", ignorenulls=True).over(w)).where("side = 1").select("c_custkey", "e.event_id", "e.value")


# ---- production rules ------------------------------------------------------------


@query("prd01_snapshot_diff", "with b as (select o_orderkey as path, o_totalprice as mtime from orders where o_orderkey % 3 <> 0), a as (select o_orderkey as path, case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end as mtime from orders) select a.path, b.path is null as is_new from a left join b using (path) where b.path is null or a.mtime > b.mtime")
def prd01(spark, sf):
    """Files that are new, or newer than before."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("mtime"))
    before = o.where("path % 3 <> 0").select("path", F.col("mtime").alias("old"))
    after = o.withColumn("mtime", F.when(F.col("path") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return after.join(before, "path", "left").where("old is null or mtime > old").select("path", F.col("old").isNull().alias("is_new"))


@query("prd02_roi_precedence", f"with {CANDIDATES} select pose_id, seq, case when gate then 'contour_board' when depth_valid > 0.5 then 'contour_fallback' when inlier > 0.8 then 'hybrid' when residual < 1 then 'rgb_seeded' else 'failed' end as roi from cand")
def prd02(spark, sf):
    return candidates(spark, sf).select("pose_id", "seq", F.coalesce(F.when(F.col("gate"), "contour_board"), F.when(F.col("depth_valid") > 0.5, "contour_fallback"), F.when(F.col("inlier") > 0.8, "hybrid"), F.when(F.col("residual") < 1, "rgb_seeded"), F.lit("failed")).alias("roi"))


@query("prd03_rgb_fallback", f"with {CANDIDATES} select pose_id, seq, area > 0 and depth_valid >= 0.5 and seq % 6 <> 0 and area / 120000.0 <= 0.4 as accepted from cand")
def prd03(spark, sf):
    return candidates(spark, sf).select("pose_id", "seq", ((F.col("area") > 0) & (F.col("depth_valid") >= 0.5) & (F.col("seq") % 6 != 0) & (F.col("area") / 120000.0 <= 0.4)).alias("accepted"))


@query("prd04_classification", f"with {CANDIDATES} select pose_id, seq, case flag when 'A' then 'OK' when 'R' then 'NG' end as judgement, flag not in ('A', 'R') as input_error from cand")
def prd04(spark, sf):
    return candidates(spark, sf).select("pose_id", "seq", F.when(F.col("flag") == "A", "OK").when(F.col("flag") == "R", "NG").alias("judgement"), (~F.col("flag").isin("A", "R")).alias("input_error"))


@query("prd05_plane_outcome", f"with {CANDIDATES}, b as (select *, coalesce(bool_or(flag = 'R' and residual > 1.5) over (partition by pose_id order by seq rows between unbounded preceding and 1 preceding), false) as aborted from cand) select pose_id, seq, case when flag = 'R' then 'FAILED' else 'COMPLETE' end as status, case when flag = 'R' then 'RECHECK' else 'OK' end as judgement from b where not aborted")
def prd05(spark, sf):
    """A recoverable failure asks for a recheck; a fatal one ends its run."""
    fatal = (F.col("flag") == "R") & (F.col("residual") > 1.5)
    w = W.partitionBy("pose_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    c = candidates(spark, sf).withColumn("aborted", F.coalesce(F.bool_or(fatal).over(w), F.lit(False))).where("not aborted")
    bad = F.col("flag") == "R"
    return c.select("pose_id", "seq", F.when(bad, "FAILED").otherwise("COMPLETE").alias("status"), F.when(bad, "RECHECK").otherwise("OK").alias("judgement"))


@query("prd06_derived_areas", f"with {CANDIDATES} select pose_id, seq, round(area / nullif(patches % 5, 0), 6) as ratio, trunc(depth_valid * area)::bigint as union_px from cand")
def prd06(spark, sf):
    return candidates(spark, sf).select("pose_id", "seq", F.round(F.try_divide("area", F.col("patches") % 5), 6).alias("ratio"), (F.col("depth_valid") * F.col("area")).cast("long").alias("union_px"))
