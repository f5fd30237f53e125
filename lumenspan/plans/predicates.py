"""Projections, filters and validation gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.functions import gates as G
from lumenspan.plans.proxies import CANDIDATES, FRAMES, MANIFEST, candidates, frames, load, manifest
from lumenspan.registry import query


@query("flt01_manifest_rows", f"""with {MANIFEST} select path, split, label, string_split(path, '/')[-2] as session, case when split in ('train', 'val') and has_regions then '/regions/' || string_split(path, '/')[-2] || '/' || regexp_extract(path, '([^/]+)\\.PNG$', 1) || '.json' else '' end as regions from man""")
def flt01(spark, sf):
    """Session is the parent folder; regions only for train and val where a file exists."""
    m = manifest(spark, sf)
    session = F.element_at(F.split("path", "/"), -2)
    region = F.concat(F.lit("/regions/"), session, F.lit("/"), F.regexp_extract("path", r"([^/]+)\.PNG$", 1), F.lit(".json"))
    return m.select("path", "split", "label", session.alias("session"), F.when(F.col("split").isin("train", "val") & F.col("has_regions"), region).otherwise("").alias("regions"))


@query("flt02_label_split_constraint", f"with {MANIFEST} select path, split, label from man where (split in ('train', 'val') and label <> 'normal') or (split = 'test' and label not in ('normal', 'defect')) or split not in ('train', 'val', 'test')")
def flt02(spark, sf):
    bad = (F.col("split").isin("train", "val") & (F.col("label") != "normal")) | ((F.col("split") == "test") & ~F.col("label").isin("normal", "defect")) | ~F.col("split").isin("train", "val", "test")
    return manifest(spark, sf).where(bad).select("path", "split", "label")


@query("flt03_manifest_pair", f"with {MANIFEST} select count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split in ('train', 'val') and label <> 'normal') as wrong, (select count(*) from (select path from man where split = 'train' intersect select path from man where split = 'val')) as shared from man")
def flt03(spark, sf):
    m = manifest(spark, sf)
    shared = m.where("split = 'train'").select("path").intersect(m.where("split = 'val'").select("path")).agg(F.count("*").alias("shared"))
    one = m.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split").isin("train", "val") & (F.col("label") != "normal")).alias("wrong"))
    return one.crossJoin(shared)


@query("flt04_depth_validity", f"with {FRAMES} select event_id from frames where depth > 0 and depth between 5 and 400")
def flt04(spark, sf):
    return frames(spark, sf).where(G.valid_depth(F.col("depth"), 5, 400)).select("event_id")


_GATES = "list_filter([case when depth_valid < 0.2 then 'depth_valid_ratio' end, case when 1 - depth_valid > 0.9 then 'invalid_depth' end, case when residual > 1.5 then 'rgb_saturation' end, case when inlier < 0.6 then 'rgb_sharpness' end], lambda x: x is not null)"


@query("flt05_quality_gates", f"with {CANDIDATES} select pose_id, seq, array_to_string({_GATES}, ';') as reasons, len({_GATES}) = 0 as accepted from cand")
def flt05(spark, sf):
    """Optional thresholds in fixed order; one that is not set never rejects."""
    limits = {"min_depth_valid_ratio": 0.2, "max_invalid_ratio": 0.9, "max_saturation_ratio": 1.5, "max_dark_ratio": None, "min_sharpness": 0.6}
    v, r, i = F.col("depth_valid"), F.col("residual"), F.col("inlier")
    checks = [("min_depth_valid_ratio", v, "depth_valid_ratio", -1), ("max_invalid_ratio", 1 - v, "invalid_depth", 1), ("max_saturation_ratio", r, "rgb_saturation", 1), ("max_dark_ratio", r, "rgb_dark", 1), ("min_sharpness", i, "rgb_sharpness", -1)]
    got = G.reasons([(x < limits[k] if s < 0 else x > limits[k], t) for k, x, t, s in checks if limits[k] is not None])
    return candidates(spark, sf).select("pose_id", "seq", F.array_join(got, ";").alias("reasons"), (F.size(got) == 0).alias("accepted"))


_READY = """list_filter([case when depth_valid < 0.25 then 'Depth valid low (' || printf('%.1f', round_even(depth_valid * 100, 1)) || '% < 25%)' end, case when inlier < 0.6 then 'Plane inlier low (' || printf('%.1f', round_even(inlier * 100, 1)) || '% < 60%)' end,
  case when residual > 1.5 then 'Plane residual high (' || printf('%.2f', round_even(residual, 2)) || ' mm > 1.5 mm)' end, case when area % 7 = 0 then 'Object surface not found' end, case when area % 5 = 0 then 'Surface-only mask not found' end {patch}, case when seq % 6 = 0 then 'Object too close to image edge / FOV' end], lambda x: x is not null)"""
_R = _READY.format(patch=", case when patches < 20 then 'Too few valid patches (' || patches || ' < 20)' end")


def _ready(min_patches):
    c = F.col
    return G.readiness(c("depth_valid"), c("inlier"), c("residual"), c("area") % 7, c("area") % 5, c("patches"), c("seq") % 6 == 0, min_inlier=0.6, max_residual=1.5, min_patches=min_patches)


@query("flt06_readiness", f"with {CANDIDATES} select pose_id, seq, array_to_string({_R}, '; ') as reasons, len({_R}) = 0 as ready from cand")
def flt06(spark, sf):
    got = _ready(20)
    return candidates(spark, sf).select("pose_id", "seq", F.array_join(got, "; ").alias("reasons"), (F.size(got) == 0).alias("ready"))


@query("flt07_geometry_readiness", f"with {CANDIDATES} select pose_id, seq, len({_READY.format(patch='')}) = 0 as ready from cand")
def flt07(spark, sf):
    """Readiness without the patch gate."""
    return candidates(spark, sf).select("pose_id", "seq", (F.size(_ready(None)) == 0).alias("ready"))


@query("flt08_edge_contact", "select o_custkey as mask, coalesce(min(u) <= 18 or min(v) <= 18 or max(u) >= 640 - 1 - 18 or max(v) >= 480 - 1 - 18, true) as touches from (select o_custkey, case when o_orderstatus = 'F' then 100 + o_orderkey % 530 end as u, case when o_orderstatus = 'F' then 100 + floor(o_totalprice)::bigint % 300 end as v from orders) group by all")
def flt08(spark, sf):
    f = F.col("o_orderstatus") == "F"
    p = load(spark, sf, "orders").select(F.col("o_custkey").alias("mask"), F.when(f, 100 + F.col("o_orderkey") % 530).alias("u"), F.when(f, 100 + F.floor("o_totalprice") % 300).alias("v"))
    return p.groupBy("mask").agg(G.touches_edge(F.min("u"), F.min("v"), F.max("u"), F.max("v"), 640, 480, 18).alias("touches"))


@query("flt09_axis_limits", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, (lo is null or l_quantity >= lo) and (hi is null or l_quantity <= hi) as allowed from (select *, case when l_returnflag <> 'A' then 10.0 end as lo, case when l_linestatus = 'O' then 40.0 end as hi from lineitem)")
def flt09(spark, sf):
    lo, hi = F.when(F.col("l_returnflag") != "A", 10.0), F.when(F.col("l_linestatus") == "O", 40.0)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.within(F.col("l_quantity"), lo, hi).alias("allowed"))


@query("flt10_execution_blockers", "select p_partkey as config, array_to_string(list_filter([case when p_size % 3 = 0 then 'candidates' end, case when p_type = 'ECONOMY' and p_size % 2 = 0 then 'quality_gate' end, case when p_type = 'SMALL' and p_retailprice < 950 then 'score_weights' end], lambda x: x is not null), ',') as missing from part")
def flt10(spark, sf):
    got = G.reasons([(F.col("p_size") % 3 == 0, "candidates"), ((F.col("p_type") == "ECONOMY") & (F.col("p_size") % 2 == 0), "quality_gate"), ((F.col("p_type") == "SMALL") & (F.col("p_retailprice") < 950), "score_weights")])
    return load(spark, sf, "part").select(F.col("p_partkey").alias("config"), F.array_join(got, ",").alias("missing"))


@query("flt11_z_config", f"""with {CANDIDATES}, s as (select pose_id, z, lag(z) over (partition by pose_id order by seq) as before from cand)
select pose_id, count(*) = count(distinct z) as is_unique, coalesce(bool_and(z > before), true) as ascending, max(z) <= 25 as in_range from s group by pose_id""")
def flt11(spark, sf):
    # one order gives each height the one before; a height that stands twice has
    # its like beside it in order of height
    pose, turn = W.partitionBy("pose_id"), ["l_linenumber", "l_partkey", "l_suppkey"]
    s = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pose_id"), *turn, (F.col("l_linenumber") + 16.0).alias("z"))
    s = s.select("pose_id", "z", F.lag("z").over(pose.orderBy(*turn)).alias("before"))
    s = s.withColumn("again", F.coalesce(F.col("z") == F.lag("z").over(pose.orderBy("z")), F.col("z").isNull()))
    return s.groupBy("pose_id").agg((~F.bool_or("again")).alias("is_unique"), F.coalesce(F.bool_and(F.col("z") > F.col("before")), F.lit(True)).alias("ascending"), (F.max("z") <= 25).alias("in_range"))


@query("flt12_quality_config", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount between 0 and 0.08 and l_tax between 0 and 1 and l_quantity between 0 and 255 and l_discount <= l_tax as ok from lineitem")
def flt12(spark, sf):
    ok = F.col("l_discount").between(0, 0.08) & F.col("l_tax").between(0, 1) & F.col("l_quantity").between(0, 255) & (F.col("l_discount") <= F.col("l_tax"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ok.alias("ok"))


_NAMES = ["scan_With_Floor.ply", "final_dc_mask_phase_1.ply", "object_only.ply", "OBJECT_AND_PLATFORM.ply", "segmented.ply"]


@query("flt13_cloud_type", f"""with n as (select page_id, ({_NAMES!r})[page_id % 5 + 1] as name from pages)
select page_id, name, case when lower(name) like '%with~_floor%' escape '~' then 'OBJECT_PLATFORM_FLOOR' when contains(lower(name), 'object+platform') or contains(lower(name), 'object_and_platform') then 'OBJECT_AND_PLATFORM' when contains(lower(name), 'object_only') or starts_with(lower(name), 'final_dc_mask_phase') then 'OBJECT_ONLY' else 'UNKNOWN' end as kind from n""")
def flt13(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 5 + 1).cast("int"))
    return load(spark, sf, "pages").select("page_id", name.alias("name"), G.cloud_type(name).alias("kind"))


@query("flt14_metric_eligible", "select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_totalprice >= 50000 and o_orderpriority not like '5%'")
def flt14(spark, sf):
    return load(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") >= 50000) & ~F.col("o_orderpriority").startswith("5")).select("o_orderkey")


@query("flt15_reachability", "select o_orderkey as pose, case when o_orderstatus = 'O' then 'UNCALIBRATED' when o_totalprice > 300000 then 'UNREACHABLE' else 'REACHABLE' end as status, case when o_orderstatus = 'O' then 'no calibration' when o_totalprice > 300000 then 'beyond limit' end as reason from orders")
def flt15(spark, sf):
    o, far = F.col("o_orderstatus") == "O", F.col("o_totalprice") > 300000
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("pose"), F.when(o, "UNCALIBRATED").when(far, "UNREACHABLE").otherwise("REACHABLE").alias("status"), F.when(o, "no calibration").when(far, "beyond limit").alias("reason"))


@query("flt16_clamp", "select c_custkey, greatest(-5000, least(5000, c_acctbal)) as applied, abs(c_acctbal) > 5000 as clamped from customer")
def flt16(spark, sf):
    from lumenspan.operators.geometry import clamp

    return load(spark, sf, "customer").select("c_custkey", clamp(F.col("c_acctbal"), 5000.0).alias("applied"), (F.abs("c_acctbal") > 5000).alias("clamped"))


@query("flt17_disc_raster", """with p as (select vec_id % 40 as u, vec_id // 40 % 30 as v, label from embeddings where label < 3), d as (select dx, dy from (select unnest(range(-2, 3)) as dx), (select unnest(range(-2, 3)) as dy) where dx * dx + dy * dy <= 4)
select label, count(distinct (u + dx, v + dy)) as pixels from p, d where u + dx between 0 and 39 and v + dy between 0 and 29 group by label""")
def flt17(spark, sf):
    """Points widened to discs, clipped to the frame, each pixel once."""
    disc = [(x, y) for x in range(-2, 3) for y in range(-2, 3) if x * x + y * y <= 4]
    offsets = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in disc])
    p = load(spark, sf, "embeddings").where("label < 3").select((F.col("vec_id") % 40).alias("u"), (F.floor(F.col("vec_id") / 40) % 30).alias("v"), "label", F.explode(offsets).alias("d"))
    p = p.select("label", (F.col("u") + F.col("d.dx")).alias("u"), (F.col("v") + F.col("d.dy")).alias("v")).where("u between 0 and 39 and v between 0 and 29")
    return p.groupBy("label").agg(F.countDistinct("u", "v").alias("pixels"))


@query("flt18_model_ready", "select p_partkey as model, p_retailprice between 900 and 1000 and p_size > 0 and p_size <= 40 as ready from part")
def flt18(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("model"), (F.col("p_retailprice").between(900, 1000) & (F.col("p_size") > 0) & (F.col("p_size") <= 40)).alias("ready"))


@query("flt19_finite_scores", "select label, bool_and(isfinite(embedding[1]::double)) and count(*) > 0 as finite from embeddings group by label")
def flt19(spark, sf):
    return load(spark, sf, "embeddings").groupBy("label").agg((F.bool_and(G.finite(F.col("embedding")[0].cast("double"))) & (F.count("*") > 0)).alias("finite"))


@query("flt20_path_containment", f"with {MANIFEST} select path, path = '/data/src1' or starts_with(path, '/data/src1/') as inside from man")
def flt20(spark, sf):
    return manifest(spark, sf).select("path", G.inside(F.col("path"), "/data/src1").alias("inside"))


@query("flt21_single_candidate", "select o_custkey as run, coalesce(max(o_orderkey) filter (o_orderpriority like '1%'), max(o_orderkey) filter (o_orderstatus = 'P'), case when count(*) = 1 then max(o_orderkey) end) as chosen from orders group by all")
def flt21(spark, sf):
    """An explicit choice, then the manifest's, then the only one there is."""
    top = lambda c: F.max(F.when(c, F.col("o_orderkey")))
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.coalesce(top(F.col("o_orderpriority").startswith("1")), top(F.col("o_orderstatus") == "P"), F.when(F.count("*") == 1, F.max("o_orderkey"))).alias("chosen"))


@query("flt22_preflight", "select o_orderkey, case when o_orderstatus = 'P' then 'SOURCE_INVALID' when o_orderpriority like '1%' then 'ENVIRONMENT_INVALID' when o_totalprice < 50000 then 'CALIBRATION_MISSING' else 'READY' end as status from orders")
def flt22(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "SOURCE_INVALID").when(F.col("o_orderpriority").startswith("1"), "ENVIRONMENT_INVALID").when(F.col("o_totalprice") < 50000, "CALIBRATION_MISSING").otherwise("READY").alias("status"))


_WORDS = ["1.5", "nan", "inf", "true", "-2e3", "x", ""]


@query("flt23_finite_number", f"with t as (select event_id, ({_WORDS!r})[event_id % 7 + 1] as s from events) select event_id, case when isfinite(try_cast(s as double)) and s <> 'true' then try_cast(s as double) end as number from t")
def flt23(spark, sf):
    """Numbers only: NaN, infinities and booleans are refused."""
    x = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % 7 + 1).cast("int")).try_cast("double")
    return load(spark, sf, "events").select("event_id", F.when(G.finite(x), x).alias("number"))


@query("flt24_tracking_guard", f"""with {FRAMES}, p as (select device, seq, depth, lag(depth) over (partition by device order by seq) as before, kind from frames)
select device, seq, before is null or (depth / before between 0.5 and case kind when 'purchase' then 1.2 else 2.0 end and least(depth, before) / greatest(depth, before) >= 0.3) as accepted from p""")
def flt24(spark, sf):
    """A mask may grow only so much, by confidence, and must overlap the last."""
    p = frames(spark, sf).withColumn("before", F.lag("depth").over(W.partitionBy("device").orderBy("seq")))
    ratio, overlap = F.try_divide("depth", "before"), F.try_divide(F.least("depth", "before"), F.greatest("depth", "before"))
    ok = ratio.between(0.5, 2.0) & (ratio <= F.when(F.col("kind") == "purchase", 1.2).otherwise(2.0)) & (overlap >= 0.3)
    from_nothing = (F.col("before") == 0) & F.col("depth").isNotNull()
    return p.select("device", "seq", F.when(F.col("before").isNull(), True).when(from_nothing, False).otherwise(ok).alias("accepted"))


@query("flt25_sensor_confidence", f"with {CANDIDATES} select pose_id, seq, case when depth_valid >= 0.7 and inlier >= 0.7 then 'HIGH' when depth_valid >= 0.4 then 'MEDIUM' else 'LOW' end as confidence from cand")
def flt25(spark, sf):
    return candidates(spark, sf).select("pose_id", "seq", F.when((F.col("depth_valid") >= 0.7) & (F.col("inlier") >= 0.7), "HIGH").when(F.col("depth_valid") >= 0.4, "MEDIUM").otherwise("LOW").alias("confidence"))


@query("flt26_roi_bounds", "select o_orderkey, o_orderkey % 700 >= 0 and o_orderkey % 700 + 50 <= 640 as ok from orders")
def flt26(spark, sf):
    x = F.col("o_orderkey") % 700
    return load(spark, sf, "orders").select("o_orderkey", ((x >= 0) & (x + 50 <= 640)).alias("ok"))
