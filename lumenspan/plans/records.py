"""Sources and sinks on the supplied tables: written, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.plans.proxies import CANDIDATES, MANIFEST, candidates, load, manifest
from lumenspan.registry import query
from lumenspan.session import scratch
from lumenspan.sources import files, sinks


@query("src03_first_occurrence", "select p_name, min(p_partkey) as pos from part group by p_name")
def src03(spark, sf):
    return files.first_occurrences(load(spark, sf, "part").select("p_name", F.col("p_partkey").alias("pos")), "p_name", "pos")


@query("src06_manifest_csv", f"with {MANIFEST} select path, split, label, session, material from man")
def src06(spark, sf):
    """The manifest written as CSV and read back (also SNK01)."""
    out = scratch(spark, "manifest")
    sinks.write_manifest(manifest(spark, sf), out)
    return files.manifest(spark, out).select("path", "split", "label", "session", "material")


@query("src07_manifest_split", f"with {MANIFEST} select path, label from man where split = 'val'")
def src07(spark, sf):
    return files.manifest_split(manifest(spark, sf), "val").select("path", "label")


@query("src08_manifest_paths", f"with {MANIFEST} select path from man where split = 'train'")
def src08(spark, sf):
    return files.manifest_paths(manifest(spark, sf), "train", "/project")


@query("src09_validation_entries", f"with {MANIFEST} select path, case when has_regions then 'r' end as regions from man where split = 'val' and label = 'normal'")
def src09(spark, sf):
    m = manifest(spark, sf).withColumn("regions", F.when(F.col("has_regions"), "r").otherwise(" "))
    return files.validation_entries(m, "/project")


@query("src10_validation_paths", f"with {MANIFEST} select path from man where split = 'val' and label = 'normal'")
def src10(spark, sf):
    return files.validation_entries(manifest(spark, sf), "/project").select("path")


@query("src11_ply_points", "select 'cloud_' || l_suppkey as path, l_quantity as x, l_linenumber::double as y, 500 + l_tax as z, l_linenumber as red from lineitem")
def src11(spark, sf):
    """Point clouds put together as text and parsed."""
    l = load(spark, sf, "lineitem").withColumn("row", F.concat_ws(" ", *[c.cast("string") for c in (F.col("l_quantity"), F.col("l_linenumber"), 500 + F.col("l_tax"), F.col("l_linenumber"), F.lit(0), F.lit(0))]))
    head = "ply\nformat ascii 1.0\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    a, b = head.split("{}")
    text = l.groupBy(F.concat(F.lit("cloud_"), F.col("l_suppkey").cast("string")).alias("path")).agg(F.concat(F.lit(a), F.count("*").cast("string"), F.lit(b), F.array_join(F.collect_list("row"), "\n")).alias("value"))
    return files.ply_from_text(text).select("path", "x", "y", "z", "red")


@query("src12_ply_headers", "select p_partkey::varchar as path, p_size % 2 = 0 as valid, p_size % 3 = 0 as has_color from part")
def src12(spark, sf):
    colour = F.when(F.col("p_size") % 3 == 0, "property uchar red\nproperty uchar green\nproperty uchar blue\n").otherwise("")
    text = F.concat(F.lit("ply\nformat ascii 1.0\nproperty float x\nproperty float y\n"), F.when(F.col("p_size") % 2 == 0, "property float z\n").otherwise(""), colour, F.lit("end_header\n"))
    return files.ply_headers(load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("value"))).select("path", "valid", "has_color")


@query("src13_pose_json", "select o_custkey as plan, count(*) as planes, max_by(o_orderkey, (round(o_totalprice)::bigint, -o_orderkey)) as dominant from orders group by all")
def src13(spark, sf):
    """Plans as JSON, parsed; the plane with most points, ties to the first."""
    plane = F.struct(F.col("o_orderkey").cast("string").alias("plane_name"), F.lit(False).alias("dominant"), F.round("o_totalprice").cast("int").alias("points_count"), F.lit(1.0).alias("roll_deg"), F.lit(2.0).alias("pitch_deg"))
    doc = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("plan")).agg(F.to_json(F.struct(F.lit("1").alias("schema_version"), F.lit("a.ply").alias("input_ply"), F.collect_list(plane).alias("planes"))).alias("doc"))
    p = doc.select("plan", F.explode(files.poses(F.col("doc"))["planes"]).alias("p"))
    return p.groupBy("plan").agg(F.count("*").alias("planes"), F.max_by(F.col("p.plane_name").cast("long"), F.struct(F.col("p.points_count"), -F.col("p.plane_name").cast("long"))).alias("dominant"))


@query("src14_intrinsics", "select p_partkey, case when p_size > 5 then p_size * 10.0::double end as fx, case when p_size > 5 then 320.0::double end as cx from part")
def src14(spark, sf):
    v = F.concat(F.lit('{"fx":'), F.when(F.col("p_size") > 5, F.col("p_size") * 10).otherwise(-1).cast("string"), F.lit(',"fy":500,"cx":320,"cy":240}'))
    doc = F.when(F.col("p_partkey") % 2 == 0, v).otherwise(F.concat(F.lit('{"color_intrinsics":'), v, F.lit("}")))
    return load(spark, sf, "part").select("p_partkey", files.intrinsics(doc).alias("i")).select("p_partkey", "i.fx", "i.cx")


@query("src15_axis_contract", "select p_partkey, p_size % 2 = 0 as verified, case when p_size % 2 = 0 then -1 else 1 end as roll_sign from part")
def src15(spark, sf):
    doc = F.when(F.col("p_size") % 2 == 0, '{"verified":true,"roll_sign":-1}')
    return load(spark, sf, "part").select("p_partkey", files.axis_contract(doc).alias("a")).select("p_partkey", "a.*")


@query("src17_region_json", "select p_partkey, p_size as x1, p_size + 64 as x2 from part")
def src17(spark, sf):
    doc = F.concat(F.lit('{"regions":[{"x1":'), F.col("p_size").cast("string"), F.lit(',"y1":0,"x2":'), (F.col("p_size") + 64).cast("string"), F.lit(',"y2":64}]}'))
    return load(spark, sf, "part").select("p_partkey", F.explode(files.regions(doc)).alias("r")).select("p_partkey", "r.x1", "r.x2")


@query("src19_run_results", f"with {CANDIDATES} select pose_id, seq, coalesce(case when gate then 'OK' end, 'RECHECK') as judgement from cand")
def src19(spark, sf):
    """Cycle results as nested JSON, one view a plane."""
    plane = F.struct("seq", F.when(F.col("gate"), "OK").alias("judgement"))
    doc = candidates(spark, sf).groupBy("pose_id").agg(F.to_json(F.struct(F.collect_list(plane).alias("inspection_planes"))).alias("doc"))
    p = doc.select("pose_id", F.explode(F.from_json("doc", "inspection_planes array<struct<seq:bigint,judgement:string>>")["inspection_planes"]).alias("p"))
    return p.select("pose_id", "p.seq", F.coalesce("p.judgement", F.lit("RECHECK")).alias("judgement"))


@query("src25_depth_units", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 0.25, 6) as mm from lineitem")
def src25(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 0.25, 6).alias("mm"))


@query("src28_latest_file", "select o_custkey as run, max_by(o_orderkey::varchar, (o_orderdate, o_orderkey::varchar)) as path from orders group by all")
def src28(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return files.latest(o, "run")


@query("snk05_score_csv", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax as mean, (l_tax > 0.05)::int as mean_is_anomaly from lineitem")
def snk05(spark, sf):
    out = scratch(spark, "scores")
    sinks.write_scores(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_tax").alias("mean")), out, {"mean": 0.05})
    return spark.read.csv(out, header=True, schema="l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, mean double, mean_is_anomaly int")


@query("snk06_append_log", "select c_custkey, c_acctbal from customer")
def snk06(spark, sf):
    """Two appends, one log."""
    out, c = scratch(spark, "log"), load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    for part in (0, 1):
        sinks.append_log(c.where(F.col("c_custkey") % 2 == part), out)
    return spark.read.csv(out, header=True, schema="c_custkey bigint, c_acctbal double")


@query("snk10_sweep_csv", "select p_partkey, printf('%.3f', p_retailprice) as price from part")
def snk10(spark, sf):
    out = scratch(spark, "sweep")
    sinks.write_sweep(load(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price")), out, ["price"], 3)
    return spark.read.csv(out, header=True, schema="p_partkey bigint, price string")


@query("snk11_result_json", "select c_custkey, c_name, c_acctbal from customer")
def snk11(spark, sf):
    out = scratch(spark, "results")
    sinks.write_json(load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), out)
    return spark.read.text(out).select(F.from_json("value", "c_custkey bigint, c_name string, c_acctbal double").alias("r")).select("r.*")


@query("snk14_candidate_artifacts", f"with {CANDIDATES} select z, count(*) as n, sum(area)::bigint as area from cand group by z")
def snk14(spark, sf):
    """A folder for each height; readers of one height skip the others."""
    out = scratch(spark, "artifacts")
    sinks.write_artifacts(candidates(spark, sf).select("z", "pose_id", "area"), out, "z")
    return spark.read.schema("pose_id bigint, area bigint, z double").parquet(out).groupBy("z").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
