"""Stand-ins for inspection data on the supplied tables, as DataFrames and as
SQL common table expressions: the shape and rules are an inspection's, the
values are the tables'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z candidates: an order is a pose, its lines are candidates in turn."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pose_id"),
        F.row_number().over(w).cast("long").alias("seq"),
        (F.col("l_linenumber") + 16.0).alias("z"),
        (F.col("l_quantity") / 50.0).alias("depth_valid"),
        (1.0 - 5.0 * F.col("l_discount")).alias("inlier"),
        (25.0 * F.col("l_tax")).alias("residual"),
        F.floor("l_extendedprice").cast("long").alias("area"),
        (F.col("l_returnflag") != "R").alias("gate"),
        F.col("l_quantity").cast("long").alias("patches"),
        F.col("l_returnflag").alias("flag"),
    )


CANDIDATES = """cand as (select l_orderkey as pose_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq,
  l_linenumber + 16.0::double as z, l_quantity / 50.0 as depth_valid, 1.0 - 5.0::double * l_discount as inlier, 25.0::double * l_tax as residual,
  floor(l_extendedprice)::bigint as area, l_returnflag <> 'R' as gate, l_quantity::bigint as patches, l_returnflag as flag from lineitem)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry and depth of a device: a user's events in order of time."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"), F.row_number().over(w).cast("long").alias("seq"), "event_id", "ts", F.col("value").alias("depth"), (F.col("event_type") != "error").alias("stable"), F.col("event_type").alias("kind")
    )


FRAMES = """frames as (select user_id as device, row_number() over (partition by user_id order by ts, event_id) as seq, event_id, ts,
  value as depth, event_type <> 'error' as stable, event_type as kind from events)"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches: squared distance of each component from its label's mean."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(64)]).alias("c"))
    return e.join(mean, "label").select("vec_id", "label", F.zip_with("v", "c", lambda x, c: (x - c) * (x - c)).alias("residual"))


RESIDUALS = """ev as (select vec_id, label, i, embedding[i]::double as v from embeddings, (select unnest(range(1, 65)) as i)),
mean as (select label, i, avg(v) as c from ev group by all),
res as (select vec_id, label, list((v - c) * (v - c) order by i) as residual from ev join mean using (label, i) group by all)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows: documents as images, their source as session."""
    d = load(spark, sf_dir, "documents")
    l = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    path = F.concat(F.lit("/data/"), "source", F.lit("/img_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".PNG"))
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "val").otherwise("test")
    label = F.when((F.col("quality") == 0) & (F.col("doc_id") % 10 >= 8), "defect").otherwise("normal")
    return d.join(l, "doc_id", "left").select("doc_id", path.alias("path"), split.alias("split"), label.alias("label"), F.col("source").alias("session"), F.col("lang").alias("material"), F.col("quality").isNotNull().alias("has_regions"))


MANIFEST = """man as (select doc_id, '/data/' || source || '/img_' || lpad(doc_id::varchar, 6, '0') || '.PNG' as path,
  case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'val' else 'test' end as split,
  case when quality = 0 and doc_id % 10 >= 8 then 'defect' else 'normal' end as label, source as session, lang as material, quality is not null as has_regions
  from documents left join (select doc_id, max(quality) as quality from labels group by doc_id) using (doc_id))"""
