"""A corpus pipeline of five of the operators in ``lumenspan.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  Stages but the last return
the columns of docs, whatever others they hold beside doc_id, text, lang and
source.  Empty tables give empty tables.  Rows without text or letters go in the
first stage; rows with a NULL doc_id are documents of their own, and stay unless
another text's rows with an id are near duplicates of theirs; of ties in a group
the smallest id stays; rows that repeat id and text share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import decontamination, language_id, mixing, ngram_join, token_ids
from lumenspan.llm.common import broadcast_small, documents, fold_of, materialize, table

#: Trained models and shuffles have no SQL; tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found, with it as ``lang``; those
    without text or letters go."""
    model = language_id.train(language_id.sample_runs(docs.where(fold_of(F.col("doc_id")) != 2)))
    out = language_id.identify(docs, model, keep=docs.columns).where(F.col("lang_pred") != language_id.UND)
    return out.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id;
    rows that repeat its id and text stay with it."""
    found = ngram_join.near_duplicates(docs)
    gone = found.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    gone = broadcast_small(materialize(gone, "gone"), F.lit(100))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    return rows.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (key == F.col("gone_key")), "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated mixture draws."""
    return mixing.mix(docs).where("keep").select("row.*")


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, and per document its place in them."""
    return token_ids.roundtrip(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
