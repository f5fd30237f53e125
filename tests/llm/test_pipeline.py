"""The pipeline's stages: each takes the columns of documents, and its
decisions take effect."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize
from tests.llm.test_operators import brute_components, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    texts = [prose(rng, 60) for _ in range(120)]
    data = [(i, t) for i, t in enumerate(texts)] + [(200 + i, t) for i, t in enumerate(texts[:20])] + [(300, None), (301, "12 34"), (302, "")]
    data += [(400, texts[100] + " " + texts[0]), (401, prose(rng, 40))]
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 5}", len(t or "")) for i, t in data]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, dict(data)[401]), (2, prose(rng, 30))], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), name)
        if name != "token_ids":
            assert docs.columns == COLUMNS and docs.dtypes == before.dtypes
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    language, near, clean, mixed, ids = kept
    assert language == set(range(120)) | {200 + i for i in range(20)} | {400, 401}
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.doc_id in language]
    assert near == {c for _, _, c in brute_components(pairs)}
    assert clean == near - {401}
    assert mixed < clean and len(mixed) > 0.2 * len(clean)
    assert ids == mixed


def test_run_equals_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    total = got.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert total[0] == total[1]


def test_odd_rows_and_names(spark, sf_dir, tmp_path):
    """NULL ids, rows that repeat, ties, empty and very long texts, and columns
    that bear the names that stages use themselves."""
    rng = random.Random(13)
    a, b = prose(rng, 80), prose(rng, 80)
    data = [(None, a), (None, a), (5, a), (5, a), (5, b), (None, prose(rng, 30)), (7, None), (8, ""), (9, prose(rng, 60_000)), (10, b)]
    data += [(20 + i, prose(rng, 40)) for i in range(30)]
    rows = [(i, t, ["en", "de"][k % 2], None if k % 3 else "s", "k", "x", 1, True, "g") for k, (i, t) in enumerate(data)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _key string, text_key string, row int, keep boolean, gone_id string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), name)
        if name != "token_ids":
            assert docs.dtypes == before.dtypes
        kept[name] = sorted(((r.doc_id, getattr(r, "text", None)) for r in docs.collect()), key=repr)
    assert len(kept["language_id"]) == len(data) - 2
    near = kept["near_duplicates"]
    assert (None, a) not in near and near.count((5, a)) == 2 and (5, b) in near and (10, b) not in near and any(i == 9 for i, _ in near)
    assert len(kept["token_ids"]) == len(kept["mixing"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
