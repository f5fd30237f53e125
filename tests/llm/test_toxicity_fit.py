"""Toxicity learned from every labelled document, in shards."""

import numpy as np
from pyspark.sql import functions as F

from lumenspan.llm import queries, toxicity


def test_every_shard_teaches_whatever_the_partitions(spark):
    # the words of class 1 differ from shard to shard, so each must be read
    rows = [(i, " ".join(["table", "river", "window", f"vile{i % 8}" if i % 2 else f"kind{i % 8}", "garden"]), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1)], "doc_id bigint, toxic int")
    net = toxicity.fit(docs, labels, shard_docs=60)
    got = toxicity.score(docs, net).toPandas()
    assert ((got["predicted"] == 1) == (got["doc_id"] % 2 == 1)).mean() > 0.98
    again = toxicity.score(docs, toxicity.fit(docs.union(docs).repartition(7), labels, shard_docs=60)).toPandas()
    assert got.sort_values("doc_id")["score"].tolist() == again.sort_values("doc_id")["score"].tolist()


def test_query_takes_no_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "sample", None)
    assert queries.op4_toxicity(spark, "/root/testdata/sf0.001").where(F.col("score").isNull()).count() == 0


def test_fit_without_labels(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, lang string")
    net = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert net.by_lang == {} and toxicity.score(docs, net).count() == 1


def test_pooling_gathers_each_width_once_and_stays_in_a_text():
    large = []

    class Parts(np.ndarray):
        def __getitem__(self, at):
            large.extend(x for x in (at if isinstance(at, tuple) else (at,)) if isinstance(x, np.ndarray) and len(x) > 100)
            return super().__getitem__(at)

    draw, net = np.random.default_rng(3), toxicity.Network()
    length = np.array([0, 1, 2, 90, 0, 3, 104])
    ids, parts = draw.integers(0, 50, length.sum()), draw.normal(0, 1, (50, 48)).astype(np.float32)
    best = net.pooled(parts.view(Parts), ids, length)[0]
    assert len(large) == len(toxicity.WIDTHS)
    for d, hi in enumerate(np.cumsum(length).tolist()):
        own, at = ids[hi - length[d] : hi], 0
        for n, k in enumerate(toxicity.WIDTHS):
            z = [sum(parts[own[i + j], (at + j) * 8 : (at + j + 1) * 8] for j in range(k) if i + j < len(own)) for i in range(len(own))]
            np.testing.assert_allclose(best[d, n * 8 : (n + 1) * 8], np.maximum(np.max(z, axis=0), 0) if z else np.zeros(8), rtol=1e-5)
            at += k
