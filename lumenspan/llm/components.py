"""Connected components of a table of undirected links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import discard, lean, materialize

#: Up to so many links (a count made first) one task joins them; beyond, the
#: links shrink to stars by joins that are spread over the cluster.
ONE_TASK_LINKS = 200_000


def components(links: DataFrame, *, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b: bigint); label is the
    smallest node of its component.  Loops and repeated links are harmless;
    an empty table gives no row."""
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    if links.count() <= one_task:
        return links.coalesce(1).mapInArrow(lean(_union_find), "node bigint, label bigint")
    return _stars(links)


def _union_find(batches):
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    a, b = (np.concatenate(x) for x in zip(*got, strict=True))
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(inverse[:n].tolist(), inverse[n:].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for i in range(len(parent)):  # a parent is never larger: one pass in order
        parent[i] = parent[parent[i]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[parent])], names=["node", "label"])


def _stars(links: DataFrame) -> DataFrame:
    """Alternating large-star and small-star steps until nothing changes."""

    def star(pairs: DataFrame, keep) -> DataFrame:
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return pairs.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    known = state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, F.col("b") > F.col("a")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        hub = down.groupBy("a").agg(F.min("b").alias("b"))
        small = star(down, F.lit(True)).union(hub).where("a <> b").distinct()
        nxt = materialize(small, "stars")
        now = state(nxt)
        discard(links)
        links = nxt
        if now == known:
            break
        known = now
    leaves = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return leaves.union(leaves.select("label", "label").distinct())
