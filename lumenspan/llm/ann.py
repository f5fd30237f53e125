"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample, with more leaves the more vectors
there are; every vector is then filed under one leaf of each tree.  A query
opens leaves of all trees in the order of one shared priority queue, by how far
it lies beyond the splits in the way.  How far it goes is found on the sample:
the queue distance within which ``GOAL`` of the true neighbours lie there.  Data
with structure are searched in a few leaves, data without any in many.  Leaves
are packed into buckets by the vectors that they hold, a fat leaf in parts; a
bucket's task holds its vectors, streams the queries that open its leaves, and
reranks exactly.  Only the best of each query and bucket leave the task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.llm.common import lean, materialize, unit_hash

#: Vectors that the trees are fitted on: one of ``SAMPLE_OF``, but at least and
#: at most so many; trees; vectors of a leaf, about.
SAMPLE, SAMPLE_MOST, SAMPLE_OF = 20_000, 200_000, 50
TREES, LEAF = 4, 400
#: Share of the sample's true neighbours that the queue distance must reach, and
#: queries that it is found with; distinct candidates that a query meets in any
#: case, or all there are.
GOAL, TRIALS, LEAST = 0.97, 400, 2000
#: Vectors of a bucket at most, about.
BUCKET = 100_000


class Forest:
    """Balanced trees: node i has children 2i + 1 and 2i + 2; leaves follow."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaves: int = 128, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.log2(leaves)))
        self.leaves = 1 << self.depth
        dim = sample.shape[1]
        self.normal = np.zeros((trees, self.leaves - 1, dim))
        self.offset = np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for k in range(self.leaves - 1):
                at = held.pop(k)
                best = (-1.0, None, None)
                for _ in range(3):
                    w = sample[at[rng.integers(len(at))]] - sample[at[rng.integers(len(at))]] if len(at) > 1 else rng.normal(size=dim)
                    size = np.linalg.norm(w)
                    w = w / size if size > 0 else rng.normal(size=dim) / np.sqrt(dim)
                    p = sample[at] @ w
                    spread = float(p.var()) if len(p) else 0.0
                    if spread > best[0]:
                        best = (spread, w, p)
                _, w, p = best
                self.normal[t, k], self.offset[t, k] = w, np.median(p) if len(p) else 0.0
                left = p <= self.offset[t, k]
                held[2 * k + 1], held[2 * k + 2] = at[left], at[~left]

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered across the forest."""
        out = np.empty((len(x), len(self.normal)), np.int64)
        for t, (w, b) in enumerate(zip(self.normal, self.offset, strict=True)):
            right = x @ w.T > b
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + right[np.arange(len(x)), node]
            out[:, t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Queue distance of every leaf from each vector: the squared distances
        beyond the splits on the way, summed."""
        out = np.zeros((len(x), len(self.normal), 1))
        for d in range(self.depth):
            row = slice((1 << d) - 1, (2 << d) - 1)
            far = np.einsum("tkd,nd->ntk", self.normal[:, row], x) - self.offset[:, row]
            cost = far * far
            out = np.stack([out + np.where(far > 0, cost, 0), out + np.where(far > 0, 0, cost)], axis=3).reshape(len(x), len(self.normal), -1)
        return out.reshape(len(x), -1)

    def reach(self, sample: np.ndarray, k: int, goal: float, trials: int = TRIALS, seed: int = 3) -> float:
        """The queue distance within which ``goal`` of the ``k`` nearest of the
        sample's vectors lie, in the tree that finds each first."""
        pick = np.random.default_rng(seed).permutation(len(sample))[:trials]
        leaf, found = self.file(sample), []
        for lo in range(0, len(pick), 20):
            own = pick[lo : lo + 20]
            near = sample[own] @ sample.T
            near[np.arange(len(own)), own] = -np.inf
            top = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k]
            key = self.keys(sample[own])
            found.append(np.take_along_axis(key, leaf[top].reshape(len(own), -1), 1).reshape(len(own), top.shape[1], -1).min(2).ravel())
        return float(np.quantile(np.concatenate(found), goal)) if found else 0.0

    def open(self, x: np.ndarray, reach: float, held: list[int], least: int) -> list[int]:
        """The leaves of the shared queue that hold vectors, up to a distance
        of ``reach``, and beyond until one tree alone has met ``least``
        vectors; ``held`` is the number of vectors in each leaf."""
        far = np.einsum("tkd,d->tk", self.normal, x) - self.offset
        cost, side = (far * far).tolist(), (far > 0).tolist()
        queue = [(0.0, t, 0) for t in range(len(self.normal))]
        out: list[int] = []
        inner = self.leaves - 1
        met, most = [0] * len(self.normal), 0
        while queue and (queue[0][0] <= reach or most < least):
            d, t, k = heapq.heappop(queue)
            c, s = cost[t], side[t]
            while k < inner:
                near = 2 * k + 1 + s[k]
                heapq.heappush(queue, (d + c[k], t, 4 * k + 3 - near))
                k = near
            leaf = k - inner + t * self.leaves
            if held[leaf]:
                out.append(leaf)
                met[t] += held[leaf]
                most = max(most, met[t])
        return out


def pack(held: list[int], buckets: int, most: int = BUCKET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves as units of ``most`` vectors at most, dealt to buckets so that
    these hold about the same: a leaf's parts, its first unit, and the bucket
    of each unit."""
    held = np.asarray(held, np.int64)
    parts = np.maximum(1, -(-held // most))
    first = np.cumsum(parts) - parts
    size = np.repeat(held / parts, parts)
    load = [(0.0, b) for b in range(buckets)]
    out = np.empty(len(size), np.int32)
    for u in np.argsort(-size, kind="stable").tolist():
        x, b = heapq.heappop(load)
        out[u] = b
        heapq.heappush(load, (x + size[u], b))
    return parts, first, out


def _vectors(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(good)


def _as_matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def nearest(table: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding", trees: int = TREES, goal: float = GOAL, sample: int | None = None, leaf: int = LEAF, bucket: int = BUCKET, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every`` the ``k`` rows of largest inner product found, ties to the
    smaller id.

    Vectors that are NULL, empty, zero, or hold NULL, NaN or infinite
    components take no part, nor do NULL ids and vectors of another length
    than most.  A row whose id is the query's is its own and no candidate; an
    id that repeats is listed once, with its best score.  Of equal vectors only
    the k + 1 smallest ids can be among anyone's first k, so the others need
    no place in the index.  Only fewer candidates than k in the table give
    fewer rows; up to ``LEAST`` distinct vectors all are compared.  An empty
    table gives no row; other columns are not read.
    """
    spark = table.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = _vectors(table, id_col, vector)
    widths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    dim, count = widths[0]["d"], widths[0]["n"]
    rows = rows.where(F.size("v") == dim)
    sample = sample or min(SAMPLE_MOST, max(SAMPLE, count // SAMPLE_OF))
    # the hash takes the vector too, so that an id that repeats is no all-or-nothing
    picked = rows.where(unit_hash(F.col("vec_id"), F.col("v"), F.lit(seed)) < sample / count).select("v").limit(2 * sample).toArrow()
    base = _as_matrix(picked.column(0).combine_chunks(), dim) if picked.num_rows else np.zeros((1, dim))
    leaves = max(2, min(count // leaf, len(base) // 8))
    fitted = Forest(base, trees, 1 << (leaves - 1).bit_length(), seed)
    reach = fitted.reach(base, k, goal)
    forest = spark.sparkContext.broadcast(fitted)
    total = fitted.leaves * trees
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.withColumn("_r", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= k + 1).select("vec_id", "v").distinct()
    kept = materialize(kept, "vectors")

    def fill(batches):
        f, n = forest.value, np.zeros(total, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(f.file(_as_matrix(b.column(1), dim)).ravel(), minlength=total)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["leaf", "n"])

    held = [0] * total
    for r in kept.mapInArrow(lean(fill), "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        held[r["leaf"]] = r["n"]
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-sum(held) // bucket))
    dealt = spark.sparkContext.broadcast((held, *pack(held, buckets, bucket)))
    # an id has at most so many vectors in a tree, so ``least`` of them hold enough distinct ids
    often = kept.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    least = max(LEAST, 100 * k) * often

    def file(batches):
        f, (_, parts, first, bucket_of) = forest.value, dealt.value
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _as_matrix(b.column(1), dim)
            leaf = f.file(x)
            at = np.repeat(np.arange(b.num_rows), leaf.shape[1])
            flat = leaf.ravel()
            got = b.take(pa.array(at))
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32)), pa.array(flat.astype(np.int32)))
            mixed = pd.util.hash_array(x[:, 0]) ^ pd.util.hash_array(b.column(0).to_numpy())  # the same for a row wherever it is read
            unit = first[flat] + (mixed[at] % parts[flat].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of[unit]), pa.array(np.zeros(len(at), np.int32)), got.column(0), got.column(1), one], names=["bucket", "kind", "vec_id", "v", "leaf"])

    def ask(batches):
        f, (held, parts, first, bucket_of) = forest.value, dealt.value
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _as_matrix(b.column(1), dim)
            out_b, out_i, out_l = [], [], []
            for i in range(len(x)):
                leaf = np.array(sorted(f.open(x[i], reach, held, least)), np.int64)
                many = parts[leaf]
                leaf = np.repeat(leaf, many)
                own = bucket_of[first[leaf] + np.arange(len(leaf)) - np.repeat(np.cumsum(many) - many, many)]
                order = np.argsort(own, kind="stable")
                names, cut = np.unique(own[order], return_index=True)
                for name, part in zip(names.tolist(), np.split(leaf[order], cut[1:]), strict=True):
                    out_b.append(name)
                    out_i.append(i)
                    out_l.append(np.unique(part).tolist())
            got = b.take(pa.array(out_i, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(np.ones(len(out_i), np.int32)), got.column(0), got.column(1), pa.array(out_l, pa.list_(pa.int32()))], names=["bucket", "kind", "vec_id", "v", "leaf"])

    filed = "bucket int, kind int, vec_id bigint, v array<double>, leaf array<int>"
    both = kept.mapInArrow(lean(file), filed).union(rows.where(F.col("vec_id") % every == 0).mapInArrow(lean(ask), filed))
    both = both.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")

    def rerank(batches):
        now, ids, vecs, leaf, ready = None, [], [], [], {}
        for b in batches:
            bucket, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])]).tolist() + [len(bucket)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if bucket[lo] != now:
                    now, ids, vecs, leaf, ready = bucket[lo], [], [], [], {}
                part = b.slice(lo, hi - lo)
                x = _as_matrix(part.column(3), dim)
                if kind[lo] == 0:
                    ids.append(part.column(2).to_numpy())
                    vecs.append(x)
                    leaf.append(part.column(4).flatten().to_numpy())
                    continue
                if not ids:
                    continue
                if not ready:
                    all_ids, all_v, all_leaf = np.concatenate(ids), np.concatenate(vecs), np.concatenate(leaf)
                    order = np.argsort(all_leaf, kind="stable")
                    all_ids, all_v, all_leaf = all_ids[order], all_v[order], all_leaf[order]
                    names, first = np.unique(all_leaf, return_index=True)
                    ready = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(all_leaf)], strict=True), strict=True))
                out_q, out_v, out_s = [], [], []
                for q, own, opened in zip(x, part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True):
                    spans = [ready[z] for z in opened if z in ready]
                    if not spans:
                        continue
                    cand = np.concatenate([np.arange(a, e) for a, e in spans])
                    s = all_v[cand] @ q
                    room = 2 * k * trees + 1
                    while len(s) > room:  # repeated ids may fill the room
                        edge = np.partition(s, len(s) - room)[len(s) - room]
                        some = cand[s >= edge - 1e-9 * (1 + abs(edge))]
                        if len(np.unique(all_ids[some])) > k + 1:
                            cand = some
                            break
                        room *= 2
                    who = all_ids[cand]
                    exact = (all_v[cand] * q).sum(1)
                    order = np.lexsort((who, -exact))
                    seen: set[int] = {own}
                    for i in order.tolist():
                        if who[i] not in seen:
                            seen.add(int(who[i]))
                            out_q.append(own)
                            out_v.append(int(who[i]))
                            out_s.append(float(exact[i]))
                            if len(seen) > k:
                                break
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(lean(rerank), "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(table: DataFrame, *, k: int = 20, every: int = 20) -> DataFrame:
    """Brute force, for measuring recall on small tables."""
    rows = materialize(_vectors(table, "vec_id", "embedding"), "vectors")
    got = rows.toArrow()
    ids, v = got.column(0).to_numpy(), np.stack(got.column(1).to_numpy())
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = (v * v[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return table.sparkSession.createDataFrame(out, "query_id bigint, rank int, vec_id bigint, score double")
