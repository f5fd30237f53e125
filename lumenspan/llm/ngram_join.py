"""Exact Jaccard self-join of documents' word-shingle sets by signature trees.

1. One pass reads every text: a document's distinct 5-word shingles as 64-bit
   hashes give its set's size, digest and bitmap.  Equal sets become one.
2. Two sets of similarity 0.8 or more share one of their first
   n - ceil(0.8 n) + 1 shingles in any common order.  The order puts shingles
   of many documents last (frequent-items counting over all texts; a wrong
   count costs time, never a link), so shared passages seldom bring documents
   together.  Sets that share such a shingle form a block.
3. In each block signature trees are searched against each other: a node
   holds the OR of its sets' bitmaps, their size range and label; a pair of
   nodes is dropped when the largest possible overlap, or the sizes, or a
   common component rule links out, and only then opened further.
4. Pairs left over are checked on the texts.  A first round takes a spanning
   forest of each block, so that groups of copies collapse without all pairs;
   a second round takes every remaining pair between different components.
   Together they lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import bound_batches, broadcast_small, chunks, discard, lean, materialize, space_words
from lumenspan.llm.components import components

SHINGLE = 5
#: Similarity as a fraction: NUM / DEN.
NUM, DEN = 80, 100
#: Shingles counted at once, and the count in such a batch that is noted.
COUNT_BATCH, COUNT_LEAST = 3_000_000, 2
#: Frequent shingles that move to the end of the order (a broadcast of 6 MB at most).
HOT_LEAST, HOT_MOST = 8, 400_000
#: Members of a block; a larger one becomes blocks of pairs of its parts.
BLOCK_MOST = 8192
ALL_PAIRS, ORDERS, NEIGHBOURS = 96, 8, 2
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than five words
    the whole sequence is the only shingle; none without words."""
    words = [space_words(x) for x in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.zeros(0, np.uint64)] * len(texts)
    h = pd.util.hash_array(np.array(flat, dtype=object), hash_key=f"shingle-{seed:08d}", categorize=False)
    n = max(0, len(h) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        s = (s ^ h[j : j + n]) * _M[j]
        s ^= s >> np.uint64(32)
    s = _mix(s)
    out, at = [], 0
    for ws in words:
        size = len(ws)
        if size >= SHINGLE:
            out.append(np.unique(s[at : at + size - SHINGLE + 1]))
        elif size:
            x = np.array([size], np.uint64)
            for k in h[at : at + size]:
                x = _mix((x ^ k) * _M[1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed numbers."""
    a = _mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
    b = _mix(s ^ _M[2]).sum(dtype=np.uint64)
    return int(np.int64(_mix(np.array([a]))[0].astype(np.int64))), int(b.astype(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """One bit a shingle, in a power of two of at least 5 bits a shingle; half
    as wide a bitmap is the OR of the halves."""
    width = max(64, 1 << int(5 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def links_at_least(common: int, a: int, b: int) -> bool:
    return DEN * common >= NUM * (a + b - common)


def _profile(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, tkey, sid, check, n, bits) of each document; rows with n = -1
    hold a frequent shingle (sid) and its count (check)."""

    def run(batches):
        pool, held = [], 0

        def counted():
            t, c = np.unique(np.concatenate(pool), return_counts=True)
            t, c = t[c >= COUNT_LEAST].astype(np.int64), c[c >= COUNT_LEAST]
            k = len(t)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(t), pa.array(c.astype(np.int64)), pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.binary())], names=names)

        names = ["doc_id", "tkey", "sid", "check", "n", "bits"]
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, seed)
            marks = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())], names=names
            )
            pool += sets
            held += sum(map(len, sets))
            if held >= COUNT_BATCH:
                yield counted()
                pool, held = [], 0
        if pool:
            yield counted()

    return docs.mapInArrow(lean(run), "doc_id bigint, tkey string, sid bigint, check bigint, n int, bits binary")


def _prefixes(docs: DataFrame, hot, seed: int) -> DataFrame:
    """(token, sid, n) for the first shingles of each set in the common order."""

    def run(batches):
        tokens, counts = hot.value
        seen: set[int] = set()
        for _, texts in chunks(batches):
            out_t, out_s, out_n = [], [], []
            for s in shingle_sets(texts, seed):
                n = len(s)
                if n == 0 or (sid := digest(s)[0]) in seen:
                    continue
                seen.add(sid)
                p = n + (-NUM * n // DEN) + 1
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    often = np.where(tokens[at] == s, counts[at], 0)
                    if often.any():
                        s = s[np.lexsort((s, often))]
                out_t.append(s[:p])
                out_s.append(np.full(p, sid, np.int64))
                out_n.append(np.full(p, n, np.int32))
            if len(seen) > 500_000:
                seen.clear()
            if out_t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_t).astype(np.int64)), pa.array(np.concatenate(out_s)), pa.array(np.concatenate(out_n))], names=["token", "sid", "n"])

    return docs.mapInArrow(lean(run), "token bigint, sid bigint, n int")


def _runs(batches, columns: int) -> Iterator[list[np.ndarray]]:
    """Groups of equal first column from sorted batches: all groups that a
    batch completes come together, as column arrays."""
    rest = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        last = np.flatnonzero(cols[0] != cols[0][-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield [c[:cut] for c in cols]
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _blocks(batches):
    """Members of each block, (block, sid), from (token, sid, n) sorted by token
    and sid.  Sets that no other of the block resembles in size are left out.
    Blocks of the same members are given once a task; a block larger than
    BLOCK_MOST is dealt into parts, a block for each pair of parts."""
    seen: set[int] = set()
    for tok, sid, n in _runs(batches, 3):
        new = np.r_[True, (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])]
        tok, sid, n = tok[new], sid[new], n[new].astype(np.int64)
        order = np.lexsort((n, tok))
        near = (tok[order][1:] == tok[order][:-1]) & (DEN * n[order][:-1] >= NUM * n[order][1:])
        keep = np.zeros(len(tok), bool)
        keep[order] = np.r_[near, False] | np.r_[False, near]
        tok, sid = tok[keep], sid[keep]
        if not len(tok):
            continue
        edge = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        size = np.diff(np.r_[edge, len(tok)])
        ids, members = [], []
        for a, g in zip(edge[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            m = sid[a : a + g]
            key = int(_mix(_mix(m.view(np.uint64)).cumsum(dtype=np.uint64)[-1:] + np.uint64(g)).astype(np.int64)[0])
            if key in seen:
                continue
            seen.add(key)
            cuts = [m[i : i + BLOCK_MOST // 2] for i in range(0, g, BLOCK_MOST // 2)] if g > BLOCK_MOST else [m]
            for i in range(len(cuts)):
                for j in range(i + 1 if len(cuts) > 1 else i, len(cuts)):
                    both = [cuts[i]] if i == j else [cuts[i], cuts[j]]
                    ids.append(np.full(sum(map(len, both)), key + 1_000_003 * (i * len(cuts) + j) if len(cuts) > 1 else key, np.int64))
                    members += both
        if len(seen) > 500_000:
            seen.clear()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(members))], names=["block", "sid"])


class Tree:
    """Sets of similar size as leaves; each node above ORs four below."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, label: np.ndarray):
        spare = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, spare, label)]
        while len(size) > 1:
            cut = np.arange(0, len(size), 4)
            low, high, spare = np.minimum.reduceat(self.levels[-1][1], cut), np.maximum.reduceat(self.levels[-1][2], cut), np.maximum.reduceat(spare, cut)
            same = np.minimum.reduceat(label, cut) == np.maximum.reduceat(label, cut)
            bits, label, size = np.bitwise_or.reduceat(bits, cut, axis=0), np.where(same & (label[cut] != MIXED), label[cut], MIXED), low
            self.levels.append((bits, low, high, spare, label))


MIXED = np.iinfo(np.int64).min


def _fits(x, y, i, j) -> np.ndarray:
    """Which node pairs may hold a link between different labels."""
    (bx, lx, hx, sx, kx), (by, ly, hy, sy, ky) = x, y
    ok = (DEN * hx[i] >= NUM * ly[j]) & (DEN * hy[j] >= NUM * lx[i]) & ((kx[i] != ky[j]) | (kx[i] == MIXED))
    at = np.flatnonzero(ok)
    if len(at):
        a, b = i[at], j[at]
        most = np.bitwise_count(bx[a] & by[b]).sum(1, dtype=np.int64) + np.minimum(sx[a], sy[b])
        ok[at] = (DEN + NUM) * most >= NUM * (lx[a] + ly[b])
    return ok


def search(x: Tree, y: Tree, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs that the trees' dual traversal cannot rule out."""
    tx, ty = len(x.levels) - 1, len(y.levels) - 1
    stack = [(tx, ty, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        p, q, i, j = stack.pop()
        step = max(256, 4_000_000 // x.levels[0][0].shape[1] // 8)
        if len(i) > step:
            stack += [(p, q, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
            continue
        if itself:
            i, j = i[i <= j], j[i <= j]
        ok = _fits(x.levels[p], y.levels[q], i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if p == 0 and q == 0:
            if itself:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        if p >= q and p:
            kids = np.minimum(4, len(x.levels[p - 1][1]) - 4 * i)
            j2 = np.repeat(j, kids)
            i = np.repeat(4 * i, kids) + _count_up(kids)
            j, p = j2, p - 1
            if itself:  # both sides go down together
                kids = np.minimum(4, len(y.levels[q - 1][1]) - 4 * j)
                i2 = np.repeat(i, kids)
                j = np.repeat(4 * j, kids) + _count_up(kids)
                i, q = i2, q - 1
        else:
            kids = np.minimum(4, len(y.levels[q - 1][1]) - 4 * j)
            i2 = np.repeat(i, kids)
            j = np.repeat(4 * j, kids) + _count_up(kids)
            i, q = i2, q - 1
        stack.append((p, q, i, j))


def _count_up(kids: np.ndarray) -> np.ndarray:
    return np.arange(kids.sum()) - np.repeat(np.cumsum(kids) - kids, kids)


def _bands(n: np.ndarray, raw: list[bytes], label: np.ndarray):
    """Members by size: bands whose limits grow by 1.25, so that links stay
    within a band or its neighbours; bitmaps of a band have one width."""
    band = np.floor(np.log(n) / np.log(DEN / NUM) + 1e-9).astype(np.int64)
    for k in np.unique(band):
        at = np.flatnonzero(band == k)
        width = min(len(raw[i]) for i in at)
        bits = np.stack([_fold(np.frombuffer(raw[i], np.uint64), width // 8) for i in at])
        order = np.lexsort((bits[:, 0], label[at]))
        yield int(k), at[order], bits[order]


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    while len(x) > width:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def _fold_all(x: np.ndarray, width: int) -> np.ndarray:
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
    return x


def block_pairs(n: np.ndarray, raw: list[bytes], label: np.ndarray, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block's members to be checked: all that may link, or for
    ``forest`` only between neighbours in a large band."""
    bands = {k: (at, bits) for k, at, bits in _bands(n, raw, label)}
    for k, (at, bits) in bands.items():
        if forest and len(at) > ALL_PAIRS:
            leaf = Tree(bits, n[at], label[at]).levels[0]
            i, j = _neighbours(bits)
            ok = _fits(leaf, leaf, i, j)
            yield at[i[ok]], at[j[ok]]
        else:
            tree = Tree(bits, n[at], label[at])
            for i, j in search(tree, tree, True):
                yield at[i], at[j]
        if k + 1 in bands:
            at2, bits2 = bands[k + 1]
            if forest and max(len(at), len(at2)) > ALL_PAIRS:
                i = np.concatenate([np.arange(len(at))] * NEIGHBOURS)
                j = (i * len(at2) // len(at) + np.repeat(np.arange(NEIGHBOURS), len(at))) % len(at2)
                width = min(bits.shape[1], bits2.shape[1])
                x, y = Tree(_fold_all(bits, width), n[at], label[at]).levels[0], Tree(_fold_all(bits2, width), n[at2], label[at2]).levels[0]
                ok = _fits(x, y, i, j)
                yield at[i[ok]], at2[j[ok]]
            else:
                width = min(bits.shape[1], bits2.shape[1])
                x, y = Tree(_fold_all(bits, width), n[at], label[at]), Tree(_fold_all(bits2, width), n[at2], label[at2])
                for i, j in search(x, y, False):
                    yield at[i], at2[j]


def _neighbours(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that lie side by side in several orders: similar sets share most
    words of their bitmaps, so an order by one word brings them together."""
    i, j = [], []
    for w in range(0, bits.shape[1], max(1, bits.shape[1] // ORDERS)):
        order = np.argsort(bits[:, w], kind="stable")
        for d in range(1, NEIGHBOURS + 1):
            i.append(order[:-d])
            j.append(order[d:])
    return np.concatenate(i), np.concatenate(j)


def _alike(raw: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How alike the members of each pair look: common bits over their sizes."""
    out = np.empty(len(i))
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = np.frombuffer(raw[a], np.uint64), np.frombuffer(raw[b], np.uint64)
        width = min(len(x), len(y))
        out[k] = np.bitwise_count(_fold(x, width) & _fold(y, width)).sum() / (n[a] + n[b])
    return out


def _spanning(g: int, pairs, raw: list[bytes], n: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that prefers those that look most alike:
    they are the likeliest to be links."""
    parent = list(range(g))
    if not pairs:
        return
    i, j = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
    order = np.argsort(-_alike(raw, n, i, j), kind="stable") if len(i) > 1 else np.arange(len(i))
    pairs = [(i[order], j[order])]
    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = a, b
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[x] = y
                yield a, b


def _candidates(forest: bool):
    """Batches of (block, sid, n, bits, label) sorted by block to (a, b), and
    for ``forest`` to (NULL, NULL, block) of the blocks that are not finished:
    those with large bands, or with pairs that the forest passed over."""

    def run(batches):
        for block, sid, n, bits, label in _runs(batches, 5):
            edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            out_a, out_b, again = [], [], []
            for a, e in zip(edge.tolist(), np.r_[edge[1:], len(block)].tolist(), strict=True):
                own, k = sid[a:e], label[a:e]
                if e - a < 2 or (k == k[0]).all():
                    continue
                sizes = n[a:e].astype(np.int64)
                raw = bits[a:e].tolist()
                pairs = list(block_pairs(sizes, raw, k, forest))
                if forest:
                    got = list(_spanning(e - a, pairs, raw, sizes))
                    if e - a > ALL_PAIRS or len(got) < sum(len(x) for x, _ in pairs):
                        again.append(block[a])
                    i, j = np.array([x for x, _ in got], np.int64), np.array([x for _, x in got], np.int64)
                else:
                    i, j = (np.concatenate([x[c] for x in pairs]) if pairs else np.zeros(0, np.int64) for c in (0, 1))
                if len(i):
                    out_a.append(np.minimum(own[i], own[j]))
                    out_b.append(np.maximum(own[i], own[j]))
            if out_a:
                ab = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[:, 0])), pa.array(np.ascontiguousarray(ab[:, 1])), pa.nulls(len(ab), pa.int64())], names=["a", "b", "again"])
            if again:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.int64()), pa.array(again, pa.int64())], names=["a", "b", "again"])

    return run


def _verify(seed: int):
    """Batches of (a, b, sid, text) sorted by pair to the pairs that link."""

    def run(batches):
        keep: dict[int, np.ndarray] = {}
        last = None
        for batch, texts in chunks(batches):
            out_a, out_b = [], []
            sets = shingle_sets(texts, seed)
            for a, b, sid, s in zip(*(batch.column(i).to_pylist() for i in range(3)), sets, strict=True):
                if last != (a, b):
                    keep, last = {}, (a, b)
                keep[sid] = s
                if len(keep) == 2:
                    x, y = keep.values()
                    if links_at_least(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                        out_a.append(a)
                        out_b.append(b)
                    keep = {}
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """The pairs whose texts link.  Texts travel only for the sets in pairs;
    their keys are broadcast if they are few, else joined by shuffles."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("sid"))
    wanted = materialize(ends.select("sid").distinct().join(sets.select("sid", "tkey"), "sid"), "wanted")
    texts = docs.select("tkey", "text").join(broadcast_small(wanted, F.lit(100)), "tkey").groupBy("sid").agg(F.first("text").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.join(texts, "sid").select("a", "b", "sid", "text").repartition(n, "a", "b").sortWithinPartitions("a", "b")
    return rows.mapInArrow(lean(_verify(seed)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id
    that links reach, its own included) and text_key (md5 of the text).

    Words are runs without white space, A-Z lowered.  NULL and empty texts and
    those without words have an empty set and link with nothing.  Rows with
    equal sets link, whatever their ids; rows that repeat a doc_id are rows of
    their own; a NULL doc_id is never the smallest unless all of a component's
    are NULL.  No length, group or number of partners is capped.  An empty
    table gives no row.  Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tkey", F.md5("text"))
    prof = materialize(_profile(src, seed), "profile")
    rows = prof.where("n >= 0")
    sets = rows.where("n > 0").groupBy("sid").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("n").alias("n"), F.min("tkey").alias("tkey"), F.first("bits").alias("bits"))
    sets = materialize(sets, "sets")
    if sets.where("lo <> hi").limit(1).count():  # two sets with one digest: hash anew
        return near_duplicates(docs, seed=seed + 1)
    often = prof.where("n = -1").groupBy("sid").agg(F.sum("check").alias("c")).where(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "sid").limit(HOT_MOST).toArrow()
    tokens = often.column("sid").to_numpy().astype(np.int64).astype(np.uint64)
    counts = often.column("c").to_numpy().astype(np.int64)
    order = np.argsort(tokens)
    hot = spark.sparkContext.broadcast((tokens[order], counts[order]))
    grouped = _prefixes(src, hot, seed).repartition(n, "token").sortWithinPartitions("token", "sid")
    members = materialize(grouped.mapInArrow(lean(_blocks), "block bigint, sid bigint").distinct(), "members")
    links, labels, tried, used = None, None, None, [sets, members]
    for forest in (True, False):
        own = members if labels is None else members.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
        own = own.withColumn("label", F.coalesce("label", "sid") if labels is not None else F.col("sid"))
        full = own.join(sets.select("sid", "n", "bits"), "sid")
        full = full.select("block", "sid", "n", "bits", "label").repartition(n, "block").sortWithinPartitions("block")
        found = full.mapInArrow(lean(_candidates(forest)), "a bigint, b bigint, again bigint").distinct()
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        found = materialize(found, "pairs")
        tried = pairs = found.where("a is not null").select("a", "b")
        if forest:
            left = found.where("again is not null").select(F.col("again").alias("block"))
            members = materialize(members.join(left, "block", "left_semi"), "unfinished")
            used.append(members)
        got = materialize(_checked(pairs, sets, src, seed), "checked")
        used += [found, got]
        links = got if links is None else links.union(got)
        labels = materialize(components(links), "labels")
    slim = materialize(rows.select("doc_id", "n", "sid", "tkey"), "documents")
    for table in (prof, *used):  # nothing reads them any more
        discard(table)
    out = slim.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = materialize(out.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least")), "least")  # a table, so that a large group's rows are split
    out = out.join(broadcast_small(least, F.lit(40)), "label", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.col("tkey").alias("text_key"))
