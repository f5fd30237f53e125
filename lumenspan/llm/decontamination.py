"""Benchmark decontamination by winnowing.

The minimum hash of every window of consecutive word k-grams is a
fingerprint.  With window length ``span - k + 1`` each run of ``span`` words
selects the same fingerprint wherever it stands, so joining the fingerprints
of documents with those of benchmark items misses no shared run; each joined
position is extended both ways, and only runs of ``span`` equal words count.

An item of fewer than ``span`` words (but not none) is one window of its own
length: such items join on the hash of the whole window instead.

The benchmark is broadcast in blocks of bounded text (``block_bytes``); every
block is joined with all documents in a pass of its own, whose result is written
before the next block, so a task holds one block's index; documents are never
shuffled, whatever passage they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import alnum_words, bound_batches, chunks, discard, lean, materialize

SPAN, K = 13, 5
#: Text of the benchmark in one broadcast block, and rows at most.
BLOCK_BYTES, BLOCK_ITEMS = 32 << 20, 100_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (h[j : j + n] * _MULT[j % 5])) * _MULT[(j + 1) % 5]
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost minimum of each window; the global minimum of
    a shorter sequence."""
    if len(grams) == 0:
        return np.zeros(0, np.int64)
    if len(grams) < window:
        return np.array([int(np.argmin(grams))])
    n = len(grams) - window + 1
    least, off = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        less = grams[j : j + n] < least
        np.copyto(least, grams[j : j + n], where=less)
        off[less] = j
    chosen = np.zeros(len(grams), bool)
    chosen[off + np.arange(n)] = True
    return np.flatnonzero(chosen)


class Index:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]], span: int = SPAN, k: int = K):
        self.span, self.k, self.ids = span, k, []
        words, prints, owner, place = [], [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        self.short_words: list[np.ndarray] = []
        at = span
        words.append(np.zeros(span, np.uint64))
        for item_id, text in items:
            h = word_hashes(alnum_words(text))
            if len(h) == 0:
                continue
            no = len(self.ids)
            self.ids.append(item_id)
            if len(h) < span:
                self.short.setdefault(len(h), {}).setdefault(int(gram_hashes(h, len(h))[0]), []).append(no)
                self.short_words.append(h)
                continue
            self.short_words.append(h[:0])
            g = gram_hashes(h, k)
            p = winnow(g, span - k + 1)
            prints.append(g[p])
            owner.append(np.full(len(p), no))
            place.append(at + p)
            words += [h, np.zeros(span, np.uint64)]  # zeros part the items
            at += len(h) + span
        self.words = np.concatenate(words)
        order = np.argsort(np.concatenate(prints), kind="stable") if prints else []
        self.prints = np.concatenate(prints)[order] if prints else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner)[order] if prints else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if prints else np.zeros(0, np.int64)

    def hits(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of documents whose word hashes stand one after another in ``h``:
        a mark for each hit word, and (document, item) pairs."""
        span, k = self.span, self.k
        mark = np.zeros(len(h) + 1, np.int32)
        first = np.concatenate([[0], np.cumsum(length)])
        doc_of = np.repeat(np.arange(len(length)), length)
        docs, items = [], []
        if len(self.prints) and len(h) >= span:
            g = gram_hashes(h, k)
            p = winnow(g, span - k + 1)
            p = p[doc_of[p] == doc_of[p + k - 1]]
            lo, hi = np.searchsorted(self.prints, g[p], "left"), np.searchsorted(self.prints, g[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            upto = np.cumsum(n)
            reach = np.arange(k - span, span)  # words that a run over this k-gram can hold
            for a in range(0, int(n.sum()), 1 << 14):  # a print may stand in many items
                each = np.arange(a, min(a + (1 << 14), int(upto[-1])))
                own = np.searchsorted(upto, each, "right")
                q, f = p[own], lo[own] + each - (upto[own] - n[own])
                pos = q[:, None] + reach
                inside = (pos >= first[doc_of[q]][:, None]) & (pos < first[doc_of[q] + 1][:, None])
                same = inside & (h[np.clip(pos, 0, len(h) - 1)] == self.words[np.clip(self.place[f][:, None] + reach, 0, len(self.words) - 1)])
                full = np.lib.stride_tricks.sliding_window_view(same, span, axis=1).all(axis=2)
                row, off = np.nonzero(full)
                begin = q[row] + reach[0] + off
                np.add.at(mark, begin, 1)
                np.add.at(mark, begin + span, -1)
                docs.append(doc_of[begin])
                items.append(self.owner[f[row]])
        for size, keys in self.short.items():
            g = gram_hashes(h, size)
            known = np.array(sorted(keys), np.uint64)
            where = np.searchsorted(known, g)
            found = np.flatnonzero(known[np.minimum(where, len(known) - 1)] == g)
            found = found[doc_of[found] == doc_of[found + size - 1]] if len(found) else found
            for begin in found.tolist():
                for no in keys[int(g[begin])]:
                    if np.array_equal(h[begin : begin + size], self.short_words[no]):
                        mark[begin] += 1
                        mark[begin + size] -= 1
                        docs.append(np.array([doc_of[begin]]))
                        items.append(np.array([no]))
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1) if docs else np.zeros((2, 0), np.int64)
        return np.cumsum(mark[:-1]) > 0, pairs[0], pairs[1]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in lists of bounded text, one at a time on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and text <> ''")
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, text.encode()))
        size += len(text)
        if size >= block_bytes or len(block) >= block_items:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(docs: DataFrame, index) -> DataFrame:
    """One block joined with all documents; adds to ``_hit`` and ``_items``."""

    def run(batches):
        ix = index.value
        for batch, texts in chunks(batches, "_text"):
            words = [alnum_words(x) for x in texts]
            length = np.array([len(w) for w in words], np.int64)
            hit, doc, item = ix.hits(word_hashes([x for w in words for x in w]), length)
            first = np.concatenate([[0], np.cumsum(length)])
            old_hit, old_items = batch.column(batch.schema.get_field_index("_hit")).to_pylist(), batch.column(batch.schema.get_field_index("_items")).to_pylist()
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            new_hit, new_items, n_hit = [], [], []
            for i in range(len(texts)):
                mine = hit[first[i] : first[i + 1]]
                if old_hit[i]:
                    mine = mine | np.unpackbits(np.frombuffer(old_hit[i], np.uint8), count=len(mine)).astype(bool)
                new_hit.append(np.packbits(mine).tobytes() if mine.any() else b"")
                n_hit.append(int(mine.sum()))
                new_items.append(sorted({ix.ids[j] for j in item[cut[i] : cut[i + 1]]} - {None} | set(old_items[i] or [])))
            out = {"_hit": pa.array(new_hit, pa.binary()), "_items": pa.array(new_items, pa.list_(pa.int64())), "_words": pa.array(length), "_n": pa.array(n_hit, pa.int64())}
            yield pa.RecordBatch.from_arrays([out.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], schema=pa.schema([pa.field(f.name, out[f.name].type if f.name in out else f.type) for f in batch.schema]))

    return docs.mapInArrow(lean(run), docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with columns of their own, as structs under ``row``,
    beside n_words, n_hit, n_items, item_ids and contaminated.

    A window is ``span`` consecutive words of an item, or all words of a
    shorter item.  Every word inside an occurrence of a window is hit; a
    document is contaminated if some word is hit and 20 * n_hit >= n_words.
    NULL and empty texts have no words and no hit; NULL or empty items have no
    window; an item with a NULL id marks words but is not counted; repeated
    item ids count once; repeated rows each get their result; an empty
    benchmark or table of documents gives no hit or no row.  Columns of
    ``docs`` may bear any name.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    state = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("_text"), F.lit(None).cast("binary").alias("_hit"), F.lit(None).cast("array<bigint>").alias("_items"), F.lit(None).cast("bigint").alias("_words"), F.lit(None).cast("bigint").alias("_n"))
    index = written = None
    for block in blocks(benchmark, block_bytes):
        if index is not None:
            state = materialize(state, "hits")
            index.destroy()
            if written is not None:
                discard(written)
            written = state
        index = spark.sparkContext.broadcast(Index(block, span, k))
        state = _scan(state, index)
    if index is None:
        state = _scan(state, spark.sparkContext.broadcast(Index([], span, k)))
    return (
        state.select("row", F.col("_words").alias("n_words"), F.col("_n").alias("n_hit"), F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"))
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def items_digest(item_ids):
    """sha256 of the ids sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(item_ids, lambda x: x.cast("string"))), ","), 256)
