"""Periodic runs of words, found from the blocks of an LZ factorization.

Per document: ranks of the stretches of 2^k words (prefix doubling) give the
suffix array and, compared from the largest k down, common prefixes of any two
places.  The array of longest previous factors follows from suffix array and LCP
with one stack and cuts the text into LZ blocks.  A run that touches a block's
border is met by extending the border's place and one a period away to both
sides (Main); a run strictly inside a block is a copy of one that begins in the
block's source, taken over from buckets of runs by start.

Spark deals the documents; a task works on about half a MB of texts at a time,
and a longer text by itself, in memory linear in its words but for the ranks
(one number a word and doubling).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import bound_batches, chunks, lean

#: Words that a run has at least (and twice its period).
LEAST = 12
#: (border, period) pairs extended at once.
PAIRS = 1 << 20


def word_ids(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all documents, and the words of each document."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
    return ids, np.array([len(ws) for ws in words], np.int64)


def may_repeat(ids: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Documents in which some ``size`` consecutive words may stand twice: a
    document outside has no run of 2 * size words or more.  Equal stretches have
    equal sums, so none is missed."""
    if len(ids) < size:
        return np.zeros(0, np.int64)
    code = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    total = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + code[j : j + len(total)]
    at = np.flatnonzero(owner[: len(total)] == owner[size - 1 :])
    total, where = total[at] + owner[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB), owner[at]
    order = np.argsort(total)
    total, where = total[order], where[order]
    return np.unique(where[1:][(total[1:] == total[:-1]) & (where[1:] == where[:-1])])


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), np.int64)
    fresh[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(fresh) - 1
    return out


def stretch_ranks(ids: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Per k the rank of the 2^k words from each place among those of its
    document, an end counting as less than any word, until no two are equal;
    each followed by -1, which equals nothing."""
    n = len(ids)
    levels = [_dense(owner * (int(ids.max(initial=0)) + 1) + ids)]
    step = 1
    while len(levels[-1]) and int(levels[-1].max()) + 1 < n:
        rank = levels[-1].astype(np.int64)
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(owner[:-step] == owner[step:]) if step < n else np.zeros(0, np.int64)
        after[inside] = rank[inside + step] + 1
        levels.append(_dense(rank * (n + 1) + after))
        step *= 2
    return [np.append(x, np.int32(-1)) for x in levels]


def ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are equal (i and j differ)."""
    i, j, n = i.copy(), j.copy(), len(levels[0]) - 1
    begin = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][i] == levels[k][j]
        same &= (i < n) & (j < n)
        i += same << k
        j += same << k
    return i - begin


def behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j are equal, i < j."""
    i, j = i.copy(), j.copy()
    begin = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        a = i - (1 << k)
        same = (a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][j - (1 << k) * (a >= 0)])
        i -= same << k
        j -= same << k
    return begin - i


def previous_factors(levels: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Per place the longest stretch that also begins earlier, and where."""
    rank = levels[-1][:-1]
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = [0, *ahead(levels, order[:-1], order[1:]).tolist(), 0]
    length, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []
    for place, shared in zip([*order.tolist(), -1], common, strict=True):
        while stack and place < stack[-1][0]:
            top, below = stack.pop()
            if shared >= below:
                length[top], source[top] = shared, place
            else:
                length[top], source[top] = below, stack[-1][0]
            shared = min(shared, below)
        stack.append((place, shared))
    return length, source


def lz_blocks(length: list[int], starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(begin, end, document) of each block; a document's blocks in order."""
    blocks, owner = [], []
    for d, (at, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        while at < end:
            to = at + max(1, length[at])
            blocks.append((at, to))
            owner.append(d)
            at = to
    return blocks, owner


def _expand(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated ``count`` times, and lo, lo + 1, ... within each."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row]


def border_runs(levels: list[np.ndarray], blocks: list, owner: list[int], starts: np.ndarray, ends: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """(start, end) to smallest period of the runs that touch a border.

    A run that ends in block h and begins at or before its border has a period
    below the lengths of the blocks h - 1 and h together, for else block h - 1
    would have gone on: so many periods are tried at a border."""
    size = np.array([b - a for a, b in blocks], np.int64)
    doc = np.array(owner, np.int64)
    last = np.append(doc[1:] != doc[:-1], True)
    x = np.array([b for _, b in blocks], np.int64)  # each block's end is a border
    after = np.where(last, 0, np.append(size[1:], 0))
    left = np.minimum(size + after, x - starts[doc])
    right = np.minimum(after, ends[doc] - x)
    found: dict[tuple[int, int], int] = {}
    for reach, side in ((right, 0), (left, 1)):
        many = np.cumsum(reach)
        lo = 0
        while lo < len(x):  # borders of about PAIRS pairs together
            hi = max(lo + 1, int(np.searchsorted(many, (many[lo - 1] if lo else 0) + PAIRS, "right")))
            row, q = _expand(np.ones(hi - lo, np.int64), reach[lo:hi])
            i = x[lo:hi][row] - (q if side else 0)
            lo = hi
            if not len(i):
                continue
            before, more = behind(levels, i, i + q), ahead(levels, i, i + q)
            hit = before + more >= np.maximum(q, least - q)
            for s, t, p in zip((i - before)[hit].tolist(), (i + q + more)[hit].tolist(), q[hit].tolist(), strict=True):
                if p < found.get((s, t), p + 1):
                    found[s, t] = p
    return found


def inner_runs(found: dict[tuple[int, int], int], blocks: list, source: list[int], least: int) -> None:
    """Add the runs strictly inside a block: copies of its source's, by
    buckets of starts, blocks and starts in rising order."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, t), q in found.items():
        buckets.setdefault(s, []).append((t, q))
    for begin, end in blocks:
        if end - begin < least + 2:
            continue
        away = begin - source[begin]
        for s in range(source[begin] + 1, end - away - least):
            for t, q in buckets.get(s, ()):
                if t + away < end and (s + away, t + away) not in found:
                    found[s + away, t + away] = q
                    buckets.setdefault(s + away, []).append((t + away, q))


def runs_of(words: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Per document the runs (start, length, period) by start, then period."""
    out = [np.zeros((0, 3), np.int64) for _ in words]
    ids, length = word_ids(words)
    some = may_repeat(ids, np.repeat(np.arange(len(words)), length), max(1, least // 2))
    if not len(some):
        return out
    first = np.cumsum(length) - length
    ids = np.concatenate([ids[first[d] : first[d] + length[d]] for d in some])
    ends = np.cumsum(length[some])
    starts = ends - length[some]
    levels = stretch_ranks(ids, np.repeat(np.arange(len(some)), length[some]))
    factor, source = previous_factors(levels)
    blocks, owner = lz_blocks(factor, starts, ends)
    found = border_runs(levels, blocks, owner, starts, ends, least)
    inner_runs(found, blocks, source, least)
    if not found:
        return out
    table = np.array([(s, t - s, q) for (s, t), q in found.items()], np.int64)
    table = table[np.lexsort((table[:, 2], table[:, 0]))]
    for n, at in enumerate(np.searchsorted(table[:, 0], starts)):
        part = table[at : np.searchsorted(table[:, 0], ends[n])]
        out[some[n]] = part - [starts[n], 0, 0]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside of the repetitions of runs, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length, period; by start,
    then period) of at least ``least`` words and twice their period, and
    collapsed: the text's words without any run's words past its first period.

    Words are what white space ``[\\x20\\x09-\\x0D]`` parts.  NULL and empty
    texts have no words, no runs and an empty ``collapsed``.  Texts are read
    whole.  Rows that repeat each give their row; a NULL doc_id stays NULL; an
    empty table gives no row; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch, texts in chunks(batches):
            words = [x.split() for x in texts]
            found = runs_of(words, least)
            offsets = np.cumsum([0] + [len(r) for r in found], dtype=np.int32)
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"]))
            kept = pa.array([collapse(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), runs, kept], names=["doc_id", "n_words", "runs", "collapsed"])

    return src.mapInArrow(lean(run), "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


#: Repeats part of a text's words where the id's checksum is a multiple of ten.
_PLANT = r"""
case when h % 10 = 0 then array_join(transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')), ws ->
  case when size(ws) > 0 then transform(sequence(0, size(ws) - 1), i -> ws[
    case when i < g % size(ws) then i else int(g % size(ws) + (i - g % size(ws)) % (1 + floor((size(ws) - g % size(ws)) / (3 + g % 8)))) end])
  else ws end)[0], ' ') else text end
"""


def plant(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; where h = crc32(doc_id as text) is a multiple of
    ten, the words from a = g % n on (g = h / 10, n words) repeat with period
    1 + (n - a) / (3 + g % 8).  A NULL id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    return named.select("doc_id", F.expr(_PLANT).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``find_runs`` returns."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line: Column = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
