"""Alignment of two tokenizers by the byte offsets at which both end a token.

Neither tokenizer lets a token reach over a space that leads a word, so a text
is cut there.  A text in which something else than a word follows a space (or
that holds U+2581, which the second vocabulary writes for a space) is one part
by itself.

What the corpus decides, how often two ids are linked, is relational: each
distinct part is encoded once, with the number of its places; its tokens are
exploded with their ends, the two sides meet on part and end, and the pairs that
meet are counted and compared over the corpus.  Then each document is read once
more where it lies: the parts' tokens give the shared ends again, a running count
of these numbers the groups, and the counts of the pairs, of which a bounded
number of frequent ones is broadcast, give its sums; pairs beyond these are joined
by a shuffle of ids.  No text is shuffled but in the distinct parts, and no groups.
"""

from __future__ import annotations

import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.llm.common import bound_batches, chunks, discard, lean, materialize, release_shuffles

#: Most pairs of ids that are broadcast, at 17 bytes each.
FREQUENT = 1 << 20
#: Parts that a worker remembers, parts that it aligns at once, parts that are
#: encoded as one text, and bytes of documents that it holds.
MAX_CACHE, AT_ONCE, JOINED, CHUNK = 200_000, 50_000, 256, 2 << 20
_TOGETHER = r"\x20(?![\p{L}\p{M}\p{N}\p{P}\p{S}])|▁"
_workers: dict = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pair:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(bytes_path), SentencePieceProcessor(model_file=pieces_path)
        self.a.encode_special_tokens = True
        # a byte-level vocabulary writes printable bytes as themselves, and the others, in order, as what follows 255
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.leads_a, self.leads_b = (np.array([x.startswith(b" ") for x in t]) for t in (self.bytes_a, self.bytes_b))
        #: How an id is written inside a group's side, at the first one's end and at the group's.
        self.written = np.array([[f"{i}{mark}".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))] for mark in ",|;"], object)

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def _gives(self, a: list[int], b: list[int], text: str) -> bool:
        want = b" " + text.encode()
        return b"".join([self.bytes_a[x] for x in a]) == want == b"".join([self.bytes_b[x] for x in b])

    def _alone(self, part: str, whole: bool) -> tuple[list[int], list[int]]:
        (a,), (b,) = self._both([part])
        if part and self._gives(a, b, part):
            return a, b
        if not whole:
            raise ValueError(f"a part is not given back by its tokens ({part!r}); align whole texts with split=False")
        return [], []

    def encode(self, parts: list[str], whole: list[bool]) -> Sides:
        """Ids by both, one part after another, and how many are each part's;
        none where the tokens' bytes are not those of a whole text led by a
        space.  Other parts hold no space, and many of them are encoded as one
        text, in which a token that begins with a space begins a part."""
        a: list = [None] * len(parts)
        b: list = [None] * len(parts)
        for i in np.flatnonzero(whole).tolist():
            a[i], b[i] = self._alone(parts[i], True)
        cut = np.flatnonzero(~np.asarray(whole, bool)).tolist()
        runs = [cut[lo : lo + JOINED] for lo in range(0, len(cut), JOINED)]
        texts = [" ".join([parts[i] for i in run]) for run in runs]
        for run, text, x, y in zip(runs, texts, *self._both(texts), strict=True) if runs else ():
            at_a, at_b = np.flatnonzero(self.leads_a[x]).tolist(), np.flatnonzero(self.leads_b[y]).tolist()
            if len(at_a) == len(at_b) == len(run) and self._gives(x, y, text):
                for i, lo, hi, low, high in zip(run, at_a, [*at_a[1:], len(x)], at_b, [*at_b[1:], len(y)], strict=True):
                    a[i], b[i] = x[lo:hi], y[low:high]
            else:
                for i in run:
                    a[i], b[i] = self._alone(parts[i], False)
        return Sides(*[f(v) for v in (a, b) for f in (_flat, _many)])


class Sides(NamedTuple):
    """Ids of both tokenizers, and each part's number of them."""

    a: np.ndarray
    many_a: np.ndarray
    b: np.ndarray
    many_b: np.ndarray


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter((x for part in lists for x in part), np.int64)


def _many(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


def pair(bytes_path: str, pieces_path: str) -> Pair:
    key = (bytes_path, pieces_path)
    if key not in _workers:
        _workers[key] = Pair(*key)
    return _workers[key]


def parts_of(text: Column, split: bool) -> Column:
    whole = F.array(text)
    return F.when(F.concat(F.lit(" "), text).rlike(_TOGETHER), whole).otherwise(F.split(text, " ")) if split else whole


def is_whole(part: Column, split: bool) -> Column:
    """Whether a part is a text that may not be cut."""
    return F.concat(F.lit(" "), part).rlike(_TOGETHER) if split else F.lit(True)


def tokens_of(parts: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Per part its tokens, those of the first tokenizer before those of the
    second, and the byte at which each ends."""

    def run(batches):
        both = pair(bytes_path, pieces_path)
        for batch, texts in chunks(batches, "part"):
            a, many_a, b, many_b = both.encode([t.decode() for t in texts], batch.column(2).to_pylist())
            first, second = np.cumsum(many_a), np.cumsum(many_b)
            order = np.argsort(np.concatenate([np.repeat(np.arange(len(texts)), m) for m in (many_a, many_b)]), kind="stable")
            ends = []
            for ids, length, many, last in ((a, both.len_a, many_a, first), (b, both.len_b, many_b, second)):
                total = np.append(0, np.cumsum(length[ids]))
                ends.append(total[1:] - np.repeat(total[last - many], many))
            at = pa.array(np.append(0, first + second).astype(np.int32))
            listed = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x)[order].astype(np.int32))) for x in ((a, b), ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(many_a), *listed], names=["k", "n", "n_a", "ids", "ends"])

    return parts.select("k", "n", "whole", "part").mapInArrow(lean(run), "k bigint, n bigint, n_a bigint, ids array<int>, ends array<int>")


def links_of(tokens: DataFrame) -> DataFrame:
    """(n, a, b): per part and shared end the two ids that end there.

    All rows of a part stay where one shuffle of its arrays has dealt them.  The
    equi-join of both sides on part and end is one grouping on its keys, for a
    join would deal its rows anew.
    """
    rows = tokens.repartition("k").select("k", "n", "n_a", F.posexplode(F.arrays_zip("ids", "ends")).alias("pos", "token"))
    second = F.col("pos") >= F.col("n_a")
    ends = rows.select("k", "n", F.col("token.ends").alias("end"), F.when(~second, F.col("token.ids")).alias("a"), F.when(second, F.col("token.ids")).alias("b"))
    return ends.groupBy("k", "n", "end").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a is not null and b is not null").select("n", "a", "b")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): places in the corpus at which a and b are linked,
    and whether no id of the first tokenizer is linked with b at more."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b")))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Counts(NamedTuple):
    """Frequent pairs of ids, sorted, with their counts."""

    key: np.ndarray
    n: np.ndarray
    best: np.ndarray


def frequent_counts(counts: DataFrame, least: int) -> Counts:
    got = counts.where(F.col("n") >= least).select(_key(F.col("a"), F.col("b")).alias("key"), "n", "best").toArrow()
    key, n, best = (got.column(c).to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(key)
    return Counts(key[order], n[order], best[order].astype(bool))


def _key(a, b):
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


class Aligned:
    """Parts' numbers (n_a, n_b, n_links, n_best, count_sum), written groups and
    links with pairs that are not in ``counts``."""

    def __init__(self, both: Pair, counts: Counts, parts: list[str], whole: list[bool]):
        a, many_a, b, many_b = both.encode(parts, whole)
        # a part has as many bytes on both sides, so running sums over all parts meet where those of a part do
        end_a, end_b = np.cumsum(both.len_a[a]), np.cumsum(both.len_b[b])
        at = np.searchsorted(end_b, end_a)
        cut_a, cut_b = end_b[at] == end_a, np.zeros(len(b), bool)
        at_a, at_b = np.flatnonzero(cut_a), at[cut_a]
        cut_b[at_b] = True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b  # shared ends before
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + np.append(0, at_b + 1)[group_a]] = both.written[cut_a.astype(int), a]
        written[np.arange(len(b)) + (at_a + 1)[group_b]] = both.written[cut_b * 2, b]
        written, upto = written.tolist(), [0, *np.cumsum(many_a + many_b).tolist()]
        self.groups = [b"".join(written[lo:hi]) for lo, hi in zip(upto, upto[1:], strict=False)]

        links = np.append(0, np.cumsum(cut_a))[np.append(0, np.cumsum(many_a))]
        key = a[at_a] << 32 | b[at_b]
        told, n, best = np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        if len(counts.key):
            place = np.minimum(np.searchsorted(counts.key, key), len(counts.key) - 1)
            told = counts.key[place] == key
            n, best = np.where(told, counts.n[place], 0), told & counts.best[place]

        def summed(x: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(x))[links])

        self.numbers = np.stack([many_a, many_b, np.diff(links), summed(best), summed(n)], axis=1)
        self.rest = {i: key[links[i] : links[i + 1]][~told[links[i] : links[i + 1]]] for i in np.flatnonzero(summed(~told)).tolist()}


def documents_of(rows: DataFrame, counts: Counts, bytes_path: str, pieces_path: str) -> DataFrame:
    """Per row (doc_id, whole, text): doc_id, the numbers, as far as ``counts``
    holds its pairs, its groups, and the pairs that it does not hold."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        both, counts = pair(bytes_path, pieces_path), shared.value
        known: dict[str, int] = {}
        numbers, groups, rest = np.zeros((0, 5), np.int64), [], {}
        for batch, texts in chunks(batches, "text", CHUNK):
            lists = [([t] if w else t.split(" ")) if t else [] for t, w in zip((x.decode() for x in texts), batch.column(1).to_pylist(), strict=True)]
            alone = {x[0] for x, w in zip(lists, batch.column(1).to_pylist(), strict=True) if w and x}
            held, fresh = len(known), list(dict.fromkeys(p for x in lists for p in x if p not in known))
            known.update(zip(fresh, range(held, held + len(fresh)), strict=True))
            for lo in range(0, len(fresh), AT_ONCE):
                part = fresh[lo : lo + AT_ONCE]
                got = Aligned(both, counts, part, [p in alone for p in part])
                rest |= {held + lo + i: x for i, x in got.rest.items()}
                numbers, groups = np.concatenate([numbers, got.numbers]), groups + got.groups
            slots = np.fromiter((known[p] for x in lists for p in x), np.int64)
            upto = np.append(0, np.cumsum(_many(lists)))
            own = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(numbers[slots], axis=0)])[upto], axis=0)
            ordered, at = [groups[i] for i in slots.tolist()], upto.tolist()
            written = [b"".join(ordered[lo:hi])[:-1].decode() for lo, hi in zip(at, at[1:], strict=False)]
            left = [[y for i in slots[lo:hi].tolist() if i in rest for y in rest[i].tolist()] for lo, hi in zip(at, at[1:], strict=False)] if rest else [[]] * len(lists)
            columns = [own[:, 0], own[:, 1], own[:, 2], own[:, 2], own[:, 3], own[:, 4]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(written, pa.string()), pa.array(left, pa.list_(pa.int64()))], names=["doc_id", *NUMBERS, "groups", "rest"])
            if len(known) > MAX_CACHE:  # the parts met first stay
                for p in fresh[max(0, MAX_CACHE - held) :]:
                    del known[p]
                numbers, groups, rest = numbers[: len(known)].copy(), groups[: len(known)], {i: x for i, x in rest.items() if i < len(known)}

    return rows.select("doc_id", "whole", "text").mapInArrow(lean(run), f"doc_id bigint, {', '.join(f'{c} bigint' for c in NUMBERS)}, groups string, rest array<bigint>")


def frequent_from(parts: DataFrame, most: int) -> int:
    """The least number of places such that at most ``most`` rows have as many;
    from counts of counts by eighths of a power of two."""
    step = F.floor(F.log2("n") * 8)
    left, least = most, None
    for row in parts.groupBy(step.alias("step")).agg(F.count("*").alias("parts"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        left -= row["parts"]
        if left < 0:
            break
        least = row["least"]
    return least if least is not None else 1 << 62


def align(docs: DataFrame, *, bytes_path: str | None = None, pieces_path: str | None = None, split: bool = True, frequent: int = FREQUENT) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best
    (links whose count is the highest of their second id, ties included),
    count_sum (of the links' counts) and groups (``a1,a2|b1;a3|b2,b3``).

    The first tokenizer is byte-level and reads the text led by a space; the
    second writes a leading space itself.  NULL and empty texts, and texts that
    the tokens do not give back byte by byte, have zeros and empty groups and
    count nowhere.  Rows that repeat count each time and each get their row; a
    NULL doc_id stays NULL; an empty table gives no row; other columns are not
    read.  ``split=False`` aligns whole texts, for tokenizers whose tokens reach
    over spaces.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    bytes_path, pieces_path = bytes_path or vocabulary("byte_bpe_50k.json"), pieces_path or vocabulary("piece_bpe_32k.model")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    places = rows.where("text <> ''").select(F.explode(parts_of(F.col("text"), split)).alias("part"))
    counted = places.groupBy("part").agg(F.count("*").alias("n"))
    parts = materialize(counted.select(F.monotonically_increasing_id().alias("k"), "n", is_whole(F.col("part"), split).alias("whole"), "part"), "parts")
    release_shuffles(spark)
    counts = materialize(pair_counts(links_of(tokens_of(parts, bytes_path, pieces_path))), "pairs")
    discard(parts)
    release_shuffles(spark)

    least = frequent_from(counts, frequent)
    told = documents_of(rows.withColumn("whole", is_whole(F.col("text"), split)), frequent_counts(counts, least), bytes_path, pieces_path)
    if not counts.where(F.col("n") < least).limit(1).count():
        return told.drop("rest")
    told = materialize(told.withColumn("row", F.monotonically_increasing_id()), "aligned")
    left = told.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    rare = counts.where(F.col("n") < least).select(_key(F.col("a"), F.col("b")).alias("key"), "n", "best")
    more = left.join(rare, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("best_"), F.sum(F.col("times") * F.col("n")).alias("sum_"))
    out = told.drop("rest").join(more, "row", "left")
    added = {"n_best": "best_", "count_sum": "sum_"}
    return out.select("doc_id", *[(F.col(c) + F.coalesce(added[c], F.lit(0))).alias(c) if c in added else c for c in NUMBERS], "groups")
