"""Language identification by a linear-chain conditional random field.

Each word is labelled with a language; of a word longer than ``HEAD`` bytes
each piece is, so that all of a text without spaces counts.  Its features are its beginnings and
endings (affixes), its byte bigrams and trigrams, and membership in a lexicon
of words typical of one language; transitions between the labels of
neighbouring words are learned too, so code-switched passages are labelled as
such.  Marginals come from forward-backward; the document's language has the
largest share of them.

Training takes a bounded sample of labelled documents (``train_docs``), cut
into runs of words that are strung together across languages, so that switches
are seen; it runs in numpy on the driver, and the weights are broadcast.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import ALNUM, bound_batches, chunks, lean, texts_of, unit_hash

TRAIN_DOCS, RUN_WORDS, SEQ_WORDS = 4000, 60, 120
BITS, HEAD, MAX_CACHE = 16, 16, 200_000
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: No digits, unlike the words of other operators.
_TABLE = bytes(32 if 48 <= i <= 57 else b for i, b in enumerate(ALNUM))


def letter_words(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII digits and punctuation; words longer
    than ``HEAD`` bytes are cut into consecutive pieces of whole characters."""
    words = text.decode("utf-8", "replace").lower().encode().translate(_TABLE).split()
    if max(map(len, words), default=0) <= HEAD:
        return words
    out = []
    for w in words:
        lo = 0
        while len(w) - lo > HEAD:
            hi = lo + HEAD
            while w[hi] & 0xC0 == 0x80:
                hi -= 1
            out.append(w[lo:hi])
            lo = hi
        out.append(w[lo:])
    return out


def feature_ids(words: list[bytes]) -> np.ndarray:
    """A row of hashed feature numbers for each word."""
    n, size = len(words), 1 << BITS
    head = np.array([w[:HEAD] for w in words], dtype=f"S{HEAD}").view(np.uint8).reshape(n, HEAD).astype(np.uint64)
    tail = np.array([w[-4:][::-1] for w in words], dtype="S4").view(np.uint8).reshape(n, 4).astype(np.uint64)
    cols, salt = [], 0

    def add(value):
        nonlocal salt
        salt += 1
        x = (value + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15)
        cols.append(((x >> np.uint64(64 - BITS)) % np.uint64(size)).astype(np.int32))

    for part in (head, tail):
        value = np.zeros(n, np.uint64)
        for j in range(4):
            value = value * np.uint64(256) + part[:, j]
            if j:
                add(value)
    salt = 100
    first = np.concatenate([np.full((n, 1), 1, np.uint64), head], axis=1)
    for j in range(HEAD):  # the same feature wherever the letters stand
        salt = 100
        add(np.where(first[:, j] > 0, first[:, j] * np.uint64(256) + first[:, j + 1], np.uint64(0)))
    for j in range(HEAD - 1):
        salt = 101
        add(np.where(first[:, j + 1] > 0, (first[:, j] * np.uint64(256) + first[:, j + 1]) * np.uint64(256) + first[:, j + 2], np.uint64(0)))
    return np.stack(cols, axis=1)


def transfer_products(e, start, trans, begin):
    """Per block of words, the product of the steps from word to word."""
    nb, steps, n = e.shape
    m = np.broadcast_to(np.eye(n), (nb, n, n)).copy()
    for t in range(steps):
        m = np.where(start[:, t, None, None], m.sum(-1, keepdims=True) * begin, m @ trans) * e[:, t, None, :]
        m /= m.sum((1, 2), keepdims=True)
    return m


def marginals(scores: np.ndarray, start: np.ndarray, trans: np.ndarray, begin: np.ndarray, steps: int = 64) -> np.ndarray:
    """Forward-backward over sequences that stand one after another; ``start``
    marks the first word of each.  Words are dealt into blocks whose products
    are found side by side, then chained: the result is that of the plain
    recursion."""
    count, n = scores.shape
    pad = -count % steps
    e = np.exp(scores - scores.max(1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, n))]).reshape(-1, steps, n)
    s = np.concatenate([start, np.ones(pad, bool)]).reshape(-1, steps)
    products = transfer_products(e, s, trans, begin)
    nb = len(e)
    before, after = np.empty((nb, n)), np.empty((nb, n))
    a, b = begin.copy(), np.ones(n)
    for k in range(nb):
        before[k] = a
        a = a @ products[k]
        a /= a.sum()
    for k in range(nb - 1, -1, -1):
        after[k] = b
        b = products[k] @ b
        b /= b.sum()
    alpha = np.empty_like(e)
    for t in range(steps):
        before = np.where(s[:, t, None], begin, before @ trans) * e[:, t]
        before /= before.sum(1, keepdims=True)
        alpha[:, t] = before
    for t in range(steps - 1, -1, -1):
        alpha[:, t] *= after
        w = e[:, t] * after
        after = np.where(s[:, t, None], (w @ begin)[:, None], w @ trans.T)
        after /= after.sum(1, keepdims=True)
    out = alpha.reshape(-1, n)[:count]
    return out / out.sum(1, keepdims=True)


class Model:
    """Weights of the field; ``lexicon`` maps a word to a label number."""

    def __init__(self, langs: list[str], weights, lexicon: dict[bytes, int], lexicon_weight, trans, begin):
        self.langs, self.weights, self.lexicon, self.lexicon_weight, self.trans, self.begin = langs, weights, lexicon, lexicon_weight, trans, begin

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for lo in range(0, len(words), 20_000):
            ids = feature_ids(words[lo : lo + 20_000])
            for j in range(ids.shape[1]):
                out[lo : lo + 20_000] += self.weights[ids[:, j]]
        for i, w in enumerate(words):
            if (k := self.lexicon.get(w)) is not None:
                out[i] += self.lexicon_weight[k]
        return out


class Tagger:
    """Applies a model; remembers the emission scores of words seen."""

    def __init__(self, model: Model):
        self.model, self.known, self.scores = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def score_words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > MAX_CACHE:
            self.known, self.scores = {}, self.scores[:0]
        known, n = self.known, len(self.known)
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if len(known) > n:
            fresh = list(known)[n:] if n == 0 else [w for w in dict.fromkeys(words) if known[w] >= n]
            self.scores = np.concatenate([self.scores, self.model.emissions(fresh)])
        return self.scores[ids]

    def documents(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        words = [letter_words(x) if _LETTER.search(x.decode("utf-8", "replace")) else [] for x in texts]
        length = np.array([len(w) for w in words], np.int64)
        flat = [x for w in words for x in w]
        if not flat:
            return [(UND, 0.0)] * len(texts)
        m = self.model
        first = np.concatenate([[0], np.cumsum(length)])
        start = np.zeros(len(flat), bool)
        start[first[:-1][length > 0]] = True
        p = marginals(self.score_words(flat), start, m.trans, m.begin)
        sums = np.add.reduceat(p, first[:-1][length > 0], axis=0) / length[length > 0][:, None]
        best = iter(zip(sums.argmax(1), sums.max(1), strict=True))
        out = []
        for n in length:
            if n:
                k, x = next(best)
                out.append((m.langs[k], float(min(1.0, x))))
            else:
                out.append((UND, 0.0))
        return out


def sample_runs(docs: DataFrame, *, train_docs: int = TRAIN_DOCS, run_words: int = RUN_WORDS, seed: int = 7) -> list[tuple[str, list[bytes]]]:
    """(language, words) of one random run from each of about ``train_docs``
    labelled documents, as many of each language as there are.  Every language
    is taken, a run that repeats once; training holds about 1 MB of weights for each on the driver."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, train_docs / len(counts) / n))]) if counts else None
    if share is None:
        return []
    picked = rows.where(unit_hash(F.coalesce("id", F.lit("")), F.col("text"), F.lit(seed)) < F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def cut(batches):
        for batch in batches:
            out = []
            for x, key in zip(texts_of(batch), batch.column(0).to_pylist(), strict=True):
                w = letter_words(x)
                at = (hash_of(key or "") ^ seed) % max(1, len(w) - run_words + 1)
                out.append(b" ".join(w[at : at + run_words]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.string())], names=["lang", "run"])

    got = picked.mapInArrow(lean(cut), "lang string, run string").distinct().collect()
    return sorted((r["lang"], r["run"].encode().split()) for r in got if r["run"])


def hash_of(x: str) -> int:
    return int(pd.util.hash_array(np.array([x], dtype=object))[0] >> np.uint64(1))


def train(runs: list[tuple[str, list[bytes]]], *, epochs: int = 4, rate: float = 0.3, seed: int = 7) -> Model:
    """Maximum likelihood by Adagrad on sequences of several languages."""
    langs = sorted({lang for lang, _ in runs}) or [UND]
    n = len(langs)
    number = {lang: i for i, lang in enumerate(langs)}
    counts = [Counter() for _ in langs]
    for lang, words in runs:
        counts[number[lang]].update(set(words))
    lexicon: dict[bytes, int] = {}
    for k, c in enumerate(counts):
        for w, x in c.most_common(400):
            if x >= 5 and x >= 0.8 * sum(o[w] for o in counts):
                lexicon[w] = k
    weights, grad2 = np.zeros((1 << BITS, n)), np.full((1 << BITS, n), 1e-2)
    lexw, lexg = np.zeros((n, n)), np.full((n, n), 1e-2)
    trans, transg = np.zeros((n, n)), np.full((n, n), 1e-2)
    rng = np.random.default_rng(seed)
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in runs for w in words))}
    feats = feature_ids(list(vocab)) if vocab else np.zeros((0, 1), np.int32)
    lex = np.array([lexicon.get(w, -1) for w in vocab], np.int64)
    begin = np.full(n, 1.0 / n)
    for _ in range(epochs if vocab else 0):
        stream_w, stream_y = [], []
        for i in rng.permutation(len(runs)):
            lang, words = runs[i]
            cut = max(1, int(rng.integers(5, RUN_WORDS + 1)))
            stream_w += [vocab[w] for w in words[:cut]]
            stream_y += [number[lang]] * len(words[:cut])
        rows = len(stream_w) // SEQ_WORDS
        if rows == 0:
            rows, size = 1, len(stream_w)
        else:
            size = SEQ_WORDS
        w = np.array(stream_w[: rows * size]).reshape(rows, size)
        y = np.array(stream_y[: rows * size]).reshape(rows, size)
        for lo in range(0, rows, 32):
            bw, by = w[lo : lo + 32], y[lo : lo + 32]
            ids, lx = feats[bw.ravel()], lex[bw.ravel()]
            scores = weights[ids].sum(1)
            scores[lx >= 0] += lexw[lx[lx >= 0]]
            e = np.exp(scores - scores.max(1, keepdims=True)).reshape(*bw.shape, n)
            t = np.exp(trans)
            alpha, beta = np.empty_like(e), np.empty_like(e)
            a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            alpha[:, 0] = a
            for i in range(1, size if rows > 1 or size > 1 else 1):
                a = (a @ t) * e[:, i]
                a /= a.sum(1, keepdims=True)
                alpha[:, i] = a
            b = np.ones_like(a)
            beta[:, -1] = b
            pair = np.zeros((n, n))
            for i in range(bw.shape[1] - 2, -1, -1):
                x = e[:, i + 1] * b
                j = alpha[:, i, :, None] * t * x[:, None, :]
                pair += (j / j.sum((1, 2), keepdims=True)).sum(0)
                b = x @ t.T
                b /= b.sum(1, keepdims=True)
                beta[:, i] = b
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            g = (np.eye(n)[by] - p).reshape(-1, n)
            seen = np.zeros((n, n))
            np.add.at(seen, (by[:, :-1].ravel(), by[:, 1:].ravel()), 1)
            flat, times = ids.ravel(), ids.shape[1]
            for k in range(n):
                d = np.bincount(flat, np.repeat(g[:, k], times), 1 << BITS) / len(g)
                grad2[:, k] += d * d
                weights[:, k] += 0.05 * rate * d / np.sqrt(grad2[:, k]) * 10
            d = np.zeros((n, n))
            np.add.at(d, lx[lx >= 0], g[lx >= 0])
            d /= len(g)
            lexg += d * d
            lexw += rate * d / np.sqrt(lexg)
            d = (seen - pair) / len(g)
            transg += d * d
            trans += rate * d / np.sqrt(transg)
    return Model(langs, weights.astype(np.float32), lexicon, lexw.astype(np.float32), np.exp(trans - trans.max()), begin)


def identify(docs: DataFrame, model: Model, *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns of docs (doc_id if None), as struct ``row``, with
    lang_pred (a learned language, or ``und`` if the text is NULL, empty or
    has no letter) and score (0 to 1; 0 for ``und``).

    Every text is read whole, however long.  Repeated rows each get their
    result; ties go to the first language in order; an empty table gives no
    row; with no labelled document at all, ``und`` is the only language.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or ["doc_id"])]).alias("row"), F.col(text).cast("string").alias("_text"))
    schema = src.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        tagger = Tagger(shared.value)
        for batch, texts in chunks(batches, "_text"):
            got = tagger.documents(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["row", "lang_pred", "score"])

    return src.mapInArrow(lean(run), schema)
