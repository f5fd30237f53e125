"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first
four, five and six bytes, so inflected forms of a known stem are known.
Filters one, two and three words wide slide over the whole text; each filter's
maximum feeds a logistic output.  The score is shifted so that the threshold
that serves the calibration documents best stands at 0.3; thresholds by
language are found on the same documents.

``fit`` learns from every labelled document: shards of them are dealt by a hash,
each is descended in a task of its own from the same network, and what the
shards changed is averaged on Spark, row by row of the network; then the next
round begins.  Thresholds are found in counts of all calibration documents.
``train`` is the same on rows at hand, for which ``sample`` bounds their number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import alnum_words, bound_batches, chunks, discard, lean, materialize, unit_hash

TRAIN_DOCS, TRAIN_BYTES = 1500, 24 << 20
#: What a shard holds, about; (epochs, rate) of the rounds of many shards and of one.
SHARD_DOCS, SHARD_BYTES = 3000, 12 << 20
ROUNDS, ALONE = ((5, 0.1), (3, 0.03)), ((10, 0.1),)
#: Changes are summed as whole numbers of this size, so that no order of the sums
#: changes a result; margins are counted in steps of the second.
GRAIN, STEP = 2.0**-30, 1e-3
BITS, DIM, FILTERS, WIDTHS = 17, 16, 8, (1, 2, 3)
MAX_CACHE, THRESHOLD = 150_000, 0.3
KINDS = 4


def feature_rows(words: list[bytes]) -> np.ndarray:
    """Embedding rows of each word: itself and three beginnings of it."""
    mask = (1 << BITS) - 1
    out = np.empty((len(words), KINDS), np.int64)
    for i, w in enumerate(words):
        out[i] = (zlib.crc32(w) & mask, zlib.crc32(w[:4], 1) & mask, zlib.crc32(w[:5], 2) & mask, zlib.crc32(w[:6], 3) & mask)
    return out


def _over_kinds(x: np.ndarray) -> np.ndarray:
    """``x.sum(1)``, which is slow over a short middle axis."""
    total = x[:, 0]
    for kind in range(1, KINDS):
        total = total + x[:, kind]
    return total


class Network:
    """Embeddings, filters (one matrix a width and offset) and the output."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
        self.filters = {k: rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.shift, self.by_lang = 0.0, {}

    def project(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to each filter at each of its offsets."""
        e = _over_kinds(self.embed[feature_rows(words)])
        return np.concatenate([e @ f for k in WIDTHS for f in self.filters[k]], axis=1)

    def pooled(self, parts: np.ndarray, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over each document (0 at least) and, for
        training, the word at which it stands; ``parts`` are projections."""
        docs = len(length)
        best, where = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32), np.full((docs, len(WIDTHS) * FILTERS), -1, np.int64)
        full = np.flatnonzero(length)
        if not len(full):
            return best, where
        first = (np.cumsum(length) - length)[full]
        last = np.cumsum(length)[full]
        at = 0
        for n, k in enumerate(WIDTHS):
            rows = parts[:, at * FILTERS : (at + k) * FILTERS][ids]
            z = rows[:, :FILTERS] + self.bias[n]
            for j in range(1, k):  # words past the end of a document add nothing
                ends = np.unique(np.maximum(last[:, None] - np.arange(1, j + 1), first[:, None]))
                kept = z[ends]
                z[:-j] += rows[j:, j * FILTERS : (j + 1) * FILTERS]
                z[ends] = kept
            cols = slice(n * FILTERS, (n + 1) * FILTERS)
            best[full, cols] = np.maximum(np.maximum.reduceat(z, first, axis=0), 0)
            if self._training:
                for d, a in zip(full, first, strict=True):
                    where[d, cols] = z[a : a + length[d]].argmax(0) + a
            at += k
        return best, where

    _training = False

    def logits(self, parts, ids, length) -> np.ndarray:
        return self.pooled(parts, ids, length)[0] @ self.out + self.out_bias


def descend(net: Network, docs: list[np.ndarray], feats: np.ndarray, y: np.ndarray, rng: np.random.Generator, *, epochs: int, rate: float, batch: int = 32) -> None:
    """Steps down the loss on documents as numbers of words (rows of feats)."""
    cut = len(docs)
    net._training = True
    g2 = {k: np.full_like(v, 1e-3) for k, v in {"embed": net.embed, "bias": net.bias, "out": net.out} .items()}
    f2 = {k: np.full_like(v, 1e-3) for k, v in net.filters.items()}
    b2 = 1e-3
    for _ in range(epochs):
        order = rng.permutation(cut)
        for lo in range(0, cut, batch):
            pick = order[lo : lo + batch]
            length = np.array([len(docs[i]) for i in pick])
            ids = np.concatenate([docs[i] for i in pick]) if length.sum() else np.zeros(0, np.int64)
            local, inverse = np.unique(ids, return_inverse=True)
            # a form of a word is dropped at times, so that beginnings carry what they share
            kept = rng.random((len(local), KINDS, 1)) >= np.array([0.6, 0.2, 0.2, 0.2])[:, None]
            vec = _over_kinds(net.embed[feats[local]] * kept)
            parts = np.concatenate([vec @ f for k in WIDTHS for f in net.filters[k]], axis=1) if len(local) else np.zeros((0, 48), np.float32)
            h, where = net.pooled(parts, inverse, length)
            p = 1 / (1 + np.exp(-(h @ net.out + net.out_bias)))
            d = (p - y[pick]) / len(pick)
            gh = d[:, None] * net.out
            go, gb = h.T @ d, d.sum()
            ge = np.zeros_like(vec)
            ends = np.cumsum(length)
            for n, k in enumerate(WIDTHS):
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                i, f = np.nonzero((h[:, cols] > 0) & (where[:, cols] >= 0))
                pos, g = where[:, cols][i, f], gh[:, cols][i, f]
                gbias = np.bincount(f, g, FILTERS).astype(np.float32)
                g2["bias"][n] += gbias**2
                net.bias[n] -= rate * gbias / np.sqrt(g2["bias"][n])
                gf = np.zeros_like(net.filters[k])
                for j in range(k):
                    ok = pos + j < ends[i]
                    w = inverse[pos[ok] + j]
                    np.add.at(gf[j].T, f[ok], vec[w] * g[ok, None])
                    np.add.at(ge, w, net.filters[k][j].T[f[ok]] * g[ok, None])
                f2[k] += gf**2
                net.filters[k] -= rate * gf / np.sqrt(f2[k])
            g2["out"] += go**2
            net.out -= rate * go / np.sqrt(g2["out"])
            b2 += gb**2
            net.out_bias -= np.float32(rate * gb / np.sqrt(b2))
            hot = np.flatnonzero(np.abs(ge).sum(1))
            at, g = feats[local[hot]].ravel(), (ge[hot][:, None] * kept[hot]).reshape(-1, DIM)
            rows_, back = np.unique(at, return_inverse=True)
            total = np.zeros((len(rows_), DIM), np.float32)
            np.add.at(total, back, g)
            g2["embed"][rows_] += total**2
            net.embed[rows_] -= rate * total / np.sqrt(g2["embed"][rows_])
    net._training = False


def train(rows: list[tuple[bytes, int, str]], *, epochs: int = 10, rate: float = 0.1, batch: int = 32, seed: int = 5) -> Network:
    """Fit to (text, label, language); a quarter of the rows calibrates."""
    net = Network(seed)
    if not rows:
        return net
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    vocab: dict[bytes, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in alnum_words(t)], np.int64) for t, _, _ in rows]
    feats = feature_rows(list(vocab))
    y = np.array([r[1] for r in rows], np.float32)
    cut = max(1, len(rows) * 3 // 4)
    descend(net, docs[:cut], feats, y[:cut], rng, epochs=epochs, rate=rate, batch=batch)
    parts = net.project(list(vocab)) if vocab else np.zeros((0, 48), np.float32)
    rest = range(cut, len(rows)) if cut < len(rows) else range(len(rows))
    z = np.array([net.logits(parts, docs[i], np.array([len(docs[i])]))[0] for i in rest])
    truth, langs = y[list(rest)], [rows[i][2] for i in rest]
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - best_threshold(z, truth)
    for lang in sorted(set(langs)):
        at = np.array([x == lang for x in langs])
        if 0 < truth[at].sum() < at.sum():
            net.by_lang[lang] = float(1 / (1 + np.exp(-(best_threshold(z[at], truth[at]) + net.shift))))
    return net


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap that gives the largest F1."""
    order = np.argsort(-z, kind="stable")
    s, hit = z[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(len(z)) + 1 + y.sum())
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1.0


def sample(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, seed: int = 5) -> list[tuple[bytes, int, str]]:
    """(text, toxic, language) of about ``train_docs`` labelled documents of
    each class; fewer if their text would pass ``train_bytes``.  Rows that repeat
    are taken once, so that no id or text fills the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, train_docs / n))])
    picked = known.where(unit_hash(F.col("doc_id"), F.lit(seed)) < share[F.col("toxic")])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).join(F.broadcast(picked), "doc_id").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > train_bytes:
        rows = rows.where(unit_hash(F.col("doc_id"), F.col("text"), F.lit(seed + 1)) < train_bytes / size)
    return sorted((r["text"].encode(), int(r["toxic"] > 0), r["lang"]) for r in rows.select("text", "toxic", "lang").collect())


def _flat(net: Network) -> np.ndarray:
    """The network as rows of ``DIM`` numbers: embeddings, then the rest."""
    rest = np.concatenate([*[net.filters[k].ravel() for k in WIDTHS], net.bias.ravel(), net.out, [net.out_bias]])
    return np.concatenate([net.embed, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float32)


def _from_flat(flat: np.ndarray) -> Network:
    net, rest, at = Network(), flat[1 << BITS :].ravel(), 0

    def take(shape):
        nonlocal at
        n = int(np.prod(shape))
        at += n
        return rest[at - n : at].reshape(shape).astype(np.float32)

    net.embed = flat[: 1 << BITS].astype(np.float32)
    net.filters = {k: take((k, DIM, FILTERS)) for k in WIDTHS}
    net.bias, net.out, net.out_bias = take(net.bias.shape), take(net.out.shape), np.float32(take((1,))[0])
    return net


def _shard(shared, number: int, epochs: int, rate: float, seed: int):
    """What a shard changes in the shared network: rows and whole numbers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, vocab = _from_flat(shared.value), {}
        pdf = pdf.sort_values(["doc_id", "text", "lang"], ignore_index=True)
        rng = np.random.default_rng([seed, number, int(pdf["shard"].iloc[0])])
        words = [np.array([vocab.setdefault(w, len(vocab)) for w in alnum_words(t.encode())], np.int64) for t in pdf["text"]]
        descend(own, words, feature_rows(list(vocab)), pdf["toxic"].to_numpy(np.float32), rng, epochs=epochs, rate=rate)
        change = np.rint((_flat(own) - shared.value).astype(np.float64) / GRAIN).astype(np.int64)
        moved = np.flatnonzero(change.any(1))
        return pd.DataFrame({"at": moved, **{f"d{i}": change[moved, i] for i in range(DIM)}})

    return run


def fit(docs: DataFrame, labels: DataFrame, *, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES, seed: int = 5) -> Network:
    """A network of all labelled documents; a quarter of them, by a hash of the
    id, calibrates.  Rows that repeat count once; an id or text that is NULL is
    none or empty; contradicting labels count as toxic."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).join(known, "doc_id").distinct()
    rows = materialize(rows.withColumn("fits", unit_hash(F.col("doc_id"), F.lit(seed)) < 0.75), "toxicity")
    net = Network(seed)
    size = rows.where("fits").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    shards = max(1, -(-size["n"] // shard_docs), -(-(size["b"] or 0) // shard_bytes))
    dealt = rows.where("fits").withColumn("shard", F.floor(unit_hash(F.col("doc_id"), F.col("text"), F.lit(seed + 1)) * shards))
    for number, (epochs, rate) in enumerate((ALONE if shards == 1 else ROUNDS) if size["n"] else ()):
        before = _flat(net)
        shared = spark.sparkContext.broadcast(before)
        changed = dealt.groupBy("shard").applyInPandas(_shard(shared, number, epochs, rate, seed), "at long, " + ", ".join(f"d{i} long" for i in range(DIM)))
        mean = changed.groupBy("at").agg(*[(F.sum(f"d{i}") / F.count("*")).alias(f"d{i}") for i in range(DIM)]).toPandas()
        before[mean["at"].to_numpy()] += (mean[[f"d{i}" for i in range(DIM)]].to_numpy() * GRAIN).astype(np.float32)
        net = _from_flat(before)
        shared.unpersist()
    _calibrate(net, rows)
    discard(rows)
    return net


def _calibrate(net: Network, rows: DataFrame) -> None:
    """Shift and thresholds by language from counts of margins."""
    rest = rows.where("not fits")
    rest = rest if rest.limit(1).count() else rows
    truth = rest.select("doc_id", "toxic").distinct()
    p = F.col("score")
    step = F.floor(F.log(p / (1 - p)) / STEP).cast("long").alias("step")
    scored = score(rest, net, language=True).join(truth, "doc_id")
    counts = scored.groupBy("lang", step).agg(F.count("*").alias("n"), F.sum("toxic").alias("hit")).toPandas()
    if not len(counts):
        return
    total = counts.groupby("step", as_index=False)[["n", "hit"]].sum()
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - counted_threshold(total)
    for lang, own in counts.groupby("lang"):
        if 0 < own["hit"].sum() < own["n"].sum():
            net.by_lang[lang] = float(1 / (1 + np.exp(-(counted_threshold(own) + net.shift))))


def counted_threshold(counts: pd.DataFrame) -> float:
    """``best_threshold`` of counts by step of the margin."""
    own = counts.sort_values("step", ascending=False)
    at, n, hit = own["step"].to_numpy(), own["n"].cumsum().to_numpy(), own["hit"].cumsum().to_numpy()
    k = int((2 * hit / (n + hit[-1])).argmax())
    return float(at[k] + at[k + 1] + 1) / 2 * STEP if k + 1 < len(at) else at[k] * STEP - 1.0


def score(docs: DataFrame, net: Network, language: bool = False) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1), predicted (1 if score >= 0.3),
    threshold (of the row's language, else 0.3) and flagged (score reaches it);
    with ``language`` the language too.

    Only the text enters the score; language chooses the threshold of
    ``flagged`` alone.  NULL and empty texts score what no word scores.
    Repeated rows each get the same score; an empty table gives no row; with
    no labelled document the network is untrained and scores lie near 0.5.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches):
        model = shared.value
        known: dict[bytes, int] = {}
        parts = np.zeros((MAX_CACHE, sum(WIDTHS) * FILTERS), np.float32)
        for batch, texts in chunks(batches):
            words = [alnum_words(x) for x in texts]
            every = [w for ws in words for w in ws]
            held, fresh = len(known), [w for w in dict.fromkeys(every) if w not in known]
            known.update(zip(fresh, range(held, held + len(fresh)), strict=True))
            if len(known) > len(parts):
                parts = np.concatenate([parts[:held], np.zeros((len(fresh), parts.shape[1]), np.float32)])
            if fresh:
                parts[held : len(known)] = model.project(fresh)
            ids = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
            for w in fresh[max(0, MAX_CACHE - held) :]:  # the words met first stay
                del known[w]
            z = model.logits(parts, ids, np.array([len(w) for w in words], np.int64)).astype(np.float64) + model.shift
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            limit = np.array([model.by_lang.get(x, THRESHOLD) for x in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(limit), pa.array(p >= limit)], names=["doc_id", "score", "predicted", "threshold", "flagged"]) if not language else pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), batch.column(2)], names=["doc_id", "score", "lang"])

    return src.mapInArrow(lean(run), "doc_id bigint, score double, lang string" if language else "doc_id bigint, score double, predicted int, threshold double, flagged boolean")
