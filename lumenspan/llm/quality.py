"""Document quality from random-indexing word vectors and a small network.

Each form of a word (the word, its shape, its ending) owns a sparse random
vector of +1 and -1; its context vector is the sum of the random vectors of the
forms that stand within ``WINDOW`` words of it, anywhere in the corpus.  Forms
are hashed to ``ROWS`` rows, so the tables keep their size while the corpus
grows: each task adds up its own rows, and Spark sums them by row.  A document
is the mean and the spread, over all of its words, of the words' random and
context vectors.  A network of two layers, trained in numpy on labelled
documents, reads these; a temperature, fitted on documents set aside, and the
shares of the classes among all labels make its outputs probabilities.

Word vectors come from all documents.  Labels are learnt from a bounded sample:
``train_docs`` documents of each class, of which the driver sees the pooled
vectors and not the text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import bound_batches, chunks, lean, unit_hash

ROWS, DIM, NONZERO, WINDOW, KINDS = 1 << 14, 24, 4, 2, 3
TRAIN_DOCS, HIDDEN, THRESHOLD = 2500, 24, 0.5
#: Text bytes worked on at once; a longer text makes a step of its own.
STEP_BYTES = 4 << 20

#: Bytes of a shape: A for capitals, a for other letters, 0 for digits.
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))
#: White space becomes a space.
_SPACE = bytes(32 if 9 <= i <= 13 else i for i in range(256))


def form_rows(words: list[bytes]) -> np.ndarray:
    """KINDS x words, rows of each word's forms: itself in lower case, its shape
    with repeats taken once, and its last three bytes."""
    if not words:
        return np.zeros((KINDS, 0), np.int64)
    blob = b"\n".join(words)
    shape = np.frombuffer(blob.translate(_SHAPE), np.uint8)
    shapes = shape[np.append(True, shape[1:] != shape[:-1])].tobytes().split(b"\n")
    kinds = [zlib.crc32(w) for w in blob.lower().split(b"\n")], [zlib.crc32(w, 1) for w in shapes], [zlib.crc32(w[-3:], 2) for w in words]
    return np.array(kinds, np.int64) % ROWS


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of all texts, and their owners."""
    parts = pc.split_pattern(pa.array([t.translate(_SPACE) for t in texts], pa.large_binary()), b" ")
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    coded = parts.flatten().dictionary_encode()
    words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if b"" in words:  # space beside space, or no text
        gap = words.index(b"")
        some = ids != gap
        ids, owner = ids[some], owner[some]
        ids[ids > gap] -= 1
        del words[gap]
    return words, ids, owner


def random_vectors(seed: int) -> np.ndarray:
    """DIM x ROWS of 0, and NONZERO of +1 or -1 a row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIM))
    at = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO)), 1)
    return np.ascontiguousarray(out.T)


def context_sums(docs: DataFrame, *, seed: int = 13) -> np.ndarray:
    """DIM x ROWS: per row the sum of the random vectors round its forms, over
    every word of every document."""
    bound_batches(docs.sparkSession)

    def run(batches):
        index = random_vectors(seed)
        total = np.zeros((DIM, ROWS))
        for _, texts in chunks(batches, limit=STEP_BYTES):
            words, ids, owner = numbered(texts)
            rows, none = form_rows(words), len(words)
            at = np.full(len(ids) + WINDOW * (len(texts) + 1), none)
            at[np.arange(len(ids)) + WINDOW * (owner + 1)] = ids  # no window reaches over the gap between texts
            for d in range(DIM):
                vec = np.append(index[d][rows].sum(0), 0.0)[at]
                near = np.zeros(len(at))
                for k in range(1, WINDOW + 1):
                    near[:-k] += vec[k:]
                    near[k:] += vec[:-k]
                sums = np.bincount(at, near, none + 1)[:none]
                for kind in rows:
                    total[d] += np.bincount(kind, sums, ROWS)
        hot = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(hot), *[pa.array(x[hot].astype(np.int64)) for x in total]], names=["at", *[f"d{d}" for d in range(DIM)]])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "at bigint, " + ", ".join(f"d{d} bigint" for d in range(DIM)))
    sums = parts.groupBy("at").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)]).toArrow()  # ROWS rows at most
    out = np.zeros((DIM, ROWS))
    for d in range(DIM):
        out[d, sums.column("at").to_numpy()] = sums.column(f"d{d}").to_numpy()
    return out


def unit_rows(sums: np.ndarray) -> np.ndarray:
    """Context vectors of length one, without what all rows share."""
    scale = np.linalg.norm(sums, axis=0)
    seen = scale > 0
    unit = np.zeros_like(sums)
    unit[:, seen] = sums[:, seen] / scale[seen]
    if seen.any():
        unit[:, seen] -= unit[:, seen].mean(1, keepdims=True)
    return unit


#: Means and spreads of both vectors, likeness of neighbours in each, length.
WIDTH = 4 * DIM + 3


def pooled(batches, context: np.ndarray, seed: int):
    """(batch slice, one row of WIDTH a text) of Arrow batches with texts."""
    index = random_vectors(seed)
    for batch, texts in chunks(batches, limit=STEP_BYTES):
        words, ids, owner = numbered(texts)
        rows = form_rows(words)
        length = np.bincount(owner, minlength=len(texts))
        some = np.flatnonzero(length)
        out = np.zeros((len(texts), WIDTH))
        out[:, -1] = np.log1p(length)
        if len(some):
            n, first = length[some], (np.cumsum(length) - length)[some]
            inside = np.append(owner[1:] == owner[:-1], False)
            for t, vectors in enumerate((index, context)):
                alike = np.zeros(len(ids))
                for d in range(DIM):
                    vec = vectors[d][rows].sum(0)[ids]
                    mean = np.add.reduceat(vec, first) / n
                    out[some, t * DIM + d] = mean
                    out[some, (2 + t) * DIM + d] = np.sqrt(np.maximum(np.add.reduceat(vec * vec, first) / n - mean * mean, 0))
                    alike[:-1] += vec[1:] * vec[:-1]
                out[some, 4 * DIM + t] = np.add.reduceat(alike * inside, first) / n
        yield batch, out


class Network:
    """tanh layer and logistic output over standardized pooled vectors."""

    def __init__(self, width: int = WIDTH, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature, self.prior = 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.prior, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, share: float, *, epochs: int = 60, rate: float = 0.01, batch: int = 64, seed: int = 13) -> Network:
    """Train on three quarters of the rows with both classes weighing the same;
    the rest sets the temperature.  ``share`` is label 1's share of all labels."""
    net = Network(x.shape[1], seed)
    if not len(y) or y.min() == y.max():
        net.w[2][:] = 0
        net.prior = 4.0 * (float(y.mean()) - 0.5) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) * 3 // 4)
    train, rest = order[:cut], order[cut:] if cut < len(y) else order
    net.mean, net.scale = x[train].mean(0), x[train].std(0) + 1e-3
    ones = np.clip(y[train].mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / ones, 0.5 / (1 - ones))
    z = np.clip((x - net.mean) / net.scale, -8, 8)
    m, v, t = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    for _ in range(epochs):
        for lo in range(0, cut, batch):
            pick = train[rng.permutation(cut)[:batch]] if lo else train[:batch]
            h = np.tanh(z[pick] @ net.w[0] + net.w[1])
            d = (1 / (1 + np.exp(-(h @ net.w[2] + net.w[3]))) - y[pick]) * weight[pick] / len(pick)
            back = d[:, None] * net.w[2] * (1 - h * h)
            grad = [z[pick].T @ back + 1e-3 * net.w[0], back.sum(0), h.T @ d + 1e-3 * net.w[2], d.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(grad):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                net.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    net.prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    mass = np.where(y[rest] > 0, share / max(y[rest].mean(), 1e-6), (1 - share) / max(1 - y[rest].mean(), 1e-6))
    logit = net.logits(x[rest])

    def loss(temperature: float) -> float:
        return float((mass * np.logaddexp(0, np.where(y[rest] > 0, -1, 1) * (logit / temperature + net.prior))).mean())

    net.temperature = float(min(2.0 ** np.arange(-3, 5.01, 0.125), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, context: np.ndarray, *, label: str = "quality", train_docs: int = TRAIN_DOCS, seed: int = 13) -> Network:
    """Fit the network to about ``train_docs`` labelled documents of each class.
    Of several labels of an id the largest counts; rows that repeat are one."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, WIDTH)), np.zeros(0), 0.5)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, train_docs / n))])
    picked = known.where(unit_hash(F.col("doc_id"), F.lit(seed)) < rate[F.col("y")])  # about 2 * train_docs rows
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").distinct()
    many = rows.count()
    if many > 3 * train_docs:  # ids with several texts
        rows = rows.where(unit_hash(F.col("doc_id"), F.col("text"), F.lit(seed + 1)) < 2 * train_docs / many)
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(unit_rows(context))

    def run(batches):
        for batch, x in pooled(batches, shared.value, seed):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(lean(run), "doc_id bigint, y int, x array<float>").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, WIDTH)), np.zeros(0), 0.5)
    x = np.stack(got.column("x").to_numpy()).astype(np.float64)
    order = np.lexsort((*x[:, :4].T, got.column("doc_id").to_numpy()))  # rows come in any order
    return fit(x[order], got.column("y").to_numpy().astype(np.float64)[order], counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, context: np.ndarray, net: Network, *, seed: int = 13) -> DataFrame:
    """Per row of docs: doc_id, score (probability of label 1) and predicted (1
    if score >= 0.5).  Only the text enters; NULL and empty texts score what no
    word scores; rows that repeat get the same score; a NULL doc_id stays NULL;
    an empty table gives no row; other columns are not read.  Without labels, or
    with one class only, every document gets one score."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((unit_rows(context), net))

    def run(batches):
        vectors, model = shared.value
        for batch, x in pooled(batches, vectors, seed):
            p = model.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id bigint, score double, predicted int")
