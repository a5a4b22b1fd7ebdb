"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are hashed to `BUCKETS` slots. Each slot has a fixed sparse ternary index vector; its context vector
is the sum of the index vectors of the words around all its occurrences in the whole corpus (partial sums
per task, one native aggregation over slots). A word's vector is its centred, normalised context vector
plus its own index vector; a document pools its words' vectors weighted by rarity (mean and spread). A
network of one hidden layer, trained in numpy on at most `MAX_TRAIN` labelled rows, gives a logit whose
temperature is set on a part of those rows kept out of the training.

What reaches the driver and the broadcast is BUCKETS x (DIM + 1) numbers, whatever the corpus.

Defined cases: a null or empty text has the zero vector and gets the network's score for it; null labels
or ids are not learned from; with one class only (or no rows) every score is that share of positives
(0.5); a document with several labels contributes each; repeated rows and extra columns change nothing;
very long texts are pooled whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, free_name, text_of, text_udf

BUCKETS = 1 << 15
DIM = 40
NONZERO = 4
#: Words of context on each side.
REACH = 2
#: Labelled rows the network is trained on, at most.
MAX_TRAIN = 20_000
HIDDEN = 24
EPOCHS = 60


def index_vectors() -> np.ndarray:
    """The fixed index vector of each slot: NONZERO entries of +1 or -1."""
    rng = np.random.default_rng(20240)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), axis=1)
    return out


class _Slots(dict):
    """word -> slot, remembering up to a bounded number of words."""

    def __missing__(self, word: str) -> int:
        slot = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        if len(self) < 400_000:
            self[word] = slot
        return slot


_SLOTS = _Slots()


def slots(text: str) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_SLOTS.__getitem__, words), dtype=np.int32, count=len(words))


def _add_contexts(ids: np.ndarray, index: np.ndarray, sums: np.ndarray) -> None:
    """Add to each slot's row the index vectors around its occurrences; the last column counts them. A slot of -1 ends a document."""
    real = ids >= 0
    rows = np.where(real[:, None], index[np.maximum(ids, 0)], np.float32(0))
    around = np.zeros_like(rows)
    for k in range(1, REACH + 1):
        around[k:] += rows[:-k]
        around[:-k] += rows[k:]
    own, around = ids[real].astype(np.uint16), around[real]
    if not len(own):
        return
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    sums[own[first], :-1] += np.add.reduceat(around[order], first, axis=0)
    sums[own[first], -1] += np.diff(np.append(first, len(own)))


def context_sums(docs: DataFrame) -> DataFrame:
    """slot, c0..c{DIM-1}, n: the context vectors and counts over all documents."""
    names = [*(f"c{k}" for k in range(DIM)), "n"]

    def run(batches):
        index, sums = index_vectors(), np.zeros((BUCKETS, DIM + 1), dtype=np.float64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                held += [slots(text), np.full(REACH, -1, np.int32)]
                size += len(held[-2])
                if size > 200_000:
                    _add_contexts(np.concatenate(held), index, sums)
                    held, size = [], 0
            if held:
                _add_contexts(np.concatenate(held), index, sums)
        used = np.flatnonzero(sums[:, -1])
        for part in np.array_split(used, max(1, len(used) // 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(sums[part, k]) for k in range(DIM + 1))], names=["slot", *names])

    rows = docs.select(text_of(docs).alias("text")).mapInArrow(run, "slot int, " + ", ".join(f"{c} double" for c in names))
    return rows.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names))


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and pooling weights of all slots."""
    sums = np.zeros((BUCKETS, DIM + 1))
    for row in context_sums(docs).toLocalIterator():
        sums[row[0]] = row[1:]
    n = sums[:, -1]
    mean = sums[:, :-1] / np.maximum(n, 1)[:, None]
    mean -= sums[:, :-1].sum(axis=0) / max(n.sum(), 1)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    vectors = np.where(length > 0, mean / np.maximum(length, 1e-12), 0) + index_vectors() / np.sqrt(NONZERO)
    weights = 1 / (1 + np.log1p(n))
    return vectors.astype(np.float32), weights.astype(np.float32)


def pool(text: str, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted mean and spread of a document's word vectors, and the log of its length."""
    ids = slots(text)
    if not len(ids):
        return np.zeros(2 * DIM + 1, dtype=np.float32)
    w = weights[ids]
    w = w / w.sum()
    v = vectors[ids]
    mean = w @ v
    return np.concatenate((mean, w @ (v * v) - mean * mean, [np.log1p(len(ids)) / 10])).astype(np.float32)


class Network:
    """Two layers (tanh, logistic) with standardised inputs and a calibrated temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = 0 < self.share < 1 and len(y) >= 10
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        kept, train = order[: len(y) // 5], order[len(y) // 5 :]
        shape = x.shape[1]
        p = [rng.normal(0, shape**-0.5, (shape, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for at in range(0, len(train), 256):
                xb, yb = x[train[at : at + 256]], y[train[at : at + 256]]
                h = np.tanh(xb @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yb) / len(yb)
                gh = np.outer(g, p[2]) * (1 - h * h)
                grads = [xb.T @ gh + 1e-4 * p[0], gh.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                step += 1
                for k, grad in enumerate(grads):  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z, t = self._logit(x[kept]), y[kept]
        loss = lambda temp: np.mean(np.logaddexp(0, z / temp) - t * z / temp)
        self.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class QualityModel:
    """Word vectors and network; `column` scores a text column."""

    def __init__(self, spark, vectors, weights, network):
        self.shared = spark.sparkContext.broadcast((vectors, weights))
        self.network = network

    def column(self, text: Column) -> Column:
        shared, network = self.shared, self.network

        def make():
            vectors, weights = shared.value
            return lambda texts: network.score(np.array([pool(t, vectors, weights) for t in texts]).reshape(len(texts), -1)).tolist() if texts else []

        return text_udf(make, "double", pa.float64())(text)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", max_train: int = MAX_TRAIN) -> QualityModel:
    """Word vectors over all of `docs`; the network on labelled rows whose doc_id satisfies `usable` (a column of doc_id)."""
    spark = docs.sparkSession
    vectors, weights = word_vectors(docs)
    shared = spark.sparkContext.broadcast((vectors, weights))
    named = labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    named = named.where(usable) if usable is not None else named
    chosen = bounded_sample(named, F.struct("doc_id", "y"), max_train)

    def pooled(batches):
        vectors, weights = shared.value
        for batch in batches:
            x = [pool(t, vectors, weights).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["y", "x"])

    rows = docs.select("doc_id", text_of(docs).alias("text")).join(chosen, "doc_id").select("y", "text").mapInArrow(pooled, "y int, x array<float>")
    rows = sorted((r.y, tuple(r.x)) for r in rows.toLocalIterator())
    x = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), 2 * DIM + 1)
    network = Network(x, np.array([r[0] for r in rows], dtype=np.float64))
    return QualityModel(spark, vectors, weights, network)


def score(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; `held_out` maps a doc_id column to a boolean one."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.column(text_of(docs)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.5) -> DataFrame:
    """`docs` without the documents scoring below `threshold`."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    name = free_name(docs, "score_")
    return docs.withColumn(name, model.column(text_of(docs))).where(F.col(name) >= threshold).drop(name)
