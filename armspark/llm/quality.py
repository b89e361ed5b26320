"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word bucket and every word shape has a fixed sparse ternary index vector. A bucket's context vector is the sum of the
index vectors of its neighbours, in whole numbers, so that partial sums of any tasks add up to the same
vectors. A document is the mean and the spread of its words' unit vectors. A two-layer numpy network gives a logit,
and a temperature fitted on rows that did not train the network makes it a probability.

Vectors, network and temperature are fitted on about ``sample`` labelled rows (a documented bound; rows are taken by a
hash of their id). The vector table has a fixed number of buckets, so it is a bounded broadcast. Scoring is one
map over the documents: no shuffle, whole texts, and nothing but the text goes in.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, text_bytes

SAMPLE = 20_000
BUCKETS, SHAPES, DIM, WINDOW, NONZERO = 1 << 15, 1 << 10, 64, 2, 6
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 2e-3, 1e-4
HELD_OUT_FOLD, CALIBRATION_PART = 0, 8
THRESHOLD = 0.3
_ROWS, _CHUNK, _SHORT = 4096, 50_000, 64
_RUNS = re.compile(rb"[A-Z]+|[0-9]+|[a-z\x80-\xff]+|(?s:(.)\1*)")


def shape_of(word: bytes) -> bytes:
    """Runs of capitals, digits and other letters as U, 9 and a; any other character once per run."""

    def sign(m):
        first = m[0][:1]
        return b"U" if first.isupper() else b"9" if first.isdigit() else first if m[1] else b"a"

    return _RUNS.sub(sign, word)


class Codes(dict):
    """Word -> bucket * SHAPES + shape, remembered up to a bounded number of short words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        code = zlib.crc32(word.lower()) % BUCKETS * SHAPES + zlib.crc32(shape_of(word)) % SHAPES
        if len(word) <= _SHORT:
            self[word] = code
        return code


def codes_of(text: bytes, codes: Codes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary rows: buckets first, then shapes."""
    rng = np.random.default_rng(seed)
    rows = np.zeros((BUCKETS + SHAPES, DIM), np.int32)
    at = rng.integers(0, DIM, (len(rows), NONZERO))
    np.put_along_axis(rows, at, rng.choice(np.array([-1, 1], np.int32), at.shape), axis=1)
    return rows


def add_contexts(code: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add the neighbours' index vectors to the context vectors of each word's bucket and shape."""
    bucket, shape = code // SHAPES, BUCKETS + code % SHAPES
    own = index[bucket] + index[shape]
    near = np.zeros_like(own)
    for step in range(1, WINDOW + 1):
        near[step:] += own[:-step]
        near[:-step] += own[step:]
    for ids in (bucket, shape):
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        into[ids[order][first]] += np.add.reduceat(near[order], first, axis=0)


FEATURES = 4 * DIM + 1


def pooled(code: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the bucket and shape vectors, and the log of the length. No words: zeros."""
    out = np.zeros(FEATURES, np.float32)
    if not len(code):
        return out
    for part, ids in enumerate((code // SHAPES, BUCKETS + code % SHAPES)):
        total, square = np.zeros(DIM), np.zeros(DIM)
        for at in range(0, len(ids), _CHUNK):
            rows = vectors[ids[at : at + _CHUNK]]
            total += rows.sum(axis=0)
            square += np.einsum("ij,ij->j", rows, rows)
        mean = total / len(ids)
        out[2 * part * DIM : (2 * part + 1) * DIM] = mean
        out[(2 * part + 1) * DIM : (2 * part + 2) * DIM] = np.sqrt(np.maximum(square / len(ids) - mean * mean, 0.0))
    out[-1] = np.log1p(len(code)) / 10.0
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.centre) / self.scale) @ self.w1 + self.b1, 0.0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x) / self.temperature, -40.0, 40.0)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Log loss by Adam on shuffled batches. Without rows: a network that says one half."""
    width = x.shape[1]
    if not len(x):
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0)
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = ((x - centre) / scale).astype(np.float32)
    p = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
    mean, square, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            before = z[rows] @ p[0] + p[1]
            hidden = np.maximum(before, 0.0)
            out = 1.0 / (1.0 + np.exp(-np.clip(hidden @ p[2] + p[3][0], -40, 40)))
            error = (out - y[rows]) / len(rows)
            back = np.outer(error, p[2]) * (before > 0)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(0), hidden.T @ error + DECAY * p[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))


def calibrate(network: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature with the least log loss on rows the network has not seen."""
    if len(x):
        logit = network.logit(x)

        def loss(t):
            return np.mean(np.logaddexp(0.0, np.where(y > 0, -logit, logit) / t))

        network.temperature = float(min(np.exp(np.linspace(-1.5, 3.0, 181)), key=loss))
    return network


def _features(rows: DataFrame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and calibration flags of the sampled rows (label, text), in an order that no partitioning changes."""
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        codes, table = Codes(), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = [pooled(codes_of(t, codes), table).tobytes() for t in texts]
            keys = [zlib.crc32(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), pa.array(x, pa.binary())], names=["k", "label", "x"])

    texts = rows.select("label", text_bytes())
    found = texts.mapInArrow(run, "k long, label long, x binary").orderBy("k", "label", "x").toArrow()
    shared.destroy()
    x = np.empty((found.num_rows, FEATURES), np.float32)
    at = 0
    for chunk in found.column("x").chunks:
        for value in chunk:
            x[at] = np.frombuffer(value.as_buffer(), np.float32)
            at += 1
    keys = found.column("k").to_numpy().astype(np.int64)
    # Another mix of the hash than the order: an eighth of the texts.
    return x, found.column("label").to_numpy().astype(np.float64), (keys // 7919) % CALIBRATION_PART == 0


def _contexts(rows: DataFrame, index: np.ndarray) -> np.ndarray:
    """Unit context vectors. A task sends the vectors it has touched; they are whole numbers, added up per row in Spark."""
    def run(batches):
        codes, index = Codes(), index_vectors()
        context = np.zeros_like(index)
        for batch in batches:
            for text in batch.column(0):
                code = codes_of(text.as_py(), codes)
                for at in range(0, len(code), _CHUNK):
                    add_contexts(code[at : at + _CHUNK], index, context)
        touched = np.flatnonzero(context.any(axis=1))
        for at in range(0, len(touched), _ROWS):
            ids = touched[at : at + _ROWS]
            numbers = pa.array(context[ids].ravel().astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(numbers) + 1, DIM), pa.int32()), numbers)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["row", "part"])

    parts = rows.select(text_bytes()).mapInArrow(run, "row long, part array<long>")
    sums = parts.groupBy("row").agg(*[F.sum(F.col("part")[i]).alias(f"d{i}") for i in range(DIM)]).toArrow()
    vectors = index.astype(np.float32)
    ids = sums.column("row").to_numpy()
    for i in range(DIM):
        vectors[ids, i] = sums.column(f"d{i}").to_numpy()
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    return vectors


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Vectors and network from about ``sample`` labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", HELD_OUT_FOLD, sample, "quality-sample")
    vectors = _contexts(rows, index_vectors())
    x, y, apart = _features(rows, vectors)
    return vectors, calibrate(train_network(x[~apart], y[~apart]), x[apart], y[apart])


def _scored(rows: DataFrame, vectors: np.ndarray, network: Network, keep: bool) -> DataFrame:
    """rows: text bytes last. keep: the rows at or over the threshold without the bytes; else (doc_id, score)."""
    shared = rows.sparkSession.sparkContext.broadcast((vectors, vars(network)))  # plain values: a broadcast is pickled by reference
    last = len(rows.columns) - 1

    def run(batches):
        codes, (table, fitted) = Codes(), shared.value
        net = Network(**fitted)
        for batch in batches:
            scores = np.zeros(0)
            if batch.num_rows:
                scores = net.probability(np.stack([pooled(codes_of(t.as_py(), codes), table) for t in batch.column(last)]))
            if keep:
                columns = [batch.column(i) for i in range(last)]
                out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])
                yield out.filter(pa.array(scores >= THRESHOLD))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, rows.drop(rows.columns[-1]).schema if keep else "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    NULL or empty text: the score of a text without words. NULL doc_id: fold of the empty text. Repeated rows are scored each;
    repeated labels count once. Labels that are not 0 or 1, or whose document is missing, are left out; without labels every
    score is one half. Other columns are ignored.
    """
    vectors, network = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return _scored(rows, vectors, network, keep=False).select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns as they were."""
    vectors, network = fit(docs, labels, sample)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text bytes", F.coalesce(F.col(names[docs.columns.index("text")]), F.lit("")).cast("binary"))
    return _scored(rows, vectors, network, keep=True).toDF(*docs.columns)
