"""Quality classification (operator 9): random-indexing word vectors and a small numpy network.

Tokens are runs of letters and digits, runs of signs, and marks for capitals and for a word said
twice in a row. Each token falls into one of BUCKETS buckets by hash and has a fixed sparse index
vector. The word vector of a bucket is the sum of the index vectors of its neighbours over *all*
documents: each task sums whole numbers in one bounded table and the tables are added in Spark, so
the vectors are the same whatever the partitions are. What comes to the driver has BUCKETS rows.

A document is the mean of its tokens' word vectors and index vectors. A two-layer network learns
the labels from the vectors of at most FIT_ROWS labelled documents (those with the smallest hashes
of their ids; documented bound of the fit only) in STEPS steps, however many there are. A
temperature, fitted on documents held back from the training, calibrates its probabilities.

Null and empty texts have no tokens: a zero vector, scored by the network like any other. Very long
texts are pooled whole. Without labels of both kinds the score is the share of label 1 (0.5 without
labels). Ids may repeat or be null: each row gives one row, and a null id is never held out. Empty
tables give empty results. Other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm import textbytes as tb
from semindex.llm.common import fit_rows, table, tidied
from semindex.llm.toxicity import crc_fold, held_out

BUCKETS, DIM, NONZERO, REACH = 8192, 32, 4, 2
FIT_ROWS, HIDDEN, STEPS, RATE, BATCH, DECAY = 20_000, 32, 6_000, 0.01, 64, 1e-4
THRESHOLD = 0.3

_CLASS = np.full(256, 2, np.uint8)  # signs
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
#: Marks that stand beside words: all capitals, one capital first, same word as before.
_MARKS = tb.mix(np.arange(101, 104, dtype=tb.U))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of all tokens in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    inner = kind[starts] > 0
    starts, ends = starts[inner], ends[inner]
    hashes = tb.span_hash(tb.prefix_sums(tb.RANDOM[tb.LOWER[data]], tb.POWERS), starts, ends, tb.POWERS)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals = upper[ends] - upper[starts]
    word = kind[starts] == 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    if len(starts) > 2:  # "word, word," : the same word after a sign
        again[2:] |= word[2:] & (hashes[2:] == hashes[:-2]) & (docs[2:] == docs[:-2])
    marks = [word & (capitals > 1) & (capitals * 2 >= ends - starts), word & (capitals == 1) & (_UPPER[data[starts]] == 1), again]
    order = np.arange(len(starts)) * 4
    all_hashes = np.concatenate([hashes, *[np.full(m.sum(), h) for m, h in zip(marks, _MARKS, strict=True)]])
    all_order = np.concatenate([order + 3, *[order[m] + i for i, m in enumerate(marks)]])
    all_docs = np.concatenate([docs, *[docs[m] for m in marks]])
    by = np.argsort(all_order, kind="stable")
    return (all_hashes[by] % tb.U(BUCKETS)).astype(np.int64), all_docs[by]


def index_vectors() -> np.ndarray:
    """(BUCKETS, DIM) sparse vectors of -1, 0 and 1, from a fixed rule."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    rows = np.arange(BUCKETS, dtype=tb.U)
    for k in range(NONZERO):
        h = tb.mix(rows * tb.U(NONZERO) + tb.U(k + 1))
        at = (h % tb.U(DIM // NONZERO)).astype(np.int64) + k * (DIM // NONZERO)
        out[np.arange(BUCKETS), at] = np.where((h >> tb.U(40)) & tb.U(1), 1, -1)
    return out


def context_sums(bucket: np.ndarray, doc: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add to ``into`` the index vectors of each token's neighbours in its document."""
    n = len(bucket)
    if n < 2:
        return
    own = index[bucket]
    context = np.zeros((n, DIM), np.float32)
    for k in range(1, min(REACH, n - 1) + 1):
        same = (doc[k:] == doc[:-k])[:, None]
        context[k:] += own[:-k] * same
        context[:-k] += own[k:] * same
    for j in range(DIM):
        into[:, j] += np.bincount(bucket, weights=context[:, j], minlength=BUCKETS).astype(np.int64)


_SUMS = ", ".join(["bucket int", *[f"x{j} long" for j in range(DIM)]])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, 2 DIM): normalised context vector and index vector of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((BUCKETS, DIM), np.int64)
        for batch in batches:
            for _, _, data, offsets in tb.chunks(batch.column(0)):
                context_sums(*tokens(data, offsets), index, sums)
        used = np.flatnonzero(np.abs(sums).sum(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(sums[used, j]) for j in range(DIM)]], names=["bucket", *[f"x{j}" for j in range(DIM)]])

    rows = docs.selectExpr(f"cast(`{text_col}` as string) text").mapInArrow(tidied(run), _SUMS).groupBy("bucket").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(DIM)])
    out = np.zeros((BUCKETS, DIM))
    for r in rows.collect():  # BUCKETS rows at most
        out[r[0]] = r[1:]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.concatenate([out / np.maximum(size, 1e-9), index_vectors()], 1).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(rows, 2 DIM) mean vectors of the texts."""
    out = np.zeros((len(column), vectors.shape[1]), np.float32)
    for first, end, data, offsets in tb.chunks(column):
        bucket, doc = tokens(data, offsets)
        if len(bucket):
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[first + doc[at]] = np.add.reduceat(vectors[bucket], at, axis=0) / np.diff(np.append(at, len(bucket)))[:, None]
    return out


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Train on pooled vectors and 0/1 labels, a fifth held back to fit the temperature."""
    dims = x.shape[1] if x.ndim == 2 and len(x) else 2 * DIM
    rng = np.random.default_rng(seed)
    net = Network(np.zeros(dims), np.ones(dims), rng.normal(0, (2 / dims) ** 0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(np.clip(y.mean(), 0.01, 0.99))
        net.w2[:] = 0
        net.b2 = float(np.log(share / (1 - share)))
        return net
    order = rng.permutation(len(y))
    back = order[: len(y) // 5] if len(y) >= 50 else order
    train = order[len(y) // 5 :] if len(y) >= 50 else order
    net.mean, net.spread = x[train].mean(0), x[train].std(0) + 1e-3
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    xs = (x - net.mean) / net.spread
    order = np.zeros(0, int)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(train)):
            order = rng.permutation(train)
        some, order = order[:BATCH], order[BATCH:]
        h = np.maximum(xs[some] @ params[0] + params[1], 0)
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        d = (p - y[some]) / len(some)
        dh = np.outer(d, params[2]) * (h > 0)
        grads = [xs[some].T @ dh + DECAY * params[0], dh.sum(0), h.T @ d + DECAY * params[2], d.sum(keepdims=True)]
        rate = RATE * 0.5 ** (3 * step / STEPS)
        for q, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    z = net.logits(x[back])
    losses = [(float(np.mean(np.logaddexp(0, np.where(y[back] == 1, -z, z) / t))), t) for t in np.exp(np.linspace(-1.5, 2.5, 81))]
    net.temperature = float(min(losses)[1])
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, fold_is, id_col: str = "doc_id", text_col: str = "text") -> Network:
    labelled = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_y")).filter(fold_is)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(0), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))], names=["_y", "x"])

    # sorted, so that the fit doesn't depend on their order
    found = sorted((tuple(r[1]), r[0]) for r in fit_rows(docs, labelled, FIT_ROWS, id_col, text_col).mapInArrow(tidied(run), "_y int, x array<double>").toLocalIterator())
    return fit(np.array([r[0] for r in found], float), np.array([r[1] for r in found], float))


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table_, network = sent.value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(pooled(batch.column(1), table_).astype(np.float64)), pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(tidied(run), "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    net = train(docs, table(spark, sf_dir, "labels"), vectors, crc_fold(5) != 0)
    scored = score_quality(docs, vectors, net)
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
