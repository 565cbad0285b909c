"""Language identification (operator 6): a byte convolutional network in numpy.

Bytes (lower case A-Z) become short vectors; filters of several widths run over windows of fixed
length; the maximum of each filter over a window feeds a softmax layer. All of it is trained by
gradient descent on labelled texts. A text is scored by the mean of the logits of all its windows,
so every byte counts.

The fit takes FIT_WINDOWS windows at most, of FIT_ROWS labelled rows at most (those with the
smallest hashes of their ids): of each text the window that hashes lowest, then of each the next, so
that any part of a text can be taken. STEPS of gradient descent follow, however many windows there
are. Those bounds are for the fit only, and all that the driver gets are these windows.

Texts that are null or have no letter (Unicode category L) get ``und`` with score 0. Without labelled
rows every text is ``und``; with one label only, that label has probability 1. Very long texts are
scored whole. Ids may repeat or be null: each row gives one row, and a null id is never held out.
Empty tables give empty results. Other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm import textbytes as tb
from semindex.llm.common import fit_rows, table, tidied
from semindex.llm.toxicity import crc_fold, held_out

WINDOW, WIDTHS, FILTERS, DIM = 128, (2, 3, 4), 12, 6
FIT_ROWS, FIT_WINDOWS, STEPS, RATE, BATCH = 4_000, 16_000, 750, 0.01, 128
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
PAD = 32  # windows at a text's end are filled with spaces


def windows(data: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """(n, length) windows that cover all bytes; the last one is filled with spaces."""
    n = max(1, -(-len(data) // length))
    out = np.full(n * length, PAD, np.uint8)
    out[: len(data)] = tb.LOWER[data]
    return out.reshape(n, length)


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width * DIM, FILTERS) each
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    _tables: list | None = None

    @classmethod
    def start(cls, labels: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        wide = FILTERS * len(WIDTHS)
        f32 = np.float32
        return cls(
            labels,
            rng.normal(0, 0.5, (256, DIM)).astype(f32),
            [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(f32) for w in WIDTHS],
            [np.zeros(FILTERS, f32) for _ in WIDTHS],
            rng.normal(0, (1 / wide) ** 0.5, (wide, len(labels))).astype(f32),
            np.zeros(len(labels), f32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of a batch of windows (n, length) with label numbers."""
        n, length = x.shape
        e = self.embed[x]
        pooled, where, cols = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            col = np.concatenate([e[:, j : length - w + 1 + j] for j in range(w)], axis=2)
            z = col @ f + b
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            where.append(at)
            cols.append(col)
        h = np.concatenate(pooled, 1)
        logits = h @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        d = p.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g_out, g_out_b = h.T @ d, d.sum(0)
        dh = (d @ self.out.T) * (h > 0)
        g_embed = np.zeros_like(self.embed)
        g_filters, g_bias = [], []
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            part = dh[:, i * FILTERS : (i + 1) * FILTERS]
            picked = cols[i][rows, where[i]]  # (n, FILTERS, w * DIM)
            g_filters.append(np.einsum("nfk,nf->kf", picked, part))
            g_bias.append(part.sum(0))
            back = part[:, :, None] * self.filters[i].T[None]  # (n, FILTERS, w * DIM)
            for j in range(w):
                np.add.at(g_embed, x[rows, where[i] + j], back[:, :, j * DIM : (j + 1) * DIM])
        return loss, [g_embed, *g_filters, *g_bias, g_out, g_out_b]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(n, labels) of windows, by tables of what each pair of bytes adds to each filter."""
        if self._tables is None:
            self._tables = []
            for w, f in zip(WIDTHS, self.filters, strict=True):
                single = [self.embed @ f[j * DIM : (j + 1) * DIM] for j in range(w)]
                pairs = [(single[j][:, None, :] + single[j + 1][None]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
                self._tables.append((pairs, single[-1] if w % 2 else None))
        pair = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        pooled = []
        for w, (pairs, odd), b in zip(WIDTHS, self._tables, self.bias, strict=True):
            size = x.shape[1] - w + 1
            z = pairs[0][pair[:, :size]]
            for j, t in enumerate(pairs[1:], 1):
                z += t[pair[:, 2 * j : 2 * j + size]]
            if odd is not None:
                z += odd[x[:, w - 1 : w - 1 + size]]
            pooled.append(np.maximum(z.max(1) + b, 0))
        return np.concatenate(pooled, 1) @ self.out + self.out_bias

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}


def fit_windows(text: str, label: str) -> list[tuple[int, int, bytes, str]]:
    """(rank by hash, hash, window, label) of a text's windows."""
    own = windows(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
    places = np.arange(len(own), dtype=tb.U)
    hashes = tb.mix((own.astype(tb.U) * tb.mix(np.arange(1, WINDOW + 1, dtype=tb.U))).sum(1, dtype=tb.U) + places)
    return [(rank, int(hashes[k] >> tb.U(1)), own[k].tobytes(), label) for rank, k in enumerate(np.argsort(hashes).tolist())]


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Network:
    """Train on (text, label) rows."""
    return fit_on(sorted(w for t, y in rows for w in fit_windows(t, y))[:FIT_WINDOWS], seed)


def fit_on(chosen: list[tuple[int, int, bytes, str]], seed: int = 7) -> Network:
    """Train on windows, as of fit_windows(), with Adam; the same windows give the same network."""
    chosen = sorted(chosen)
    net = Network.start(sorted({w[3] for w in chosen}), seed)
    if len(net.labels) < 2:
        return net
    number = {y: i for i, y in enumerate(net.labels)}
    x, y = np.stack([np.frombuffer(w[2], np.uint8) for w in chosen]), np.array([number[w[3]] for w in chosen])
    rng = np.random.default_rng(seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    order = np.zeros(0, int)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(x)):
            order = rng.permutation(len(x))
        some, order = order[:BATCH], order[BATCH:]
        _, grads = net.gradients(x[some], y[some])
        for p, g, (m, v) in zip(net.parameters(), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, fold_is, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Fit on rows with a language and a letter that satisfy ``fold_is`` (on _id)."""
    named = docs.filter(F.col(text_col).cast("string").rlike(r"\p{L}")).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_y"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = zip(*fit_windows(text.as_py(), label), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["nth", "h", "w", "y"])

    every = fit_rows(docs, named.filter(fold_is), FIT_ROWS, id_col, text_col).mapInArrow(tidied(cut_up), "nth int, h long, w binary, y string")
    chosen = every.orderBy("nth", "h", "w", "y").limit(FIT_WINDOWS).collect()
    return fit_on([(r[0], r[1], bytes(r[2]), r[3]) for r in chosen])


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for first, end, data, offsets in tb.chunks(batch.column(1), 1 << 18):
                logits, counts = [], []
                for i in range(end - first):
                    own = windows(data[offsets[i] : offsets[i + 1]])
                    logits.append(own)
                    counts.append(len(own))
                x = np.concatenate(logits)
                if len(net.labels) > 1:
                    z = np.concatenate([net.logits(x[k : k + 512]) for k in range(0, len(x), 512)])
                else:
                    z = np.zeros((len(x), max(1, len(net.labels))))
                ends = np.cumsum(counts)
                mean = np.add.reduceat(z, ends - counts, axis=0) / np.array(counts)[:, None]
                mean -= mean.max(1, keepdims=True)
                p = np.exp(mean)
                p /= p.sum(1, keepdims=True)
                for i in range(end - first):
                    text = batch.column(1)[first + i].as_py()
                    if not net.labels or text is None or _LETTER.search(text) is None:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(p[i].argmax())
                        langs.append(net.labels[best])
                        scores.append(float(p[i, best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    texts = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return texts.mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, crc_fold(3) != 1))
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score")
