"""Toxicity scoring (operator 1): a weighted lexicon matched by Aho-Corasick.

Text is folded first: case, homoglyphs, invisible characters, digits and signs that stand for
letters. The automaton finds lexicon entries at word starts (and whole words, for entries marked
so); exception phrases cover hits that are meant harmlessly. The summed weights, normalised by
length, become a score between 0 and 1.

The lexicon starts from a few fixed words and learns the rest from labelled rows: word starts and
words whose share among toxic documents is far above their share among the others. It is fitted
on at most FIT_ROWS labelled rows (those with the smallest hashes of their ids; the documented bound
of the fit). Executors count the words of whole texts; the driver gets the few that tell the labels
apart, each in MIN_DOCS toxic rows at least, and three numbers a row.

Null and empty texts score as texts without hits; very long texts are scored whole. Ids may repeat or
be null: each row gives one row, and a null id is never held out. Without any labelled row the fixed
words are used. Empty tables give empty results. Other columns are never inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import fit_rows, table, tidied, tidy

FIT_ROWS = 20_000
MIN_DOCS = 5
ODDS = 2.0
THRESHOLD = 0.3

# Seed words with weights, and phrases in which a word is harmless.
SEEDS = {"idiot": 3.0, "moron": 3.0, "stupid": 2.5, "scum": 3.0, "loser": 2.5, "worthless": 2.5, "pathetic": 2.5, "disgusting": 2.5, "trash": 2.0, "clown": 2.0}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "circus clown", "clown fish", "clownfish", "pond scum", "sore loser board")
# Characters that look like a Latin letter.
HOMOGLYPHS = dict(zip("аеорсухіѕјԁһӏկոսցАВЕКМНОРСТХΑΒΕΗΙΚΜΝΟΡΤΥΧαοινρτυ", "aeopcyxisjdhlqnugabekmhopctxabehikmnoptyxaoivptu", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "8": "b"}
_GLYPHS = {ord(a): b for a, b in HOMOGLYPHS.items()} | {c: chr(c - 0xFF21 + 97) for c in range(0xFF21, 0xFF3B)} | {c: chr(c - 0xFF41 + 97) for c in range(0xFF41, 0xFF5B)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))


def fold(text: str) -> str:
    """Lower case, homoglyphs to Latin letters, and digits or signs to letters where a letter
    touches them on both sides or on the left and right through other such signs."""
    out = text.lower()
    if not out.isascii():
        out = out.translate(_GLYPHS)
    if any(c in out for c in LEET):
        out = _LEET_RUN.sub(lambda m: m[0].translate(_LEET_TABLE), out)
    return out


_LEET_TABLE = str.maketrans(LEET)
_SIGNS = re.escape("".join(LEET))
#: A sign run inside a word, or signs at a word's start: "1d1ot", "m0r0n", "$tupid".
_LEET_RUN = re.compile(rf"(?<![^\W_])[{_SIGNS}]+(?=[^\W\d_])|(?<=[^\W\d_])[{_SIGNS}]+(?=[^\W\d_])")


@dataclass
class Lexicon:
    """entries: (text, whole word?) to weight. The score is logistic(scale * weights / length**power + bias)."""

    entries: dict[tuple[str, bool], float]
    scale: float = 1.0
    bias: float = -2.0
    power: float = 0.25
    exceptions: tuple[str, ...] = EXCEPTIONS
    _built: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._built is None:
            import ahocorasick

            built = ahocorasick.Automaton()
            rows: dict[str, list] = {}
            for (word, whole), weight in self.entries.items():
                rows.setdefault(word, []).append((len(word), whole, weight))
            for phrase in self.exceptions:
                rows.setdefault(phrase, []).append((len(phrase), None, 0.0))
            for word, value in rows.items():
                built.add_word(word, value)
            if rows:
                built.make_automaton()
            self._built = built
        return self._built

    def __getstate__(self):
        return self.__dict__ | {"_built": None}

    def raw(self, text: str | None) -> tuple[float, int]:
        """Summed weight, one entry for each word start (the heaviest), and the number of hits."""
        if not text or not self.entries:
            return 0.0, 0
        folded = fold(text)
        n, best, covered = len(folded), {}, []
        for end, values in self.automaton().iter(folded):
            for size, whole, weight in values:
                start = end + 1 - size
                if start and folded[start - 1].isalpha():
                    continue
                if whole is None:
                    covered.append((start, end))
                elif not whole or end + 1 == n or not folded[end + 1].isalpha():
                    if abs(weight) > abs(best.get(start, 0.0)):
                        best[start] = weight
        if covered:
            inside = {p for a, b in covered for p in range(a, b + 1)}
            best = {s: w for s, w in best.items() if s not in inside}
        return sum(best.values()), len(best)

    def score(self, text: str | None) -> float:
        weight, _ = self.raw(text)
        z = self.scale * weight / length(text) ** self.power + self.bias
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def length(text: str | None) -> float:
    """Words of a text, about."""
    return max(1.0, len(text or "") / 6)


_WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6, 8)


def candidates(text: str | None) -> set[tuple[str, bool]]:
    """Words (whole) and word starts of a folded text."""
    words = set(_WORD.findall(fold(text or "")))
    out = {(w, True) for w in words if len(w) >= 3}
    for k in STARTS:
        out |= {(w[:k], False) for w in words if len(w) >= k}
    return out


def lexicon_of(counts: dict[tuple[str, bool], tuple[int, int]], pos: int, neg: int) -> Lexicon:
    """The entries that tell ``pos`` toxic rows from ``neg`` others; ``counts`` has the number of
    rows of both kinds with each candidate."""
    found = []
    for key, (a, b) in counts.items():
        odds = math.log(((a + 0.5) / (pos + 1)) / ((b + 0.5) / (neg + 1)))
        pooled = (a + b) / (pos + neg)
        z = (a / pos - b / neg) / math.sqrt(max(1e-12, pooled * (1 - pooled) * (1 / pos + 1 / neg)))
        if a >= MIN_DOCS and odds > ODDS and z > 6.0:
            found.append((key, min(6.0, odds)))
    # a word start that nearly always continues the same way gives way to the longer entry
    longest: dict[str, int] = {}
    for (word, whole), _ in found:
        for k in range(3, len(word) + whole):
            longest[word[:k]] = max(longest.get(word[:k], 0), counts[word, whole][0])
    kept = {key: odds for key, odds in sorted(found) if key[1] or longest.get(key[0], 0) < 0.9 * counts[key][0]}
    return Lexicon({(w, False): v for w, v in SEEDS.items()} | kept)


def calibrate(lexicon: Lexicon, rows: list[tuple[float, float, int]]) -> Lexicon:
    """Learn the three numbers of the score from (weight, words, label) rows."""
    raws, words, y = (np.array(c, float) for c in zip(*sorted(rows), strict=True))
    best = None
    for power in (0.0, 0.25, 0.5, 0.75, 1.0):  # the length normalisation that explains the labels best
        x = raws / words**power
        scale, bias = logistic(x, y)
        z = np.clip(scale * x + bias, -30, 30)
        loss = float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, power, scale, bias)
    _, lexicon.power, lexicon.scale, lexicon.bias = best
    return lexicon


def fit(rows: list[tuple[str | None, int]]) -> Lexicon:
    """Learn from (text, label) rows."""
    pos = sum(y for _, y in rows)
    if not pos or pos == len(rows):
        return Lexicon({(w, False): v for w, v in SEEDS.items()})
    both = Counter(), Counter()
    for t, y in rows:
        both[1 - y].update(candidates(t))
    lexicon = lexicon_of({key: (n, both[1][key]) for key, n in both[0].items()}, pos, len(rows) - pos)
    return calibrate(lexicon, [(lexicon.raw(t)[0], length(t), y) for t, y in rows])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton's method for one feature, lightly regularised."""
    spread = float(np.std(x)) or 1.0
    u, w = x / spread, np.zeros(2)
    design = np.stack([u, np.ones_like(u)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.01 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1])


def fit_on(rows: DataFrame) -> Lexicon:
    """fit() on a frame (_t, _y): the same lexicon, with texts read in the executors only."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = Counter(), Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                both[1 - y].update(candidates(text.as_py()))
            keys = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *[pa.array([n[k] for k in keys], pa.int64()) for n in both]],
                names=["word", "whole", "a", "b"],
            )

    kinds = dict(rows.groupBy("_y").count().collect())
    pos, neg = kinds.get(1, 0), kinds.get(0, 0)
    if not pos or not neg:
        return fit([])
    counts = rows.mapInArrow(tidied(counted), "word string, whole boolean, a long, b long").groupBy("word", "whole").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    telling = counts.filter((F.col("a") >= MIN_DOCS) & (F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1)) > ODDS - 1e-6))
    lexicon = lexicon_of({(r[0], r[1]): (r[2], r[3]) for r in telling.collect()}, pos, neg)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.raw(t)[0] for t in texts], pa.float64()), pa.array([length(t) for t in texts], pa.float64()), batch.column(1)], names=["raw", "words", "y"])

    found = rows.mapInArrow(tidied(weighed), "raw double, words double, y int").collect()  # three numbers a row
    return calibrate(lexicon, [tuple(r) for r in found])


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and number of hits of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(tidied(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with its own columns."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        found = pa.array([lexicon.score(x.as_py()) < threshold for x in texts], pa.bool_())
        tidy()
        return found

    return docs.filter(clean(F.col(text_col).cast("string")))


def crc_fold(divisor: int, id_col: str = "_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def held_out(divisor: int, remainder: int, id_col: str = "doc_id"):
    """Is the row of that fold? Null ids are of none."""
    return F.coalesce(crc_fold(divisor, id_col) == remainder, F.lit(False)).alias("held_out")


def train(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Lexicon:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    return fit_on(fit_rows(docs, labels.filter(crc_fold(4) != 2), FIT_ROWS))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), train(spark, sf_dir))
    return scored.select("doc_id", held_out(4, 2), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
