"""Exact vector top-k, candidate widening and re-ranking."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semindex.functions import ranking, vectors

RERANK_CAP = 200
#: Queries that one pass over the corpus compares at once (a block of so many vectors is broadcast).
QUERY_BLOCK = 1024


def widened(k: int, filtered: bool) -> int:
    """Candidates to fetch for k results: more if filters or re-ranking follow."""
    return max(20 * k, k + 50) if filtered else min(10 * k, RERANK_CAP)


def similar_fetch(k: int) -> int:
    return min(max(3 * k, k + 1), RERANK_CAP)


def top_k(corpus: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows most similar to one vector, with a ``score``. Ties go to the smaller id.

    One pass with a heap in each task (TakeOrderedAndProject); no shuffle of the corpus.
    """
    scored = corpus.withColumn("score", vectors.similarity(F.col(vector_col), query))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def search_top_k(corpus: DataFrame, query: list[float], k: int, keep: Column | None = None, mode: str = "pre", id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Top-k under a filter: ``pre`` filters first and is complete; ``post`` filters the nearest
    ``widened(k)`` rows, so it can return fewer."""
    if keep is None:
        return top_k(corpus, query, k, id_col, vector_col)
    if mode == "pre":
        return top_k(corpus.filter(keep), query, k, id_col, vector_col)
    if mode != "post":
        raise ValueError(f"unknown filter mode {mode!r}")
    near = top_k(corpus, query, widened(k, True), id_col, vector_col)
    return near.filter(keep).orderBy(F.desc("score"), id_col).limit(k)


def top_k_batch(corpus: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str = "query_id", query_vector: str = "query_vector", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows for each query.

    Queries are taken in blocks of QUERY_BLOCK; a task multiplies each Arrow batch of the corpus
    with a block and keeps its own k best for each query, so that only k rows for each query and
    task are shuffled, whatever the size of the corpus. Null vectors are like nothing.
    """
    spark = corpus.sparkSession
    kind = corpus.schema[id_col].dataType.simpleString()
    rows = corpus.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col)

    def near(part: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r[0] for r in part], _unit(np.array([r[1] for r in part], float))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_pylist()
                values = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                scores = _unit(values) @ matrix.T
                best = _merge(best, own, scores, ids, k, exclude_self)
            if best is not None:
                q, i, s = zip(*[(ids[n], i, s) for n, row in enumerate(best) for s, i in row], strict=True) if any(best) else ((), (), ())
                yield pa.RecordBatch.from_pydict({"query_id": list(q), "id": list(i), "score": list(s)})

        return rows.mapInArrow(run, f"query_id {kind}, id {kind}, score double")

    found = in_blocks(queries, near, query_id, query_vector)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def in_blocks(queries: DataFrame, near: Callable[[list], DataFrame], query_id: str, query_vector: str) -> DataFrame | None:
    """The union of ``near`` of blocks of (id, vector); None without queries."""
    found, block = [], []
    for row in queries.select(query_id, query_vector).toLocalIterator():  # block by block, never all
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            found, block = [*found, near(block)], []
    if block:
        found.append(near(block))
    return functools.reduce(DataFrame.unionByName, found) if found else None


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1.0, size)


def _merge(best, own: list, scores: np.ndarray, ids: list, k: int, exclude_self: bool):
    """The k best (score, id) of each query so far and of this batch."""
    best = best or [[] for _ in ids]
    for n in range(len(ids)):
        column = scores[:, n]
        take = np.arange(len(column))
        if len(column) > 4 * (k + 1):  # all that tie with the k-th stay
            bound = np.partition(column, -(k + 1))[-(k + 1)]
            take = np.flatnonzero(column >= bound)
        rows = best[n] + [(float(column[i]), own[i]) for i in take if not (exclude_self and own[i] == ids[n])]
        best[n] = sorted(rows, key=lambda r: (-r[0], r[1]))[:k]
    return best


def rerank(candidates: DataFrame, query: str, k: int, id_col: str = "chunk_id") -> DataFrame:
    """Order candidates by rank score; ``score`` stays the plain similarity."""
    ranked = candidates.withColumn(
        "rank_score",
        ranking.rank_score(F.lit(query), F.col("score"), F.col("chunk_type"), F.col("name"), F.col("relative_path"), F.col("tags"), F.col("docstring"), F.col("content_preview")),
    )
    return ranked.orderBy(F.desc("rank_score"), F.desc("score"), id_col).limit(k)
