"""Approximate top-k: vectors in cells around trained centroids, few cells searched.

Centroids come from at most SAMPLE vectors (those with the smallest hashes of their ids; a bound of
the fit only). Every vector gets a cell; writing the index partitioned by ``cell`` lets a search
read only the cells that it probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semindex.operators.topk import _merge, _unit, in_blocks, top_k

SAMPLE, ROUNDS, PROBES = 20_000, 12, 8


def cells_for(dimension: int) -> int:
    return min(100, max(10, dimension // 8))


def probes_for(cells: int) -> int:
    """Cells to search: a quarter of them, PROBES at least."""
    return max(PROBES, cells // 4)


def train(corpus: DataFrame, id_col: str, vector_col: str = "embedding", cells: int | None = None, seed: int = 5) -> np.ndarray:
    """(cells, dimension) unit centroids by spherical k-means."""
    rows = corpus.select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    x = np.array([r[1] for r in rows.toLocalIterator()], float)
    if not len(x):
        return np.zeros((0, 0))
    x = _unit(x)
    k = min(len(x), cells or cells_for(x.shape[1]))
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = _unit(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, centroids))
    return centroids


def assign(corpus: DataFrame, centroids: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """``corpus`` with each row's ``cell``."""
    sent = corpus.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("int")
    def cell(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.int32())
        x = np.asarray(vectors.flatten(), float).reshape(len(vectors), -1)
        return pa.array((x @ sent.value.T).argmax(1).astype(np.int32))

    return corpus.withColumn("cell", cell(F.col(vector_col)))


def search(assigned: DataFrame, centroids: np.ndarray, query: list[float], k: int, probes: int = PROBES, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows of the ``probes`` nearest cells."""
    near = np.argsort(-(centroids @ _unit(np.array([query], float))[0]))[:probes]
    return top_k(assigned.filter(F.col("cell").isin([int(c) for c in near])), query, k, id_col, vector_col)


def search_batch(assigned: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int = PROBES, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k best rows of each query's ``probes`` nearest cells.
    ``queries`` has query_id and query_vector; they are taken in blocks, as top_k_batch() does."""
    kind = assigned.schema[id_col].dataType.simpleString()
    rows = assigned.select(id_col, "cell", vector_col)

    def near(part: list):
        matrix = _unit(np.array([r[1] for r in part], float))
        probed = np.zeros((len(part), len(centroids)), bool)
        np.put_along_axis(probed, np.argsort(-(matrix @ centroids.T), axis=1)[:, :probes], True, axis=1)
        sent = assigned.sparkSession.sparkContext.broadcast(([r[0] for r in part], matrix, probed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked, cells = sent.value
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                own, cell = np.array(batch.column(0)), np.asarray(batch.column(1))
                values = np.asarray(batch.column(2).flatten(), float).reshape(batch.num_rows, -1)
                for c in np.unique(cell):
                    here, those = np.flatnonzero(cell == c), np.flatnonzero(cells[:, c])
                    if len(those):
                        merged = _merge([best[q] for q in those], own[here].tolist(), _unit(values[here]) @ asked[those].T, [ids[q] for q in those], k, False)
                        for q, found in zip(those, merged, strict=True):
                            best[q] = found
            out = [(ids[n], i, s) for n, row in enumerate(best) for s, i in row]
            if out:
                q, i, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"query_id": list(q), "id": list(i), "score": list(s)})

        return rows.mapInArrow(run, f"query_id {kind}, id {kind}, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = in_blocks(queries, near, "query_id", "query_vector")
    if found is None:
        return assigned.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, score double, rank int")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(found: Iterator, exact: Iterator) -> float:
    found, exact = set(found), set(exact)
    return len(found & exact) / len(exact) if exact else 1.0
