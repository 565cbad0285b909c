"""Merkle trees of file tables, level by level from the deepest folder up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semindex.sources.store import materialised

ROOT = "."


def file_nodes(files: DataFrame) -> DataFrame:
    """Nodes of files: path, parent, name, depth, hash, is_file, size. ``files`` has path, content."""
    parts = F.split("path", "/")
    return files.select(
        "path",
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(ROOT).alias("parent"),
        F.element_at(parts, -1).alias("name"),
        F.size(parts).alias("depth"),
        F.sha2("content", 256).alias("hash"),
        F.lit(True).alias("is_file"),
        F.octet_length("content").cast("long").alias("size"),
    )


def build(files: DataFrame, root_name: str, empty_dirs: DataFrame | None = None) -> DataFrame:
    """All nodes of the tree over ``files`` (path relative to the root, content).

    A folder's hash is sha256 of its name and the sorted hashes of its children. One aggregation
    for each level, deepest first: as many rounds as the tree is deep, whatever it holds. Hashes of
    children are sorted in the exchange, which spills, and digested as they pass: a folder may be
    of any width.
    ``empty_dirs`` (path) names folders without any file below them, which a file scan can't see.
    Contents are read once, for the narrow nodes of the files; every level is computed once.
    """
    leaves = materialised(file_nodes(files))
    parts = F.split("path", "/")
    above = leaves.filter(F.col("parent") != ROOT).select(F.col("parent").alias("path"))
    if empty_dirs is not None:
        above = above.unionByName(empty_dirs.select("path"))
    # every folder on the way to a file
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = above.distinct().select(F.explode(prefixes).alias("path")).distinct()
    folders = folders.select(
        "path",
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(ROOT).alias("parent"),
        F.element_at(parts, -1).alias("name"),
        F.size(parts).alias("depth"),
    )
    top = leaves.sparkSession.range(1).select(F.lit(ROOT).alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(root_name).alias("name"), F.lit(0).alias("depth"))
    folders = folders.unionByName(top)
    deepest = folders.agg(F.max("depth")).first()[0]
    done = leaves
    level = leaves.filter(F.col("depth") == deepest + 1)
    for depth in range(deepest, -1, -1):
        here = folders.filter(F.col("depth") == depth).join(_digests(level, root_name), "path", "left")
        digest = F.coalesce("digest", F.sha2(F.col("name"), 256))  # of the name alone, if nothing is in it
        here = here.select("path", "parent", "name", "depth", digest.alias("hash"), F.lit(False).alias("is_file"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
        here = materialised(here) if depth else here  # nothing stands on the root
        done = done.unionByName(here)
        level = leaves.filter(F.col("depth") == depth).unionByName(here)
    return done


def _digests(level: DataFrame, root_name: str) -> DataFrame:
    """(path, digest, size) of the folders right above ``level``: sha256 of a folder's name and the
    sorted hashes in it, and the sum of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state, size = None, None, 0
        for batch in batches:
            n, out = batch.num_rows, []
            if not n:
                continue
            parents, hashes, sizes = batch.columns
            edges = np.flatnonzero(np.asarray(pc.not_equal(parents.slice(1), parents.slice(0, n - 1)))) + 1
            for a, b in zip([0, *edges], [*edges, n], strict=True):
                if parents[a].as_py() != path:
                    if path is not None:
                        out.append((path, state.hexdigest(), size))
                    path, size = parents[a].as_py(), 0
                    state = hashlib.sha256((root_name if path == ROOT else path.rsplit("/", 1)[-1]).encode())
                state.update("".join(h for h in hashes.slice(a, b - a).to_pylist() if h is not None).encode())
                size += pc.sum(sizes.slice(a, b - a)).as_py() or 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "digest", "size"), r, strict=True)) for r in out])
        if path is not None:
            yield pa.RecordBatch.from_pydict({"path": [path], "digest": [state.hexdigest()], "size": [size]})

    rows = level.select("parent", "hash", "size").repartition("parent").sortWithinPartitions("parent", "hash")
    return rows.mapInArrow(run, "path string, digest string, size long")


def stats(nodes: DataFrame) -> DataFrame:
    """One row: node_count, file_count, directory_count, total_size, root_hash."""
    return nodes.agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count_if("is_file").alias("file_count"),
        F.count_if(~F.col("is_file")).alias("directory_count"),
        F.coalesce(F.sum(F.when(F.col("is_file"), F.col("size"))), F.lit(0)).cast("long").alias("total_size"),
        F.max(F.when(F.col("path") == ROOT, F.col("hash"))).alias("root_hash"),
    )


def find_node(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("path") == path)


def file_hashes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_file").select("path", "hash")


def root_hash(nodes: DataFrame) -> str | None:
    row = nodes.filter(F.col("path") == ROOT).select("hash").first()
    return row[0] if row else None


def to_dict(nodes: DataFrame, root_path: str) -> dict:
    """Nested dictionary of a tree, for export; the tree must fit the driver."""
    rows = [r.asDict() for r in nodes.toLocalIterator()]
    children: dict[str | None, list[dict]] = {}
    for r in rows:
        children.setdefault(r["parent"], []).append(r)

    def nested(row: dict) -> dict:
        below = sorted(children.get(row["path"], []), key=lambda r: r["name"]) if not row["is_file"] else []
        return {"path": row["path"], "hash": row["hash"], "is_file": row["is_file"], "size": row["size"], "children": [nested(r) for r in below]}

    root = next(r for r in rows if r["path"] == ROOT)
    return {"root_path": root_path, "root_node": nested(root), "file_count": sum(r["is_file"] for r in rows), "total_size": root["size"]}


def from_dict(spark, data: dict) -> DataFrame:
    """Nodes of a nested dictionary."""
    rows: list[tuple] = []
    todo = [(data["root_node"], None, 0)]
    while todo:
        node, parent, depth = todo.pop()
        rows.append((node["path"], parent, node["path"].rsplit("/", 1)[-1] if depth else data["root_path"].rstrip("/").rsplit("/", 1)[-1], depth, node["hash"], node["is_file"], node["size"]))
        todo += [(child, node["path"], depth + 1) for child in node["children"]]
    return spark.createDataFrame(rows, "path string, parent string, name string, depth int, hash string, is_file boolean, size long")
