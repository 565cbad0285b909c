"""The engine's entry points: index, search, similar, status, projects, suggestions.

Results are lazy DataFrames; states are versioned tables under one storage folder, a set of tables
for each project. Writing order: index first, then the snapshot, so that a crash between the two
repeats work instead of losing it.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex import schemas
from semindex.functions import embedding, globs, ids
from semindex.functions import text as T
from semindex.operators import changes, context, index_stats, merkle, mutate, snapshots, topk
from semindex.operators.chunking.files import chunk_files
from semindex.sources import files as sources
from semindex.sources.store import VersionedTable, materialised


@dataclass
class IndexResult:
    files_added: int = 0
    files_removed: int = 0
    files_modified: int = 0
    chunks_added: int = 0
    chunks_removed: int = 0
    time_taken: float = 0.0
    success: bool = True
    error: str | None = None


class Project:
    """One indexed directory."""

    def __init__(self, spark: SparkSession, storage: str, root: str, model: embedding.Embedder = embedding.DEFAULT) -> None:
        self.spark, self.root, self.model = spark, root.rstrip("/") or "/", model
        self.id = ids.project_id(self.root)
        self.name = self.root.rsplit("/", 1)[-1]
        base = f"{storage.rstrip('/')}/{self.name}_{self.id[:8]}"
        self.index = VersionedTable(spark, f"{base}/index", schemas.INDEXED)
        self.nodes = VersionedTable(spark, f"{base}/nodes", schemas.NODE)
        self.snapshots = VersionedTable(spark, f"{base}/snapshots", schemas.SNAPSHOT)

    # --- indexing ------------------------------------------------------------------------------

    def scan_nodes(self) -> DataFrame:
        found = sources.scan(self.spark, self.root)
        return merkle.build(found.select("path", "content"), self.name, sources.empty_directories(self.spark, self.root))

    def detect_changes(self, nodes: DataFrame | None = None) -> DataFrame:
        """Against the last snapshot; without one all files are added."""
        return changes.diff(merkle.file_hashes(self.nodes.read()), merkle.file_hashes(self.scan_nodes() if nodes is None else nodes))

    def _embedded(self, paths: DataFrame) -> DataFrame:
        """Indexed rows of the files named by ``paths``; content is read for those only."""
        found = sources.scan(self.spark, self.root).join(paths, "path", "left_semi").select("path", "content")
        chunks = chunk_files(found, self.root)
        # equal ids within a file: the later chunk wins, as it would overwrite the earlier
        chunks = mutate.last_of_each(chunks, "chunk_id", "end_line")
        told = T.embedding_text(F.col("name"), F.col("chunk_type"), F.col("parent_name"), F.col("tags"), F.col("docstring"), F.col("content"))
        return chunks.withColumn("embedding", embedding.embed(told, self.model)).withColumn("model", F.lit(self.model.name))

    def index_directory(self, patterns: list[str] | None = None, incremental: bool = True) -> IndexResult:
        began = time.time()
        # hashed once: what is compared now is what the snapshot will hold, whatever is lost meanwhile
        fresh = materialised(self.scan_nodes())
        full = not incremental or not self.nodes.exists()
        before = self.spark.createDataFrame([], schemas.NODE) if full else self.nodes.read()
        found = changes.diff(merkle.file_hashes(before), merkle.file_hashes(fresh))
        found = materialised(sources.supported(found, patterns))
        counts = changes.summary(found).first()
        result = IndexResult(counts["added"], counts["removed"], counts["modified"])
        if full:
            rows = self._embedded(changes.to_reindex(found))
            self.index.write(rows)
            result.chunks_added = self.index.read().count()
        elif counts["total_changed"]:
            old = self.index.read()
            kept = mutate.delete_files(old, changes.to_remove(found))
            size = old.count()
            result.chunks_removed = size - kept.count()
            self.index.write(mutate.upsert(kept, materialised(self._embedded(changes.to_reindex(found))), order="end_line"))
            result.chunks_added = self.index.read().count() - (size - result.chunks_removed)
        self.nodes.write(fresh)
        self._snapshot(fresh, result, not full)
        result.time_taken = time.time() - began
        return result

    def _snapshot(self, nodes: DataFrame, result: IndexResult, incremental: bool) -> None:
        facts = merkle.stats(nodes).first()
        old = self.snapshots.read()
        row = (self.id, int(time.time() * 1e6), None, self.root, self.name, facts["root_hash"], facts["file_count"], result.chunks_added, incremental)
        new = self.spark.createDataFrame([row], schemas.SNAPSHOT).withColumn("snapshot_ts", F.timestamp_micros("snapshot_id"))
        self.snapshots.write(snapshots.newest(old.unionByName(new), 5).drop("rank"))

    def needs_reindex(self, max_age_minutes: float = 5) -> bool:
        last = snapshots.newest(self.snapshots.read(), 1)
        if last.isEmpty():
            return True
        root = F.lit(merkle.root_hash(self.scan_nodes()))
        return bool(last.select(snapshots.needs_reindex(F.col("snapshot_ts"), F.col("root_hash"), root, F.current_timestamp(), max_age_minutes)).first()[0])

    def reindex_if_needed(self, max_age_minutes: float = 5) -> IndexResult:
        return self.index_directory() if self.needs_reindex(max_age_minutes) else IndexResult()

    def last_snapshot(self) -> DataFrame:
        """The newest snapshot's facts with its age in seconds and the number of chunks now in the
        index; no row without a snapshot."""
        last = snapshots.newest(self.snapshots.read(), 1).drop("rank")
        now = self.index.read().agg(F.count(F.lit(1)).alias("current_chunks"))
        return last.withColumn("age_seconds", snapshots.age_seconds(F.col("snapshot_ts"), F.current_timestamp())).join(F.broadcast(now))

    def export_snapshot(self) -> dict | None:
        """The newest snapshot and its tree as one nested dictionary, for a file outside Spark."""
        last = self.last_snapshot().first()
        if last is None:
            return None
        return {"version": "1.0", "timestamp": last["snapshot_ts"].isoformat(), "dag": merkle.to_dict(self.nodes.read(), self.root)}

    # --- queries -------------------------------------------------------------------------------

    def _filter(self, file_pattern=None, chunk_type: str | None = None, tags: list[str] | None = None):
        keep = None
        for part in (
            globs.matches_globs(F.coalesce("relative_path", "file_path"), file_pattern) if file_pattern else None,
            F.col("chunk_type") == chunk_type if chunk_type else None,
            F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])) if tags else None,
        ):
            if part is not None:
                keep = part if keep is None else keep & part
        return keep

    def search(self, query: str, k: int = 5, file_pattern=None, chunk_type: str | None = None, tags: list[str] | None = None, include_context: bool = True, filter_mode: str = "pre", search_mode: str = "semantic", max_age_minutes: float | None = None) -> DataFrame:
        """The k best chunks, by rank; ``score`` is the plain similarity. Neighbours come with
        ``include_context``. ``max_age_minutes`` re-indexes first if the index is older."""
        if search_mode not in ("auto", "semantic"):
            raise ValueError(f"unknown search mode {search_mode!r}")
        if max_age_minutes is not None:
            self.reindex_if_needed(max_age_minutes)
        vector = embedding.embed_query(query.strip(), self.model)
        keep = self._filter(file_pattern, chunk_type, tags)
        near = topk.search_top_k(self.index.read(), vector, topk.widened(k, False), keep, filter_mode)
        ranked = topk.rerank(near, query, k).drop("embedding")
        return self._in_context(ranked) if include_context else ranked

    def _in_context(self, hits: DataFrame) -> DataFrame:
        around = context.with_context(self.index.read().drop("embedding"), hits).select("chunk_id", "neighbours", "chunks_in_file")
        order = [F.desc("rank_score"), F.desc("score"), "chunk_id"] if "rank_score" in hits.columns else [F.desc("score"), "chunk_id"]
        return hits.join(around, "chunk_id").orderBy(*order)

    def find_similar(self, chunk_id: str, k: int = 5, mode: str = "vector") -> DataFrame:
        """Chunks most like a chunk, without itself; none if there is no such chunk. ``content``
        embeds its plain content anew instead of taking the stored vector."""
        rows = self.index.read()
        own = mutate.lookup(rows, chunk_id).select("embedding", "content").first()
        if own is None:
            return rows.limit(0).drop("embedding").withColumn("score", F.lit(0.0))
        vector = own[0] if mode == "vector" else embedding.embed_document(own[1], self.model)
        near = topk.top_k(rows, [float(x) for x in vector], topk.similar_fetch(k)).filter(F.col("chunk_id") != chunk_id)
        return self._in_context(near.orderBy(F.desc("score"), "chunk_id").limit(k).drop("embedding"))

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return mutate.lookup(self.index.read(), chunk_id)

    def stats(self) -> DataFrame:
        return index_stats.summary(self.index.read()).withColumn("model_name", F.lit(self.model.name)).withColumn("project_id", F.lit(self.id))

    def suggestions(self, partial: str) -> list[str]:
        found = index_stats.suggestions(index_stats.counts(self.index.read()), partial)
        return [r[0] for r in found.collect()]  # five rows at most

    def clear(self) -> None:
        for part in (self.index, self.nodes, self.snapshots):
            part.clear()


def search_rows(found: DataFrame) -> DataFrame:
    """Search results as they are served: file, lines, kind, score, chunk_id, name, snippet."""
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return found.select(
        F.col("relative_path").alias("file"), F.concat_ws("-", "start_line", "end_line").alias("lines"), F.coalesce("chunk_type", F.lit("unknown")).alias("kind"),
        F.round("score", 2).alias("score"), "chunk_id", blank(F.col("name")).alias("name"), blank(T.snippet(F.col("content_preview"))).alias("snippet"),
    )


def similar_rows(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("relative_path").alias("file_path"), F.concat_ws("-", "start_line", "end_line").alias("lines"), "chunk_type", "name",
        F.round("score", 3).alias("similarity_score"), "content_preview", "tags",
    )


def json_or_text(value: str) -> object:
    """A parsed JSON document, or the text under ``result`` if it isn't one."""
    try:
        return json.loads(value)
    except ValueError:
        return {"result": value}


class Service:
    """Projects under one storage folder, one of them current."""

    def __init__(self, spark: SparkSession, storage: str, model: embedding.Embedder = embedding.DEFAULT) -> None:
        self.spark, self.storage, self.model = spark, storage.rstrip("/"), model
        self.catalog = VersionedTable(spark, f"{self.storage}/projects", schemas.PROJECT)
        self.current: Project | None = None

    def project(self, root: str) -> Project:
        return Project(self.spark, self.storage, root, self.model)

    def index_directory(self, root: str, patterns: list[str] | None = None, incremental: bool = True) -> IndexResult:
        project = self.project(root)
        result = project.index_directory(patterns, incremental)
        row = self.spark.createDataFrame([(project.id, project.name, project.root, project.index.read().count())], "project_id string, name string, path string, total_chunks long")
        self.catalog.write(mutate.upsert(self.catalog.read(), row.withColumn("last_indexed", F.current_timestamp()), "project_id"))
        self.current = project
        return result

    def list_projects(self) -> DataFrame:
        return self.catalog.read().orderBy(F.desc("last_indexed"))

    def switch_project(self, root: str) -> Project:
        project = self.project(root)
        known = self.catalog.read().filter((F.col("project_id") == project.id) & (F.col("total_chunks") > 0))
        if known.isEmpty() or not project.index.exists():
            raise LookupError(f"{root} has no index")
        self.current = project
        return project

    def _project(self) -> Project:
        if self.current is None:
            first = self.list_projects().first()
            if first is None:
                raise LookupError("no project is indexed")
            self.current = self.project(first["path"])
        return self.current

    def search_code(self, query: str, k: int = 5, **more) -> DataFrame:
        return search_rows(self._project().search(query, k, **more))

    def find_similar_code(self, chunk_id: str, k: int = 5) -> DataFrame:
        return similar_rows(self._project().find_similar(chunk_id, k))

    def index_status(self) -> DataFrame:
        return self._project().stats()

    def clear_index(self) -> None:
        project = self._project()
        project.clear()
        self.catalog.write(self.catalog.read().filter(F.col("project_id") != project.id))
        self.current = None
