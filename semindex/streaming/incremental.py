"""Continuous indexing of new and changed files by Structured Streaming.

A file source reports files once when they appear or are replaced under a new name; each
micro-batch is chunked, embedded and merged into the versioned index. Removals are found by a
periodic full diff (Project.index_directory), which a stream of arrivals can't see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from semindex.functions import embedding
from semindex.functions import text as T
from semindex.operators import mutate
from semindex.operators.chunking.files import chunk_files
from semindex.sources.store import VersionedTable

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/")
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").load(base)
    local = F.regexp_replace("path", r"^[a-z0-9+.-]+:(//[^/]*)?", "")
    return files.select(F.substr(local, F.lit(len(base) + 2)).alias("path"), "content", F.col("modificationTime").alias("modified"))


def index_stream(spark: SparkSession, root: str, index: VersionedTable, checkpoint: str, model: embedding.Embedder = embedding.DEFAULT) -> StreamingQuery:
    """Merge all files that wait into ``index`` and stop. A batch that runs again writes the same."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        files = mutate.last_of_each(batch, "path", "modified")
        chunks = mutate.last_of_each(chunk_files(files.select("path", "content"), root), "chunk_id", "end_line")
        told = T.embedding_text(F.col("name"), F.col("chunk_type"), F.col("parent_name"), F.col("tags"), F.col("docstring"), F.col("content"))
        rows = chunks.withColumn("embedding", embedding.embed(told, model)).withColumn("model", F.lit(model.name))
        kept = mutate.delete_files(index.read(), files.select("path"))
        index.write(mutate.upsert(kept, rows))

    return arrivals(spark, root).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and time window, with a watermark for late rows; for streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
