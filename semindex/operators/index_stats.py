"""Statistics of an index, and what is suggested from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10


def counts(chunks: DataFrame) -> DataFrame:
    """(category, value, count): chunk types, tags and folders of all chunks, in one pass."""
    told = F.concat(
        F.array(F.struct(F.lit("chunk_types").alias("category"), F.col("chunk_type").alias("value"))),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.struct(F.lit("top_tags").alias("category"), x.alias("value"))),
        F.transform(F.coalesce("folder_structure", F.array().cast("array<string>")), lambda x: F.struct(F.lit("top_folders").alias("category"), x.alias("value"))),
    )
    return chunks.select(F.explode(told).alias("t")).groupBy("t.category", "t.value").agg(F.count(F.lit(1)).alias("count"))


def top(found: DataFrame, category: str, n: int = TOP) -> DataFrame:
    """The n most frequent values, ranked: a heap in each task, then one of n rows from each."""
    first = found.filter(F.col("category") == category).orderBy(F.desc("count"), "value").limit(n)
    return first.select("value", "count", F.row_number().over(Window.orderBy(F.desc("count"), "value")).alias("rank"))


def summary(chunks: DataFrame) -> DataFrame:
    """One row: total_chunks, files_indexed, embedding_dimension, and maps of the most frequent."""
    base = chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.countDistinct("relative_path").alias("files_indexed"),
        F.max(F.size("embedding")).alias("embedding_dimension") if "embedding" in chunks.columns else F.lit(None).cast("int").alias("embedding_dimension"),
    )
    every = counts(chunks)
    # chunk types are as many as the rule tables name; of tags and folders the TOP are kept
    ranked = every.filter("category = 'chunk_types'")
    for category in ("top_tags", "top_folders"):
        ranked = ranked.unionByName(every.filter(F.col("category") == category).orderBy(F.desc("count"), "value").limit(TOP))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.when(F.col("category") == c, F.struct("value", "count"))))
    maps = ranked.agg(*[pairs(c).alias(c) for c in ("chunk_types", "top_tags", "top_folders")])
    return base.join(F.broadcast(maps))


def suggestions(found: DataFrame, partial: str, n: int = 5) -> DataFrame:
    """Up to n suggestions for the start of a query: tags first, then chunk types."""
    hit = F.contains(F.lower("value"), F.lit(partial.lower()))
    text = F.when(F.col("category") == "top_tags", F.concat(F.lit("Find "), F.col("value"), F.lit(" related code"))).otherwise(
        F.concat(F.lit("Show all "), F.col("value"), F.lit("s"))
    )
    kind = F.when(F.col("category") == "top_tags", 0).otherwise(1)
    rows = found.filter(F.col("category").isin("top_tags", "chunk_types") & hit)
    return rows.select(kind.alias("ord"), "count", "value", text.alias("suggestion")).orderBy("ord", F.desc("count"), "value").limit(n).select("suggestion", "ord", "count", "value")
