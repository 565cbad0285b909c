"""Differences between two states of a file table (path, hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDED, REMOVED, MODIFIED, UNCHANGED = "added", "removed", "modified", "unchanged"


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change_type, old_hash, new_hash) of every path of either side: one full outer join."""
    a = old.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("_o"))
    b = new.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("_n"))
    kind = (
        F.when(F.col("_o").isNull(), ADDED).when(F.col("_n").isNull(), REMOVED)
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), UNCHANGED).otherwise(MODIFIED)
    )
    return a.join(b, "path", "full").select("path", kind.alias("change_type"), "old_hash", "new_hash")


def summary(changes: DataFrame) -> DataFrame:
    """One row: counts by type and of all changed paths."""
    count = lambda kind: F.count_if(F.col("change_type") == kind)
    return changes.agg(
        *[count(k).alias(k) for k in (ADDED, REMOVED, MODIFIED, UNCHANGED)],
        F.count_if(F.col("change_type") != UNCHANGED).alias("total_changed"),
    )


def to_reindex(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change_type").isin(ADDED, MODIFIED)).select("path")


def to_remove(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change_type").isin(REMOVED, MODIFIED)).select("path")


def changed_directories(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Folders of the new tree that are new or whose hash differs; deleted folders don't count."""
    a = old_nodes.filter(~F.col("is_file")).select("path", F.col("hash").alias("_old"))
    b = new_nodes.filter(~F.col("is_file")).select("path", "hash")
    return b.join(a, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("_old"))).select("path")


def patterns(changes: DataFrame) -> DataFrame:
    """(category, value, count) of changed paths by ending, folder and type, in one pass."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"[^.].*?(\.[^.]*[^.])$", 1)
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise("root")
    told = F.array(
        F.struct(F.lit("file_extensions").alias("category"), F.when(suffix == "", "no_extension").otherwise(suffix).alias("value")),
        F.struct(F.lit("directories").alias("category"), folder.alias("value")),
        F.struct(F.lit("change_types").alias("category"), F.col("change_type").alias("value")),
    )
    changed = changes.filter(F.col("change_type") != UNCHANGED)
    return changed.select(F.explode(told).alias("t")).groupBy("t.category", "t.value").agg(F.count(F.lit(1)).alias("count"))


def is_same(old_nodes: DataFrame, new_nodes: DataFrame) -> bool:
    """Quick check by root hashes. A rename within a folder keeps the hash; diff() sees it."""
    from semindex.operators.merkle import root_hash

    return root_hash(old_nodes) == root_hash(new_nodes)
