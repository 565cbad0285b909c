"""Retention and staleness of snapshots (project_id, snapshot_ts, root_hash, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(snapshots: DataFrame, keep: int = 5) -> DataFrame:
    """The ``keep`` newest snapshots of each project, with their ``rank``."""
    order = Window.partitionBy("project_id").orderBy(F.desc("snapshot_ts"), F.desc("snapshot_id"))
    return snapshots.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def expired(snapshots: DataFrame, keep: int = 5) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(F.desc("snapshot_ts"), F.desc("snapshot_id"))
    return snapshots.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") > keep)


def age_seconds(snapshot_ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(snapshot_ts.cast("timestamp"))) / 1e6


def needs_reindex(snapshot_ts: Column, old_root: Column, new_root: Column, now: Column, max_age_minutes: float) -> Column:
    """No snapshot, another root hash, or too old."""
    return snapshot_ts.isNull() | ~old_root.eqNullSafe(new_root) | (age_seconds(snapshot_ts, now) > max_age_minutes * 60)
