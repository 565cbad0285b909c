"""Upsert, delete and look-up on immutable index frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the one with the largest ``order``, and of those that tie in it the one
    whose columns hash lowest. Rows are reduced before the shuffle."""
    plain = [F.col(f"`{name}`") if "map" not in kind else F.to_json(F.col(f"`{name}`")) for name, kind in rows.dtypes]
    whole = rows.select(F.col(key).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.struct(F.col(order).alias("o"), (-F.xxhash64(*plain)).alias("h")).alias("_order"))
    return whole.groupBy("_key").agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Rows of ``new`` and those of ``existing`` that it doesn't replace. A key that ``new`` holds
    several times gives one row: that with the largest ``order`` (the key itself if not given)."""
    new = last_of_each(new, key, order or key)
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_files(existing: DataFrame, files: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """``existing`` without the chunks of ``files`` (a column of paths)."""
    return existing.join(files.toDF(path_col), path_col, "left_anti")


def lookup(existing: DataFrame, key_value: str, key: str = "chunk_id") -> DataFrame:
    return existing.filter(F.col(key) == key_value)
