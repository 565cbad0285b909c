"""Exact duplicate removal (operator 5), DataFrame operations only.

Texts are equal when identical after lower-casing A-Z only; null counts as the empty text.
Rows are grouped by a 128-bit hash of the normalised text *and* the text itself, so the bytes
are compared inside each hash group and a collision makes two groups, not one. Aggregation is
partial before the shuffle: a group that holds a third of all rows leaves each map task as one
row. Ties and repeated rows: equal ids are one id; a null id stays
only in a group without others; of rows with equal ids and texts the drop keeps the one whose columns
hash lowest. A very long text is one row like any other. Empty tables give empty results. Other
columns of the input are never read but by the drop, which returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.llm.common import cut, join_by_hot_key, same_order, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(column: str = "text") -> Column:
    return F.translate(text_or_empty(column), UPPER, LOWER)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names which id of a group stays: ``min`` (the smallest, the default) or ``max``.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("_norm"))
    classes = (
        base.select("doc_id", F.unhex(F.md5("_norm")).alias("_h"), "_norm")
        .groupBy("_h", "_norm")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", F.unhex(F.sha2("_norm", 256)).alias("_sha"), "keep_id", "group_size")
    )
    members = base.select(
        "doc_id", F.unhex(F.md5("_norm")).alias("_h"), F.unhex(F.sha2("_norm", 256)).alias("_sha")
    )
    # both narrow tables are read twice below; the texts are hashed and shuffled once
    joined = join_by_hot_key(cut(members), cut(classes), ["_h", "_sha"], "group_size")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of ``docs`` for each text, with its own columns: that with the smallest (or largest)
    id. Rows with one id and equal texts count as copies, too. Whole rows take part in the partial
    aggregation, so a text moves once."""
    pick = {"min": F.min_by, "max": F.max_by}[keep]
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        normalised(text_col).alias("_norm"),
        F.struct(F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull(), F.col(id_col), F.xxhash64(F.col(text_col)), same_order(docs)).alias("_order"),
    )
    kept = row.groupBy(F.unhex(F.md5("_norm")).alias("_h"), "_norm").agg(pick("_row", "_order").alias("_row"))
    return kept.select("_row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


SQL = f"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
