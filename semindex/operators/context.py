"""What stands around a chunk in its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semindex.functions.text import neighbour_preview


def with_context(chunks: DataFrame, hits: DataFrame | None = None, window: int = 1) -> DataFrame:
    """``chunks`` with ``neighbours`` (chunks next to it in file order) and ``chunks_in_file``.

    With ``hits`` (chunk_id, relative_path) only their files go through the window, and only their
    rows come back.
    """
    rows = chunks
    if hits is not None:
        rows = rows.join(hits.select("relative_path").distinct(), "relative_path", "left_semi")
    in_file = Window.partitionBy("relative_path")
    order = in_file.orderBy("start_line", "end_line", "chunk_id")
    told = F.struct(
        "chunk_id",
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"),
        F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type"),
        "name",
        neighbour_preview(F.col("content_preview"), F.col("content")).alias("preview"),
    )
    near = F.collect_list(told).over(order.rowsBetween(-window, window))
    rows = rows.withColumn("neighbours", F.filter(near, lambda x: x["chunk_id"] != F.col("chunk_id")))
    rows = rows.withColumn("chunks_in_file", F.count(F.lit(1)).over(in_file))
    return rows if hits is None else rows.join(hits.select("chunk_id"), "chunk_id", "left_semi")
