"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from semindex.llm.common import cut


def _state(edges: DataFrame) -> Row:
    """A checksum of the set of edges: the same set twice is the end."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b, long); component is its smallest node.

    Each round joins every node to its smallest neighbour. Minima are aggregated before the
    shuffle, joins carry two numbers a row and are split where a node is hot; nothing is collected
    but one count and one checksum a round.
    """
    now = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct())
    before = _state(now)
    while True:
        # large star: each larger neighbour of a node goes to the node's smallest neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(joined.select(F.col("m").alias("u"), "v"))
        now = cut(small.filter("u <> v").distinct())
        state = _state(now)
        if state == before:
            break
        before = state
    stars = now.groupBy("v").agg(F.min("u").alias("u"))
    roots = now.select("u").distinct().join(stars.select(F.col("v").alias("u")), "u", "left_anti")
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))
