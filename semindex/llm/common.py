"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least 1/HOT_SHARE of all rows is "hot"; there are HOT_SHARE such keys at most,
#: so a table of the HOT_SHARE largest keys is a broadcast of proven size.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only
    where that is unset in local mode (tests), for on a cluster executors couldn't see it."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="semindex-ckpt-"))
    return context.getCheckpointDir().get()


RELEASE_SECONDS = 10
_released = 0.0


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: an eager checkpoint in the shared folder. Spark removes it with the frame.

    What earlier cuts have made unreachable is let go first, each RELEASE_SECONDS: Spark deletes
    shuffle files and checkpoints only when the driver's garbage collectors have found their owners,
    which a loop of small jobs would otherwise hardly ever cause.
    """
    global _released
    _checkpoint_dir(df.sparkSession)
    if time.monotonic() - _released > RELEASE_SECONDS:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        _released = time.monotonic()
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write as Parquet under the shared folder and read again; the path is for discard()."""
    path = f"{_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what stored() has written, when nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def same_order(docs: DataFrame) -> Column:
    """A hash of all columns of a row: decides ties between rows that agree in what counts."""
    return F.xxhash64(*[F.col(f"`{name}`") if "map" not in kind else F.to_json(F.col(f"`{name}`")) for name, kind in docs.dtypes])


def fit_rows(docs: DataFrame, labelled: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_t, _y): text and label of ``rows`` labelled documents at most, those whose ids hash lowest;
    ``labelled`` has _id and _y. Of an id that repeats, the largest label and the largest text count.
    The ids are chosen from narrow rows first and broadcast, ``rows`` of them at most. (Checkpointed.)"""
    ids = labelled.filter("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).join(F.broadcast(ids), "_id")
    return cut(texts.groupBy("_id").agg(F.max(F.struct("_t", "_y")).alias("r")).select("r._t", "r._y"))


#: At most so many keys are broadcast, after they have been counted.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, keys: list[Column], dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` equal no row of ``dropped`` (null equals null). The narrow
    ``dropped`` is broadcast if it has BROADCAST_KEYS rows at most, so that texts stay where they are."""
    dropped = cut(dropped.toDF(*[f"__drop{i}" for i in range(len(keys))]))
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_KEYS else dropped.hint("merge")
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & key.eqNullSafe(dropped[f"__drop{i}"])
    return docs.join(side, same, "left_anti")


def tidy() -> None:
    """Give freed memory back to the system. Python workers wait for their next task with all that
    their allocators keep, beside an executor that fills its heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(function):
    """A function for mapInArrow() that tidies up at the end of its task."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            tidy()

    return run


def scan_parallelism(df: DataFrame) -> int:
    """Partitions for an exchange that carries about as much as the scan reads."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row for each key, ``size`` = its number of rows).

    Keys in the HOT_SHARE largest groups travel by a broadcast of at most HOT_SHARE rows, all
    others by a shuffle in which no key has more than 1/HOT_SHARE of the rows. Every row finds
    its group in exactly one of the two.
    """
    wide = [c for c in groups.columns if c not in key]
    hot = groups.orderBy(F.desc(size), *key).limit(HOT_SHARE)
    hot = F.broadcast(hot.select(*key, F.struct(*wide).alias("_hot")))
    marked = rows.join(hot, key, "left")
    found = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in wide])
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns)
    return found.unionByName(rest.join(groups.hint("merge"), key, "inner").select(*rows.columns, *wide))
