"""Scans of directory trees."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semindex.functions import globs, rules


def _root(root: str) -> str:
    return root.rstrip("/") or "/"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to ``root``, length, modified, content) of all files that aren't ignored.

    Ignored names are pruned from the file listing, before anything is opened: the filter is on the
    file's metadata alone. Columns are lazy: a plan that doesn't use ``content`` doesn't read it. The
    root's own name is never matched against the ignore list.
    """
    base = unquote(urlparse(_root(root)).path).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_root(root))
    plain = lambda path: F.regexp_replace(path, r"^[a-z0-9+.-]+:(//[^/]*)?", "")
    below = F.slice(F.split(plain(F.col("_metadata.file_path")), "/"), base.count("/") + 2, 1 << 20)
    kept = files.filter(~F.exists(below, rules.is_ignored_part))
    return kept.select(F.substr(plain(F.col("path")), F.lit(len(base) + 2)).alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def empty_directories(spark: SparkSession, root: str) -> DataFrame:
    """Folders below ``root`` without any file below them, which a file scan can't see: listed on
    the driver through Hadoop's file system, so any store that Spark reads will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(_root(root))
    system = top.getFileSystem(conf)
    found: list[str] = []

    def visit(path, relative: str) -> bool:
        """True if there is a file below."""
        any_file = False
        for status in system.listStatus(path):
            name = status.getPath().getName()
            if ignored(name):
                continue
            if status.isDirectory():
                any_file |= visit(status.getPath(), f"{relative}/{name}" if relative else name)
            else:
                any_file = True
        if not any_file and relative:
            found.append(relative)
        return any_file

    if system.exists(top):
        visit(top, "")
    return spark.createDataFrame([(p,) for p in sorted(found)], "path string")


def ignored(name: str) -> bool:
    return any(name.endswith(x[1:]) if x.startswith("*") else name == x for x in rules.IGNORED)


def supported(files: DataFrame, patterns: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Files that can be chunked, match any glob, and have one of the endings."""
    out = files.filter(rules.is_supported(F.col("path")))
    if extensions is not None:
        wanted = sorted({x.lower() for x in extensions} & set(rules.SUPPORTED))
        out = out.filter(rules.ending(F.col("path")).isin(wanted))
    if patterns:
        out = out.filter(globs.matches_globs(F.col("path"), patterns))
    return out


def texts(files: DataFrame) -> DataFrame:
    """(path, content as text); bytes that aren't UTF-8 are replaced."""
    return files.select("path", F.expr("coalesce(try_validate_utf8(cast(content as string)), make_valid_utf8(cast(content as string)))").alias("content"))
