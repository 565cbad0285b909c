"""Versioned Parquet tables with an atomic pointer, through Hadoop's file system.

A table is a folder of immutable versions and a file that names the current one. A write makes a
new version and then moves the pointer, so readers see one or the other and a lost driver leaves
the old one. Parquet has no MERGE; an upsert is a new version.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or, only where
    that is unset in local mode (tests), below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='semindex-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df``, computed once and read from the shared folder from now on; survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _child(self, name: str):
        jvm, _, root = self._fs()
        return jvm.org.apache.hadoop.fs.Path(root, name)

    def version(self) -> str | None:
        _, fs, _ = self._fs()
        pointer = self._child(POINTER)
        if not fs.exists(pointer):
            return None
        stream = fs.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self) -> bool:
        return self.version() is not None

    def read(self) -> DataFrame:
        """The current version; empty if there is none."""
        now = self.version()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{now}")

    def write(self, rows: DataFrame, keep: int = 2) -> str:
        """Make ``rows`` the current version; they may come from the old one."""
        name = f"v-{uuid.uuid4().hex}"
        names = [f.split()[0] for f in self._fields()]
        rows.select(*names).write.parquet(f"{self.path}/{name}")
        jvm, fs, root = self._fs()
        fresh = self._child(f"{POINTER}.{name}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        old = self.version()
        pointer = self._child(POINTER)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, pointer, options)
        self._vacuum({name, old} if keep > 1 else {name})
        return name

    def _fields(self) -> list[str]:
        from pyspark.sql.types import StructType

        return [f.name for f in StructType.fromDDL(self.schema).fields]

    def _vacuum(self, keep: set) -> None:
        _, fs, root = self._fs()
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in keep:
                fs.delete(status.getPath(), True)

    def clear(self) -> None:
        _, fs, root = self._fs()
        if fs.exists(root):
            fs.delete(root, True)
