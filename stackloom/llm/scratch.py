"""Materialised intermediate tables in the folder that all executors share.

A plan is cut by writing a table and reading it again, never by a local
checkpoint: the files outlive any executor.  Shuffle files of a finished write
are released at once, so the disk peak is that of one step, not of their sum.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(spark, "_stackloom_root", None)
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="stackloom-")
            spark._stackloom_root = root
    return root.rstrip("/")


def file_system(uri: str):
    """The pyarrow file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


def delete_path(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_open: list[tuple[SparkSession, str]] = []


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the folders opened after the first `since`; results that still read them must have been written."""
    while len(_open) > since:
        owner, path = _open.pop()
        delete_path(owner, path)


def opened() -> int:
    return len(_open)


@atexit.register
def _release_all() -> None:
    with contextlib.suppress(Exception):
        release(None)


class Scratch:
    """A folder of intermediate tables.

    Operators drop their large tables themselves; what their results read stays
    until release() or the end of the process, as a result is read when its
    caller wants and other DataFrames may derive from it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/stackloom-{name}-{uuid.uuid4().hex}"
        _open.append((spark, self.path))

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df and returns the written table."""
        conf = self.spark.conf
        before = conf.get(_CLEANUP, None)
        with contextlib.suppress(Exception):
            conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{table}")
        finally:
            with contextlib.suppress(Exception):
                if before is None:
                    conf.unset(_CLEANUP)
                else:
                    conf.set(_CLEANUP, before)
        return self.read(table, df.schema)

    def read(self, table: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{table}")

    def drop(self, *tables: str) -> None:
        for t in tables:
            delete_path(self.spark, f"{self.path}/{t}")
