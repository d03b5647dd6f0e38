"""Shared storage: checkpoints and scratch folders that outlive any single executor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (session, path) of the scratch folders that no one removed yet.
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a temporary one is set, if Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: later reads neither recompute it nor depend on one executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def few(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A kept table of narrow rows, sent to all tasks if it has no more than `rows`; a larger one is joined as any table is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends if no one has removed it before."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes them (file:/x), and the path in it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    _made[:] = [(s, p) for s, p in _made if p != path]
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in list(_made):
        # a session that has ended can't remove its folders any more
        with contextlib.suppress(Exception):
            remove(spark, path)
