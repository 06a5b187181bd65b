"""Folders for tables that outlive a query, such as indexes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which every node shares; where a session on one machine names none, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written once and read back: what uses it twice does not compute it twice, and joins know its size."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _stamp(spark: SparkSession, path: str) -> tuple:
    """What changes when a table is written anew: its files with their sizes and times."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = system.getFileStatus(where)
    files = system.listStatus(where) if status.isDirectory() else [status]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def once(spark: SparkSession, source: str, name: str, write: Callable[[str], None]) -> str:
    """The folder that `write` filled from the table at `source`, written once an application while that table is the
    same."""
    key = (spark.sparkContext.applicationId, source, name, _stamp(spark, source))
    if key not in _made:
        path = fresh(spark, name)
        write(path)
        _made[key] = path
    return _made[key]
