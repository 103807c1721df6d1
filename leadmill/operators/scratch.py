"""Frames written to the folder that driver and executors share, which cuts their lineage.

What is written within a scope is removed at its end, but for what is kept; a scope within a scope keeps things in the
outer one. What is kept outside of any scope stays until the caller removes it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[str | None] = ContextVar("leadmill_scope", default=None)
_own: dict[str, str] = {}  # folders of local sessions without a setting


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, which is one machine, may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="leadmill-")
        _own[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _put(df: DataFrame, tag: str, under: str) -> DataFrame:
    path = f"{under}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame, written once and read again: what reads it twice sees the same rows."""
    return _put(df, tag, _scope.get() or shared_folder(df.sparkSession))


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives keep(df, tag), which writes what outlives the scope."""
    outer = _scope.get() or shared_folder(spark)
    own = f"{outer}/scope-{uuid.uuid4().hex}"
    token = _scope.set(own)
    try:
        yield lambda df, tag: _put(df, tag, outer)
    finally:
        _scope.reset(token)
        removed(spark, own)
