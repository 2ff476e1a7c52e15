"""Intermediate tables: written once to a folder that driver and executors share, read wherever they are needed."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: bytes of a row group, all of which a task holds in memory while it writes
ROW_GROUP = 16 << 20

_LOCAL: list[str] = []
_MINE = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` (or the context's checkpoint folder) names; without one a temporary folder, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="hazardloom-"))
    return _LOCAL[0]


def _written() -> list[str]:
    """What this thread wrote and has not released: runs in other threads keep their own."""
    if not hasattr(_MINE, "written"):
        _MINE.written = []
    return _MINE.written


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: made once however often it is read, and safe from lost executors.

    The files go when the process ends, or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hz-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _written().append(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = True
    return out


def mark() -> int:
    """How many tables this thread has stored so far, for :func:`release`."""
    return len(_written())


def release(spark: SparkSession, since: int) -> None:
    """Remove what this thread stored since a :func:`mark`; frames over it can't be read any more."""
    while len(_written()) > since:
        _remove(spark, _written().pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        pass
