"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import json
import tempfile
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` or the context names it; without one a temporary folder, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="hazardloom-"))
        return _LOCAL[0]
    return named.rstrip("/")


_LOCAL: list[str] = []
_MINE = threading.local()


def _written() -> list[str]:
    """What this thread cut and has not settled: runs in other threads keep their own."""
    if not hasattr(_MINE, "written"):
        _MINE.written = []
    return _MINE.written


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: a short lineage that survives lost executors.

    The files go when the process ends, or earlier by :func:`settle`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hl-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written().append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        pass


def written() -> int:
    """How many frames this thread has cut so far: a mark for :func:`settle`."""
    return len(_written())


def settle(df: DataFrame, since: int) -> DataFrame:
    """:func:`cut`, after which the files that this thread cut ``since`` a mark are no longer needed, and go."""
    out = cut(df)
    while len(_written()) > since + 1:
        _remove(df.sparkSession, _written().pop(since))
    return out


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """Add a row number that a file-backed frame gets again whenever it is read again."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def sampled_splitters(rows: DataFrame, key: Sequence[str], size: str, pieces: int, oversample: int = 16, draw: Sequence[str] = ()) -> list[tuple]:
    """Quantile boundaries of ``key`` by ``size``, from a size-weighted key sample.

    A row is drawn with probability ``min(1, size * m / total)``, ``m = pieces * oversample``,
    by a hash of its key (or of the ``draw`` columns), so a lost task draws the same rows again. The driver gets about
    ``m`` keys, whatever the number of rows, and returns at most ``pieces - 1`` of them.
    """
    total = rows.agg(F.sum(size)).first()[0]
    if not total or pieces < 2:
        return []
    m = pieces * oversample
    drawn = rows.where(hash_unit(F.lit(71), *[F.col(k) for k in draw or key]) * F.lit(float(total)) < F.col(size) * F.lit(float(m)))
    sample = sorted((tuple(r[k] for k in key), max(float(r[size]), total / m)) for r in drawn.select(*key, size).collect())
    weight, out, want = 0.0, [], sum(w for _, w in sample) / pieces
    for k, w in sample:
        if weight >= want * (len(out) + 1) and (not out or out[-1] != k):
            out.append(k)
        weight += w
    return out[: pieces - 1]


def range_index(spark: SparkSession, splitters: Sequence[tuple], names: Sequence[str], types: Sequence[str]) -> Column:
    """How many splitters are at or below the key: a binary search over one constant array."""
    if not splitters:
        return F.lit(0)
    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, types)) + ">>"
    array = F.from_json(F.lit(json.dumps([dict(zip(names, s)) for s in splitters])), kind)
    key = F.struct(*[F.col(n) for n in names])
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(array, at + step - 1) <= key, at + step).otherwise(at),
    )
