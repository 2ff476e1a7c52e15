"""Streams of outcomes: curves kept up to date, and scoring.

The counts of (group, time, event) are a mergeable sufficient statistic of every estimator in
``operators.incidence``. :func:`maintain_curves` keeps them in a streaming aggregation and derives the curves anew with each
micro-batch. :func:`append_counts` keeps no state: each micro-batch adds a table of its own counts, so its work follows the batch and not what came before; the counts are
merged when curves are asked for (:func:`current_curves`), and tables that have piled up are merged by :func:`compact`.
Scoring a stream needs nothing special: ``predict`` of any fitted model works on a streaming frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.incidence import cif_variance
from ..operators.scans import running


def outcome_counts(stream: DataFrame, by: Sequence[str] = (), arrived: str | None = None, delay: str = "1 hour", window: str | None = None) -> DataFrame:
    """Counts by (group, time, event); with ``arrived`` (record timestamp) late records beyond ``delay`` are dropped,
    and with ``window`` counts are kept by arrival window, which bounds the state."""
    if arrived:
        stream = stream.withWatermark(arrived, delay)
    keys = [*by, "time", "event"] + ([F.window(arrived, window).alias("arrival")] if arrived and window else [])
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def curves_from_counts(counts: DataFrame, by: Sequence[str] = (), causes: int = 2) -> DataFrame:
    """Incidence and variance columns from (by.., time, event, n)."""
    n = F.col("n").cast("double")
    table = counts.groupBy(*by, "time").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("event") != 0, n).otherwise(0.0)).alias("d"), *[F.sum(F.when(F.col("event") == k, n).otherwise(0.0)).alias(f"d_{k}") for k in range(1, causes + 1)])
    return cif_variance(running(table, by, "time", {"y": ("sum", F.col("n"), "onward")}), by, causes)


def maintain_curves(stream: DataFrame, path: str, checkpoint: str, by: Sequence[str] = (), causes: int = 2, trigger: dict | None = None) -> StreamingQuery:
    """Write the current curves to ``path`` after each micro-batch (replacing them); restart from ``checkpoint``."""

    def refresh(batch: DataFrame, _: int) -> None:
        curves_from_counts(batch, by, causes).write.mode("overwrite").parquet(path)

    writer = outcome_counts(stream, by).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(refresh)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_counts(stream: DataFrame, path: str, checkpoint: str, by: Sequence[str] = (), trigger: dict | None = None) -> StreamingQuery:
    """Add the counts (by.., time, event, n) of each micro-batch to ``path``; restart from ``checkpoint``.

    A batch has a folder of its own number, which a batch that is made again after a failure replaces: nothing counts twice. Batches without rows add nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by, "time", "event").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(**(trigger or {"availableNow": True})).start()


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the folders ``name=number`` that were written to their end."""
    fs, where = _files(spark, path)
    folders = fs.listStatus(where) if fs.exists(where) else []
    return sorted(int(f.getPath().getName().split("=")[1]) for f in folders if fs.exists(_files(spark, f"{f.getPath()}/_SUCCESS")[1]))


def current_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """The counts that :func:`append_counts` has added so far, merged; None where there are none."""
    upto = _numbers(spark, f"{path}/merged")[-1:]
    parts = [f"{path}/merged/upto={n}" for n in upto] + [f"{path}/deltas/batch={n}" for n in _numbers(spark, f"{path}/deltas") if not upto or n > upto[0]]
    if not parts:
        return None
    rows = spark.read.parquet(*parts)
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))


def current_curves(spark: SparkSession, path: str, by: Sequence[str] = (), causes: int = 2) -> DataFrame:
    """Incidence and variance columns of all that :func:`append_counts` has added."""
    counts = current_counts(spark, path)
    if counts is None:
        raise ValueError(f"no counts in {path}")
    return curves_from_counts(counts, by, causes)


def compact(spark: SparkSession, path: str) -> None:
    """Merge the tables of all batches so far into one. Whoever asks next meets either the old tables or the merged one, also if this stops halfway.

    One such call may run at a time, and a reader that is still at work while the old tables go may have to ask again.
    """
    batches = _numbers(spark, f"{path}/deltas")
    merged = _numbers(spark, f"{path}/merged")
    if not batches or (merged and batches[-1] <= merged[-1]):
        return
    current_counts(spark, path).write.mode("overwrite").parquet(f"{path}/merged/upto={batches[-1]}")
    for name in [f"deltas/batch={n}" for n in batches] + [f"merged/upto={n}" for n in merged]:
        fs, where = _files(spark, f"{path}/{name}")
        fs.delete(where, True)
