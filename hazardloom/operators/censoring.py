"""The three Kaplan-Meier estimators of censoring, which must never be mixed up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import is_wide, running, with_blocks


def _by_time(df: DataFrame, by: Sequence[str], deaths, time: str, event: str, weight: str | None = None) -> DataFrame:
    wide = None if weight else is_wide(df, *by, time)  # weighted rows are many: their counts are stored and counted, not made twice
    m = F.col(weight).cast("double") if weight else F.lit(1.0)
    counts = df.groupBy(*by, F.col(time).alias("time")).agg(F.sum(m).alias("n"), F.sum(F.when(deaths(F.col(event)), m).otherwise(0.0)).alias("d"))
    return running(with_blocks(counts, "time", wide), by, "time", {"y": ("sum", F.col("n"), "onward")})


def _with_g(counts: DataFrame, by: Sequence[str], lost, base) -> DataFrame:
    keep = F.when(base > 0, 1 - lost / F.when(base > 0, base).otherwise(1.0)).otherwise(1.0)
    return running(counts, by, "time", {"g": ("product", keep, "upto"), "g_left": ("product", keep, "before")})


def km_censor_uno(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """Only code 1 is a death; other causes count as censored; deaths leave the risk set first."""
    c = _by_time(df, [], lambda e: e == 1, time, event)
    return _with_g(c, [], F.col("n") - F.col("d"), F.col("y") - F.col("d"))


def km_censor_score(df: DataFrame, by: Sequence[str] = (), time: str = "time", event: str = "event", weight: str | None = None) -> DataFrame:
    """Every cause is a death; deaths leave the risk set first. ``weight`` counts a row's copies."""
    c = _by_time(df, by, lambda e: e != 0, time, event, weight)
    return _with_g(c, by, F.col("n") - F.col("d"), F.col("y") - F.col("d"))


def km_censor_fg(df: DataFrame, by: Sequence[str] = (), time: str = "time", event: str = "event") -> DataFrame:
    """Plain Kaplan-Meier of the censoring indicator over the full risk set, by stratum."""
    c = _by_time(df, by, lambda e: e != 0, time, event)
    return _with_g(c, by, F.col("n") - F.col("d"), F.col("y"))
