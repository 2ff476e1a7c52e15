"""Feature bins, time grids and the coarse time map, from distinct values in Spark."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans


def cut_points(distinct: np.ndarray, n_bins: int) -> np.ndarray:
    """Edges of one feature from its sorted distinct values: midpoints where they fit the bins, else quantiles."""
    if len(distinct) <= n_bins:
        return (distinct[:-1] + distinct[1:]) / 2
    return sorted_quantiles(distinct, inner_shares(n_bins))


def inner_shares(n: int) -> np.ndarray:
    return np.linspace(0, 1, n + 1)[1:-1]


def sorted_quantiles(values: np.ndarray, qs: np.ndarray) -> np.ndarray:
    """Quantiles of sorted values, in the very arithmetic of :func:`scans.quantiles`."""
    at = np.asarray(qs, float) * (len(values) - 1)
    low = np.floor(at).astype(int)
    part = at - low
    return np.where(part == 0, values[low], (1 - part) * values[low] + part * values[np.ceil(at).astype(int)])


def feature_bin_edges(df: DataFrame, features: Sequence[str], n_bins: int = 256) -> list[np.ndarray]:
    """Midpoints between distinct values where they fit the bins, else exact quantiles of the distinct values: three jobs for all features."""
    if not 2 <= n_bins <= 256:
        raise ValueError("n_bins must be from 2 to 256")
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)]))
    distinct = df.select(pairs.alias("x")).select("x.f", "x.v").distinct()
    count = {r["f"]: r["count"] for r in distinct.groupBy("f").count().collect()}
    few, many = ([f for f, n in count.items() if (n <= n_bins) == small] for small in (True, False))
    found: dict[int, np.ndarray] = {}
    if few:
        for r in distinct.where(F.col("f").isin(few)).groupBy("f").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():
            found[r["f"]] = cut_points(np.array(r["v"]), n_bins)
    if many:
        rows = scans.quantiles(distinct.where(F.col("f").isin(many)), ["f"], "v", inner_shares(n_bins), wide=sum(count.values()) > scans.ONE_TASK)
        found |= {r["f"]: np.array(r["quantiles"]) for r in rows.collect()}
    return [found.get(i, np.zeros(0)) for i in range(len(features))]


def bin_column(x: str | Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value: a value on an edge goes up."""
    x = F.col(x) if isinstance(x, str) else x
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) if len(edges) else F.lit(0)


def bin_to_threshold(edges: Sequence[float], b: int) -> float:
    """The edge above bin ``b``; infinity for the last."""
    return float(edges[b]) if b < len(edges) else float("inf")


def event_time_grid(df: DataFrame, max_points: int | None = 200, time: str = "time", event: str = "event") -> np.ndarray:
    """All distinct event times if they fit (or no limit is set: they then come to the driver), else distinct exact quantiles of them."""
    distinct = df.where(F.col(event) > 0).select(F.col(time).cast("double").alias("v")).distinct()
    n = distinct.count()
    if not n:
        raise ValueError("no event times: every row is censored")
    if max_points is None or n <= max_points:
        return np.array(sorted(r[0] for r in distinct.collect()))
    return np.unique(np.array(scans.quantiles(distinct, [], "v", np.linspace(0, 1, max_points), wide=n > scans.ONE_TASK).first()["quantiles"]))


def time_points(event_times: np.ndarray, max_points: int | None) -> np.ndarray:
    """:func:`event_time_grid` of sorted distinct event times at hand."""
    if not len(event_times):
        raise ValueError("no event times: every row is censored")
    if max_points is None or len(event_times) <= max_points:
        return event_times
    return np.unique(sorted_quantiles(event_times, np.linspace(0, 1, max_points)))


def time_index(time: Column, grid: Sequence[float]) -> Column:
    """Last grid point at or before the time; earlier times share point 0."""
    return F.greatest(bin_column(time, grid) - 1, F.lit(0))


def coarsen_time_grid(grid: np.ndarray, ntime: int) -> np.ndarray:
    """Coarse bin of each point of a rising grid: its rank dealt into ``ntime`` equal shares of the ranks.

    Equal points share the rank of the last of them. Where they leave under half of the bins with a point, bins are
    equal spans of time instead, with a warning. With ``ntime`` points or fewer each is a bin of its own.
    """
    grid = np.asarray(grid, float)
    last = len(grid) - 1
    if ntime > last:
        return np.arange(len(grid))
    rank = np.searchsorted(grid, grid, side="right") - 1
    by_rank = np.minimum(rank * ntime // last, ntime - 1)
    if len(np.unique(by_rank)) >= ntime // 2:
        return by_rank
    warnings.warn(f"repeated grid points leave under half of {ntime} rank bins filled; binning equal time spans", UserWarning, stacklevel=2)
    span = grid[-1] - grid[0]
    return np.minimum(((grid - grid[0]) / (span or 1.0) * ntime).astype(int), ntime - 1)
