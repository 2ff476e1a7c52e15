"""Split search and tree growing as relational operators: no row leaves the executors, so n is unbounded.

A level of a tree is one aggregation of (node, feature, bin) rows, each holding the counts by coarse time as
columns, prefix windows over bins, and a top-1 by node; the split table (two rows a node) is then broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grids import bin_column, time_index


def binned_rows(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], grid: Sequence[float], coarse: Sequence[int] | None = None, time: str = "time", event: str = "event") -> DataFrame:
    """b0 .. b{p-1} (bins), t (coarse time bin), tf (full grid index), event."""
    full = time_index(F.col(time), grid)
    split = full if coarse is None else F.get(F.array(*[F.lit(int(c)) for c in coarse]), full)
    return df.select(*[bin_column(c, e).alias(f"b{i}") for i, (c, e) in enumerate(zip(features, edges))], split.alias("t"), full.alias("tf"), F.col(event).cast("int").alias("event"))


def split_statistics(rows: DataFrame, p: int, n_times: int, causes: int = 2, rule: str = "logrankCR", cause: int = 1, min_leaf: int = 1, by: Sequence[str] = ("node",), weights: Sequence[float] | None = None) -> DataFrame:
    """(by.., feature, bin, num, var, stat, n_left, n) of every candidate split "bin <= b" of every node.

    ``rule`` is ``logrankCR`` (all causes pooled; rows of another cause stay at risk), ``relabeled`` (the same risk sets, ``cause`` alone)
    or ``logrank`` (``cause`` alone, others censored).
    """
    if rule not in ("logrankCR", "relabeled", "logrank"):
        raise ValueError(f"unknown rule {rule!r}")
    ts, ks = range(n_times), range(1, causes + 1)
    long = rows.select(*by, "t", "event", F.posexplode(F.array(*[F.col(f"b{i}") for i in range(p)])).alias("feature", "bin"))
    cell = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    counts = long.groupBy(*by, "feature", "bin").agg(*[cell(F.col("t") == j).alias(f"n{j}") for j in ts], *[cell((F.col("t") == j) & (F.col("event") == k)).alias(f"d{k}_{j}") for k in ks for j in ts])
    names = [f"n{j}" for j in ts] + [f"d{k}_{j}" for k in ks for j in ts]
    node = Window.partitionBy(*by, "feature")
    left = node.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(*by, "feature", "bin", *[F.sum(c).over(left).alias(f"l_{c}") for c in names], *[F.sum(c).over(node).alias(f"a_{c}") for c in names])

    # rows at risk and earlier events of other causes, a step of time at a projection: each is the one before and one count more
    counts = counts.withColumns({f"{s}_y{n_times - 1}": F.col(f"{s}_n{n_times - 1}") for s in "al"} | {f"{s}_o{k}_0": F.lit(0.0) for s in "al" for k in ks})
    for j in range(1, n_times):
        back = n_times - 1 - j
        steps = {f"{s}_y{back}": F.col(f"{s}_y{back + 1}") + F.col(f"{s}_n{back}") for s in "al"}
        steps |= {f"{s}_o{k}_{j}": sum((F.col(f"{s}_d{m}_{j - 1}") for m in ks if m != k), F.col(f"{s}_o{k}_{j - 1}")) for s in "al" for k in ks}
        counts = counts.withColumns(steps)

    def at_risk(side: str, j: int) -> Column:
        return F.col(f"{side}_y{j}")

    def others(side: str, k: int, j: int) -> Column:
        return F.col(f"{side}_o{k}_{j}")

    lau = rule != "logrank"
    used = ks if rule == "logrankCR" else [cause]
    num, var = [], []
    for k in used:
        w = 1.0 if weights is None else float(weights[k - 1])
        for j in ts:
            y, yl = at_risk("a", j), at_risk("l", j)
            yi, yli = (y + others("a", k, j), yl + others("l", k, j)) if lau else (y, yl)
            d, dl = F.col(f"a_d{k}_{j}"), F.col(f"l_d{k}_{j}")
            num.append(F.when(y >= (1 if lau else 2), w * (dl - d * yli / F.greatest(yi, F.lit(1.0)))).otherwise(0.0))
            var.append(F.when(y >= 2, w * w * d * yli * (yi - yli) * (yi - d) / (yi * yi * F.greatest(yi - 1, F.lit(1.0)))).otherwise(0.0))
    add = lambda xs: sum(xs[1:], xs[0])
    out = counts.select(*by, "feature", "bin", add(num).alias("num"), add(var).alias("var"), at_risk("l", 0).alias("n_left"), at_risk("a", 0).alias("n"))
    ok = (F.col("n_left") >= min_leaf) & (F.col("n") - F.col("n_left") >= min_leaf) & (F.col("n_left") < F.col("n")) & (F.col("var") >= 1e-12)
    return out.where(ok).withColumn("stat", F.col("num") * F.col("num") / F.col("var"))


def best_splits(stats: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """The largest statistic of each node; ties to the lower feature, then bin."""
    order = F.struct(F.col("stat"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    return stats.where("stat > 0").groupBy(*by).agg(F.max_by(F.struct("feature", "bin", "stat", "n_left", "n"), order).alias("s")).select(*by, "s.*")


def grow(rows: DataFrame, p: int, n_times: int, causes: int = 2, max_depth: int = 3, min_split: int = 6, min_leaf: int = 3, rule: str = "logrankCR", cause: int = 1) -> tuple[DataFrame, list[tuple]]:
    """(rows with their final node, splits as (depth, node, feature, bin, stat)): node i has children 2i and 2i + 1.

    The driver holds the split table only (at most 2^depth rows); every level is one pass over the rows.
    """
    spark = rows.sparkSession
    rows, splits = rows.withColumn("node", F.lit(1).cast("long")), []
    for depth in range(max_depth):
        stats = split_statistics(rows.where(F.col("node") >= (1 << depth)), p, n_times, causes, rule, cause, min_leaf)
        found = [(depth, r["node"], r["feature"], r["bin"], r["stat"]) for r in best_splits(stats).where(F.col("n") >= min_split).collect()]
        if not found:
            break
        splits += found
        table = spark.createDataFrame([(n, f, b) for _, n, f, b, _ in found], "node long, sf int, sb int")
        value = F.get(F.array(*[F.col(f"b{i}") for i in range(p)]), F.col("sf"))
        rows = rows.join(F.broadcast(table), "node", "left").withColumn("node", F.when(F.col("sf").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(value <= F.col("sb"), 0).otherwise(1))).drop("sf", "sb")
    return rows, splits


def leaf_counts(rows: DataFrame, causes: int = 2, t: str = "tf") -> DataFrame:
    """(node, t, n, d_1 .. d_K, y): sufficient statistics of the leaves by grid index."""
    counts = rows.groupBy("node", F.col(t).alias("t")).agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.col("event") > 0, 1.0).otherwise(0.0)).alias("d"), *[F.sum(F.when(F.col("event") == k, 1.0).otherwise(0.0)).alias(f"d_{k}") for k in range(1, causes + 1)])
    return counts.withColumn("y", F.sum("n").over(Window.partitionBy("node").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)))
