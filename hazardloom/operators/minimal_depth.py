"""Minimal depth over a table of trees (tree_id, node_id, depth, feature, is_leaf)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_depths(trees: DataFrame, p: int) -> DataFrame:
    """(tree_id, feature, depth, used): depth of a feature's first split in each tree; unused features get the tree's height."""
    height = trees.groupBy("tree_id").agg(F.max("depth").alias("height"))
    found = trees.where("not is_leaf").groupBy("tree_id", "feature").agg(F.min("depth").alias("depth"))
    grid = height.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    return grid.join(found, ["tree_id", "feature"], "left").select("tree_id", "feature", F.coalesce("depth", "height").alias("depth"), F.col("depth").isNotNull().alias("used"))


def threshold(trees: DataFrame, p: int) -> DataFrame:
    """One row (threshold, mean_height): the minimal depth expected of a feature without effect.

    ``sum over d < D of (1 - 1/p)^(internal nodes above and at d)`` with forest means of nodes by depth and D the
    rounded (half to even) mean height.
    """
    heights = trees.groupBy("tree_id").agg(F.max("depth").alias("h"))
    forest = heights.agg(F.count("*").alias("n"), F.bround(F.avg("h"), 0).cast("int").alias("D"), F.avg("h").alias("mean_height"))
    inner = trees.where("not is_leaf").groupBy("depth").agg(F.count("*").alias("nodes"))
    grid = forest.withColumn("depth", F.explode(F.sequence(F.lit(0), F.greatest(F.col("D") - 1, F.lit(0)))))
    level = grid.join(inner, "depth", "left").withColumn("mean", F.coalesce("nodes", F.lit(0)) / F.col("n"))
    above = F.sum("mean").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    terms = level.withColumn("term", F.pow(F.lit(1.0 - 1.0 / p), above))
    return terms.agg(F.sum(F.when(F.col("depth") < F.col("D"), F.col("term")).otherwise(0.0)).alias("threshold"), F.first("mean_height").alias("mean_height"))


def minimal_depth(trees: DataFrame, features: Sequence[str]) -> DataFrame:
    p = len(features)
    first = first_depths(trees, p)
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    stats = first.groupBy("feature").agg(F.avg("depth").alias("mean_min_depth"), F.percentile("depth", 0.25).alias("q25"), F.percentile("depth", 0.75).alias("q75"), F.avg(F.col("used").cast("double")).alias("frac_used"))
    joined = stats.join(F.broadcast(threshold(trees, p).select("threshold")))
    return joined.select(name.alias("feature"), "mean_min_depth", "q25", "q75", "frac_used", "threshold", (F.col("mean_min_depth") <= F.col("threshold")).alias("selected")).orderBy("mean_min_depth", "feature")
