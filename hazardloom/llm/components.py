"""Connected components by alternating stars over a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: a vertex with more than this part of the links is joined by broadcast: there are fewer such than this
HUBS = 1000


def _met(links: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``links`` (u, v) with m of ``low`` (u, m, n): hubs, which would fill a task, by broadcast."""
    hubs = F.broadcast(low.where(F.col("n") > total / HUBS).select("u", "m"))
    rest = low.where(F.col("n") <= total / HUBS).select("u", "m")
    return links.join(hubs, "u").unionByName(links.join(hubs.select("u"), "u", "left_anti").join(rest, "u"))


def _at_rest(edges: DataFrame) -> bool:
    """Whether every vertex points at one root, and no root at anything."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b): root is the smallest vertex that v reaches.

    Each round points all larger neighbours of a vertex at the smallest one, then the vertex itself; the
    number of links never grows, and the rounds needed grow with the logarithm of the longest path. Null ends link
    nothing; a link of a vertex with itself, repeated links and an empty table are no matter. RuntimeError if links are
    not at rest after ``rounds``, which no graph of under 2**``rounds`` vertices should need. The driver gets a count a round.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if _at_rest(edges):
            break
        total = edges.count()
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large star: larger neighbours of u meet u's smallest neighbour
        large = cut(_met(both.where("v > u"), low, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # small star: u's smaller neighbours, and u, meet the smallest of them
        small = _met(large, low, total)
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
    else:
        if not _at_rest(edges):
            raise RuntimeError(f"links are not at rest after {rounds} rounds")
    # at rest every edge is (vertex, root)
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root"))).distinct()
