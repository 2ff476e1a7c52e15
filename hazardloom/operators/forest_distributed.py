"""Growing a forest over rows that no task could hold.

A level of a batch of trees is one scan: tasks send rows down the trees known so far, count
(tree, node, drawn feature, bin, time, event) cells, and the summed cells of a node decide its split. Only
cells are shuffled; the driver keeps the node arrays of the batch. All draws are hashes (:mod:`draws`), in-bag copies by the
rows' keys, so a tree is the one that a task would grow, and does not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .draws import content_keys, copies, drawn_features, drawn_ranks
from .tree_kernel import TREES, split_scores, tree_frame, tree_of

#: copies of equal rows that one task numbers
COPIES = 1 << 16


def keyed(rows: DataFrame, key: str | None = None) -> DataFrame:
    """``rows`` with row, a number of its own, and key, which draws go by: the column of that name (whole numbers, which it gives up),
    or a hash of the row's content and of its number among equal rows. Either is the same however rows are partitioned."""
    names, width = [c for c in rows.columns if c != key], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if key:
        return rows.select(*names, F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"))
    n = F.col("__n")
    parts = rows.groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES)))).repartition(width, *names, "__b")
    each = parts.withColumn("__i", F.explode(F.sequence(F.col("__b") * COPIES, F.least((F.col("__b") + 1) * COPIES, n) - 1)))
    # sorted, so that a partition that is made again numbers its rows alike
    each = each.sortWithinPartitions(*names, "__i").select(*names, "__i", F.monotonically_increasing_id().alias("row"))

    def run(frames):
        for frame in frames:
            frame["key"] = content_keys([frame[c].to_numpy() for c in names], frame["__i"].to_numpy())
            yield frame[[*names, "key", "row"]]

    return each.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("key", T.LongType()), T.StructField("row", T.LongType())]))


class _Growing:
    """Node arrays of a tree while it grows."""

    def __init__(self):
        self.feature, self.split, self.left, self.depth = np.full(1, -1), np.zeros(1, int), np.zeros(1, int), np.zeros(1, int)
        self.open = np.zeros(1, int)

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        at, live = np.zeros(len(bins), int), np.arange(len(bins))
        while len(live):
            inner = self.feature[at[live]] >= 0
            live = live[inner]
            node = at[live]
            at[live] = self.left[node] + (bins[live, self.feature[node]] > self.split[node])
        return at

    def divide(self, found: dict[int, tuple[int, int]], level: int) -> None:
        nodes = sorted(found)
        first = len(self.feature)
        for i, n in enumerate(nodes):
            self.feature[n], self.split[n] = found[n]
            self.left[n] = first + 2 * i
        grow = lambda x, v: np.concatenate([x, np.full(2 * len(nodes), v)])
        self.feature, self.split, self.left, self.depth = grow(self.feature, -1), grow(self.split, 0), grow(self.left, 0), grow(self.depth, level + 1)
        self.open = np.arange(first, first + 2 * len(nodes))


def leaf_trees(rows: DataFrame, growing: dict[int, _Growing], p: int, seed: int, bootstrap: bool) -> DataFrame:
    """Rows of ``TREES``: trees whose nodes are known, with their leaves' cells from rows (key, b0 .. b{p-1}, t, event)."""
    names = [f"b{i}" for i in range(p)]
    held = rows.sparkSession.sparkContext.broadcast(growing)

    def run(frames):
        for frame in frames:
            bins, t, e, key = frame[names].to_numpy(np.int64), frame["t"].to_numpy(), frame["event"].to_numpy(), frame["key"].to_numpy()
            for tree, g in held.value.items():
                m = copies(key, seed, tree) if bootstrap else np.ones(len(key), int)
                mine = m > 0
                part = pd.DataFrame({"tree": tree, "node": g.nodes_of(bins[mine]), "t": t[mine], "event": e[mine], "n": m[mine]})
                yield part.groupby(["tree", "node", "t", "event"], as_index=False)["n"].sum()

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        g, n = held.value[tree], frame["n"].to_numpy(float)
        node = frame["node"].to_numpy()
        cover = np.bincount(node, weights=n, minlength=len(g.feature))
        for i in np.argsort(g.depth, kind="stable")[::-1]:
            if g.feature[i] >= 0:
                cover[i] = cover[g.left[i]] + cover[g.left[i] + 1]
        made = tree_of(g.feature, g.split, g.left, g.depth, cover, node, frame["t"].to_numpy().astype(np.int64), frame["event"].to_numpy().astype(np.int64), n)
        return tree_frame([(tree, made)])

    counts = rows.mapInPandas(run, "tree int, node int, t int, event int, n long").groupBy("tree", "node", "t", "event").agg(F.sum("n").alias("n"))
    return counts.groupBy("tree").applyInPandas(assemble, TREES)


def grow_forest(rows: DataFrame, p: int, coarse: np.ndarray, *, n_trees: int, seed: int, bootstrap: bool, n_bins: int, n_times: int, causes: int, mtry: int, nsplit: int, max_depth: int | None, min_split: int, min_leaf: int, rule: str, cause: int, weights=None, batch: int = 16) -> DataFrame:
    """Rows of ``TREES`` from rows (key, b0 .. b{p-1}, t, event); ``key`` is a hash that tells rows apart."""
    spark, parts = rows.sparkSession, None
    names = [f"b{i}" for i in range(p)]
    cells = (causes + 1) * n_times

    def counted(growing: dict[int, _Growing]):
        held = spark.sparkContext.broadcast(growing)

        def run(frames):
            for frame in frames:
                bins, t, e, key = frame[names].to_numpy(np.int64), coarse[frame["t"].to_numpy()], frame["event"].to_numpy(), frame["key"].to_numpy()
                for tree, g in held.value.items():
                    m = copies(key, seed, tree) if bootstrap else np.ones(len(key), int)
                    node = g.nodes_of(bins)
                    mine = np.flatnonzero((m > 0) & np.isin(node, g.open))
                    if not len(mine):
                        continue
                    used, back = np.unique(node[mine], return_inverse=True)
                    drawn = drawn_features(used, p, mtry, seed, tree)[back]
                    x = bins[mine[:, None], drawn]
                    cell = ((np.arange(mtry) * n_bins + x) * (causes + 1) + e[mine, None]) * n_times + t[mine, None]
                    fused, where = np.unique(back[:, None] * (mtry * n_bins * cells) + cell, return_inverse=True)
                    n = np.bincount(where.ravel(), weights=np.repeat(m[mine], mtry))
                    yield pd.DataFrame({"tree": tree, "node": used[fused // (mtry * n_bins * cells)], "cell": fused % (mtry * n_bins * cells), "n": n})

        return rows.mapInPandas(run, "tree int, node int, cell long, n double").groupBy("tree", "node", "cell").agg(F.sum("n").alias("n"))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(frame["tree"].iloc[0]), int(frame["node"].iloc[0])
        n = np.zeros(mtry * n_bins * cells)
        n[frame["cell"].to_numpy()] = frame["n"].to_numpy()
        n = n.reshape(mtry, n_bins, causes + 1, n_times)
        size = n[0].sum()
        seen = n.sum(axis=(2, 3)) > 0
        n = n.cumsum(axis=1)
        total = n.sum(axis=2)
        num, var = split_scores(total, n[:, :, 1:], rule, cause, weights)
        left = total[:, :-1].sum(axis=2)
        ok = (left >= min_leaf) & (size - left >= min_leaf) & (var >= 1e-12) & seen[:, :-1]
        drawn = drawn_features(np.array([node]), p, mtry, seed, tree)[0]
        if nsplit > 0:
            many = seen.sum(axis=1) - 1  # all observed bins but the largest
            ranks = drawn_ranks(many, nsplit, np.full(mtry, node), drawn, seed, tree)
            place = np.cumsum(seen, axis=1)[:, :-1] - 1
            ok &= (place[:, :, None] == np.where(ranks < many[:, None], ranks, -1)[:, None, :]).any(axis=2)
        stat = np.where(ok, num * num / np.where(var > 0, var, 1.0), 0.0)
        top = int(np.argmax(stat))
        f, b = divmod(top, n_bins - 1)
        good = size >= min_split and stat.ravel()[top] > 0
        return pd.DataFrame({"tree": [tree], "node": [node], "feature": [int(drawn[f]) if good else -1], "bin": [b]})

    for start in range(0, n_trees, batch):
        growing = {i: _Growing() for i in range(start, min(start + batch, n_trees))}
        level = 0
        while any(len(g.open) for g in growing.values()) and (max_depth is None or max_depth < 0 or level < max_depth):
            found: dict[int, dict] = {i: {} for i in growing}
            for r in counted(growing).groupBy("tree", "node").applyInPandas(best, "tree int, node int, feature int, bin int").where("feature >= 0").collect():
                found[r["tree"]][r["node"]] = (r["feature"], r["bin"])
            for i, g in growing.items():
                g.divide(found[i], level)
            level += 1
        done = leaf_trees(rows, growing, p, seed, bootstrap)
        parts = done if parts is None else parts.union(done)
    return parts
