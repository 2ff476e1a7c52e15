"""Exact split search: every midpoint between the distinct values that a node has, against every one of its event times.

Rows of a node are scanned in the order of a feature. A split's numerator is the running sum of a score that each row
has once the node's risk sets are known (its event, less the rates summed over the times it is at risk). Its variance is
a quadratic form of the rows on the left: two rows share the risk sets up to the one that leaves first, so each row adds its own part and, for every row
before it in the order of the feature, the part up to the smaller of two ranks. Those sums over earlier rows are counted by bits of the rank, as
in :mod:`concordance`: n log(times) cell rows a feature and cause in place of n x times counts.

Two forms use the same arithmetic: NumPy over the nodes of a level at once, for nodes that a task may hold, and scans of
tables (:mod:`scans`) for larger ones. Statistics are compared to nine significant digits, ties go to the feature drawn first and then to the smaller value, and draws go by a
node's place in the tree, so both grow the same trees.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import copies, drawn_features, drawn_ranks, mix64
from .scans import running, with_blocks
from .stored import mark, release, stored

#: bytes of a node's in-bag rows (as doubles, copies counted) up to which one task searches it and all below it
NODE_BYTES = 64 << 20
ROOT = 1


def child_of(path: np.ndarray, side: int) -> np.ndarray:
    """The number of a node's child, by which it draws: a hash of 42 bits of its parent's and its side."""
    of = np.asarray(path, np.int64)
    return (mix64(of.reshape(-1).astype(np.uint64) * np.uint64(2) + np.uint64(side)) >> np.uint64(22)).astype(np.int64).reshape(of.shape)


def significant(x: np.ndarray) -> np.ndarray:
    """Positive numbers to nine significant digits."""
    scale = 10.0 ** (8 - np.floor(np.log10(np.maximum(x, 1e-300))))
    return np.round(x * scale) / scale


# ---- in one task -------------------------------------------------------------------------------------------


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums within segments; ``first`` is where the segment of each entry begins."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[1:] - total[first]


def _segments(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the run of equal keys of each entry begins, where it ends) for sorted keys."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    return begin[of], np.append(begin[1:], len(key))[of]


def risk_tables(node: np.ndarray, t: np.ndarray, event: np.ndarray, m: np.ndarray, causes: Sequence[int], lau: bool) -> tuple[np.ndarray, np.ndarray, list, list, list]:
    """For each row: its rank among its node's times, the node's number of ranks, and lists by cause of (rate, spread, reach).

    Rates, spreads and reaches are sums over the times at which a row is at risk of the cause: of d / y, of the variance factor d (y - d) / (y^2 (y - 1)),
    and of that factor times y. Where ``lau``, rows of another cause stay at risk throughout.
    """
    times = int(t.max(initial=0)) + 1
    cell, back = np.unique(node * times + t, return_inverse=True)
    first, end = _segments(cell // times)
    n = np.bincount(back, m)
    at = np.arange(len(cell))
    total = np.concatenate([[0.0], np.cumsum(n)])
    y = total[end] - total[at]
    deaths = {k: np.bincount(back, m * (event == k), minlength=len(cell)) for k in set(event[event > 0].tolist()) | set(causes)}
    rank, last = at - first + 1, end - 1
    a, c, reach = [], [], []
    for k in causes:
        d = deaths[k]
        other = sum((v for j, v in deaths.items() if j != k), np.zeros(len(cell)))
        risk = y + (_sums(other, first) - other if lau else 0.0)
        seen = y >= (1 if lau else 2)
        rate = np.where(seen, d / np.maximum(risk, 1.0), 0.0)
        factor = np.where(y >= 2, d * (risk - d) / (risk * risk * np.maximum(risk - 1, 1.0)), 0.0)
        stays = lau & (event > 0) & (event != k)
        for out, x in ((a, rate), (c, factor), (reach, factor * risk)):
            upto = _sums(x, first)
            out.append(np.where(stays, upto[last[back]], upto[back]))
        a[-1] = a[-1] - np.where((event == k) & seen[back], 1.0, 0.0)  # minus the row's score
    ranks = rank[last[back]]
    return rank[back], ranks, a, c, reach


def pair_sums(node: np.ndarray, rank: np.ndarray, part: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each row, over the rows before it in its node: the sum of m times the part up to the smaller rank.

    ``part`` never falls as the rank rises. Rows are in order, sorted by node.
    """
    out = np.zeros(len(rank))
    order = np.lexsort((rank, node))
    first, _ = _segments(node[order] * (int(rank.max(initial=0)) + 1) + rank[order])
    out[order] = part[order] * (_sums(m[order], first) - m[order])  # of the same rank
    for bit in range(int(rank.max(initial=0)).bit_length()):
        cell = node * ((int(rank.max()) >> (bit + 1)) + 1) + (rank >> (bit + 1))
        order = np.argsort(cell, kind="stable")
        high = (rank[order] >> bit & 1).astype(bool)
        first, _ = _segments(cell[order])
        weight, p = m[order], part[order]
        out[order] += np.where(high, _sums(np.where(high, 0.0, weight * p), first), p * _sums(np.where(high, weight, 0.0), first))
    return out


def node_splits(node: np.ndarray, path: np.ndarray, x: np.ndarray, t: np.ndarray, event: np.ndarray, m: np.ndarray, drawn: np.ndarray, *, causes: int, rule: str, cause: int, weights, min_leaf: int, nsplit: int, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, threshold, left copies) of each node. ``node`` numbers the rows' nodes from 0, sorted; ``x`` (row, slot) holds the drawn features."""
    lau = rule == "logrankCR"
    used = list(range(1, causes + 1)) if lau or weights is not None else [cause]
    w = np.ones(len(used)) if weights is None else np.asarray(weights, float)[[k - 1 for k in used]]
    rank, ranks, a, c, reach = risk_tables(node, t, event, m, used, lau)
    score = -sum(wk * v for wk, v in zip(w, a))
    line = sum(wk * wk * v for wk, v in zip(w, reach))
    nodes, slots = drawn.shape
    size = np.bincount(node, m, minlength=nodes)
    best, feature, threshold, left = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    for slot in range(slots):
        order = np.lexsort((rank, x[:, slot], node))
        g, v, mm = node[order], x[order, slot], m[order]
        first, end = _segments(g)
        square = np.zeros(len(g))
        for k, wk, ck in zip(used, w, c):
            r = np.where(lau & (event > 0) & (event != k), ranks + 1, rank)[order]
            part = ck[order]
            # rows of one value may come in any order, so long as it is one order
            square += wk * wk * (mm * mm * part + 2 * mm * pair_sums(g, r, part, mm))
        edge = np.ones(len(g), bool)
        edge[:-1] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        num, var, n_left = _sums(mm * score[order], first), _sums(mm * line[order], first) - _sums(square, first), _sums(mm, first)
        ok = edge & (np.arange(len(g)) < end - 1) & (n_left >= min_leaf) & (size[g] - n_left >= min_leaf) & (var >= 1e-12) & (var >= 1e-9 * _sums(mm * line[order], first))
        if nsplit > 0:
            place = _sums(edge.astype(float), first).astype(np.int64) - 1
            many = np.bincount(g, edge, minlength=nodes).astype(np.int64) - 1
            chosen = drawn_ranks(many, nsplit, path, drawn[:, slot], seed, tree)
            ok &= (np.where(chosen < many[:, None], chosen, -1)[g] == place[:, None]).any(axis=1)
        stat = np.where(ok, significant(num * num / np.where(var > 0, var, 1.0)), 0.0)
        at = np.flatnonzero(stat > 0)
        if not len(at):
            continue
        pick = at[np.lexsort((at, -stat[at], g[at]))]  # the first of each node's largest
        pick = pick[np.unique(g[pick], return_index=True)[1]]
        pick = pick[stat[pick] > best[g[pick]]]
        best[g[pick]], feature[g[pick]], left[g[pick]] = stat[pick], drawn[g[pick], slot], n_left[pick]
        threshold[g[pick]] = (v[pick] + v[pick + 1]) / 2
    return feature, threshold, left


def grow_below(x: np.ndarray, t: np.ndarray, event: np.ndarray, m: np.ndarray, path: int, depth: int, seed: int, tree: int, *, mtry: int, max_depth: int | None, min_split: int, min_leaf: int, **search) -> list[tuple[int, int, float]]:
    """The splits (path, feature, threshold) of a node and all below it: a level at a time over all rows."""
    out, p = [], x.shape[1]
    t = np.unique(t, return_inverse=True)[1]
    rows, node, paths = np.arange(len(x)), np.zeros(len(x), np.int64), np.array([path], np.int64)
    while len(rows) and (max_depth is None or max_depth < 0 or depth < max_depth):
        live = np.bincount(node, m[rows], minlength=len(paths)) >= min_split
        renumber = np.cumsum(live) - 1
        mine = live[node]
        rows, node, paths = rows[mine], renumber[node[mine]], paths[live]
        if not len(rows):
            break
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        drawn = drawn_features(paths, p, mtry, seed, tree)
        feature, threshold, _ = node_splits(node, paths, x[rows[:, None], drawn[node]], t[rows], event[rows], m[rows].astype(float), drawn, min_leaf=min_leaf, seed=seed, tree=tree, **search)
        cut = feature >= 0
        out += zip(paths[cut].tolist(), feature[cut].tolist(), threshold[cut].tolist())
        mine = cut[node]
        rows, node = rows[mine], (np.cumsum(cut) - 1)[node[mine]]
        feature, threshold, paths = feature[cut], threshold[cut], paths[cut]
        right = x[rows, feature[node]] > threshold[node]
        paths = np.stack([child_of(paths, 0), child_of(paths, 1)], axis=1).ravel()
        node = 2 * node + right
        depth += 1
    return out


# ---- over tables ----------------------------------------------------------------------------------------------


def table_splits(long: DataFrame, ranks: DataFrame | None, *, causes: int, rule: str, cause: int, weights, min_leaf: int) -> DataFrame:
    """(tree, node, slot, threshold, n_left, n) of the best split of each node, by scans: no node needs to fit a task.

    ``long`` has (tree, node, slot, x, t, e, m), one row for each in-bag row and drawn feature; ``ranks`` the drawn candidates (tree, node, slot,
    rank), or None where all are searched.
    """
    lau = rule == "logrankCR"
    used = list(range(1, causes + 1)) if lau or weights is not None else [cause]
    w = {k: 1.0 if weights is None else float(weights[k - 1]) for k in used}
    key, every = ["tree", "node"], range(1, causes + 1)
    long = stored(long.groupBy(*key, "slot", "x", "t", "e").agg(F.sum("m").cast("double").alias("m")))
    times = long.where("slot = 0").groupBy(*key, "t").agg(F.sum("m").alias("n"), *[F.sum(F.when(F.col("e") == k, F.col("m")).otherwise(0.0)).alias(f"d{k}") for k in every])
    others = {k: sum((F.col(f"d{j}") for j in every if j != k), F.lit(0.0)) for k in used}
    times = running(with_blocks(times, "t"), key, "t", {"y": ("sum", F.col("n"), "onward"), "rank": ("sum", F.lit(1.0), "upto")} | {f"o{k}": ("sum", others[k], "before") for k in used})
    sums = {}
    for k in used:
        d, y, risk = F.col(f"d{k}"), F.col("y"), F.col("y") + (F.col(f"o{k}") if lau else 0.0)
        factor = F.when(y >= 2, d * (risk - d) / (risk * risk * F.greatest(risk - 1, F.lit(1.0)))).otherwise(0.0)
        sums |= {f"a{k}": ("sum", F.when(y >= (1 if lau else 2), d / risk).otherwise(0.0), "upto"), f"c{k}": ("sum", factor, "upto"), f"f{k}": ("sum", factor * risk, "upto")}
    times = stored(running(times, key, "t", sums))
    whole = times.groupBy(*key).agg(F.sum("n").alias("size"), F.max("rank").alias("ranks"), *[F.max(f"{c}{k}").alias(f"all_{c}{k}") for k in used for c in "acf"])
    rows = long.join(times.select(*key, "t", "y", "rank", *sums), [*key, "t"]).join(whole, key)
    m, e = F.col("m"), F.col("e")
    stays = lambda k: (e > 0) & (e != k) if lau else F.lit(False)
    upto = lambda c, k: F.when(stays(k), F.col(f"all_{c}{k}")).otherwise(F.col(f"{c}{k}"))
    score = sum((w[k] * (F.when((e == k) & (F.col("y") >= (1 if lau else 2)), 1.0).otherwise(0.0) - upto("a", k)) for k in used), F.lit(0.0))
    line = sum((w[k] * w[k] * upto("f", k) for k in used), F.lit(0.0))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.when(stays(k), F.col("ranks") + 1).otherwise(F.col("rank")).cast("long").alias("r"), upto("c", k).alias("part"), F.lit(w[k] * w[k]).alias("w")) for k in used])
    values = rows.groupBy(*key, "slot", "x").agg(F.sum(m * score).alias("score"), F.sum(m * line).alias("line"), F.sum("m").alias("m"), F.max("size").alias("size"))
    pairs = stored(rows.select(*key, "slot", "x", "m", F.explode(parts).alias("p")).groupBy(*key, "slot", "x", "p.k", "p.r", "p.part", "p.w").agg(F.sum("m").alias("m")))
    bits = int(pairs.agg(F.max("r")).first()[0]).bit_length()
    cells = pairs.withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1)))).withColumn("prefix", F.expr("shiftright(r, bit + 1)"))
    same = F.col("bit") < 0
    cells = cells.withColumn("high", same | (F.expr("shiftright(r, greatest(bit, 0))") % 2 == 1))
    before = {"low": ("sum", F.when(~F.col("high"), m * F.col("part")).otherwise(0.0), "before"), "many": ("sum", F.when(F.col("high"), m).otherwise(0.0), "before")}
    met = running(with_blocks(cells, "x"), [*key, "slot", "k", "bit", "prefix"], ["x", "r"], before)
    earlier = F.when(F.col("high") & ~same, F.col("low")).otherwise(F.col("part") * F.col("many"))
    square = met.groupBy(*key, "slot", "x").agg(F.sum(F.col("w") * (2 * m * earlier + F.when(same, m * m * F.col("part")).otherwise(0.0))).alias("square"))
    scan = with_blocks(values.join(square, [*key, "slot", "x"]), "x")
    scan = running(scan, [*key, "slot"], "x", {n: ("sum", F.col(c), "upto") for n, c in (("num", "score"), ("linear", "line"), ("squares", "square"), ("n_left", "m"))} | {"next": ("next", F.col("x"), "after"), "place": ("sum", F.lit(1.0), "before")})
    var = F.col("linear") - F.col("squares")
    found = scan.withColumn("var", var).where(F.col("next").isNotNull() & (F.col("n_left") >= min_leaf) & (F.col("size") - F.col("n_left") >= min_leaf) & (var >= 1e-12) & (var >= 1e-9 * F.col("linear")))
    if ranks is not None:
        found = found.join(ranks.select(*key, "slot", F.col("rank").cast("double").alias("place")), [*key, "slot", "place"])
    stat = F.col("num") * F.col("num") / F.col("var")
    scale = F.pow(F.lit(10.0), 8 - F.floor(F.log10(F.greatest("stat", F.lit(1e-300)))))
    found = found.withColumn("stat", stat).withColumn("stat", F.round(F.col("stat") * scale) / scale).where("stat > 0")
    order = F.struct(F.col("stat"), (-F.col("slot")).alias("s"), (-F.col("x")).alias("v"))
    best = found.groupBy(*key).agg(F.max_by(F.struct("slot", ((F.col("x") + F.col("next")) / 2).alias("threshold"), "n_left", F.col("size").alias("n")), order).alias("b"))
    return best.select(*key, "b.*")


class _Growing:
    """The splits of a tree that are known, by path."""

    def __init__(self):
        self.splits: dict[int, tuple[int, float]] = {}

    def place(self, x: np.ndarray) -> np.ndarray:
        """The path of the node where each row stands."""
        at = np.full(len(x), ROOT, np.int64)
        todo = [(ROOT, np.arange(len(x)))]
        while todo:
            path, rows = todo.pop()
            if path not in self.splits or not len(rows):
                at[rows] = path
                continue
            feature, threshold = self.splits[path]
            right = x[rows, feature] > threshold
            todo += [(int(child_of(path, 0)), rows[~right]), (int(child_of(path, 1)), rows[right])]
        return at


def grow_exact(rows: DataFrame, p: int, *, n_trees: int, seed: int, bootstrap: bool, causes: int, mtry: int, nsplit: int, max_depth: int | None, min_split: int, min_leaf: int, rule: str, cause: int, weights=None, batch: int = 16) -> dict[int, dict[int, tuple[int, float]]]:
    """{tree: {path: (feature, threshold)}} from rows (x0 .. x{p-1}, time, event, key).

    Nodes of more than ``NODE_BYTES`` of in-bag rows are searched by scans, a level of a batch of trees at once; the rows of each smaller one
    then meet in a task, which grows all below it. The driver holds the splits.
    """
    spark, names, most = rows.sparkSession, [f"x{i}" for i in range(p)], NODE_BYTES // (8 * (p + 4))
    search = dict(causes=causes, rule=rule, cause=cause, weights=None if weights is None else [float(x) for x in weights])
    deep = lambda depth: max_depth is not None and 0 <= max_depth <= depth
    out: dict[int, dict[int, tuple[int, float]]] = {}
    for start in range(0, n_trees, batch):
        growing = {i: _Growing() for i in range(start, min(start + batch, n_trees))}
        sizes = {i: 0 for i in growing}

        def counted(frames):
            for frame in frames:
                for i in sizes:
                    yield pd.DataFrame({"tree": [i], "n": [int(copies(frame["key"].to_numpy(), seed, i).sum()) if bootstrap else len(frame)]})

        for r in rows.select("key").mapInPandas(counted, "tree int, n long").groupBy("tree").agg(F.sum("n").alias("n")).collect():
            sizes[r["tree"]] = r["n"]
        open_ = {(i, ROOT): (n, 0) for i, n in sizes.items()}  # (tree, path): (in-bag rows, depth)
        small: dict[tuple[int, int], int] = {}

        def sent(wanted: dict[tuple[int, int], int], slots: bool):
            """Rows of the wanted nodes: whole, or one for each drawn feature."""
            held = spark.sparkContext.broadcast((growing, wanted))

            def run(frames):
                known, wanted = held.value
                for frame in frames:
                    x, t, e, key = frame[names].to_numpy(float), frame["time"].to_numpy(float), frame["event"].to_numpy(np.int32), frame["key"].to_numpy()
                    for tree, g in known.items():
                        mine = np.array([path for i, path in wanted if i == tree], np.int64)
                        if not len(mine):
                            continue
                        m = copies(key, seed, tree) if bootstrap else np.ones(len(key), np.int64)
                        node = g.place(x)
                        at = np.flatnonzero((m > 0) & np.isin(node, mine))
                        facts = {"tree": tree, "node": node[at], "t": t[at], "e": e[at], "m": m[at]}
                        if not slots:
                            yield pd.DataFrame(facts | {n: x[at, j] for j, n in enumerate(names)})
                            continue
                        used, back = np.unique(node[at], return_inverse=True)
                        drawn = drawn_features(used, p, mtry, seed, tree)[back]
                        for slot in range(drawn.shape[1]):
                            yield pd.DataFrame(facts | {"slot": slot, "x": x[at, drawn[:, slot]]})

            columns = "slot int, x double" if slots else ", ".join(f"{n} double" for n in names)
            return rows.select(*names, "time", "event", "key").mapInPandas(run, f"tree int, node long, t double, e int, m long, {columns}")

        while open_:
            large = {}
            for (i, path), (n, depth) in open_.items():
                if n < min_split or deep(depth):
                    continue
                if n <= most:
                    small[i, path] = depth
                else:
                    large[i, path] = depth
            if not large:
                break
            since = mark()
            long = sent(large, True)
            ranks = None
            if nsplit > 0:
                long = stored(long)
                chosen = []
                for r in long.select("tree", "node", "slot", "x").distinct().groupBy("tree", "node", "slot").agg((F.count("*") - 1).alias("many")).collect():
                    drawn = drawn_features(np.array([r["node"]]), p, mtry, seed, r["tree"])[0]
                    picked = drawn_ranks(np.array([r["many"]]), nsplit, np.array([r["node"]]), drawn[[r["slot"]]], seed, r["tree"])[0]
                    chosen += [(r["tree"], r["node"], r["slot"], int(x)) for x in picked if x < r["many"]]
                ranks = spark.createDataFrame(chosen, "tree int, node long, slot int, rank long")
            found = table_splits(long, ranks, min_leaf=min_leaf, **search).collect()
            release(spark, since)
            open_ = {}
            for r in found:
                i, path, depth = r["tree"], r["node"], large[r["tree"], r["node"]]
                growing[i].splits[path] = (int(drawn_features(np.array([path]), p, mtry, seed, i)[0][r["slot"]]), float(r["threshold"]))
                open_[i, int(child_of(path, 0))] = (r["n_left"], depth + 1)
                open_[i, int(child_of(path, 1))] = (r["n"] - r["n_left"], depth + 1)
        if small:
            depths = dict(small)

            def finish(frame: pd.DataFrame) -> pd.DataFrame:
                tree, path = int(frame["tree"].iloc[0]), int(frame["node"].iloc[0])
                made = grow_below(frame[names].to_numpy(float), frame["t"].to_numpy(float), frame["e"].to_numpy(np.int64), frame["m"].to_numpy(float), path, depths[tree, path], seed, tree, mtry=mtry, max_depth=max_depth, min_split=min_split, min_leaf=min_leaf, nsplit=nsplit, **search)
                return pd.DataFrame({"tree": tree, "path": [x[0] for x in made], "feature": [x[1] for x in made], "threshold": [x[2] for x in made]})

            for r in sent(small, False).groupBy("tree", "node").applyInPandas(finish, "tree int, path long, feature int, threshold double").collect():
                growing[r["tree"]].splits[r["path"]] = (r["feature"], r["threshold"])
        out |= {i: g.splits for i, g in growing.items()}
    return out


def node_arrays(splits: dict[int, tuple[int, float]], edges: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, split as a bin of ``edges``, left, depth) of a tree in level order from its splits by path."""
    feature, split, left, depth, paths = [], [], [], [], [(ROOT, 0)]
    for path, d in paths:  # grows as it is read
        f, threshold = splits.get(path, (-1, 0.0))
        feature.append(f)
        split.append(int(np.searchsorted(edges[f], np.nextafter(threshold, np.inf))) if f >= 0 else 0)
        left.append(len(paths) if f >= 0 else 0)
        depth.append(d)
        if f >= 0:
            paths += [(int(child_of(path, 0)), d + 1), (int(child_of(path, 1)), d + 1)]
    return tuple(np.array(x, np.int64) for x in (feature, split, left, depth))


def threshold_edges(trees: dict[int, dict[int, tuple[int, float]]], p: int) -> list[np.ndarray]:
    """The thresholds of all trees as bin edges of each feature: a value equal to a threshold stays below its edge."""
    every = [(f, v) for t in trees.values() for f, v in t.values()]
    return [np.nextafter(np.unique([v for g, v in every if g == f]), np.inf) for f in range(p)]
