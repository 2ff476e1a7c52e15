"""NumPy kernels of one tree: level-wise growing, descent, leaf curves and path attributions.

All nodes of a level are searched together. A sample's slot among the drawn thresholds of its node's feature
is one comparison each; one bincount over (node, feature, slot, time, event) then holds all left and right counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from .draws import drawn_features, drawn_ranks


@dataclass
class Tree:
    """Nodes in level order (children of i at left[i], left[i] + 1) and the in-bag rows as cells: ``n`` rows of a leaf, time and event, in that order."""

    feature: np.ndarray  # -1 in leaves
    split: np.ndarray  # rows with bin <= split go left
    left: np.ndarray
    depth: np.ndarray
    leaf: np.ndarray  # leaf number, -1 inside
    cover: np.ndarray  # in-bag rows, copies counted
    starts: np.ndarray  # of each leaf in the cells (and the end)
    t: np.ndarray
    event: np.ndarray
    n: np.ndarray

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf number of each row, all rows a level at a time."""
        at = np.zeros(len(bins), np.int32)
        live = np.arange(len(bins))
        while len(live):
            node = at[live]
            inner = self.feature[node] >= 0
            live, node = live[inner], node[inner]
            at[live] = self.left[node] + (bins[live, self.feature[node]] > self.split[node])
        return self.leaf[at]

    def counts(self, leaves: np.ndarray, n_times: int, causes: int) -> tuple[np.ndarray, np.ndarray]:
        """(events (leaf, cause, time), at risk (leaf, time)) of some leaves."""
        sizes = self.starts[leaves + 1] - self.starts[leaves]
        row = np.repeat(self.starts[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        which = np.repeat(np.arange(len(leaves)), sizes)
        flat = (which * (causes + 1) + self.event[row]) * n_times + self.t[row]
        n = np.bincount(flat, self.n[row], minlength=len(leaves) * (causes + 1) * n_times).reshape(len(leaves), causes + 1, n_times)
        return n[:, 1:].astype(float), n.sum(axis=1)[:, ::-1].cumsum(axis=1)[:, ::-1].astype(float)

    def curves(self, leaves: np.ndarray, n_times: int, causes: int, hazard: bool = False) -> np.ndarray:
        """Aalen-Johansen incidence (or Nelson-Aalen hazard) of some leaves: (leaf, cause, time)."""
        d, y = self.counts(leaves, n_times, causes)
        rate = np.divide(d, y[:, None], out=np.zeros_like(d), where=y[:, None] > 0)
        if not hazard:
            alive = np.cumprod(1 - rate.sum(axis=1), axis=1)
            rate = rate * np.concatenate([np.ones((len(d), 1)), alive[:, :-1]], axis=1)[:, None]
        return rate.cumsum(axis=2)


#: the arrays of a tree as columns of a table
FIELDS = {"feature": "int", "split": "int", "left": "int", "depth": "int", "leaf": "int", "cover": "long", "starts": "long", "t": "int", "event": "int", "n": "long"}
TREES = "tree_id long, " + ", ".join(f"{f} array<{t}>" for f, t in FIELDS.items())


def tree_frame(trees: list[tuple[int, Tree]]) -> pd.DataFrame:
    """Trees as rows of a table of ``TREES``."""
    wide = {"int": np.int32, "long": np.int64}
    return pd.DataFrame({"tree_id": [i for i, _ in trees], **{f: [getattr(t, f).astype(wide[kind]) for _, t in trees] for f, kind in FIELDS.items()}})


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest whole numbers that hold an array."""
    return x.astype(np.result_type(np.min_scalar_type(int(x.min(initial=0))), np.min_scalar_type(int(x.max(initial=0)))))


def _tree(arrays) -> Tree:
    return Tree(**{f: _narrow(x) if f in ("t", "event") else x for f, x in arrays.items()})


def trees_of(table: pd.DataFrame | pa.Table):
    """(tree_id, tree) of each row of a table of ``TREES``."""
    if isinstance(table, pa.Table):
        for i, number in enumerate(table.column("tree_id").to_pylist()):
            yield number, _tree({f: table.column(f)[i].values.to_numpy(zero_copy_only=False) for f in FIELDS})
    else:
        for i, number in enumerate(table["tree_id"]):
            yield int(number), _tree({f: np.asarray(table[f].iloc[i]) for f in FIELDS})


def split_scores(n: np.ndarray, d: np.ndarray, rule: str, cause: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numerator, variance) for left counts n (group, slot, time) and d (group, slot, cause, time), cumulated over slots; the last slot is the whole."""
    y = n[..., ::-1].cumsum(axis=-1)[..., ::-1]
    whole_y = y[:, -1:, :]
    if rule == "logrank":
        dl, da, yl, ya, seen = d[:, :-1, cause - 1], d[:, -1:, cause - 1], y[:, :-1], whole_y, whole_y >= 2
    else:
        other = d.sum(axis=2, keepdims=True) - d
        inc = y[:, :, None] + other.cumsum(axis=-1) - other
        dl, da, yl, ya = d[:, :-1], d[:, -1:], inc[:, :-1], inc[:, -1:]
        seen = np.broadcast_to((whole_y >= 1)[:, :, None], da.shape)
    safe = np.maximum(ya, 1.0)
    num = np.where(seen, dl - da * yl / safe, 0.0)
    twice = whole_y >= 2 if rule == "logrank" else np.broadcast_to((whole_y >= 2)[:, :, None], da.shape)
    var = np.where(twice, da * yl * (ya - yl) * (ya - da) / (safe * safe * np.maximum(ya - 1, 1.0)), 0.0)
    if weights is not None and rule != "logrank":
        num, var = num * weights[:, None], var * (weights * weights)[:, None]
    axes = tuple(range(2, num.ndim))
    return num.sum(axis=axes), var.sum(axis=axes)


def tree_of(feature, split, left, depth, cover, node: np.ndarray, t: np.ndarray, event: np.ndarray, n: np.ndarray) -> Tree:
    """A tree from its nodes and ``n`` rows for each (node, t, event), in any order and repeated or not."""
    leaf = np.where(feature < 0, np.cumsum(feature < 0) - 1, -1)
    times, codes = int(t.max(initial=0)) + 1, int(event.max(initial=0)) + 1
    cell, back = np.unique((leaf[node] * times + t) * codes + event, return_inverse=True)
    starts = np.searchsorted(cell // (times * codes), np.arange((feature < 0).sum() + 1))
    narrow = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return Tree(feature.astype(np.int32), split.astype(np.int16 if split.max(initial=0) < 1 << 15 else np.int32), left.astype(np.int32), depth.astype(np.int32), leaf.astype(np.int32), cover.astype(np.int64), starts.astype(np.int64), narrow(cell // codes % times), narrow(cell % codes), np.bincount(back, n, minlength=len(cell)).astype(np.int64))


def _thresholds(x: np.ndarray, node: np.ndarray, numbers: np.ndarray, drawn: np.ndarray, n_bins: int, nsplit: int, seed: int, tree: int) -> np.ndarray:
    """Drawn bins (node, feature, nsplit), rising; ``n_bins`` pads. Candidates are the node's observed bins but the largest.

    Without ``nsplit`` all candidates are taken, else that many of them without replacement.
    """
    nodes, m = drawn.shape
    group = (node[:, None] * m + np.arange(m)).ravel()
    seen = np.flatnonzero(np.bincount(group * n_bins + x.ravel(), minlength=nodes * m * n_bins))
    of = seen // n_bins
    first = np.searchsorted(of, np.arange(nodes * m))
    many = np.searchsorted(of, np.arange(nodes * m), side="right") - first - 1
    k = int(many.max(initial=0)) if nsplit <= 0 else min(nsplit, int(many.max(initial=0)))
    if k <= 0:
        return np.full((nodes, m, 1), n_bins, np.int32)
    rank = drawn_ranks(many, k, np.repeat(numbers, m), drawn.ravel(), seed, tree)
    ok = rank < many[:, None]
    bins = np.where(ok, (seen % n_bins)[np.minimum(first[:, None] + rank, len(seen) - 1)], n_bins)
    return bins.reshape(nodes, m, k).astype(np.int32)


def grow_tree(bins: np.ndarray, t_split: np.ndarray, t_full: np.ndarray, event: np.ndarray, rows: np.ndarray, seed: int, tree: int, *, n_bins: int, n_times: int, causes: int, mtry: int, nsplit: int, max_depth: int | None, min_split: int, min_leaf: int, rule: str, cause: int, weights: np.ndarray | None = None, cells: int = 1 << 21) -> Tree:
    """Grow one tree on the in-bag ``rows`` (repeats are copies). Ties go to the feature drawn first, then the lower bin."""
    p = bins.shape[1]
    feature, split, left, depth, cover = [np.full(1, -1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, len(rows))]
    node_of = np.zeros(len(rows), np.int64)  # final node number of each in-bag row
    live, node, base, count = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0, 1
    level = 0
    per_node = max(1, mtry * (max(nsplit, 0) or n_bins) * n_times * (causes + 1), mtry * n_bins // 4)
    while len(live) and (max_depth is None or max_depth < 0 or level < max_depth):
        size = np.bincount(node, minlength=count)
        chosen = np.flatnonzero(size >= min_split)
        if not len(chosen):
            break
        renumber = np.full(count, -1)
        renumber[chosen] = np.arange(len(chosen))
        mine = renumber[node] >= 0
        live, node = live[mine], renumber[node[mine]]
        order = np.argsort(node, kind="stable")
        live, node = live[order], node[order]
        ends = np.cumsum(size[chosen])
        best_f, best_b = np.full(len(chosen), -1), np.zeros(len(chosen), np.int64)
        drawn = drawn_features(base + chosen, p, mtry, seed, tree)
        step = max(1, cells // per_node)
        for a in range(0, len(chosen), step):
            z = min(a + step, len(chosen))
            s = slice(ends[a] - size[chosen[a]], ends[z - 1])
            who, local = rows[live[s]], node[s] - a
            x = bins[who[:, None], drawn[a:z][local]].astype(np.int32)
            cuts = _thresholds(x, local, base + chosen[a:z], drawn[a:z], n_bins, nsplit, seed, tree)
            k = cuts.shape[2]
            if k > 16:
                place = np.zeros((z - a, mtry, n_bins + 1), np.int32)
                np.put_along_axis(place, np.minimum(cuts, n_bins), 1, axis=2)
                place[:, :, n_bins] = 0
                below = np.cumsum(place, axis=2) - place
                slot = below[local[:, None], np.arange(mtry), x]
            else:
                narrow, slot = x.astype(np.int16), np.zeros(x.shape, np.int32)
                for cut in cuts.astype(np.int16).transpose(2, 0, 1):
                    slot += narrow > cut[local]
            e, t = event[who], t_split[who]
            flat = (((local[:, None] * mtry + np.arange(mtry)) * (k + 1) + slot) * (causes + 1) + e[:, None]) * n_times + t[:, None]
            n = np.bincount(flat.ravel(), minlength=(z - a) * mtry * (k + 1) * (causes + 1) * n_times).reshape((z - a) * mtry, k + 1, causes + 1, n_times).astype(float)
            n = n.cumsum(axis=1)
            total = n.sum(axis=2)
            num, var = split_scores(total, n[:, :, 1:], rule, cause, weights)
            n_left = total[:, :-1].sum(axis=2)
            n_all = total[:, -1].sum(axis=1)
            ok = (n_left >= min_leaf) & (n_all[:, None] - n_left >= min_leaf) & (var >= 1e-12) & (cuts.reshape(-1, k) < n_bins)
            stat = np.where(ok, num * num / np.where(var > 0, var, 1.0), 0.0).reshape(z - a, mtry * k)
            top = np.argmax(stat, axis=1)
            good = stat[np.arange(z - a), top] > 0
            best_f[a:z] = np.where(good, drawn[np.arange(a, z), top // k], -1)
            best_b[a:z] = cuts.reshape(z - a, mtry * k)[np.arange(z - a), top]
        at = base + chosen
        cut = best_f >= 0
        n_new = int(cut.sum())
        first = base + count + 2 * (np.cumsum(cut) - 1)
        feature[-1][chosen[cut]], split[-1][chosen[cut]], left[-1][chosen[cut]] = best_f[cut], best_b[cut], first[cut]
        if not n_new:
            break
        mine = cut[node]
        live, node = live[mine], node[mine]
        down = first[node] + (bins[rows[live], best_f[node]] > best_b[node])
        node_of[live] = down
        base, count = base + count, 2 * n_new
        node = down - base
        level += 1
        feature.append(np.full(count, -1))
        split.append(np.zeros(count, np.int64))
        left.append(np.zeros(count, np.int64))
        depth.append(np.full(count, level))
        cover.append(np.bincount(node, minlength=count))
    return tree_of(*(np.concatenate(x) for x in (feature, split, left, depth, cover)), node_of, t_full[rows], event[rows], np.ones(len(rows)))


# ---- path attributions ----------------------------------------------------------------------------------


def leaf_paths(tree: Tree):
    """For each leaf: (leaf, features, lower bins, upper bins, cover fractions) with repeated features joined."""
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        f = int(tree.feature[node])
        if f < 0:
            names = sorted(path)
            yield int(tree.leaf[node]), np.array(names, int), np.array([path[n][0] for n in names]), np.array([path[n][1] for n in names]), np.array([path[n][2] for n in names], float)
            continue
        child, b = int(tree.left[node]), int(tree.split[node])
        low, high, part = path.get(f, (-1, 1 << 30, 1.0))
        for side in (0, 1):
            share = tree.cover[child + side] / max(tree.cover[node], 1)
            span = (low, min(high, b)) if side == 0 else (max(low, b), high)
            stack.append((child + side, path | {f: (*span, part * share)}))


def path_weights(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley weights (row, feature) of a leaf for rows that satisfy (``inside``) or not each path feature.

    The subset-size polynomial of all features is built once; each feature is then divided out of it.
    """
    rows, m = inside.shape
    one = inside.astype(float)
    w = np.zeros((rows, m + 1))
    w[:, 0] = 1.0
    for i in range(m):
        new = w * share[i]
        new[:, 1:] += w[:, :-1] * one[:, [i]]
        w = new
    sizes = np.arange(m)
    from math import factorial

    chance = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in sizes])
    out = np.zeros((rows, m))
    for i in range(m):
        rest = np.zeros((rows, m))
        hot = inside[:, i]
        # divide by (share + x): from the top where the row is inside, else the factor is share alone
        if hot.any():
            top = w[hot, m].copy()
            for s in range(m - 1, -1, -1):
                rest[hot, s] = top
                top = w[hot, s] - share[i] * top
        if (~hot).any():
            rest[~hot] = w[~hot, :m] / share[i]
        out[:, i] = (rest * chance).sum(axis=1) * (one[:, i] - share[i])
    return out
