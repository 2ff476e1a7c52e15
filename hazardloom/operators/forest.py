"""Competing-risks random forest.

Training is tree-parallel while the table is small (``BROADCAST_BYTES``): bins and outcomes are broadcast, every task grows
its trees with the level-wise kernel, and the forest is a DataFrame of one row a tree. Beyond that size, or with
``mode="distributed"``, trees grow by aggregation over the rows (:mod:`forest_distributed`). Both give the same trees: in-bag
copies, features and splits are drawn by hashes (:mod:`draws`) of the seed, the tree, the node and the rows' keys. ``mode="reference"`` searches every
midpoint of a node's values against every event time, at every size (:mod:`exact_splits`).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.outcomes import check_inputs
from . import minimal_depth as depth_frames
from .concordance import compute_uno_weights, concordance_index_cr, concordance_pairs, uno_terms
from .draws import DEAL, MOST_DRAWN, content_keys, copies, numbers_among_equals, uniforms
from .exact_splits import grow_exact, node_arrays, threshold_edges
from .forest_distributed import _Growing, grow_forest, keyed, leaf_trees
from .grids import coarsen_time_grid, cut_points, event_time_grid, feature_bin_edges, time_points
from .regression import _outcome
from .scans import running, with_blocks
from .stored import stored
from .tree_kernel import FIELDS, TREES, Tree, grow_tree, leaf_paths, path_weights, tree_frame, trees_of

#: bytes of the table (as doubles) that the driver may fetch and share with the tasks
BROADCAST_BYTES = 256 << 20
#: bytes of trees that a task may hold; larger forests predict a part at a time
FOREST_BYTES = 1 << 30


def resolve_max_features(value, p: int) -> int:
    """None: all; sqrt and log2 round up; whole numbers clamp; fractions round down; 1 at least."""
    if value is None:
        return p
    if value == "sqrt":
        return max(1, math.ceil(math.sqrt(p)))
    if value == "log2":
        return max(1, math.ceil(math.log2(p))) if p > 1 else 1
    if isinstance(value, bool) or isinstance(value, str):
        raise ValueError(f"unknown max_features {value!r}")
    if isinstance(value, int):
        return min(max(1, value), p)
    return max(1, int(value * p))


class CompetingRiskForest:
    """``fit`` on a DataFrame, then ``predict_*`` add columns to one. ``n_jobs`` and ``device`` are accepted for compatibility and do nothing."""

    def __init__(self, n_estimators=100, max_depth=15, min_samples_split=6, min_samples_leaf=3, max_features="sqrt", bootstrap=True, random_state=None, mode="default", n_bins=256, time_grid=200, n_jobs=-1, splitrule="logrankCR", cause=1, cause_weights=None, nsplit=None, split_ntime=10, rng_mode="numpy", equivalence=None, device="auto"):
        self._params = {k: v for k, v in locals().items() if k != "self"}
        self.__dict__ |= self._params
        self.trees_: DataFrame | None = None

    # ---- parameters -----------------------------------------------------------------------------------

    def get_params(self, deep: bool = True) -> dict:
        return {k: getattr(self, k) for k in self._params}

    def set_params(self, **params) -> CompetingRiskForest:
        for k, v in params.items():
            if k not in self._params:
                raise ValueError(f"unknown parameter {k!r}")
            setattr(self, k, v)
        return self

    def _check(self) -> None:
        if self.splitrule not in ("logrankCR", "logrank"):
            raise ValueError(f"unknown splitrule {self.splitrule!r}")
        if self.mode not in ("default", "reference", "distributed"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.device not in ("auto", "cpu"):
            raise ValueError("only the CPU is supported")
        if self.cause_weights is not None and self.mode != "reference":
            raise ValueError("cause_weights need mode='reference'")
        if self.rng_mode != "numpy":
            raise ValueError(f"rng_mode {self.rng_mode!r} is not offered: draws are hashes")
        if self.equivalence not in (None, "rfsrc"):
            raise ValueError(f"unknown equivalence {self.equivalence!r}")
        if self.equivalence and self.split_ntime not in (None, 10):
            raise ValueError("the preset splits on every event time: leave split_ntime alone")
        if self.nsplit is not None and not 0 <= self.nsplit <= MOST_DRAWN:
            raise ValueError(f"nsplit must be from 0 (all) to {MOST_DRAWN}")
        if not 2 <= self.n_bins <= 256:
            raise ValueError("n_bins must be from 2 to 256")

    # ---- training ---------------------------------------------------------------------------------------

    def fit(self, df: DataFrame, features: Sequence[str], time: str = "time", event: str = "event", y: str | None = None, key: str | None = None) -> CompetingRiskForest:
        """Grow the forest. ``key`` names a column of whole numbers that tells rows apart, which in-bag draws then go by; by default they go
        by the rows' binned content."""
        self._check()
        df, time, event = _outcome(df, time, event, y)
        self.features_, self.time_, self.event_ = list(features), time, event
        self.n_causes_ = check_inputs(df, self.features_, time, event)
        if self.cause_weights is not None and len(self.cause_weights) != self.n_causes_:
            raise ValueError(f"cause_weights must have {self.n_causes_} entries")
        n, p = df.count(), len(self.features_)
        self.n_rows_, self.n_features_in_ = n, p
        self._seed = 0 if self.random_state is None else int(self.random_state)
        self._data = self._rows = None
        for held in ("_shared", "_shared_nodes", "_leaves"):
            self.__dict__.pop(held, None)
        names = [*[f"x{i}" for i in range(p)], "time", "event"]
        plain = df.select(*[F.col(c).cast("double").alias(x) for c, x in zip([*self.features_, time, event], names)], *([F.col(key).cast("long").alias("key")] if key else []))
        grow = self._grow_exact if self.mode == "reference" else self._grow_far if self.mode == "distributed" or n * (p + 2) * 8 > BROADCAST_BYTES else self._grow_near
        self.trees_ = grow(plain, key is not None).persist()
        self.trees_.count()
        return self

    def _settings(self) -> dict:
        exact = self.mode == "reference"
        ntime = len(self.time_grid_) if exact or self.equivalence == "rfsrc" or self.split_ntime is None else self.split_ntime
        self._coarse = coarsen_time_grid(self.time_grid_, ntime)
        nsplit = self.nsplit if self.nsplit is not None else (0 if exact else 10)
        return dict(n_bins=max(2, max((len(x) for x in self.bin_edges_), default=0) + 1), n_times=int(self._coarse.max()) + 1, causes=self.n_causes_, mtry=resolve_max_features(self.max_features, self.n_features_in_), nsplit=nsplit, max_depth=self.max_depth, min_split=self.min_samples_split, min_leaf=self.min_samples_leaf, rule=self.splitrule, cause=self.cause, weights=None if self.cause_weights is None else np.asarray(self.cause_weights, float))

    def _limits(self) -> tuple[int, int | None]:
        """(bins of a feature, points of the time grid); a preset asks for every event time."""
        return self.n_bins, None if self.equivalence == "rfsrc" else self.time_grid

    def _grow_far(self, plain: DataFrame, has_key: bool) -> DataFrame:
        p, (n_bins, points) = self.n_features_in_, self._limits()
        names = [f"x{i}" for i in range(p)]
        self.bin_edges_ = feature_bin_edges(plain, names, n_bins)
        self.time_grid_ = event_time_grid(plain, points)
        settings = self._settings()
        self._rows = keyed(self._binned(plain, has_key), "key" if has_key else None).persist()
        return grow_forest(self._rows, p, self._coarse, n_trees=self.n_estimators, seed=self._seed, bootstrap=self.bootstrap, **settings)

    def _grow_exact(self, plain: DataFrame, has_key: bool) -> DataFrame:
        """Trees by exact splits; what they split at become the bins that prediction goes by."""
        p, (_, points) = self.n_features_in_, self._limits()
        self.time_grid_ = event_time_grid(plain, points)
        rows = stored(keyed(plain, "key" if has_key else None))
        self.bin_edges_ = []
        settings = {k: v for k, v in self._settings().items() if k not in ("n_bins", "n_times")}
        splits = grow_exact(rows, p, n_trees=self.n_estimators, seed=self._seed, bootstrap=self.bootstrap, **settings)
        self.bin_edges_ = threshold_edges(splits, p)
        self._rows = self._binned(rows, True, row=True).persist()
        growing = {}
        for i, found in splits.items():
            growing[i] = g = _Growing()
            g.feature, g.split, g.left, g.depth = node_arrays(found, self.bin_edges_)
        return leaf_trees(self._rows, growing, p, self._seed, self.bootstrap)

    def _grow_near(self, plain: DataFrame, has_key: bool) -> DataFrame:
        spark, p, (n_bins, points) = plain.sparkSession, self.n_features_in_, self._limits()
        packed = plain.toPandas()  # of the size checked in fit
        time, event = packed["time"].to_numpy(), packed["event"].to_numpy().astype(np.int64)
        self.bin_edges_ = [cut_points(np.unique(packed[f"x{i}"].to_numpy()), n_bins) for i in range(p)]
        self.time_grid_ = time_points(np.unique(time[event > 0]), points)
        settings = self._settings()
        columns = [np.searchsorted(e, packed[f"x{i}"].to_numpy(), side="right") for i, e in enumerate(self.bin_edges_)]
        t = np.maximum(np.searchsorted(self.time_grid_, time, side="right") - 1, 0)
        facts = [*columns, t, event]
        key = packed["key"].to_numpy() if has_key else content_keys(facts, numbers_among_equals(facts))
        del packed
        narrow = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        self._data = data = spark.sparkContext.broadcast((np.stack([narrow(c) for c in columns], axis=1), narrow(t), narrow(event), key))
        seed, bootstrap, coarse = self._seed, self.bootstrap, self._coarse

        def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b, tf, ev, keys = data.value
            tf, ev = tf.astype(np.int64), ev.astype(np.int64)
            for frame in frames:
                out = []
                for i in frame["id"]:
                    chosen = np.repeat(np.arange(len(b)), copies(keys, seed, int(i))) if bootstrap else np.arange(len(b))
                    tree = grow_tree(b, coarse[tf], tf, ev, chosen, seed, int(i), **settings)
                    out.append((int(i), tree))
                yield tree_frame(out)

        ids = spark.range(0, self.n_estimators, 1, min(self.n_estimators, 4 * spark.sparkContext.defaultParallelism))
        return ids.mapInPandas(build, TREES)

    def _binned(self, plain: DataFrame, has_key: bool, row: bool = False) -> DataFrame:
        """b0 .. b{p-1}, t (grid index), event, and key and row if there are, binned by array searches an Arrow batch at a time."""
        edges, grid, p = self.bin_edges_, self.time_grid_, self.n_features_in_
        more, wide = [*["key"] * has_key, *["row"] * row], any(len(e) >= 1 << 15 for e in edges)

        def run(frames):
            for frame in frames:
                out = {f"b{i}": np.searchsorted(e, frame[f"x{i}"].to_numpy(), side="right").astype(np.int32 if wide else np.int16) for i, e in enumerate(edges)}
                out["t"] = np.maximum(np.searchsorted(grid, frame["time"].to_numpy(), side="right") - 1, 0).astype(np.int32)
                out["event"] = frame["event"].to_numpy().astype(np.int32)
                yield pd.DataFrame(out | {c: frame[c].to_numpy() for c in more})

        return plain.mapInPandas(run, ", ".join([*[f"b{i} {'int' if wide else 'short'}" for i in range(p)], "t int", "event int", *[f"{c} long" for c in more]]))

    def _training_rows(self) -> DataFrame:
        """(b0 .. b{p-1}, t, event, key, row) of the training rows, from the cluster or from what the tasks share."""
        if getattr(self, "_rows", None) is not None:
            return self._rows
        if getattr(self, "_data", None) is None:
            raise ValueError("out-of-bag figures need the training rows, which a saved model does not hold; score held-out rows instead")
        spark, data, p = self.trees_.sparkSession, self._data, self.n_features_in_

        def run(frames):
            bins, t, event, key = data.value
            for frame in frames:
                i = frame["id"].to_numpy()
                yield pd.DataFrame({**{f"b{j}": bins[i, j].astype(np.int16) for j in range(p)}, "t": t[i].astype(np.int32), "event": event[i].astype(np.int32), "key": key[i], "row": i})

        return spark.range(self.n_rows_).mapInPandas(run, ", ".join([*[f"b{i} short" for i in range(p)], "t int", "event int", "key long", "row long"]))

    def _groups(self, size) -> list[list[int]]:
        """Runs of trees of up to ``FOREST_BYTES`` (or one tree) each, as a Column tells their bytes."""
        if self.trees_ is None:
            raise RuntimeError("the forest is not fitted")
        groups, held = [[]], 0
        for i, n in sorted((r["tree_id"], r["n"]) for r in self.trees_.select("tree_id", size.alias("n")).collect()):
            if groups[-1] and held + n > FOREST_BYTES:
                groups, held = [*groups, []], 0
            groups[-1].append(i)
            held += n
        return groups

    def _fetched(self, trees: DataFrame, ids: list[int]):
        return trees.where(F.col("tree_id").between(ids[0], ids[-1])).orderBy("tree_id").toArrow()

    def _parts(self) -> list:
        """The trees as broadcasts of up to ``FOREST_BYTES`` (or one tree) each."""
        if not hasattr(self, "_shared"):
            groups = self._groups(30 * F.size("feature") + 12 * F.size("t"))
            self._shared = [self.trees_.sparkSession.sparkContext.broadcast([t for _, t in trees_of(self._fetched(self.trees_, ids))]) for ids in groups]
        return self._shared

    def _nodes(self) -> list:
        """(numbers, trees without their cells) as broadcasts: what a row needs to find its leaves."""
        if not hasattr(self, "_shared_nodes"):
            spark, empty = self.trees_.sparkSession, F.array().cast("array<long>")
            bare = self.trees_.select("tree_id", *[empty.cast(f"array<{kind}>").alias(f) if f in ("depth", "cover", "starts", "t", "event", "n") else F.col(f) for f, kind in FIELDS.items()])
            self._shared_nodes = [spark.sparkContext.broadcast(list(trees_of(self._fetched(bare, ids)))) for ids in self._groups(16 * F.size("feature"))]
        return self._shared_nodes

    # ---- the forest as tables --------------------------------------------------------------------------------

    def tree_table(self) -> DataFrame:
        """(tree_id, node_id, depth, feature, split_bin, left, right, is_leaf, leaf_id, cover); feature is -1 in leaves."""

        def rows(frames):
            for frame in frames:
                for i, t in trees_of(frame):
                    leaf = t.feature < 0
                    yield pd.DataFrame({"tree_id": i, "node_id": np.arange(len(leaf)), "depth": t.depth, "feature": t.feature, "split_bin": t.split, "left": np.where(leaf, -1, t.left), "right": np.where(leaf, -1, t.left + 1), "is_leaf": leaf, "leaf_id": t.leaf, "cover": t.cover})

        return self.trees_.mapInPandas(rows, "tree_id long, node_id int, depth int, feature int, split_bin int, left int, right int, is_leaf boolean, leaf_id int, cover int")

    def leaf_table(self) -> DataFrame:
        """(tree_id, leaf_id, t_idx, event, n): the sparse sufficient statistics of all leaves."""

        def rows(frames):
            for frame in frames:
                for i, t in trees_of(frame):
                    leaf = np.repeat(np.arange(len(t.starts) - 1), np.diff(t.starts))
                    yield pd.DataFrame({"tree_id": i, "leaf_id": leaf, "t_idx": t.t.astype(int), "event": t.event.astype(int), "n": t.n})

        return self.trees_.mapInPandas(rows, "tree_id long, leaf_id int, t_idx int, event int, n long")

    #: what a fitted forest knows beside its trees
    _LEARNED = ("features_", "time_", "event_", "n_causes_", "n_rows_", "n_features_in_", "_seed")

    def save(self, path: str) -> None:
        """The model as two Parquet tables: trees (``TREES``: whole numbers in arrays), and one row of settings as JSON, bin edges and the time grid."""
        if self.trees_ is None:
            raise RuntimeError("the forest is not fitted")
        self.trees_.write.parquet(f"{path}/trees")
        plain = lambda x: x.tolist() if isinstance(x, (np.ndarray, np.generic)) else list(x)
        settings = json.dumps({"params": self.get_params(), "learned": {k: getattr(self, k) for k in self._LEARNED}}, default=plain)
        row = (settings, [[float(v) for v in e] for e in self.bin_edges_], [float(t) for t in self.time_grid_])
        self.trees_.sparkSession.createDataFrame([row], "settings string, bin_edges array<array<double>>, time_grid array<double>").coalesce(1).write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark, path: str) -> CompetingRiskForest:
        """A saved model. It holds numbers and text alone, so that loading one runs nothing."""
        row = spark.read.parquet(f"{path}/model").first()
        settings = json.loads(row["settings"])
        out = cls(**settings["params"])
        out.__dict__ |= settings["learned"]
        out.bin_edges_, out.time_grid_ = [np.array(e, float) for e in row["bin_edges"]], np.array(row["time_grid"], float)
        out._data = out._rows = None
        out._settings()
        out.trees_ = spark.read.parquet(f"{path}/trees").persist()
        return out

    def close(self) -> None:
        """Free what the cluster holds for the model: training rows, trees and broadcasts. It can then no longer predict."""
        for held in (self.trees_, getattr(self, "_rows", None)):
            if held is not None:
                held.unpersist()
        for held in [getattr(self, "_data", None), *self.__dict__.pop("_shared", []), *self.__dict__.pop("_shared_nodes", []), *sum(self.__dict__.pop("_leaves", {}).values(), [])]:
            if held is not None:
                held.unpersist()
        self._data = self._rows = self.trees_ = None

    # ---- prediction ----------------------------------------------------------------------------------------------

    def _apply(self, df: DataFrame, name: str, width: int, values, finish, kind: T.DataType) -> DataFrame:
        """``df`` with a column made of the forest's mean of ``values(tree, leaves)`` (leaf, width), which ``finish`` shapes.

        Where the forest is more than a task may hold, only its nodes are broadcast: rows find their leaves, leaf values are a table of
        (tree, leaf) made where the trees are, and the two are joined.
        """
        missing = [c for c in self.features_ if c not in df.columns]
        if missing:
            raise ValueError(f"features are missing: {missing}")
        edges, features, trees = self.bin_edges_, self.features_, self.n_estimators
        binned = lambda frame: np.stack([np.searchsorted(e, frame[c].to_numpy(float), side="right") for c, e in zip(features, edges)], axis=1).astype(np.int32)
        kept = [f for f in df.schema.fields if f.name != name]
        schema = T.StructType([*kept, T.StructField(name, kind)])
        if len(getattr(self, "_shared", ())) == 1 or len(self._groups(30 * F.size("feature") + 12 * F.size("t"))) == 1:
            (forest,) = self._parts()

            def run(frames):
                for frame in frames:
                    bins, total = binned(frame), np.zeros((len(frame), width))
                    for tree in forest.value:
                        used, back = np.unique(tree.leaves_of(bins), return_inverse=True)
                        total += values(tree, used)[back]
                    made = finish(total / trees)
                    frame = frame.drop(columns=[name], errors="ignore")
                    frame[name] = made
                    yield frame

            return df.mapInPandas(run, schema)
        rows = df.withColumn("__row", F.monotonically_increasing_id())

        def placed(part):
            def run(frames):
                for frame in frames:
                    bins = binned(frame)
                    for number, tree in part.value:
                        yield pd.DataFrame({"__row": frame["__row"], "tree": number, "leaf": tree.leaves_of(bins)})

            return rows.select("__row", *features).mapInPandas(run, "__row long, tree long, leaf int")

        def leaf_values(frames):
            for frame in frames:
                for number, tree in trees_of(frame):
                    for part in np.array_split(np.arange(len(tree.starts) - 1), 1 + len(tree.starts) // 4096):
                        yield pd.DataFrame({"tree": number, "leaf": part.astype(np.int32), "v": list(values(tree, part))})

        where = reduce(DataFrame.union, [placed(part) for part in self._nodes()])
        met = where.join(self.trees_.mapInPandas(leaf_values, "tree long, leaf int, v array<double>"), ["tree", "leaf"])
        totals = met.groupBy("__row").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("__sum"))

        def shape(frames):
            for frame in frames:
                made = finish(np.stack(frame["__sum"].to_numpy()) / trees) if len(frame) else []
                frame = frame.drop(columns=["__sum"])
                frame[name] = made
                yield frame[[f.name for f in schema]]

        return rows.drop(name).join(totals, "__row").drop("__row").mapInPandas(shape, schema)

    def _grid_steps(self, times) -> np.ndarray | None:
        if times is None:
            return None
        return np.searchsorted(self.time_grid_, np.asarray(times, float), side="right") - 1

    def _curves(self, df: DataFrame, name: str, times, hazard: bool) -> DataFrame:
        m, k, steps = len(self.time_grid_), self.n_causes_, self._grid_steps(times)
        width = m if steps is None else len(steps)

        def values(tree, leaves):
            c = tree.curves(leaves, m, k, hazard)
            if steps is not None:
                c = np.where(steps >= 0, c[:, :, np.maximum(steps, 0)], 0.0)
            return c.reshape(len(leaves), k * width)

        def finish(total):
            return [[row.tolist() for row in one] for one in total.reshape(len(total), k, width)]

        return self._apply(df, name, k * width, values, finish, T.ArrayType(T.ArrayType(T.DoubleType())))

    def predict_cif(self, df: DataFrame, times=None, name: str = "cif") -> DataFrame:
        """Array [cause][time] of the ensemble mean incidence (on the model's grid, or at ``times``)."""
        return self._curves(df, name, times, False)

    def predict_chf(self, df: DataFrame, times=None, name: str = "chf") -> DataFrame:
        return self._curves(df, name, times, True)

    def predict_risk(self, df: DataFrame, cause: int = 1, kind: str = "integrated_chf", name: str = "risk") -> DataFrame:
        """The sum of the hazard over the grid's points, or the last incidence."""
        m, k = len(self.time_grid_), self.n_causes_
        if kind not in ("integrated_chf", "cif_last"):
            raise ValueError(f"unknown kind {kind!r}")

        def values(tree, leaves):
            c = tree.curves(leaves, m, k, kind == "integrated_chf")[:, cause - 1]
            return (c.sum(axis=1) if kind == "integrated_chf" else c[:, -1])[:, None]

        return self._apply(df, name, 1, values, lambda total: total[:, 0], T.DoubleType())

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_risk(df, 1)

    def score(self, df: DataFrame, cause: int = 1) -> float:
        return concordance_index_cr(self.predict_risk(df, cause), cause, self.event_, self.time_)

    # ---- out of bag -------------------------------------------------------------------------------------------------

    def _mortality(self, cause: int) -> list:
        """(number, nodes, mortality of the leaves) of the trees, as broadcasts of up to ``FOREST_BYTES``: the left-Riemann integral of the incidence."""
        m, k, steps, light = len(self.time_grid_), self.n_causes_, np.diff(self.time_grid_), ("feature", "split", "left", "leaf")

        def run(frames):
            for frame in frames:
                out = []
                for i, t in trees_of(frame):
                    value = np.concatenate([t.curves(part, m, k)[:, cause - 1][:, :-1] @ steps for part in np.array_split(np.arange(len(t.starts) - 1), 1 + len(t.starts) // 4096)])
                    out.append((i, t.feature, t.split, t.left, t.leaf, value))
                yield pd.DataFrame(out, columns=["tree_id", *light, "value"])

        self._leaves = getattr(self, "_leaves", {})
        if cause not in self._leaves:
            none, kinds = np.zeros(0, np.int64), ", ".join(f"{c} array<int>" for c in light)
            small = self.trees_.mapInPandas(run, f"tree_id long, {kinds}, value array<double>")

            def made(rows):
                array = lambda c, i: rows.column(c)[i].values.to_numpy(zero_copy_only=False)
                return [(number, Tree(array("feature", i), array("split", i), array("left", i), none, array("leaf", i), none, none, none, none, none), array("value", i)) for i, number in enumerate(rows.column("tree_id").to_pylist())]

            self._leaves[cause] = [self.trees_.sparkSession.sparkContext.broadcast(made(self._fetched(small, ids))) for ids in self._groups(24 * F.size("feature"))]
        return self._leaves[cause]

    def leaf_mortality(self, cause: int = 1) -> list[np.ndarray]:
        """The mortality of each tree's leaves."""
        return [value for part in self._mortality(cause) for _, _, value in part.value]

    def _oob_sums(self, cause: int, permuted: Sequence[int] = (-1,)) -> DataFrame:
        """(feature, row, sum, n): mortality over the trees that leave a row out, with a feature permuted (-1: none).

        Every task takes its rows through the trees, a part of them at a time where they are many. A permuted value is drawn, by a hash of the row's key, from the tree's
        out-of-bag values of the feature, of which the driver gets the counts by bin.
        """
        parts, rows, seed, p, bootstrap = self._mortality(cause), self._training_rows(), self._seed, self.n_features_in_, self.bootstrap
        trees = self.n_estimators
        names, permuted = [f"b{i}" for i in range(p)], [int(f) for f in permuted]
        dealt = [f for f in permuted if f >= 0]
        width = max(len(x) for x in self.bin_edges_) + 1

        def left_out(frame, tree):
            return np.flatnonzero(copies(frame["key"].to_numpy(), seed, tree) == 0) if bootstrap else np.zeros(0, int)

        def count(frames):
            for frame in frames:
                bins = frame[names].to_numpy(np.int64)
                for i in range(trees):
                    x = bins[left_out(frame, i)]
                    for f in dealt:
                        n = np.bincount(x[:, f], minlength=width)
                        b = np.flatnonzero(n)
                        yield pd.DataFrame({"tree": i, "feature": f, "bin": b, "n": n[b]})

        share = {}
        if dealt:
            for r in rows.mapInPandas(count, "tree int, feature int, bin int, n long").groupBy("tree", "feature", "bin").agg(F.sum("n").alias("n")).orderBy("bin").collect():
                share.setdefault((r["tree"], r["feature"]), []).append((r["bin"], r["n"]))
        # the bins that a tree's out-of-bag rows have, and their shares
        shares = rows.sparkSession.sparkContext.broadcast({at: (np.array([b for b, _ in x]), np.cumsum([n for _, n in x])[:-1] / sum(n for _, n in x)) for at, x in share.items()})

        def of(held):
            return lambda frames: run(frames, held)

        def run(frames, held):
            for frame in frames:
                bins, key = frame[names].to_numpy(np.int64), frame["key"].to_numpy()
                total, n = np.zeros((len(permuted), len(bins))), np.zeros(len(bins), np.int64)
                for i, tree, value in held.value:
                    out = left_out(frame, i)
                    if not len(out):
                        continue
                    n[out] += 1
                    for j, f in enumerate(permuted):
                        x = bins[out]
                        if f >= 0:
                            found, parts = shares.value[i, f]
                            x[:, f] = found[np.searchsorted(parts, uniforms(key[out], seed, i, DEAL, f), side="right")]
                        total[j, out] += value[tree.leaves_of(x)]
                seen = np.flatnonzero(n)
                for j, f in enumerate(permuted):
                    yield pd.DataFrame({"feature": f, "row": frame["row"].to_numpy()[seen], "sum": total[j, seen], "n": n[seen]})

        every = [rows.mapInPandas(of(held), "feature int, row long, sum double, n long") for held in parts]
        if len(every) == 1:
            return every[0]
        return reduce(DataFrame.union, every).groupBy("feature", "row").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))

    def _outcomes(self) -> DataFrame:
        """(row, time on the grid, event, key) of the training rows."""
        times = self.time_grid_

        def of(frames):
            for frame in frames:
                yield pd.DataFrame({"row": frame["row"], "time": times[frame["t"].to_numpy()], "event": frame["event"], "key": frame["key"]})

        return self._training_rows().select("row", "t", "event", "key").mapInPandas(of, "row long, time double, event int, key long")

    def predict_oob_risk(self, cause: int = 1) -> DataFrame:
        """(row, time, event, key, risk): mean out-of-bag mortality; rows that are in every bag get 0."""
        found = self._oob_sums(cause).select("row", (F.col("sum") / F.col("n")).alias("risk"))
        return self._outcomes().join(found, "row", "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))

    def oob_score(self, cause: int = 1) -> float:
        return concordance_index_cr(self.predict_oob_risk(cause), cause)

    # ---- importance -----------------------------------------------------------------------------------------------------

    def compute_importance(self, df: DataFrame | None = None, causes: Sequence[int] | None = None, weights: Sequence[float] | None = None, n_repeats: int = 1, seed: int = 0) -> DataFrame:
        """(feature, cause_k_vimp .., composite_vimp): out-of-bag drops in weighted C, or held-out drops in plain C on ``df``."""
        causes = list(causes or range(1, self.n_causes_ + 1))
        drops = {k: self._oob_drops(k) if df is None else self._held_out_drops(df, k, n_repeats, seed) for k in causes}
        w = np.full(len(causes), 1 / len(causes)) if weights is None else np.asarray(weights, float) / np.sum(weights)
        rows = [(c, *[float(drops[k][i]) for k in causes], float(sum(a * drops[k][i] for a, k in zip(w, causes)))) for i, c in enumerate(self.features_)]
        self.feature_importances_ = np.array([r[-1] for r in rows])
        columns = ", ".join(f"cause_{k}_vimp double" for k in causes)
        return self.trees_.sparkSession.createDataFrame(rows, f"feature string, {columns}, composite_vimp double")

    def _oob_drops(self, cause: int) -> list[float]:
        """All features in one pass: the permuted scores are groups of one weighted concordance."""
        base = compute_uno_weights(self._outcomes())
        sums = self._oob_sums(cause, range(-1, self.n_features_in_)).select("feature", "row", (F.col("sum") / F.col("n")).alias("risk")).persist()
        found = {r["feature"]: r["numer"] / r["denom"] if r["denom"] else math.nan for r in uno_terms(sums.join(base, "row"), cause, by=["feature"]).collect()}
        sums.unpersist()
        return [found[-1] - found[f] for f in range(self.n_features_in_)]

    def _held_out_drops(self, df: DataFrame, cause: int, n_repeats: int, seed: int) -> list[float]:
        """Mean drop over shuffles of each column: values are dealt anew by the order of a hash, all shuffles are scored at once."""
        def ordered(frame: DataFrame, by, name: str) -> DataFrame:
            """Rows numbered in the order of a hash, by blocks of it."""
            return running(with_blocks(frame.withColumn("__h", by), "__h"), [], ["__h", *frame.columns], {name: ("sum", F.lit(1.0), "upto")}).select(*frame.columns, F.col(name).cast("long").alias(name))

        rows = ordered(df.select(*self.features_, self.time_, self.event_), F.xxhash64(*self.features_, self.time_, self.event_), "__i").persist()
        trials = [rows.withColumn("trial", F.lit(-1))]
        for j, c in enumerate(self.features_):
            for r in range(n_repeats):
                dealt = ordered(rows.select(F.col(c).alias("__v"), F.col("__i").alias("__k")), F.xxhash64(F.lit(seed + 1000 * r + j), "__k"), "__i").select("__v", "__i")
                trials.append(rows.drop(c).join(dealt, "__i").withColumnRenamed("__v", c).withColumn("trial", F.lit(j * n_repeats + r)).select(*rows.columns, "trial"))
        every = trials[0]
        for t in trials[1:]:
            every = every.unionByName(t)
        scored = self.predict_risk(every, cause).select("trial", self.time_, self.event_, "risk").persist()
        found = {r["trial"]: (r["concordant"] + 0.5 * r["tied"]) / r["comparable"] if r["comparable"] else 0.5 for r in concordance_pairs(scored, cause, self.event_, self.time_, by=["trial"]).collect()}
        scored.unpersist()
        rows.unpersist()
        return [found[-1] - float(np.mean([found[j * n_repeats + r] for r in range(n_repeats)])) for j in range(len(self.features_))]

    def minimal_depth(self) -> DataFrame:
        """(feature, mean_min_depth, q25, q75, frac_used, threshold, selected), rising."""
        return depth_frames.minimal_depth(self.tree_table(), self.features_)

    # ---- attributions -------------------------------------------------------------------------------------------------------

    def shap_values(self, df: DataFrame, key: str, cause: int = 1, times: Sequence[float] | None = None, aggregate: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Path-dependent Shapley values of the incidence: rows (key, feature, phi[time]) and the base value.

        ``aggregate`` "sum" or "trapezoid" turns the time axis into one number first. For each row the values add
        up to its predicted incidence less the base.
        """
        m, k, steps, grid = len(self.time_grid_), self.n_causes_, self._grid_steps(times), self.time_grid_
        parts, features, edges, trees = self._parts(), self.features_, self.bin_edges_, self.n_estimators

        def values(tree: Tree) -> np.ndarray:
            v = tree.curves(np.arange(len(tree.starts) - 1), m, k)[:, cause - 1]
            axis = grid
            if steps is not None:
                v, axis = np.where(steps >= 0, v[:, np.maximum(steps, 0)], 0.0), np.asarray(times, float)
            if aggregate == "sum":
                v = v.sum(axis=1, keepdims=True)
            elif aggregate == "trapezoid":
                v = ((v[:, 1:] + v[:, :-1]) / 2 @ np.diff(axis))[:, None]
            return v

        def phis(frame, forest):
            bins = np.stack([np.searchsorted(e, frame[c].to_numpy(float), side="right") for c, e in zip(features, edges)], axis=1)
            phi = None
            for tree in forest:
                v = values(tree)
                phi = np.zeros((len(bins), len(features), v.shape[1])) if phi is None else phi
                for leaf, f, low, high, part in leaf_paths(tree):
                    if len(f):
                        inside = (bins[:, f] > low) & (bins[:, f] <= high)
                        phi[:, f] += path_weights(inside, part)[:, :, None] * v[leaf]
            return phi / trees

        def run(frames):
            for frame in frames:
                if not len(frame):
                    continue
                phi = 0.0
                for part in parts:
                    phi = phi + phis(frame, part.value)
                names = np.tile(np.array(features, dtype=object), len(frame))
                yield pd.DataFrame({key: np.repeat(frame[key].to_numpy(), len(features)), "feature": names, "phi": [x.tolist() for x in phi.reshape(-1, phi.shape[2])]})

        out = df.select(key, *[c for c in self.features_ if c != key]).mapInPandas(run, T.StructType([df.schema[key], T.StructField("feature", T.StringType()), T.StructField("phi", T.ArrayType(T.DoubleType()))]))
        base = np.mean([np.average(values(t), axis=0, weights=t.cover[t.feature < 0]) for part in parts for t in part.value], axis=0)
        return out, df.sparkSession.createDataFrame([([float(b) for b in base],)], "base array<double>")
