"""The exact split search against brute force, and its two forms against each other."""



import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardloom.operators import draws, exact_splits, scans, tree_kernel
from hazardloom.operators.forest import CompetingRiskForest

FEATURES = ["x0", "x1", "x2"]
RULES = [("logrankCR", None), ("logrank", None), ("logrank", [1.0, 0.5])]


def brute_split(x, t, e, m, rule, weights, min_leaf):
    """(feature, threshold) by counting every risk set of every midpoint."""
    x, t, e = (np.repeat(a, m, axis=0) for a in (x, t, e))
    lau, best = rule == "logrankCR", (0.0, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left, num, var = x[:, f] <= (low + high) / 2, 0.0, 0.0
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            for k in (1, 2) if lau or weights else (1,):
                w = weights[k - 1] if weights else 1.0
                for j in np.unique(t[e == k]):
                    case, there = (t == j) & (e == k), (t >= j).sum()
                    risk = (t >= j) | (lau & (e > 0) & (e != k) & (t < j))
                    d, y, yl = case.sum(), risk.sum(), (risk & left).sum()
                    num += w * ((case & left).sum() - d * yl / y) if there >= (1 if lau else 2) else 0.0
                    var += w * w * d * yl * (y - yl) * (y - d) / (y * y * max(y - 1, 1)) if there >= 2 else 0.0
            if var >= 1e-12:
                stat = exact_splits.significant(np.array([num * num / var]))[0]
                if stat > best[0]:
                    best = (stat, f, (low + high) / 2)
    return best[1:]


@pytest.mark.parametrize("rule, weights", RULES)
def test_search_in_a_task_equals_brute_force(rule, weights):
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(5, 40))
        x, t, e, m = rng.integers(0, rng.integers(2, 30), (n, 3)).astype(float), rng.integers(0, rng.integers(2, 25), n), rng.integers(0, 3, n), rng.integers(1, 4, n)
        f, threshold, _ = exact_splits.node_splits(np.zeros(n, int), np.array([1]), x, np.unique(t, return_inverse=True)[1], e, m.astype(float), np.array([[0, 1, 2]]), causes=2, rule=rule, cause=1, weights=weights, min_leaf=2, nsplit=0, seed=0, tree=0)
        assert (f[0], threshold[0]) == brute_split(x, t, e, m, rule, weights, 2)


def test_nodes_of_a_level_do_not_mix():
    rng = np.random.default_rng(2)
    parts = [(rng.integers(0, 9, (n, 2)).astype(float), rng.integers(0, 9, n), rng.integers(0, 3, n)) for n in (30, 4, 25)]
    common = dict(causes=2, rule="logrankCR", cause=1, weights=None, min_leaf=1, nsplit=0, seed=0, tree=0)
    drawn = np.array([[1, 0], [0, 1], [1, 0]])
    node = np.repeat(np.arange(3), [30, 4, 25])
    x = np.concatenate([p[0][:, d] for p, d in zip(parts, drawn)])
    joint = exact_splits.node_splits(node, np.arange(3), x, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.ones(59), drawn, **common)
    for i, (p, d) in enumerate(zip(parts, drawn)):
        alone = exact_splits.node_splits(np.zeros(len(p[0]), int), np.array([i]), p[0][:, d], p[1], p[2], np.ones(len(p[0])), drawn[[i]], **common)
        assert [a[i] for a in joint] == [a[0] for a in alone]


def test_pair_sums_by_definition():
    rng = np.random.default_rng(1)
    node, rank, m = np.sort(rng.integers(0, 3, 60)), rng.integers(1, 12, 60), rng.integers(1, 4, 60).astype(float)
    part = np.sqrt(rank + 3 * node)
    want = [sum(m[j] * min(part[j], part[i]) for j in range(i) if node[j] == node[i]) for i in range(60)]
    assert exact_splits.pair_sums(node, rank, part, m) == pytest.approx(want)


@pytest.fixture(scope="module")
def rows(spark):
    """A feature of over 5,000 distinct values, one of few, one that repeats the first."""
    u = lambda seed: F.abs(F.xxhash64(F.lit(seed), "id") % 100_000) / 1000.0
    df = spark.range(5200).select("id", u(1).alias("x0"), F.floor(u(2) / 20).alias("x1"), u(3).alias("u"), u(4).alias("v"))
    return df.select("id", "x0", "x1", F.round("x0").alias("x2"), F.floor(F.col("u") * (1 + F.col("x0") / 60)).alias("time"), F.when(F.col("v") < 30, 0).when(F.col("v") < 70 + F.col("x1") * 4, 1).otherwise(2).alias("event")).persist()


def nodes(model):
    return sorted(tuple(r) for r in model.tree_table().collect()), [e.tolist() for e in model.bin_edges_]


@pytest.mark.parametrize("more", [dict(), dict(nsplit=4, max_features="sqrt"), dict(splitrule="logrank", cause=2), dict(splitrule="logrank", cause_weights=[1.0, 0.3])], ids=str)
def test_reference_trees_are_the_same_at_every_size(rows, monkeypatch, more):
    settings = dict(n_estimators=2, max_depth=3, random_state=5, mode="reference", max_features=None) | more
    near = nodes(CompetingRiskForest(**settings).fit(rows, FEATURES, key="id"))
    monkeypatch.setattr(exact_splits, "NODE_BYTES", 8 * 7 * 1500)  # the first levels by scans
    monkeypatch.setattr(scans, "ONE_TASK", 2000 if not more else scans.ONE_TASK)
    monkeypatch.setattr(scans, "BLOCK_ROWS", 3000)
    assert nodes(CompetingRiskForest(**settings).fit(rows.repartition(3), FEATURES, key="id")) == near
    assert len(near[0]) > 15


def test_reference_forest_routes_rows_by_its_thresholds(rows):
    some = rows.where("id < 700")
    model = CompetingRiskForest(n_estimators=3, max_depth=4, random_state=1, mode="reference").fit(some, FEATURES)
    found = exact_splits.grow_exact(_keyed(some), 3, n_trees=3, seed=1, bootstrap=True, causes=2, mtry=2, nsplit=0, max_depth=4, min_split=6, min_leaf=3, rule="logrankCR", cause=1)
    frame = some.select(*FEATURES).toPandas().to_numpy(float)
    bins = np.stack([np.searchsorted(e, frame[:, j], side="right") for j, e in enumerate(model.bin_edges_)], axis=1)
    trees = dict(tree_kernel.trees_of(model.trees_.toArrow()))
    for i, splits in found.items():
        g = exact_splits._Growing()
        g.splits = splits
        paths, leaves = g.place(frame), trees[i].leaves_of(bins)
        assert len(set(zip(paths, leaves))) == len(set(paths)) == len(set(leaves)) > 4
    assert model.oob_score(1) > 0.5
    importance = {r["feature"]: r["composite_vimp"] for r in model.compute_importance(causes=[1]).collect()}
    assert set(importance) == set(FEATURES)
    assert model.predict_cif(some, [20.0, 60.0]).count() == 700


def _keyed(df):
    from hazardloom.operators.forest_distributed import keyed

    return exact_splits.stored(keyed(df.select(*[F.col(c).cast("double") for c in [*FEATURES, "time", "event"]])))


def test_rows_that_cannot_be_split(spark):
    same = spark.range(50).select(F.lit(1.0).alias("x0"), F.col("id").alias("time"), F.lit(1).alias("event"))
    model = CompetingRiskForest(n_estimators=2, mode="reference").fit(same, ["x0"])
    assert {r["is_leaf"] for r in model.tree_table().collect()} == {True} and model.bin_edges_[0].size == 0
    assert model.predict_risk(same).count() == 50


def test_draw_limits():
    with pytest.raises(ValueError):
        CompetingRiskForest(nsplit=draws.MOST_DRAWN + 1)._check()
    assert len(draws.POISSON) > 15 and (np.diff(draws.POISSON) > 0).all() and draws.POISSON[-1] < 1
