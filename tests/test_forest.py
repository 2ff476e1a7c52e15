import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardloom.operators import splits, tree_kernel
from hazardloom.operators.forest import CompetingRiskForest, resolve_max_features
from hazardloom.operators.grids import coarsen_time_grid, event_time_grid, feature_bin_edges
from hazardloom.sources.outcomes import synthetic_outcomes

FEATURES = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def rows(spark):
    return synthetic_outcomes(spark, 400, 4, seed=3, partitions=2).persist()


@pytest.fixture(scope="module")
def forest(rows):
    return CompetingRiskForest(n_estimators=8, max_depth=6, random_state=5).fit(rows, FEATURES)


def test_curves_are_incidences(forest, rows):
    for r in forest.predict_cif(rows.limit(50)).select("cif").collect():
        c = np.array(r["cif"])
        assert (np.diff(c, axis=1) >= -1e-12).all() and c.min() >= 0 and c.sum(axis=0).max() <= 1 + 1e-9
    h = np.array(forest.predict_chf(rows.limit(5)).first()["chf"])
    assert (np.diff(h, axis=1) >= -1e-12).all()


def test_forest_does_not_depend_on_partitions(forest, rows):
    again = CompetingRiskForest(n_estimators=8, max_depth=6, random_state=5).fit(rows.repartition(3, "id").sortWithinPartitions("id").coalesce(1).orderBy("id"), FEATURES)
    a, b = (m.predict_risk(rows).agg(F.sum("risk")).first()[0] for m in (again, CompetingRiskForest(n_estimators=8, max_depth=6, random_state=5).fit(rows.orderBy("id"), FEATURES)))
    assert a == pytest.approx(b, rel=1e-12)


def test_forest_finds_the_signal(forest, rows):
    assert forest.score(rows) > 0.6
    assert forest.oob_score() > 0.5
    top = forest.minimal_depth().first()
    assert top["feature"] in ("x0", "x1") and top["selected"]


def test_importance_ranks_the_signal(forest, rows):
    oob = {r["feature"]: r["cause_1_vimp"] for r in forest.compute_importance(causes=[1]).collect()}
    assert max(oob, key=oob.get) in ("x0", "x1", "x2")
    held = forest.compute_importance(rows.limit(200), causes=[1]).collect()
    assert len(held) == 4


def test_attributions_add_up(forest, rows):
    few = rows.limit(12).persist()
    phi, base = forest.shap_values(few, "id", times=[2.0, 8.0])
    sums = {r["id"]: (r["a"], r["b"]) for r in phi.groupBy("id").agg(F.sum(F.col("phi")[0]).alias("a"), F.sum(F.col("phi")[1]).alias("b")).collect()}
    start = base.first()["base"]
    for r in forest.predict_cif(few, [2.0, 8.0]).collect():
        assert [s + b for s, b in zip(sums[r["id"]], start)] == pytest.approx(r["cif"][0], abs=1e-9)


def test_path_weights_equal_the_definition():
    share = np.array([0.5, 0.25, 0.8])
    inside = np.array(list(itertools.product([False, True], repeat=3)))
    got = tree_kernel.path_weights(inside, share)
    for row, g in zip(inside, got):
        value = lambda s: math.prod(float(row[i]) if i in s else share[i] for i in range(3))
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, i}) - value(set(s))) for m in range(3) for s in itertools.combinations(rest, m))
            assert g[i] == pytest.approx(want, abs=1e-12)


def test_single_tree_equals_the_relational_tree(spark, rows):
    edges = feature_bin_edges(rows, FEATURES, 12)
    grid = event_time_grid(rows, 20)
    coarse = coarsen_time_grid(grid, 10)
    binned = splits.binned_rows(rows, FEATURES, edges, grid, coarse)
    _, found = splits.grow(binned, 4, 10, max_depth=3)
    local = binned.toPandas()
    bins, t, tf, e = local[[f"b{i}" for i in range(4)]].to_numpy(np.uint8), local["t"].to_numpy(), local["tf"].to_numpy(), local["event"].to_numpy()
    tree = tree_kernel.grow_tree(bins, t, tf, e, np.arange(len(bins)), 0, 0, n_bins=12, n_times=10, causes=2, mtry=4, nsplit=0, max_depth=3, min_split=6, min_leaf=3, rule="logrankCR", cause=1)
    where = {0: 1}
    got = []
    for i in range(len(tree.feature)):
        if tree.feature[i] >= 0:
            where[int(tree.left[i])], where[int(tree.left[i]) + 1] = 2 * where[i], 2 * where[i] + 1
            got.append((int(tree.depth[i]), where[i], int(tree.feature[i]), int(tree.split[i])))
    assert got == sorted((d, n, f, b) for d, n, f, b, _ in found)


def shown(m):
    return sorted(tuple(r) for r in m.tree_table().collect()), sorted(tuple(r) for r in m.leaf_table().collect())


def test_forests_are_the_same_at_every_size(rows, monkeypatch):
    """Trees, out-of-bag figures and importance on both sides of ``BROADCAST_BYTES``, however rows are partitioned, and in distributed mode."""
    from hazardloom.operators import forest as module

    twice = rows.unionByName(rows.limit(20))
    make = lambda df, mode="default": CompetingRiskForest(n_estimators=3, max_depth=4, random_state=5, mode=mode).fit(df, FEATURES)
    near = make(twice)
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    far = [make(twice.repartition(n)) for n in (1, 5)]
    for m in (*far, make(twice, "distributed")):
        assert shown(m) == shown(near)
    assert far[0].oob_score() == pytest.approx(near.oob_score(), abs=1e-12) and near.oob_score() > 0.5
    risk = lambda m: sorted((r["key"], r["risk"]) for r in m.predict_oob_risk().collect())
    assert len(risk(near)) == twice.count() and np.allclose(risk(far[1]), risk(near))
    drops = [sorted(tuple(r) for r in m.compute_importance().collect()) for m in (near, far[1])]
    for a, b in zip(*drops):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-12)


def test_a_key_column_decides_the_bags(rows):
    a, b = (CompetingRiskForest(n_estimators=2, max_depth=4, random_state=1).fit(df, FEATURES, key="id") for df in (rows, rows.orderBy(F.desc("id"))))
    assert shown(a) == shown(b)
    from hazardloom.operators.draws import copies

    ids = np.array([r["id"] for r in rows.collect()])
    roots = {r["tree_id"]: r["cover"] for r in a.tree_table().where("node_id = 0").collect()}
    assert roots == {i: copies(ids, 1, i).sum() for i in range(2)}
    out = {r["key"] for r in a.predict_oob_risk().where("risk > 0").collect()}
    assert out <= {int(i) for i in ids if min(copies(np.array([i]), 1, t)[0] for t in range(2)) == 0}


def test_large_forests_meet_their_leaves_by_a_join(rows, forest, monkeypatch):
    from hazardloom.operators import forest as module

    few = rows.limit(40).persist()
    show = lambda m: (sorted((r["id"], r["risk"]) for r in m.predict_risk(few).collect()), sorted((r["id"], *np.ravel(r["cif"])) for r in m.predict_cif(few, [2.0, 8.0]).collect()))
    want = show(forest)
    phi = lambda m: sorted((r["id"], r["feature"], *r["phi"]) for r in m.shap_values(few, "id", times=[2.0])[0].collect())
    first, oob = phi(forest), [r["risk"] for r in forest.predict_oob_risk(1).orderBy("row").collect()]
    monkeypatch.setattr(module, "FOREST_BYTES", 20_000)
    held = {n: forest.__dict__.pop(n) for n in ("_shared", "_shared_nodes", "_leaves") if n in forest.__dict__}
    try:
        assert len(forest._parts()) > 2
        monkeypatch.setattr(module, "FOREST_BYTES", 2_000)
        assert len(forest._nodes()) > 2
        for got, was in zip(show(forest), want):
            assert [r[0] for r in got] == [r[0] for r in was] and np.allclose([r[1:] for r in got], [r[1:] for r in was], atol=1e-12)
        assert [r[:2] for r in phi(forest)] == [r[:2] for r in first] and np.allclose([r[2:] for r in phi(forest)], [r[2:] for r in first], atol=1e-12)
        assert len(forest._mortality(1)) > 2
        assert np.allclose([r["risk"] for r in forest.predict_oob_risk(1).orderBy("row").collect()], oob, atol=1e-12)
    finally:
        for n in ("_shared", "_shared_nodes", "_leaves"):
            forest.__dict__.pop(n, None)
        forest.__dict__ |= held


def test_splits_are_drawn_without_replacement():
    from hazardloom.operators.draws import drawn_features, drawn_ranks, uniforms

    many = np.repeat([0, 3, 10, 11, 200], 4000)
    nodes = np.tile(np.arange(4000), 5)
    ranks = drawn_ranks(many, 10, nodes, np.ones(len(many), int), 3, 4)
    assert (np.diff(ranks, axis=1) > 0).all() and (ranks[many > 10] < many[many > 10, None]).all()
    assert (ranks[many <= 10] == np.arange(10)).all()
    assert np.bincount(ranks[many == 11].ravel(), minlength=11) / 4000 == pytest.approx(np.full(11, 10 / 11), abs=0.02)
    assert np.bincount(ranks[many == 200].ravel(), minlength=200).std() < 25
    drawn = drawn_features(np.arange(6000), 5, 2, 0, 0)
    assert (drawn[:, 0] != drawn[:, 1]).all() and np.bincount(drawn.ravel()) / 6000 == pytest.approx(np.full(5, 0.4), abs=0.03)
    u = uniforms(np.arange(20000), 1, 2)
    assert abs(u.mean() - 0.5) < 0.01 and 0 <= u.min() and u.max() < 1 and (u != uniforms(np.arange(20000), 2, 1)).all()


def test_many_event_times_do_not_wrap(spark):
    """More grid points than 16 bits hold, in both growers."""
    n = 70_000
    df = spark.range(n).select(((F.col("id") * 7919) % n + 1).cast("double").alias("time"), F.lit(1).alias("event"), (F.col("id") % 4).cast("double").alias("x"))
    m = CompetingRiskForest(n_estimators=1, max_depth=1, bootstrap=False, time_grid=None, random_state=0).fit(df, ["x"])
    assert m.leaf_table().agg(F.max("t_idx"), F.sum("n")).first()[:] == (n - 1, n)
    last = m.predict_cif(df.limit(3), [float(n)]).collect()
    assert all(r["cif"][0][0] == pytest.approx(1.0) for r in last)


def test_quantiles_are_exact_at_every_size(rows, monkeypatch):
    from hazardloom.operators import grids

    more = rows.select(*FEATURES, "time", "event").unionByName(rows.sparkSession.range(3000).select(*[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100_003)) / 7).alias(c) for c in FEATURES], (F.pmod(F.xxhash64("id"), F.lit(99_991)) / 11).alias("time"), F.lit(1).alias("event")))
    near = grids.feature_bin_edges(more, FEATURES, 12), grids.event_time_grid(more, 50)
    monkeypatch.setattr(grids.scans, "ONE_TASK", 20)
    monkeypatch.setattr(grids.F, "percentile_approx", None)
    far = grids.feature_bin_edges(more, FEATURES, 12), grids.event_time_grid(more, 50)
    assert all(a == pytest.approx(b, rel=1e-14) for a, b in zip((*near[0], near[1]), (*far[0], far[1])))
    local = more.toPandas()
    assert all(a == pytest.approx(grids.cut_points(np.unique(local[c]), 12), rel=1e-14) for a, c in zip(near[0], FEATURES))
    assert near[1] == pytest.approx(grids.time_points(np.unique(local["time"][local["event"] > 0]), 50), rel=1e-14)


def test_split_numerator_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2, 0.0), (2.0, 1, 0.0), (3.0, 1, 1.0), (4.0, 1, 1.0)], "time double, event int, x double")
    binned = splits.binned_rows(df, ["x"], [[0.5]], [1.0, 2.0, 3.0, 4.0]).withColumn("node", F.lit(1))
    standard = splits.split_statistics(binned, 1, 4, rule="logrank").first()
    assert standard["num"] == pytest.approx(2 / 3)


def test_saved_model_predicts_alike(forest, rows, spark, tmp_path):
    forest.save(str(tmp_path / "m"))
    again = CompetingRiskForest.load(spark, str(tmp_path / "m"))
    a, b = (m.predict_risk(rows).agg(F.sum("risk")).first()[0] for m in (forest, again))
    assert a == pytest.approx(b)


def test_parameters():
    assert [resolve_max_features(v, 10) for v in (None, "sqrt", "log2", 3, 99, 0.25)] == [10, 4, 4, 3, 10, 2]
    with pytest.raises(ValueError):
        CompetingRiskForest(splitrule="other")._check()
    with pytest.raises(ValueError):
        CompetingRiskForest().set_params(nothing=1)
    assert CompetingRiskForest().get_params()["max_depth"] == 15
    assert coarsen_time_grid(np.arange(5.0), 10).tolist() == [0, 1, 2, 3, 4]
    for wrong in (dict(rng_mode="rfsrc_aligned"), dict(equivalence="rfsrc", split_ntime=7), dict(nsplit=-1), dict(cause_weights=[1.0, 1.0])):
        with pytest.raises(ValueError):
            CompetingRiskForest(**wrong)._check()


def test_coarse_bins_are_shares_of_ranks():
    for n, k in ((20, 10), (200, 10), (11, 10), (37, 5)):
        grid = np.sort(np.random.default_rng(n).random(n)) * 100
        starts = [np.sum(grid < np.quantile(grid, j / k)) for j in range(k)]  # where each quantile bucket begins
        assert coarsen_time_grid(grid, k).tolist() == [sum(s <= i for s in starts) - 1 for i in range(n)]
    with pytest.warns(UserWarning):
        got = coarsen_time_grid(np.array([0.0] * 30 + [1.0, 10.0]), 10)
    assert got.tolist() == [0] * 30 + [1, 9]
