import math
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazardloom.functions.scalars import chi2_sf
from hazardloom.operators import censoring, concordance, evaluation, gray, incidence, minimal_depth, scans, stored
from hazardloom.sources import outcomes
from hazardloom.streaming import incremental


def frame(spark, time, event, **more):
    names = ["time", "event", *more]
    return spark.createDataFrame([tuple(float(x) if n == "time" else x for n, x in zip(names, r)) for r in zip(time, event, *more.values())], names)


def brute_cif(time, event, cause, t):
    s, f = 1.0, 0.0
    for u in sorted(set(time)):
        if u > t:
            break
        y = sum(x >= u for x in time)
        f += s * sum(x == u and e == cause for x, e in zip(time, event)) / y
        s *= 1 - sum(x == u and e != 0 for x, e in zip(time, event)) / y
    return f


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 3)), min_size=4, max_size=40))
def test_cif_equals_brute_force_and_is_monotone(spark, rows):
    time, event = [float(a) for a, _ in rows], [b for _, b in rows]
    out = incidence.cif(incidence.time_counts(frame(spark, time, event), causes=3), causes=3).orderBy("time").collect()
    for r in out:
        for k in (1, 2, 3):
            assert r[f"f_{k}"] == pytest.approx(brute_cif(time, event, k, r["time"]), abs=1e-12)
        assert sum(r[f"f_{k}"] for k in (1, 2, 3)) <= 1 + 1e-12


def test_requested_cause_without_events_is_zero(spark):
    fit = incidence.CumulativeIncidence([1, 9]).fit(frame(spark, [1, 2, 3], [1, 0, 1]))
    rows = {(r["cause"], r["t"]): r["cif"] for r in fit.timepoints([0.5, 3.0]).collect()}
    assert rows == {(1, 0.5): 0.0, (1, 3.0): 1.0, (9, 0.5): 0.0, (9, 3.0): 0.0}


def test_censoring_curves_by_hand(spark):
    g = [r["g"] for r in censoring.km_censor_score(frame(spark, [1, 2, 3, 4], [0] * 4)).orderBy("time").collect()]
    assert g == pytest.approx([0.75, 0.5, 0.25, 0.0])
    w = concordance.compute_uno_weights(frame(spark, [1, 2, 3], [0, 0, 0]), gmin="none").orderBy("time")
    assert [r["w"] for r in w.collect()] == pytest.approx([1, 2.25, 9])


def test_concordance_by_hand_and_edges(spark):
    rows = frame(spark, [3, 5, 1], [1, 0, 2], risk=[0.5, 0.1, 0.9])
    assert concordance.concordance_index_cr(rows) == 1.0
    assert concordance.concordance_index_cr(frame(spark, [1, 2], [2, 2], risk=[0.1, 0.2]), cause=1) == 0.5
    with pytest.raises(ValueError):
        concordance.concordance_index_cr(rows, cause=5)


def test_concordance_equals_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    t, e, p = rng.integers(1, 15, 80).astype(float), rng.integers(0, 3, 80), rng.integers(0, 9, 80) / 8
    c = n = 0.0
    for i in range(80):
        if e[i] == 1:
            later = t > t[i]
            n += later.sum()
            c += (p[later] < p[i]).sum() + 0.5 * (p[later] == p[i]).sum()
    rows = frame(spark, t.tolist(), e.tolist(), risk=p.tolist())
    assert concordance.concordance_index_cr(rows) == pytest.approx(c / n)
    one = concordance.concordance_pairs(rows).first()
    monkeypatch.setattr(concordance, "ONE_TASK", 0)
    assert concordance.concordance_pairs(rows).first() == one
    monkeypatch.undo()
    assert concordance.concordance_index_cr(rows.repartition(7)) == concordance.concordance_index_cr(rows.coalesce(1))


def test_gray_is_invariant_to_the_pivot(spark):
    rng = np.random.default_rng(1)
    t, e, g = rng.integers(1, 30, 200).astype(float), rng.integers(0, 3, 200), rng.integers(0, 3, 200)
    found = set()
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        for rho in (0.0, 1.0):
            rows = frame(spark, t.tolist(), e.tolist(), grp=[order[i] for i in g])
            r = gray.gray_test(rows, rho=rho)
            found.add((rho, round(r.statistic, 8)))
            assert r.df == 2 and 0 <= r.p_value <= 1
    assert len(found) == 2


def test_chi_square_tail():
    for x in (0.1, 1.0, 3.84, 20.0):
        assert chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert chi2_sf(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)


def test_brier_without_censoring_is_the_mean_square(spark):
    rows = frame(spark, [1, 2, 3, 4], [1, 2, 1, 1], p=[0.9, 0.2, 0.4, 0.1])
    pred = evaluation.long_predictions(rows, {"m": ["p"]}, [2.5])
    r = evaluation.brier_auc(pred, rows, [2.5]).first()
    assert r["brier"] == pytest.approx((0.01 + 0.04 + 0.16 + 0.01) / 4)
    assert r["auc"] == 1.0


def test_minimal_depth_expectation_by_hand(spark):
    rows = [(0, 0, 0, 0, False), (0, 1, 1, 1, False), (0, 2, 1, 2, False), (0, 3, 2, -1, True)]
    trees = spark.createDataFrame(rows, "tree_id int, node_id int, depth int, feature int, is_leaf boolean")
    assert minimal_depth.threshold(trees, 4).first()["threshold"] == pytest.approx(1.171875)


def test_blocked_scans_equal_windows(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 12)
    values = [-3.5, -1e-9, 0.0, 1e-300, 0.5, 1.0, 1.5, 2.0, 1e9, 1e9 + 1, float("inf")] + [float(x) for x in range(3, 90)]
    df = spark.createDataFrame([(g, t, None if (i + g) % 3 else float(i % 7), 1 + (i % 5) / 10) for g in (0, 1) for i, t in enumerate(values)], "g int, t double, x double, f double")
    df = df.unionByName(df.where("g = 1").withColumn("g", F.lit(None).cast("int")))
    spans = ("upto", "before", "onward", "after")
    outputs = {f"{op}_{s}": (op, F.col("f" if op == "product" else "x"), s) for op in ("sum", "product") for s in spans} | {f"last_{s}": ("last", F.col("x"), s) for s in ("upto", "before")}
    for by in ([], ["g"]):
        source = df if by else df.where("g = 0")
        one = scans.running(source, by, "t", outputs)
        many = scans.running(scans.with_blocks(source, "t", True), by, "t", outputs)
        key = lambda r: (-1 if r["g"] is None else r["g"], r["t"])
        left, right = sorted(one.collect(), key=key), sorted(many.collect(), key=key)
        assert len(left) == len(right)
        for a, b in zip(left, right):
            for name in outputs:
                assert a[name] == (pytest.approx(b[name], rel=1e-12) if b[name] is not None else None), name


def test_blocks_never_fall(spark):
    rows = [(None,), (float("-inf"),), (-1e300,), (-2.0,), (-1e-320,), (0.0,), (5e-324,), (1.0,), (1.0000001,), (3.0,), (1.7e308,), (float("inf"),), (float("nan"),)]
    bounds = [-1e300, -1.0, 0.0, 5e-324, 1.0000001, 2.0, float("inf")]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(scans.block_of(F.col("x"), bounds)).collect()]
    assert got == [0, 0, 1, 1, 2, 3, 4, 4, 5, 6, 6, 7, 7]
    assert {r[0] for r in spark.createDataFrame(rows, "x double").select(scans.block_of(F.col("x"), [])).collect()} == {0}


@pytest.mark.parametrize("value", ["1.7e9 + id * 31.0", "2020.0 + 5.0 * id / 20000", "exp(id / 100.0)", "cast(id % 7 as double)", "case when id % 3 > 0 then cast(id as double) end"])
def test_blocks_are_even_however_narrow_the_values_are(spark, monkeypatch, value):
    """A year of epoch seconds, years with decimals, values over many magnitudes, few values, many nulls."""
    monkeypatch.setattr(scans, "BLOCK_ROWS", 1000)
    df = spark.range(20_000).selectExpr("id", f"{value} as x")
    blocks = scans.with_blocks(df, "x", True)
    sizes = sorted(r["count"] for r in blocks.where("x is not null").groupBy(scans.BLOCK).count().collect())
    distinct = df.select("x").where("x is not null").distinct().count()
    hottest = df.where("x is not null").groupBy("x").count().agg(F.max("count")).first()[0]
    assert len(sizes) >= min(distinct, 12) and sizes[-1] <= max(2 * 1000, hottest)


def test_stored_tables_are_released(spark):
    since = stored.mark()
    df = stored.stored(spark.range(5).toDF("x"))
    assert sorted(r[0] for r in df.collect()) == list(range(5)) and stored.mark() == since + 1
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    stored.release(spark, since)
    assert not os.path.exists(path) and stored.mark() == since


@pytest.mark.parametrize("wide", [True, False])
def test_exact_quantiles(spark, wide):
    rng = np.random.default_rng(0)
    data = {g: rng.integers(0, 40, n) / 8 for g, n in (("a", 101), ("b", 7), ("c", 1))}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None), ("b", float("nan"))], "g string, x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in scans.quantiles(df, ["g"], "x", qs, wide=wide).collect()}
    assert got == {g: pytest.approx(np.quantile(xs, qs)) for g, xs in data.items()}


@pytest.mark.parametrize("wide", [True, False])
def test_quantiles_between_equal_values_are_that_value(spark, wide):
    """Weighted sums of two equal values miss some of them by the last bit."""
    values, qs = [i / 50 for i in range(1, 51)], [i / 10 for i in range(1, 10)]
    n = 60_000
    part = lambda q: (n - 1) * q - math.floor((n - 1) * q)
    assert any((1 - part(q)) * v + part(q) * v != v for v in values for q in qs)
    df = spark.createDataFrame([(i, v, n) for i, v in enumerate(values)], "g int, x double, w long")
    got = {r["g"]: r["quantiles"] for r in scans.quantiles(df, ["g"], "x", qs, weight="w", wide=wide).collect()}
    assert got == {i: [v] * len(qs) for i, v in enumerate(values)}


def test_estimators_by_blocks_equal_those_of_one_task(spark, sf_dir, monkeypatch):
    """Every registered estimator, concordance and evaluation query with no table small enough for one task."""
    from hazardloom.plans import estimation

    names = ["aj_cif_timepoints", "km_censor_uno", "gray_stat", "uno_gmin_auto", "cindex_uno", "calibration_deciles"]
    show = lambda df: sorted(tuple(f"{x:.7g}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    want = {n: show(estimation.QUERIES[n](spark, sf_dir)) for n in names}
    monkeypatch.setattr(scans, "ONE_TASK", 0)
    monkeypatch.setattr(scans, "BLOCK_ROWS", 300)
    from hazardloom.operators import concordance

    monkeypatch.setattr(concordance, "ONE_TASK", 0)
    for n in names:
        assert show(estimation.QUERIES[n](spark, sf_dir)) == want[n], n


def test_bootstrap_draws_are_made_once_and_not_broadcast(spark):
    rows = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") + 1.0).alias("time"), (F.col("id") % 3).cast("int").alias("event"), (F.col("id") % 7 / 10).alias("p"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    copies = evaluation.bootstrap_copies(rows.select("row_id", "time", "event"), "row_id", 6)
    assert "md5" in plan(copies) and "Broadcast" not in plan(copies)
    assert {r["n"] for r in copies.groupBy("rep").agg(F.sum("m").alias("n")).collect()} == {500} and copies.select("rep").distinct().count() == 6
    auc = evaluation.score_cr(evaluation.long_predictions(rows, {"a": ["p"]}, [200.0], ("row_id", "time", "event")), [200.0], n_bootstrap=6).auc
    assert "md5" not in plan(auc)


def test_bootstrap_reads_its_input_once_and_joins_in_tasks_of_bounded_rows(spark, monkeypatch):
    from hazardloom.operators import scans

    made, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(evaluation, "TASK_ROWS", 100)
    monkeypatch.setattr(scans, "stored", lambda df, f=scans.stored: made.append(plan(df)) or f(df))
    rows = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") + 1.0).alias("time"), (F.length(F.sha1(F.col("id").cast("string"))) * 0 + F.col("id") % 3).cast("int").alias("event"), (F.col("id") % 7 / 10).alias("p"))
    pred = evaluation.long_predictions(rows, {"a": ["p", "p"]}, [200.0, 300.0], ("row_id", "time", "event"))
    auc = evaluation.score_cr(pred, [200.0, 300.0], n_bootstrap=6).auc
    drawn = evaluation.bootstrap_copies(rows.select("row_id", "time", "event"), "row_id", 6).count()
    assert "sha1(" not in plan(auc) and any(f", {-(-drawn // 100)}), REPARTITION_BY_NUM" in p for p in made)
    # copies counted by m score as rows repeated that often
    outcomes = rows.select("row_id", "time", "event", F.lit(1).alias("rep"), (F.col("row_id") % 3).cast("int").alias("m"))
    counted = evaluation.brier_auc(pred.select("row_id", "model", "t", "p"), outcomes.where("m > 0"), [200.0, 300.0], 1, ["rep"], "row_id").orderBy("t").collect()
    repeat = lambda df: df.join(outcomes.select("row_id", "m"), "row_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m")))).where("i < m").drop("row_id", "m", "i")
    plain = evaluation.brier_auc(repeat(pred), repeat(rows.select("row_id", "time", "event")), [200.0, 300.0]).orderBy("t").collect()
    assert [(round(r["auc"], 12), round(r["brier"], 12)) for r in counted] == [(round(r["auc"], 12), round(r["brier"], 12)) for r in plain] and len(plain) == 2


def test_asof_join_sides(spark):
    knots = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "t double, v double")
    asked = spark.createDataFrame([(0.5,), (1.0,), (2.5,)], "t double")
    at = lambda strict: [r["v"] for r in scans.asof_join(asked, knots, "t", "v", strict=strict).orderBy("t").collect()]
    assert at(False) == [0.0, 10.0, 20.0]
    assert at(True) == [0.0, 0.0, 20.0]


def test_input_checks(spark):
    ok = frame(spark, [1, 2], [1, 0], x=[1.0, 2.0])
    assert outcomes.check_inputs(ok, ["x"]) == 1
    for time, event, x in (([1, 2], [2, 0], [1.0, 2.0]), ([-1, 2], [1, 0], [1.0, 2.0]), ([1, 2], [1, 0], [1.0, float("nan")]), ([1, 2], [0, 0], [1.0, 2.0])):
        with pytest.raises(ValueError):
            outcomes.check_inputs(frame(spark, time, event, x=x), ["x"])


def test_structured_outcome(spark):
    df = frame(spark, [1, 2], [1, 0]).select(outcomes.surv("event", "time", "status", "days").alias("y"))
    assert outcomes.is_surv(df, "y")
    assert [tuple(r) for r in outcomes.unpack_surv(df).select("event", "time").collect()] == [(1, 1.0), (0, 2.0)]


def test_stratified_split_is_exact(spark):
    df = spark.range(100).withColumn("event", (F.col("id") % 10 == 0).cast("int"))
    got = {r["event"]: r["n"] for r in outcomes.stratified_split(df, "id").where("is_test").groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 18, 1: 2}


def test_stream_keeps_curves(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark, [1, 2, 2, 3], [1, 0, 2, 1]).write.parquet(src)
    stream = spark.readStream.schema("time double, event long").parquet(src)
    query = incremental.maintain_curves(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    got = {r["time"]: r["f_1"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[3.0] == pytest.approx(brute_cif([1, 2, 2, 3], [1, 0, 2, 1], 1, 3))


def test_counts_are_appended_by_batch_and_merged(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    parts = [([1, 2, 2, 3], [1, 0, 2, 1]), ([2, 5], [1, 1]), ([4, 5, 5], [0, 2, 1])]
    time, event = [], []
    for i, (t, e) in enumerate(parts):
        frame(spark, t, e, g=["a"] * len(t)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("time double, event long, g string").parquet(src)
        incremental.append_counts(stream, out, check, ["g"]).awaitTermination(60)
        time, event = time + t, event + e
        got = {r["time"]: (r["f_1"], r["f_2"]) for r in incremental.current_curves(spark, out, ["g"]).collect()}
        assert got[max(time)] == pytest.approx(tuple(brute_cif(time, event, k, max(time)) for k in (1, 2)))
        if i == 1:
            incremental.compact(spark, out)
            incremental.compact(spark, out)
            assert len(os.listdir(f"{out}/merged")) == 1 and os.listdir(f"{out}/deltas") == []
            # a batch that was merged and is made again counts once
            frame(spark, [9.0], [1], g=["a"]).groupBy("g", "time", "event").agg(F.count("*").alias("n")).write.parquet(f"{out}/deltas/batch=1")
    assert incremental.current_counts(spark, str(tmp_path / "none")) is None
    assert sum(r["n"] for r in incremental.current_counts(spark, out).collect()) == len(time)
