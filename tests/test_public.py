import pytest

import hazardloom


def test_exports():
    assert all(hasattr(hazardloom, n) for n in hazardloom.__all__) and len(hazardloom.__all__) == 14


def test_outcomes_from_arrays(spark):
    df = hazardloom.Surv.from_arrays(spark, [True, False, 2], [1, 2.5, 3])
    assert [tuple(r["y"]) for r in df.collect()] == [(1, 1.0), (0, 2.5), (2, 3.0)]
    with pytest.raises(ValueError):
        hazardloom.Surv.from_arrays(spark, [1], [1.0, 2.0])


def test_score_frames(spark):
    rows = [(i, float(t), e, p, 1 - p) for i, (t, e, p) in enumerate([(1, 1, 0.9), (2, 2, 0.3), (3, 0, 0.4), (4, 1, 0.6), (5, 1, 0.2), (6, 0, 0.1), (7, 1, 0.5), (8, 2, 0.35)])]
    df = spark.createDataFrame(rows, "row_id long, time double, event int, a double, b double")
    from hazardloom.operators.evaluation import long_predictions

    pred = long_predictions(df, {"a": ["a", "a"], "b": ["b", "b"]}, [2.5, 4.5], ("row_id", "time", "event"))
    result = hazardloom.score_cr(pred, [2.5, 4.5], n_bootstrap=5, calibration_at=[4.5], calibration_n_bins=2)
    assert result.auc.columns == ["model", "times", "AUC", "lower", "upper"]
    assert result.auc.count() == 4 and result.brier.count() == 4 and result.ibs.count() == 2 and result.iauc.count() == 2
    auc = {(r["model"], r["times"]): r["AUC"] for r in result.auc.collect()}
    assert auc["a", 2.5] == pytest.approx(1 - auc["b", 2.5])
    assert {"predicted_decile", "observed_freq", "lower_ci", "upper_ci", "bin_n"} <= set(result.calibration.columns)
    with pytest.raises(ValueError):
        hazardloom.score_cr(pred, [4.5, 2.5])


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_sources_round_trip(spark, tmp_path, fmt):
    from hazardloom.sources.tables import read_survival, write_rows

    df = spark.createDataFrame([(1.5, 1, "a"), (2.0, 0, "b")], "days double, status int, grp string")
    write_rows(df, str(tmp_path / fmt), fmt)
    back = read_survival(spark, str(tmp_path / fmt), fmt, "days", "status")
    assert sorted((r["time"], r["event"], r["grp"]) for r in back.collect()) == [(1.5, 1, "a"), (2.0, 0, "b")]
    assert dict(back.dtypes)["time"] == "double" and dict(back.dtypes)["event"] == "int"


def test_views_have_their_columns(spark, sf_dir):
    from hazardloom.sources import tables

    assert set(tables.shipments_by_segment(spark, sf_dir).columns) == {"time", "event", "grp"}
    out = tables.signup_outcome(spark, sf_dir)
    assert out.where("time < 0 or event not in (0, 1, 2)").count() == 0 and out.count() > 0


def test_models_are_stages_of_pipelines(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from hazardloom import ml
    from hazardloom.sources.outcomes import synthetic_outcomes

    rows = synthetic_outcomes(spark, 200, 2, seed=3, partitions=2).persist()
    cox = ml.CauseSpecificCoxStage(features=["x0", "x1"], prediction="eta")
    both = Pipeline(stages=[cox, ml.FineGrayStage(features=["eta"], robust_se=True)]).fit(rows)
    out = both.transform(rows)
    assert out.columns[-2:] == ["eta", "prediction"] and both.stages[0].fitted.converged_
    assert ml.ConcordanceEvaluator().evaluate(out) > 0.55
    forest = ml.ForestStage(features=["x0", "x1"], n_estimators=2, random_state=1)
    grid = ParamGridBuilder().addGrid(forest.max_depth, [0, 3]).build()
    found = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=ml.ConcordanceEvaluator(), numFolds=2, seed=1).fit(rows)
    assert found.avgMetrics[0] == 0.5 < found.avgMetrics[1]


def test_stages_and_pipelines_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from hazardloom import ml
    from hazardloom.sources.outcomes import synthetic_outcomes

    rows, x = synthetic_outcomes(spark, 150, 2, seed=3, partitions=2).persist(), ["x0", "x1"]
    stages = [
        ml.ForestStage(features=x, prediction="risk", n_estimators=3, max_depth=3, random_state=4, time_grid=20), ml.FineGrayStage(features=x, prediction="fg"),
        ml.CauseSpecificCoxStage(features=x, prediction="cox", cause=2), ml.PenalizedFineGrayStage(features=x, prediction="pfg", n_lambda=3),
    ]
    pipeline = Pipeline(stages=stages)
    pipeline.save(str(tmp_path / "unfitted"))
    again = Pipeline.load(str(tmp_path / "unfitted"))
    assert [type(s) for s in again.getStages()] == [type(s) for s in stages] and again.getStages()[0].getOrDefault("n_estimators") == 3
    model = pipeline.fit(rows)
    model.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    show = lambda m: sorted(tuple(r) for r in m.transform(rows).select("id", "risk", "fg", "cox", "pfg").collect())
    assert show(loaded) == show(model) and [s.uid for s in loaded.stages] == [s.uid for s in model.stages]
    cif = lambda m: [r["cif"] for r in m.stages[1].fitted.predict_cumulative_incidence(rows, [5.0, 10.0]).orderBy("id").select("cif").collect()]
    assert cif(loaded) == cif(model)
    with pytest.raises(ValueError):
        loaded.stages[0].fitted.predict_oob_risk()  # the training rows are not saved
    files = [p.read_bytes() for p in (tmp_path / "fitted").rglob("*") if p.is_file()]
    assert not any(b"\x80\x04\x95" in f or b"\x80\x05\x95" in f for f in files)  # how pickles begin
    forest = model.stages[0].fitted
    forest.close()
    with pytest.raises(RuntimeError):
        forest.predict_risk(rows)


def test_survival_curve_in_sql(spark):
    from hazardloom.functions.table_functions import register_survival_curve

    register_survival_curve(spark)
    spark.createDataFrame([(1, [[0.1, 0.3], [0.0, 0.2]]), (2, None)], "id int, cif array<array<double>>").createOrReplaceTempView("curves_in_sql")
    got = spark.sql("SELECT id, c.* FROM curves_in_sql, LATERAL survival_curve(cif, array(10.0D, 20.0D), array(5, 10, 99)) c").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 5.0, 0.0, 1.0), (1, 1, 10.0, 0.1, 0.9), (1, 1, 99.0, 0.3, 0.5), (1, 2, 5.0, 0.0, 1.0), (1, 2, 10.0, 0.0, 0.9), (1, 2, 99.0, 0.2, 0.5)]
    with pytest.raises(Exception, match="survival_curve takes"):
        spark.sql("SELECT * FROM survival_curve(1, 2, 3)").collect()
