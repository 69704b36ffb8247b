"""Splits, scaling, models, search, retraining, explanation, jobs and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.operators import scoring
from wardlight.operators.linear import LinearScorer
from wardlight.plans import explain, jobs, training as t
from wardlight.sources import readers, writers
from wardlight.streaming import discharge, feedback

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    """The label follows ``a``; ``b`` is noise and ``c`` is constant."""
    noise = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0
    other = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000.0
    df = spark.range(0, 1200, 1, 4).select(
        "id", noise.alias("a"), other.alias("b"), F.lit(3.0).alias("c"),
        ((noise + other * 0.4) > 0.9).cast("int").alias("readmitted_30d"))
    return df.persist()


@pytest.fixture(scope="module")
def model(data):
    return t.fit(t.default_models()["logistic"], data, FEATURES)


def test_split_keeps_class_shares_exactly(data):
    train, test = t.stratified_split(data, ["id"])
    assert train.count() + test.count() == 1200 and test.count() == 240
    assert train.join(test, "id").count() == 0
    n1 = data.where("readmitted_30d = 1").count()
    assert abs(test.where("readmitted_30d = 1").count() - n1 * 0.2) < 1
    again = t.stratified_split(data.repartition(3), ["id"])[1]
    assert {r[0] for r in test.select("id").collect()} == {r[0] for r in again.select("id").collect()}
    assert "Exchange" not in test._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_shares_fill_up_by_largest_remainder():
    assert t._shares({0: 7, 1: 3}, 2) == {0: 1, 1: 1}
    assert t._shares({0: 88, 1: 12}, 20) == {0: 18, 1: 2}


def test_folds(data):
    folds = t.stratified_folds(data, ["id"], folds=5)
    sizes = {}
    for r in folds.groupBy("readmitted_30d", "_fold").count().collect():
        sizes.setdefault(r[0], []).append(r["count"])
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in sizes.values())


def test_positional_split(data):
    train, held = t.positional_split(data, "id", ["id"])
    assert train.count() == 960 and train.agg(F.max("id")).first()[0] == 959 and held.count() == 240


def test_scaling_uses_population_deviation(data):
    values = np.array([(r["a"], r["b"], r["c"]) for r in data.collect()])
    scaling = t.fit_scaling(data, FEATURES)
    for i, f in enumerate(FEATURES):
        assert scaling[f][0] == pytest.approx(values[:, i].mean())
    assert scaling["a"][1] == pytest.approx(values[:, 0].std()) and scaling["c"] == (3.0, 1.0)
    scaled = t.scale(data, scaling).agg(F.avg("a"), F.stddev_pop("a"), F.max("c")).first()
    assert tuple(scaled) == pytest.approx((0.0, 1.0, 0.0), abs=1e-9)


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    weights = lambda scheme: {r["y"]: r["_weight"] for r in t.weighted(df, "y", scheme).distinct().collect()}
    assert weights("balanced") == {0: pytest.approx(4 / 6), 1: 2.0}
    assert weights("ratio") == {0: 1.0, 1: 3.0} and weights("none") == {0: 1.0, 1: 1.0}
    with pytest.raises(ValueError):
        weights("odd")


def test_default_models_have_the_published_settings():
    models = t.default_models()
    assert models["logistic"].params == {"c": 0.1, "maxIter": 1000} and models["logistic"].scaled
    assert models["forest"].params == {"trees": 300, "max_depth": 8} and t.growth(models["forest"], 51).node_columns == 7
    assert models["boosting_a"].params["max_depth"] == 5 and models["boosting_a"].weighting == "ratio"
    assert models["boosting_b"].params == {"trees": 300, "learning_rate": 0.05, "max_depth": 6, "max_leaves": 31, "min_rows": 20}
    assert t.bootstrap_model().params["trees"] == 100
    assert t.logistic(models["logistic"], 50, "y").getRegParam() == pytest.approx(0.2)


def test_logistic_learns_and_survives_saving(data, model, tmp_path):
    auc = t.model_auc(model, data)
    assert auc > 0.9
    loaded = writers.load_model(writers.save_model(model, str(tmp_path / "m")))
    assert t.model_auc(loaded, data) == pytest.approx(auc)
    scored = scoring.with_probability(model, data)
    assert scored.columns == [*data.columns, "p"]


def test_every_kind_of_model_fits(data):
    specs = t.default_models()
    small = {
        "forest": specs["forest"].with_params(trees=5), "boosting_a": specs["boosting_a"].with_params(trees=3),
        "boosting_b": specs["boosting_b"].with_params(trees=3), "bootstrap": t.bootstrap_model(True).with_params(trees=3)}
    board = t.evaluate_all(t.fit_all(small, data, FEATURES), data).collect()
    assert len(board) == 4 and all(r["auc"] > 0.8 for r in board)
    assert [r["auc"] for r in board] == sorted((r["auc"] for r in board), reverse=True)


def test_cross_validation_and_search(data):
    row = t.cross_validate({"logistic": t.default_models()["logistic"]}, data, FEATURES, ["id"], folds=3).first()
    assert 0.8 < row["mean"] <= 1 and row["std"] >= 0
    specs = {"forest": t.default_models()["forest"].with_params(trees=6), "boosting": t.default_models()["boosting_b"].with_params(trees=5)}
    folds = t.cross_validated(specs, data, FEATURES, ["id"], folds=3)
    blocks = t.cross_validated(specs, data, FEATURES, ["id"], folds=3, block_rows=250)  # many blocks, the same trees
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, blocks.collect())) and folds.count() == 6
    assert folds.agg(F.min("auc")).first()[0] > 0.8


QUICK = {**t.RANGES, "trees": t.proposals.Range(1, 3, whole=True)}


def test_search(data):
    table, best = t.search(data, FEATURES, ["id"], 7, folds=2, startup=3, batch=2, ranges=QUICK)
    rows = table.collect()
    means = [r["mean"] for r in rows]
    assert len(rows) == 7 and means == sorted(means, reverse=True) and best == {n: rows[0][n] for n in QUICK}
    assert sorted(r["trial"] for r in rows if r["log_ratio"] is None) == [0, 1, 2]
    assert all(x.low <= r[n] <= x.high for r in rows for n, x in QUICK.items())
    again = t.search(data, FEATURES, ["id"], 7, folds=2, startup=3, batch=2, ranges=QUICK)[0].collect()
    assert again == rows
    model, report = t.refit_best(best, t.fit(t.default_models()["logistic"], data, FEATURES), data, data, FEATURES)
    row = report.first()
    assert row["improvement"] == pytest.approx((row["tuned_auc"] - row["baseline_auc"]) * 100)


def test_challenger_must_be_strictly_better(data, model, tmp_path):
    # On the same rows with the same settings the challenger cannot beat itself.
    train, _ = t.positional_split(data, "id", ["id"])
    spec = t.default_models()["logistic"]
    champion = t.fit(spec, train, FEATURES)
    kept, metrics = t.retrain(data, champion, FEATURES, "id", ["id"], "2024-01-01 00:00:00", spec=spec, save_to=str(tmp_path / "new"))
    row = metrics.first()
    assert kept is None and row["status"] == "no_improvement" and not row["model_saved"] and row["training_samples"] == 960
    assert not (tmp_path / "new").exists()
    weak = t.fit(t.bootstrap_model().with_params(trees=1, max_depth=1), train, ["b"])
    kept, metrics = t.retrain(data, weak, FEATURES, "id", ["id"], "2024-01-01 00:00:00", spec=spec, save_to=str(tmp_path / "new"))
    assert kept is not None and metrics.first()["status"] == "improved" and (tmp_path / "new").exists()
    writers.append_metrics(metrics, str(tmp_path / "history"))
    assert readers.read_metrics(data.sparkSession, str(tmp_path / "history")).count() == 1


def test_attribution(data, model):
    top = explain.linear_attribution(model, data, data, FEATURES, ["id"], rows=300, top=2).collect()
    assert top[0]["feature"] == "a" and len(top) == 2 and top[0]["importance"] > top[1]["importance"]
    moved = {r["feature"]: r["importance"] for r in explain.permutation_attribution(model, data, FEATURES, ["id"], rows=300).collect()}
    assert moved["a"] > moved["b"] and moved["c"] == pytest.approx(0.0)
    forest = t.fit(t.default_models()["forest"].with_params(trees=3), data, FEATURES)
    assert explain.split_importance(forest, FEATURES, data).first()["feature"] == "a"
    assert explain.attribution(forest, data, data, FEATURES, ["id"]).first()["feature"] == "a"
    with pytest.raises(TypeError):
        explain.linear_attribution(forest, data, data, FEATURES, ["id"])


def test_scoring_jobs(spark, data, model):
    predictions = jobs.score_features(model, data, FEATURES, keep=["id"])
    assert predictions.columns == ["id", "readmission_probability", "predicted_readmission", "risk_level", "actual"]
    assert predictions.count() == 1200
    assert jobs.daily_job(model, data, FEATURES).first()["total_scored"] == 1200
    requests = spark.createDataFrame([("p", {"a": "1.0"}, None), (None, {}, "x@y")], "patient_id string, patient_data map<string,string>, notify_email string")
    rows = {r["patient_id"]: r for r in jobs.score_requests(model, requests, FEATURES).collect()}
    assert rows["p"]["readmission_probability"] > rows["UNKNOWN"]["readmission_probability"]
    assert len(rows["UNKNOWN"]["recommendations"]) in (2, 3, 4)


def test_training_and_evaluation_jobs(data, tmp_path):
    specs = {"logistic": t.default_models()["logistic"], "forest": t.default_models()["forest"].with_params(trees=3)}
    result = jobs.training_job(data, ["id"], specs, folds=2, save_to=str(tmp_path / "models"))
    assert result.best in specs and result.cross_validation.count() == 2
    assert (tmp_path / "models" / "forest").exists()
    report = jobs.evaluation_job(result.models["logistic"], data, str(tmp_path / "report"))
    matrix = report["confusion"].first()
    assert sum(matrix) == 1200 and report["roc_auc"].first()[0] == pytest.approx(t.model_auc(result.models["logistic"], data))
    assert report["classification_report"].count() == 5 and report["pr_points"].count() == report["roc_points"].count()
    direct = scoring.with_probability(result.models["logistic"], data)
    best = report["best_threshold"].first()["threshold"]
    from wardlight.operators.evaluation import confusion
    assert tuple(confusion(direct, best, label="readmitted_30d").first()) == tuple(matrix)


def test_discharge_stream_equals_batch_and_may_run_twice(spark, model, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    events = [{"patient_id": f"p{i}", "patient_data": {"a": str(i / 20), "b": "0.5", "c": "3"}, "notify_email": "t@x" if i % 2 else None} for i in range(20)]
    for k in range(2):
        (inbox / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events[k * 10:(k + 1) * 10]))
    stream = discharge.score_events(readers.stream_requests(spark, str(inbox), files_per_batch=1), model, FEATURES)
    paths = [str(tmp_path / n) for n in ("scores", "alerts", "checkpoint")]
    discharge.run_stream(stream, *paths, once=True).awaitTermination()
    batch = discharge.score_events(readers.read_requests(spark, str(inbox)), model, FEATURES)
    results = discharge.results(batch.withColumn("scored_at", F.current_timestamp())).drop("scored_at")
    columns, expected = results.columns, sorted(tuple(r) for r in results.collect())
    got = spark.read.parquet(paths[0])
    assert sorted(tuple(r) for r in got.select(columns).collect()) == expected and got.select("batch").distinct().count() == 2
    assert got.where("scored_day <> to_date(scored_at)").count() == 0
    assert spark.read.parquet(paths[1]).count() == scoring.alert_rows(batch).count() > 0
    # Nothing new: a second run adds nothing.
    discharge.run_stream(stream, *paths, once=True).awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 20
    # A new checkpoint starts at batch 0 again and keeps what was there.
    discharge.run_stream(stream, *paths[:2], str(tmp_path / "other"), once=True).awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 40 and spark.read.parquet(paths[0]).select("query").distinct().count() == 2


def test_outcome_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    record = {"patient_id": "P1", "predicted_risk": 0.7, "actually_readmitted": 1, "recorded_at": "2024-01-01T00:00:00", "notes": ""}
    (inbox / "a.json").write_text("\n".join(json.dumps(r) for r in [record, record, {"patient_id": "P2"}]))
    stream = readers.stream_outcomes(spark, str(inbox))
    for name, option, rows in (("plain", None, 3), ("distinct", "1 hour", 2)):
        log = str(tmp_path / name)
        feedback.append_outcome_stream(stream, log, str(tmp_path / f"{name}-c"), once=True, distinct_within=option).awaitTermination()
        assert readers.read_outcomes(spark, log).count() == rows
    p2 = readers.read_outcomes(spark, str(tmp_path / "plain")).where("patient_id = 'P2'").first()
    assert (p2["predicted_risk"], p2["actually_readmitted"], p2["notes"]) == (0.5, 0, "") and p2["recorded_at"] is not None


def test_unknown_features_count_as_zero(spark, data):
    gaps = data.withColumn("a", F.when(F.col("id") % 50 != 0, F.col("a"))).withColumn("b", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("b")))
    zeros = gaps.fillna(0.0, subset=["a"]).withColumn("b", F.nanvl("b", F.lit(0.0)))
    for name in ("logistic", "boosting_b"):
        spec = t.default_models()[name]
        spec = spec.with_params(trees=3) if name != "logistic" else spec
        assert t.model_auc(t.fit(spec, gaps, FEATURES), gaps) == pytest.approx(t.model_auc(t.fit(spec, zeros, FEATURES), zeros))
    assert t.cross_validate({"l": t.default_models()["logistic"]}, gaps, FEATURES, ["id"], folds=2).first()["mean"] > 0.8
    assert t.search(gaps, FEATURES, ["id"], 1, folds=2, ranges=QUICK)[0].count() == 1
    champion = t.fit(t.bootstrap_model().with_params(trees=1), gaps, FEATURES)
    assert t.retrain(gaps, champion, FEATURES, "id", ["id"], "2024-01-01 00:00:00", spec=t.default_models()["logistic"])[1].count() == 1


def test_a_fold_fit_knows_its_own_rows(data, monkeypatch):
    seen = []
    real = t.logistic
    monkeypatch.setattr(t, "logistic", lambda spec, rows, label: seen.append(rows) or real(spec, rows, label))
    t.cross_validate({"l": t.default_models()["logistic"]}, data, FEATURES, ["id"], folds=4)
    assert sorted(seen) and all(abs(n - 900) <= 2 for n in seen)


def test_one_class_cannot_be_compared(data, model):
    late = data.withColumn("readmitted_30d", F.when(F.col("id") >= 960, 1).otherwise(F.col("readmitted_30d")))
    kept, metrics = t.retrain(late, model, FEATURES, "id", ["id"], "2024-01-01 00:00:00", spec=t.default_models()["logistic"])
    assert kept is None and metrics.first()["status"] == "not_comparable" and metrics.first()["improvement"] is None
    with pytest.raises(ValueError):
        t.stratified_split(data.withColumn("readmitted_30d", F.col("id") % 3), ["id"])


def test_learning_job_keeps_its_metrics(spark, data, tmp_path):
    outcomes = spark.range(60).select(
        F.lit("p").alias("patient_id"), (F.col("id") / 60.0).alias("predicted_risk"), (F.col("id") < 30).cast("int").alias("actually_readmitted"))
    weak = t.fit(t.bootstrap_model().with_params(trees=1, max_depth=1), data, ["b"])
    where = dict(metrics_path=str(tmp_path / "metrics"), save_to=str(tmp_path / "challenger"), spec=t.default_models()["logistic"])
    report, metrics = jobs.learning_job(outcomes, data, weak, FEATURES, "id", ["id"], "2024-01-01 00:00:00", **where)
    assert report.first()["status"] == "drift_detected" and metrics.first()["status"] == "improved" and (tmp_path / "challenger").exists()
    assert readers.read_metrics(spark, where["metrics_path"]).count() == 1
    fine = outcomes.withColumn("actually_readmitted", 1 - F.col("actually_readmitted"))
    assert jobs.learning_job(fine, data, weak, FEATURES, "id", ["id"], "2024-01-01 00:00:00", **where)[1] is None
    assert readers.read_metrics(spark, where["metrics_path"]).count() == 1


def test_given_coefficients(spark):
    scorer = LinearScorer({"a": 2.0, "b": -1.0}, 0.5)
    df = spark.createDataFrame([(1.0, 1.0), (None, float("nan"))], "a double, b double")
    p = [r["p"] for r in scoring.with_probability(scorer, df).collect()]
    assert p == pytest.approx([1 / (1 + np.exp(-1.5)), 1 / (1 + np.exp(-0.5))])
    top = explain.linear_attribution(scorer, df, df, ["a", "b"], [], rows=None).collect()
    assert [(r["feature"], r["importance"]) for r in top] == [("a", 1.0), ("b", 0.5)]


def test_jobs_leave_nothing_behind(spark, data, model, tmp_path):
    import os

    from wardlight.session import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    jobs.training_job(data, ["id"], {"logistic": t.default_models()["logistic"]}, folds=2)
    report = jobs.evaluation_job(model, data, str(tmp_path / "report"))
    assert report["prevalence"].first()[0] == pytest.approx(data.agg(F.avg("readmitted_30d")).first()[0])
    left = {x for x in set(os.listdir(shared_dir(spark))) - before if not os.path.isdir(f"{shared_dir(spark)}/{x}") or "-" in x and not x.count("-") == 4}
    assert left == set()


def test_report_ends_with_the_attribution(data, model, tmp_path):
    report = jobs.evaluation_job(model, data, str(tmp_path / "report"), features=FEATURES, ids=["id"], sample=300)
    assert report["attribution"].orderBy(F.desc("importance")).first()["feature"] == "a"
    with pytest.raises(ValueError):
        explain.permutation_attribution(model, data, FEATURES, ["id"], rows=10**6)


def test_the_registered_search_draws_all_trials():
    from wardlight.catalog import learning

    assert learning.TRIALS == 50 and len(t.RANGES) == 9
