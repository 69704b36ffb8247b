"""Scoring columns, summaries, alerts and evaluation against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.operators import evaluation as ev
from wardlight.operators import ordering, scoring
from wardlight.streaming import feedback


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    return [(rng.choice([0.7] * 3 + [round(rng.random(), 2) for _ in range(6)]), int(rng.random() < 0.4)) for _ in range(400)]


@pytest.fixture
def scored(spark, sample):
    return spark.createDataFrame(sample, "p double, label int").repartition(5)


def brute_auc(rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_curve(rows):
    total = sum(y for _, y in rows)
    out = {}
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp = sum(1 for p, y in rows if p >= t and y)
        fp = sum(1 for p, y in rows if p >= t and not y)
        out[t] = (tp / (tp + fp), tp / total, fp / (len(rows) - total))
    return out


@pytest.mark.parametrize("range_rows", [50_000, 7])
def test_curves_against_brute_force(scored, sample, monkeypatch, range_rows):
    monkeypatch.setattr(ordering, "RANGE_ROWS", range_rows)
    scores = ev.kept_scores(scored)
    curve = brute_curve(sample)
    assert ev.roc_auc(scores).first()[0] == pytest.approx(brute_auc(sample), abs=1e-12)
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in ev.pr_points(scores).collect()}
    assert pr.pop(None) == (1.0, 0.0)
    assert pr == {t: pytest.approx((p, r)) for t, (p, r, _) in curve.items()}
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in ev.roc_points(scores).collect()}
    assert roc.pop(None) == (0.0, 0.0)
    assert roc == {t: pytest.approx((f, r)) for t, (_, r, f) in curve.items()}
    steps, last = 0.0, 0.0
    for p, r, _ in curve.values():
        steps, last = steps + (r - last) * p, r
    assert ev.average_precision(scores).first()[0] == pytest.approx(steps)
    f1 = {t: 2 * p * r / (p + r + 1e-9) for t, (p, r, _) in curve.items()}
    top = max(f1.values())
    best = ev.best_f1(scores).first()
    assert best["threshold"] == min(t for t, v in f1.items() if v == top) and best["f1"] == pytest.approx(top)


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "p double, label int")
    assert ev.auc_value(df) is None
    assert ev.roc_auc(ev.kept_scores(spark.createDataFrame([], "p double, label int"))).first()[0] is None


def test_ties_count_half(spark):
    assert ev.auc_value(spark.createDataFrame([(0.7, 1), (0.7, 0)] * 5, "p double, label int")) == 0.5


def test_confusion_and_report(scored, sample):
    counts = ev.confusion(scored, 0.5)
    tn, fp, fn, tp = counts.first()
    assert tp == sum(1 for p, y in sample if p >= 0.5 and y) and tn == sum(1 for p, y in sample if p < 0.5 and not y)
    report = {r["class"]: r for r in ev.classification_report(counts).collect()}
    assert report["1"]["precision"] == pytest.approx(tp / (tp + fp)) and report["0"]["support"] == tn + fp
    assert report["accuracy"]["f1"] == pytest.approx((tp + tn) / 400)
    assert report["macro avg"]["recall"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)


def test_report_without_predictions_of_a_class(spark):
    report = ev.classification_report(ev.confusion(spark.createDataFrame([(0.1, 0), (0.2, 1)], "p double, label int")))
    assert {r["class"]: r["precision"] for r in report.collect()}["1"] == 0.0


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 88 + [(1,)] * 12, "label int")
    rows = {r["label"]: r for r in ev.class_weights(df).collect()}
    assert rows[0]["weight"] == pytest.approx(100 / 176) and rows[1]["weight"] == pytest.approx(100 / 24)
    assert rows[0]["ratio"] == pytest.approx(88 / 12)
    assert ev.prevalence(df).first()[0] == pytest.approx(0.12)


def test_fold_spread_and_leaderboard(spark):
    folds = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.9), ("b", 0.9)], "model string, auc double")
    rows = {r["model"]: tuple(r)[1:] for r in ev.mean_and_spread(folds, ["model"]).collect()}
    assert rows["a"] == pytest.approx((0.6, 0.1)) and rows["b"] == pytest.approx((0.9, 0.0))
    board = ev.leaderboard(spark.createDataFrame([("x", 0.5), ("b", 0.7), ("a", 0.7)], "model string, auc double"))
    assert [r["model"] for r in board.collect()] == ["a", "b", "x"]


def test_mean_absolute_and_top(spark):
    parts = spark.createDataFrame([(1.0, -4.0), (-3.0, 4.0)], "a double, b double")
    got = ev.top_features(ev.mean_absolute(parts, ["a", "b"]), 1).collect()
    assert [tuple(r) for r in got] == [("b", 4.0)]


def test_summaries(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.59996,), (0.6,), (0.9,)], "p double")
    assert tuple(scoring.daily_summary(df).first()) == (5, 2, 2, 1, pytest.approx(0.48))
    table = df.select(*scoring.prediction_columns(F.col("p")))
    row = scoring.band_summary(table).first()
    assert (row["total_patients"], row["high_risk"], row["medium_risk"], row["low_risk"]) == (5, 1, 2, 1)
    assert row["high_share"] == pytest.approx(0.2)
    # Band and decision are taken before rounding.
    assert table.where("readmission_probability = 0.6").where("risk_level = 'Medium'").count() == 2
    empty = scoring.band_counts(df.where("p > 0.8"))
    assert {r[0]: r[1] for r in empty.collect()} == {"High": 1, "Medium": 0, "Low": 0}


def test_alerts(spark):
    df = spark.createDataFrame(
        [("1", 0.612, "a@x"), ("2", 0.9, None), ("3", 0.9, ""), ("4", 0.5, "a@x"), (None, 0.7, "b@x")],
        "patient_id string, p double, notify_email string")
    rows = {r["patient_id"]: r for r in scoring.alert_rows(df).collect()}
    assert set(rows) == {"1", "UNKNOWN"}
    assert "HIGH" in rows["1"]["message"] and "61.2%" in rows["1"]["message"] and rows["1"]["subject"].endswith("Patient 1")
    assert all(t in rows["1"]["message"] for t in fixed.RECOMMENDATIONS["High"])


TEN = [(f"P{i}", 0.7, 1 - i % 2) for i in range(10)]


def outcome_rows(spark, rows):
    return spark.createDataFrame(rows, "patient_id string, predicted_risk double, actually_readmitted int")


def test_drift_needs_enough_outcomes(spark):
    row = feedback.drift_report(outcome_rows(spark, TEN)).first()
    assert row["status"] == "insufficient_data" and row["message"] == "Need 40 more outcomes to detect drift"
    assert row["min_required"] == 50 and row["current_auc"] is None and row["drift_detected"] is None


def test_drift_states(spark):
    tied = feedback.drift_report(outcome_rows(spark, TEN), 10).first()
    assert (tied["status"], tied["current_auc"], tied["drift_detected"]) == ("drift_detected", 0.5, True)
    assert tied["recommendation"] == "Retrain model immediately"
    good = feedback.drift_report(outcome_rows(spark, [("a", 0.9, 1), ("b", 0.1, 0)]), 2).first()
    assert (good["status"], good["current_auc"], good["recommendation"]) == ("no_drift", 1.0, "Model performing well")
    one_class = feedback.drift_report(outcome_rows(spark, [("a", 0.9, 1), ("b", 0.1, 1)]), 2).first()
    assert one_class["current_auc"] == 0.5 and one_class["drift_detected"]
    nothing = feedback.drift_report(outcome_rows(spark, [])).first()
    assert nothing["outcomes_count"] == 0 and nothing["status"] == "insufficient_data"


def test_learning_run_retrains_on_drift_only(spark):
    calls = []
    retrain = lambda: calls.append(1) or spark.range(1)
    assert feedback.learning_run(outcome_rows(spark, TEN), retrain)[1] is None and not calls
    assert feedback.learning_run(outcome_rows(spark, TEN), retrain, 10)[1] is not None and calls == [1]


def test_health(spark):
    metrics = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-01 00:00:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("retrained_at"))
    row = feedback.system_health(outcome_rows(spark, TEN), metrics).first()
    assert (row["outcomes_recorded"], row["retraining_count"], row["drift_status"]) == (10, 2, "insufficient_data")
    assert row["last_retrain"] == "2024-01-02 03:04:05" and row["system_status"] == "healthy"
    assert feedback.system_health(outcome_rows(spark, TEN), metrics.limit(0)).first()["last_retrain"] == "Never"


def test_scores_that_are_no_numbers(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.2, 0), (0.9, 1), (nan, 1), (None, 0)], "p double, label int")
    kept = ev.kept_scores(df)
    assert (kept.rows, kept.positives, kept.negatives) == (4, 1, 1) and ev.auc_value(df) == 1.0
    rows = df.select("p", *scoring.response_columns(F.col("p")), *scoring.prediction_columns(F.col("p"))[1:2]).where("p IS NULL OR isnan(p)").collect()
    assert [tuple(r)[1:5] for r in rows] == [(None, None, False, "Low")] * 2
    assert scoring.daily_summary(df).first()["total_scored"] == 2


def test_areas_of_groups(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 1), ("b", 0.5, 1), ("b", 0.5, 0), ("c", 0.3, 1)], "k string, p double, label int")
    assert {r["k"]: r["auc"] for r in ev.grouped_auc(df, ["k"]).collect()} == {"a": 1.0, "b": 0.5, "c": None}


@pytest.mark.parametrize("curve", [ev.roc_auc, ev.roc_points, ev.pr_points, ev.average_precision, ev.best_f1])
def test_a_curve_reads_the_written_scores_once(scored, curve):
    plan = curve(ev.kept_scores(scored))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Scan ExistingRDD[p" not in plan
