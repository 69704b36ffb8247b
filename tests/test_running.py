"""Streams with state against their batch twins, after every batch and after a restart."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.operators.cleaning import newest_per_key
from wardlight.streaming import feedback, running

OUTCOMES = "patient_id string, predicted_risk double, actually_readmitted int, recorded_at timestamp"
START = dt.datetime(2024, 1, 1)


def outcomes(rng, n, first=0):
    risks = [None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else round(float(rng.normal(0.5, 0.4)), int(rng.integers(1, 4))) for _ in range(n)]
    return [(f"P{rng.integers(20)}", r, None if rng.random() < 0.03 else int(rng.random() < 0.4), START + dt.timedelta(hours=first + k)) for k, r in enumerate(risks)]


def test_drift_follows_the_log(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(OUTCOMES).parquet(str(tmp_path / "in"))
    log = []
    for number in range(4):  # the query stops after each batch and starts anew from its checkpoint
        batch = outcomes(rng, (30, 90, 1, 200)[number], 1000 * number)
        log += batch
        spark.createDataFrame(batch, OUTCOMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        running.run_drift(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True).awaitTermination()
        want = feedback.drift_report(spark.createDataFrame(log, OUTCOMES)).first()
        got = spark.read.parquet(str(tmp_path / f"out/reports/batch={number}")).first()
        assert got["model"] == feedback.MODEL_VERSION and {c: got[c] for c in want.asDict()} == want.asDict()
    assert len(list((tmp_path / "out/totals").iterdir())) == 2


def test_drift_of_several_models_and_one_class(spark):
    rows = [("a", b, 10 + b, 3, 4, 5) for b in (0, 3, 7)] + [("b", 2, 6, 6, 0, 0), ("c", running.NO_SCORE, 4, 1, 3, 0)]
    found = {r["model"]: (r["outcomes_count"], r["auc"]) for r in running.area_of(spark.createDataFrame(rows, running._TOTALS)).collect()}
    # Highest range first: wins in halves inside a range, and twice its negatives times the positives above.
    assert found["a"] == (40, pytest.approx((15 + 2 * (4 * 3 + 4 * 6)) / 2 / (9 * 12)))
    assert found["b"] == (6, 0.5) and found["c"] == (4, 0.5)


SCORED = "patient_id string, p double, scored_at timestamp"


def test_outcomes_meet_predictions_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    hours = lambda k: START + dt.timedelta(hours=float(k))
    scored = [(f"P{rng.integers(15)}", float(k), hours(k * 6 + rng.integers(0, 20))) for k in range(120)]
    told = [(f"P{rng.integers(15)}", 0.5, int(rng.integers(2)), hours(k * 5 + rng.integers(0, 20))) for k in range(140)]
    end = [("end", 0.0, hours(5000))], [("end", 0.5, 0, hours(5000))]
    want = running.meet_outcomes(spark.createDataFrame(scored, SCORED), spark.createDataFrame(told, OUTCOMES), "3 days").collect()
    assert sum(r["recorded_at"] is None for r in want) > 3
    for side in ("scored", "told"):
        (tmp_path / side).mkdir()
    left = spark.readStream.schema(SCORED).parquet(str(tmp_path / "scored"))
    right = spark.readStream.schema(OUTCOMES).parquet(str(tmp_path / "told"))
    joined = running.meet_outcomes(left, right, "3 days", "2 days")

    def run():
        query = joined.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    held = []
    for part in range(4):  # in each part the rows come in any order
        some, others = scored[part * 30:part * 30 + 30], told[part * 35:part * 35 + 35]
        spark.createDataFrame([some[k] for k in rng.permutation(30)], SCORED).write.mode("append").parquet(str(tmp_path / "scored"))
        spark.createDataFrame([others[k] for k in rng.permutation(35)], OUTCOMES).write.mode("append").parquet(str(tmp_path / "told"))
        held.append(run())
    spark.createDataFrame(end[0], SCORED).write.mode("append").parquet(str(tmp_path / "scored"))
    spark.createDataFrame(end[1], OUTCOMES).write.mode("append").parquet(str(tmp_path / "told"))
    last = run()
    got = spark.read.parquet(str(tmp_path / "out")).filter("patient_id <> 'end'").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert max(held) < 200 and last <= 4


HISTORY = "row_id long, patient_id long, scored_at timestamp"


def test_histories_follow_the_log(spark, tmp_path):
    rng = np.random.default_rng(2)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(HISTORY).parquet(str(tmp_path / "in"))
    log = []
    for number in range(3):
        batch = [(1000 * number + k, int(rng.integers(12)), START + dt.timedelta(hours=int(rng.integers(300)))) for k in range(150)]  # late rows and ties
        log += batch
        spark.createDataFrame(batch, HISTORY).write.mode("append").parquet(str(tmp_path / "in"))
        running.run_history(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True).awaitTermination()
        got = running.latest_histories(spark.read.parquet(str(tmp_path / "out"))).select("patient_id", "row_id", "position").collect()
        want = newest_per_key(spark.createDataFrame(log, HISTORY), ["patient_id"], [F.desc("scored_at"), F.desc("row_id")])
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("patient_id", "row_id", "position").collect()))
    with pytest.raises(ValueError):
        running.running_history(stream, keep="2 hours")


def test_old_histories_are_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(HISTORY).parquet(str(tmp_path / "in"))
    held = []
    for day, patients in ((0, range(5)), (3, range(5, 7)), (9, range(7, 8))):
        spark.createDataFrame([(k, k, START + dt.timedelta(days=day)) for k in patients], HISTORY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = running.run_history(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True, keep="1 day")
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[-1] <= 3
