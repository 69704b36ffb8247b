"""Figures that follow a stream by state: drift, outcomes that meet their predictions, the newest rows of each patient."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlight.functions import fixed
from wardlight.functions.scalars import number
from wardlight.session import remove
from wardlight.streaming.feedback import MODEL_VERSION, judged

BUCKETS = 1024
NO_SCORE = -1

# -- drift -------------------------------------------------------------------------

_TOTALS = "model string, bucket int, rows bigint, pos bigint, neg bigint, wins bigint"
_HISTOGRAM = "scores array<double>, pos array<bigint>, neg array<bigint>"


def _counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add a batch to the histogram of one range of scores and give its new totals.

    ``wins`` are the pairs that its positives win against its negatives, in halves.
    """
    scores, pos, neg = (np.array(c) for c in state.get) if state.exists else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for b in batches:
        scores = np.concatenate([scores, b["score"].to_numpy(float)])
        pos, neg = np.concatenate([pos, b["pos"].to_numpy(np.int64)]), np.concatenate([neg, b["neg"].to_numpy(np.int64)])
    scores, at = np.unique(scores, return_inverse=True, equal_nan=True)
    pos, neg = (np.bincount(at.ravel(), c, len(scores)).astype(np.int64) for c in (pos, neg))
    state.update((scores.tolist(), pos.tolist(), neg.tolist()))
    above = pos.sum() - np.cumsum(pos)
    yield pd.DataFrame({"model": [key[0]], "bucket": [key[1]], "rows": [pos.sum() + neg.sum()], "pos": [pos.sum()], "neg": [neg.sum()],
                        "wins": [(neg * (2 * above + pos)).sum()]})


def score_totals(outcomes: DataFrame, score: str = "predicted_risk", label: str = "actually_readmitted", model: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of the totals of every range of scores that a batch has touched: ``(model, bucket, rows, pos, neg, wins)``.

    The state holds, for each model and range, the rows of each distinct score; a batch is counted by score before it
    reaches the state, and only its ranges are touched. Scores below 0 and above 1 belong to the outer ranges; rows
    whose score is no number are counted apart.
    """
    value = number(F.col(score).cast("double"))
    name = F.coalesce(F.col(model), F.lit(MODEL_VERSION)) if model else F.lit(MODEL_VERSION)
    bucket = F.when(value.isNull(), NO_SCORE).otherwise(F.least(F.greatest(F.floor(value * buckets), F.lit(0)), F.lit(buckets - 1))).cast("int")
    positive = F.coalesce((F.col(label) == 1).cast("long"), F.lit(0))
    rows = outcomes.select(name.alias("model"), bucket.alias("bucket"), F.coalesce(value, F.lit(0.0)).alias("score"), positive.alias("pos"), (1 - positive).alias("neg"))
    return rows.groupBy("model", "bucket").applyInPandasWithState(_counted, _TOTALS, _HISTOGRAM, "update", GroupStateTimeout.NoTimeout)


def area_of(totals: DataFrame) -> DataFrame:
    """``(model, outcomes_count, auc)`` from the totals of all ranges; 0.5 where one class is missing."""
    both = F.sort_array(F.collect_list(F.when(F.col("bucket") != NO_SCORE, F.struct((-F.col("bucket")).alias("b"), "pos", "neg", "wins"))))  # at most BUCKETS
    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("above"), F.lit(0).cast("decimal(38,0)").alias("negatives"), F.lit(0).cast("decimal(38,0)").alias("wins"))
    wide = lambda c: c.cast("decimal(38,0)")
    step = lambda a, r: F.struct(
        wide(a["above"] + r["pos"]).alias("above"), wide(a["negatives"] + r["neg"]).alias("negatives"),
        wide(a["wins"] + r["wins"] + 2 * wide(r["neg"] * a["above"])).alias("wins"))
    done = totals.groupBy("model").agg(F.sum("rows").alias("outcomes_count"), F.aggregate(both, start, step).alias("t"))
    pairs = F.col("t.above").cast("double") * F.col("t.negatives").cast("double")
    return done.select("model", "outcomes_count", F.when(pairs > 0, F.col("t.wins").cast("double") / 2 / pairs).otherwise(0.5).alias("auc"))


def run_drift(
    outcomes: DataFrame, path: str, checkpoint: str, once: bool = False, interval: str = "30 seconds", score: str = "predicted_risk",
    label: str = "actually_readmitted", model: str | None = None, min_outcomes: int = fixed.MIN_OUTCOMES, drift_auc: float = fixed.DRIFT_AUC,
) -> StreamingQuery:
    """Report drift after each batch of outcomes without reading the log: the area is that of all outcomes so far, exactly.

    ``path/totals/batch=N`` holds the totals of all ranges after batch N (bounded, at most ``BUCKETS`` + 1 rows a model; the last two are kept),
    ``path/reports/batch=N`` the report. A batch that runs again writes the same folders from those of the batch before.
    """
    def write(batch: DataFrame, number_: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number_:
            before = spark.read.schema(_TOTALS).parquet(f"{path}/totals/batch={number_ - 1}")
            new = before.join(batch, ["model", "bucket"], "left_anti").unionByName(batch)
        new.write.mode("overwrite").parquet(f"{path}/totals/batch={number_}")
        totals = spark.read.schema(_TOTALS).parquet(f"{path}/totals/batch={number_}")
        judged(area_of(totals), min_outcomes, drift_auc, ["model"]).write.mode("overwrite").parquet(f"{path}/reports/batch={number_}")
        if number_ > 1:
            remove(spark, f"{path}/totals/batch={number_ - 2}")

    writer = score_totals(outcomes, score, label, model).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=interval).start()


# -- outcomes and predictions ----------------------------------------------------------


def meet_outcomes(scored: DataFrame, outcomes: DataFrame, within: str = "30 days", late: str = "1 day") -> DataFrame:
    """Scored discharges ``(patient_id, p, scored_at)`` with the outcomes ``(patient_id, actually_readmitted, recorded_at)`` that follow within an interval.

    Works on two streams and on two tables. On streams both sides wait ``late`` for rows that come out of order; state is kept for the
    interval only, and a discharge without an outcome is given with nulls once none can come any more.
    """
    left, right = scored.select("patient_id", "p", "scored_at"), outcomes.select(F.col("patient_id").alias("_patient"), "actually_readmitted", "recorded_at")
    if scored.isStreaming:
        left, right = left.withWatermark("scored_at", late), right.withWatermark("recorded_at", late)
    same = F.expr(f"patient_id = _patient AND recorded_at >= scored_at AND recorded_at <= scored_at + INTERVAL {within}")
    return left.join(right, same, "leftOuter").drop("_patient")


# -- histories ------------------------------------------------------------------------

_ROWS = "times array<timestamp>, ids array<bigint>"


def running_history(scored: DataFrame, rows: int = 10, keep: str = "365 days", key: str = "patient_id", time: str = "scored_at", row_id: str = "row_id") -> DataFrame:
    """A stream of the ``rows`` newest rows of each patient that a batch has touched: ``(key, history)``, newest first, ties by the greater id.

    The state is at most ``rows`` rows a patient. A patient of whom nothing has come for ``keep`` (in event time) is forgotten.
    """
    days = int(keep.split()[0])
    if keep.split()[1:] not in (["days"], ["day"]) or days < 1:
        raise ValueError("a number of days is needed")
    patients = scored.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(row_id).cast("bigint").alias("id")).withWatermark("time", keep)
    type_of = patients.schema["key"].dataType.simpleString()

    def newest(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pd.DataFrame({"time": pd.to_datetime(pd.Series(state.get[0], dtype="datetime64[ns]")), "id": np.array(state.get[1], np.int64)}) if state.exists else None
        for b in batches:
            b = b[["time", "id"]].astype({"time": "datetime64[ns]"})
            held = (b if held is None else pd.concat([held, b])).sort_values(["time", "id"], ascending=False).head(rows)
        times, ids = [t.to_pydatetime() for t in held["time"]], [int(i) for i in held["id"]]
        state.update((times, ids))
        state.setTimeoutTimestamp(max(int(held["time"].iloc[0].timestamp() * 1000), state.getCurrentWatermarkMs()) + days * 86_400_000 + 1)
        yield pd.DataFrame({"key": [key_[0]], "times": [times], "ids": [ids]})

    out = patients.groupBy("key").applyInPandasWithState(newest, f"key {type_of}, {_ROWS}", _ROWS, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.arrays_zip("ids", "times").alias("history"))


def run_history(scored: DataFrame, path: str, checkpoint: str, once: bool = False, interval: str = "30 seconds", **how) -> StreamingQuery:
    """Write the histories that each batch has changed to ``path/batch=N``; a batch that runs again overwrites its folder."""
    def write(batch: DataFrame, number_: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number_}")

    writer = running_history(scored, **how).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=interval).start()


def latest_histories(written: DataFrame, key: str = "patient_id") -> DataFrame:
    """The newest history of each patient from the folders of :func:`run_history`, one row for each of its rows."""
    last = written.groupBy(key).agg(F.max_by("history", "batch").alias("history"))
    return last.select(key, F.posexplode("history").alias("place", "row")).select(
        key, F.col("row.ids").alias("row_id"), F.col("row.times").alias("time"), (F.col("place") + 1).alias("position"))
