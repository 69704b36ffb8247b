"""Outcomes, drift, retraining and system health."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.functions import fixed
from wardlight.functions.scalars import round_half_even
from wardlight.operators.evaluation import kept_scores, roc_auc

MODEL_VERSION = "boosting_tuned"


def append_outcome_stream(
    outcomes: DataFrame, path: str, checkpoint: str, once: bool = False, interval: str = "30 seconds",
    distinct_within: str | None = None,
) -> StreamingQuery:
    """Append arriving outcomes to the log.

    Outcomes are not deduplicated unless ``distinct_within`` (such as ``1 day``)
    says for how long a repeated record may come in late.
    """
    shaped = outcomes.select(
        "patient_id", F.coalesce("predicted_risk", F.lit(0.5)).alias("predicted_risk"),
        F.coalesce(F.col("actually_readmitted").cast("int"), F.lit(0)).alias("actually_readmitted"),
        F.coalesce("recorded_at", F.current_timestamp()).alias("recorded_at"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )
    if distinct_within:
        shaped = shaped.withWatermark("recorded_at", distinct_within).dropDuplicatesWithinWatermark(
            ["patient_id", "predicted_risk", "actually_readmitted", "notes"]
        )
    writer = (
        shaped.withColumn("recorded_day", F.to_date("recorded_at"))
        .writeStream.format("parquet").partitionBy("recorded_day")
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    trigger = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return trigger.start(path)


def drift_report(outcomes: DataFrame, min_outcomes: int = fixed.MIN_OUTCOMES, drift_auc: float = fixed.DRIFT_AUC) -> DataFrame:
    """One row: too few outcomes, drift, or none.

    Outcomes of a single class cannot be ranked; their AUC is taken as 0.5. The log is
    read once, into a score table that also counts outcomes without a risk.
    """
    scores = kept_scores(outcomes, "predicted_risk", "actually_readmitted")
    rated = roc_auc(scores).select(
        F.lit(scores.rows).cast("long").alias("outcomes_count"), F.coalesce("auc", F.lit(0.5)).alias("auc"))
    return judged(rated, min_outcomes, drift_auc)


def judged(
    rated: DataFrame, min_outcomes: int = fixed.MIN_OUTCOMES, drift_auc: float = fixed.DRIFT_AUC, keep: Sequence[str] = (),
) -> DataFrame:
    """What ``(outcomes_count, auc)`` say about drift, beside the ``keep`` columns."""
    n, auc = F.col("outcomes_count"), F.col("auc")
    enough = n >= min_outcomes
    drift = auc < drift_auc
    return rated.select(
        *keep,
        F.when(~enough, "insufficient_data").when(drift, "drift_detected").otherwise("no_drift").alias("status"),
        n,
        F.when(~enough, F.lit(min_outcomes)).alias("min_required"),
        F.when(~enough, F.concat(F.lit("Need "), (min_outcomes - n).cast("string"),
                                 F.lit(" more outcomes to detect drift"))).alias("message"),
        F.when(enough, round_half_even(auc, 4)).alias("current_auc"),
        F.when(enough, F.lit(fixed.BASELINE_AUC)).alias("baseline_auc"),
        F.when(enough, drift).alias("drift_detected"),
        F.when(enough & drift, "Retrain model immediately").when(enough, "Model performing well").alias("recommendation"),
    )


def learning_run(
    outcomes: DataFrame, retrain: Callable[[], DataFrame], min_outcomes: int = fixed.MIN_OUTCOMES
) -> tuple[DataFrame, DataFrame | None]:
    """Drift report and, if there is drift, the metrics of the retraining it calls for."""
    report = drift_report(outcomes, min_outcomes)
    drifted = report.first()["drift_detected"]
    return report, retrain() if drifted else None


def system_health(
    outcomes: DataFrame, metrics: DataFrame, min_outcomes: int = fixed.MIN_OUTCOMES, model_version: str = MODEL_VERSION
) -> DataFrame:
    """One row: counts, drift status and the time of the last retraining."""
    history = metrics.agg(
        F.count("*").alias("n"), F.date_format(F.max("retrained_at"), "yyyy-MM-dd HH:mm:ss").alias("last")
    ).first()
    report = drift_report(outcomes, min_outcomes)
    return report.select(
        F.lit(model_version).alias("model_version"),
        F.lit(fixed.BASELINE_AUC).alias("baseline_auc"),
        F.col("outcomes_count").alias("outcomes_recorded"),
        F.lit(history["n"]).cast("long").alias("retraining_count"),
        F.col("status").alias("drift_status"),
        F.lit(history["last"] or "Never").alias("last_retrain"),
        F.lit("healthy").alias("system_status"),
    )
