"""End-to-end jobs: files in, tables out."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.operators import evaluation, scoring
from wardlight.operators.cleaning import align_to_contract, coerce_numeric
from wardlight.operators.encounters import (
    EncounterStats, clean_encounters, encode_target, encounter_features, fit_encounters,
)
from wardlight.operators.hospital import finalise_hospital, fit_hospital, hospital_features, merge_hospital
from wardlight.plans import explain, training
from wardlight.session import materialise, workspace
from wardlight.sources import readers, writers
from wardlight.streaming import feedback


def encounter_job(
    raw: DataFrame, output: str | None = None, order: Sequence[str | Column] = ("encounter_id",),
    stats: EncounterStats | None = None, label_mode: str = "any", keep_ids: bool | Sequence[str] = False,
    max_levels: int = 1000, exact: bool = True,
) -> tuple[DataFrame, EncounterStats]:
    """Raw encounters to the feature table.

    The cleaned table is written once, so that learning the figures and building
    the features both read it instead of repeating the deduplication. With given
    ``stats`` (scoring) nothing is learned and nothing is written in between. With
    ``output`` the job leaves nothing but that table; without, the cleaned table stays for its reader.
    """
    cleaned = clean_encounters(encode_target(raw, label_mode), order)
    if stats is not None:
        return _written(encounter_features(cleaned, stats, keep_ids), output), stats
    with _workspace_if(raw.sparkSession, "encounter-job", output) as folder:
        cleaned = materialise(cleaned, "cleaned-encounters", folder)
        stats = fit_encounters(cleaned, max_levels, exact)
        return _written(encounter_features(cleaned, stats, keep_ids), output), stats


def _workspace_if(spark: SparkSession, name: str, output: str | None):
    """A workspace for a job that writes its result; a lazy result needs its tables longer."""
    return workspace(spark, name) if output else nullcontext()


def _written(df: DataFrame, output: str | None) -> DataFrame:
    if not output:
        return df
    writers.write_features(df, output)
    return df.sparkSession.read.parquet(output)


def hospital_job(
    tables: dict[str, DataFrame], output: str | None = None, date_format: str | None = None, max_levels: int = 1000,
    exact: bool = True,
) -> DataFrame:
    """The five hospital tables to the merged feature table.

    The join chain runs once; median and levels are learned in one scan of its result, and
    the features read it once more. With ``output`` the job leaves nothing but that table.
    """
    spark = tables["appointments"].sparkSession
    with _workspace_if(spark, "hospital-job", output) as folder:
        merged = materialise(
            merge_hospital(*[tables[n] for n in ("appointments", "doctors", "patients", "billing", "treatments")]),
            "merged-hospital", folder,
        )
        median, levels = fit_hospital(merged, exact, max_levels)
        featured = finalise_hospital(hospital_features(merged, median, date_format=date_format), levels)
        return _written(featured, output)


@dataclass
class TrainingResult:
    models: dict[str, PipelineModel]
    cross_validation: DataFrame
    leaderboard: DataFrame
    best: str


def training_job(
    features: DataFrame, ids: Sequence[str], specs: dict[str, training.ModelSpec] | None = None,
    label: str = fixed.LABEL, folds: int = 5, save_to: str | None = None,
) -> TrainingResult:
    """Split, cross-validate, fit, compare and save. The classes of the training rows are counted once."""
    specs = specs or training.default_models()
    names = [c for c in features.columns if c != label and c not in ids]
    with workspace(features.sparkSession, "training-job") as folder:
        data = materialise(coerce_numeric(features, keep=list(ids)), "training-features", folder)
        train, test = training.stratified_split(data, ids, label)
        sizes = training.class_ratio(train, label)
        validated = training.cross_validate(specs, train, names, ids, label, folds, sizes=sizes)
        validated = features.sparkSession.createDataFrame(validated.collect(), validated.schema)  # a row per model
        models = training.fit_all(specs, train, names, label, sizes, ids)
        board = training.evaluate_all(models, test, label)
        if save_to:
            for name, model in models.items():
                writers.save_model(model, f"{save_to}/{name}")
        return TrainingResult(models, validated, board, board.first()["model"])


def learning_job(
    outcomes: DataFrame, data: DataFrame, current: Transformer, features: Sequence[str], order: str, ids: Sequence[str],
    retrained_at: str, metrics_path: str, save_to: str | None = None, label: str = fixed.LABEL,
    spec: training.ModelSpec | None = None, min_outcomes: int = fixed.MIN_OUTCOMES,
) -> tuple[DataFrame, DataFrame | None]:
    """Report drift; if there is any, retrain on ``data``, save a better challenger and append the metrics.

    Returns the report and the metrics row, None without a retraining.
    """
    def retrain() -> DataFrame:
        _, metrics = training.retrain(data, current, features, order, ids, retrained_at, label, spec, save_to)
        writers.append_metrics(metrics, metrics_path)
        return metrics

    return feedback.learning_run(outcomes, retrain, min_outcomes)


def score_features(
    model: Transformer, features: DataFrame, contract: Sequence[str], keep: Sequence[str] = (),
    threshold: float = fixed.DECISION_THRESHOLD, label: str = fixed.LABEL,
) -> DataFrame:
    """Predictions for processed features; the label travels along as ``actual``."""
    carried = [*keep, *([label] if label in features.columns else [])]
    aligned = align_to_contract(features, contract, carried)
    scored = scoring.with_probability(model, aligned)
    columns = [F.col(c) for c in keep] + scoring.prediction_columns(F.col("p"), threshold)
    if label in features.columns:
        columns.append(F.col(label).alias("actual"))
    return scored.select(*columns)


def prediction_job(
    model: Transformer, features: DataFrame, contract: Sequence[str], output: str, keep: Sequence[str] = (),
    label: str = fixed.LABEL, threshold: float = fixed.DECISION_THRESHOLD, kind: str = "parquet",
) -> DataFrame:
    """Score processed features, write the predictions and return the written table."""
    writers.write_predictions(score_features(model, features, contract, keep, threshold, label), output, kind)
    written = features.sparkSession.read.option("header", True) if kind == "csv" else features.sparkSession.read
    return written.format(kind).load(output)


def score_raw(
    model: Transformer, raw: DataFrame, contract: Sequence[str], stats: EncounterStats,
    order: Sequence[str | Column] = ("encounter_id",), keep: Sequence[str] = (), threshold: float = fixed.DECISION_THRESHOLD,
) -> DataFrame:
    """Raw encounters to predictions with the figures learned in training."""
    features, _ = encounter_job(raw, order=order, stats=stats, keep_ids=keep)
    return score_features(model, features, contract, keep, threshold)


def score_requests(
    model: Transformer, requests: DataFrame, contract: Sequence[str], advice: bool = True,
    threshold: float = fixed.DECISION_THRESHOLD,
) -> DataFrame:
    """Sparse requests to responses; one row per request."""
    scored = scoring.with_probability(model, readers.aligned_requests(requests, contract))
    return scored.select("patient_id", *scoring.response_columns(F.col("p"), threshold, advice))


def score_patients(model: Transformer, records: DataFrame, contract: Sequence[str], key: str = "patient_id") -> DataFrame:
    """Any table of feature records (FHIR, intake forms) to responses."""
    scored = scoring.with_probability(model, align_to_contract(records, contract, [key]))
    return scored.select(key, *scoring.response_columns(F.col("p")))


def daily_job(model: Transformer, features: DataFrame, contract: Sequence[str]) -> DataFrame:
    scored = scoring.with_probability(model, align_to_contract(features, contract))
    return scoring.daily_summary(scored)


def evaluation_job(
    model: Transformer, test: DataFrame, output: str, label: str = fixed.LABEL, features: Sequence[str] | None = None,
    ids: Sequence[str] = (), sample: int = explain.SAMPLE_ROWS,
) -> dict[str, DataFrame]:
    """Full report of one model as tables under ``output``.

    Scores are reduced to one row per distinct score and written; every figure
    but the confusion matrix at the best threshold is computed from that table,
    and so is that matrix, by its cumulative counts. With ``features`` (and ``ids``) the report
    ends with the attribution over a sample of test rows.
    """
    spark: SparkSession = test.sparkSession
    with workspace(spark, "evaluation-job") as folder:
        scored = scoring.with_probability(model, test).select("p", label)
        scores = evaluation.kept_scores(scored, "p", label, folder)
        tables = _report(scores)
        if features:
            if not 0 < sample <= explain.MOST_SAMPLE_ROWS:
                raise ValueError(f"an attribution sample has at most {explain.MOST_SAMPLE_ROWS} rows")
            tables["attribution"] = explain.attribution(model, test, test, features, ids, label, sample)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{output}/{name}")
    return {name: spark.read.parquet(f"{output}/{name}") for name in tables}


def _report(scores: evaluation.Scores) -> dict[str, DataFrame]:
    best = evaluation.best_f1(scores)
    threshold = best.first()["threshold"]
    above = F.col("threshold") >= threshold
    matrix = scores.table.agg(
        F.coalesce(F.sum(F.when(~above, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(above, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~above, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("tp"),
    )
    total = float(scores.positives + scores.negatives)
    return {
        "roc_auc": evaluation.roc_auc(scores),
        "roc_points": evaluation.roc_points(scores),
        "pr_points": evaluation.pr_points(scores),
        "average_precision": evaluation.average_precision(scores),
        "best_threshold": best,
        "confusion": matrix,
        "classification_report": evaluation.classification_report(matrix),
        "prevalence": matrix.select(F.try_divide(F.lit(float(scores.positives)), F.lit(total)).alias("prevalence")),
    }
