"""Classifier evaluation as aggregations.

Everything that depends on the order of scores starts from the score table: one
row per distinct score with its positives and negatives. Writing it is the only
pass over the predictions; curves and areas read what was written, once each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scalars import number, nz
from wardlight.operators import ordering
from wardlight.operators.ordering import hash_sample, running_totals, split_points
from wardlight.session import materialise, workspace

EPSILON = 1e-9


def score_table(df: DataFrame, score: str = "p", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct score (and key); scores that are no number share the row without threshold."""
    positive = nz(F.col(label) == 1)
    return df.groupBy(*keys, number(F.col(score).cast("double")).alias("threshold")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


@dataclass(frozen=True)
class Scores:
    """A written score table, its class totals and the values that cut it into ranges."""

    table: DataFrame
    positives: int
    negatives: int
    rows: int
    points: tuple[float, ...]


def kept_scores(
    df: DataFrame, score: str = "p", label: str = "label", folder: str | None = None, range_rows: int | None = None
) -> Scores:
    """Write the score table, in ``folder`` if one is given. ``rows`` also counts rows without a score."""
    written = materialise(score_table(df, score, label), "score-table", folder)
    scored = written.where(F.col("threshold").isNotNull())
    known = F.col("threshold").isNotNull()
    row = written.agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.count("threshold").alias("values"),
        F.sum(F.when(known, F.col("pos"))).alias("pos"), F.sum(F.when(known, F.col("neg"))).alias("neg"),
    ).first()
    most = range_rows or ordering.RANGE_ROWS
    points = split_points(scored, "threshold", most) if row["values"] > most else []
    return Scores(scored, row["pos"] or 0, row["neg"] or 0, row["rows"] or 0, tuple(points))


def cumulative(scores: Scores) -> DataFrame:
    """True and false positives when everything at or above a score is positive."""
    return running_totals(scores.table, "threshold", {"pos": "tp", "neg": "fp"}, descending=True, points=scores.points)


def _beaten() -> Column:
    """Pairs that the positives of a row win against the negatives below or at it, ties counted half."""
    return F.col("neg").cast("double") * ((F.col("tp") - F.col("pos")).cast("double") + F.col("pos") / 2)


def roc_auc(scores: Scores) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with a single class."""
    pairs = F.lit(float(scores.positives) * float(scores.negatives))
    return cumulative(scores).agg(F.when(pairs > 0, F.sum(_beaten()) / pairs).alias("auc"))


def auc_value(df: DataFrame, score: str = "p", label: str = "label") -> float | None:
    """The area as a number."""
    with workspace(df.sparkSession, "auc") as folder:
        return roc_auc(kept_scores(df, score, label, folder)).first()["auc"]


def grouped_auc(df: DataFrame, keys: Sequence[str], score: str = "p", label: str = "label", folder: str | None = None) -> DataFrame:
    """Area per key, from one score table."""
    table = materialise(score_table(df, score, label, keys), "score-table", folder).where(F.col("threshold").isNotNull())
    curve = running_totals(table, "threshold", {"pos": "tp", "neg": "fp"}, descending=True, within=keys)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return curve.groupBy(*keys).agg(F.when(pairs > 0, F.sum(_beaten()) / pairs).alias("auc"))


def roc_points(scores: Scores) -> DataFrame:
    """One point per distinct score and the origin, which has no threshold."""
    curve = cumulative(scores)
    origin = curve.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return curve.select(
        "threshold",
        F.try_divide("fp", F.lit(float(scores.negatives))).alias("fpr"),
        F.try_divide("tp", F.lit(float(scores.positives))).alias("tpr"),
    ).unionByName(origin)


def pr_points(scores: Scores, closing: bool = True) -> DataFrame:
    """Precision and recall per distinct score; the closing point (1, 0) has no threshold."""
    curve = cumulative(scores).select(
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", F.lit(float(scores.positives))), F.lit(1.0)).alias("recall"),
    )
    if not closing:
        return curve
    end = curve.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "threshold double, precision double, recall double"
    )
    return curve.unionByName(end)


def average_precision(scores: Scores) -> DataFrame:
    """Step sum of precision over recall."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return cumulative(scores).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.lit(float(scores.positives))).alias("average_precision")
    )


def best_f1(scores: Scores) -> DataFrame:
    """Threshold with the highest F1; the lowest one on ties."""
    curve = pr_points(scores, closing=False)
    p, r = F.col("precision"), F.col("recall")
    rated = curve.withColumn("f1", F.lit(2.0) * p * r / (p + r + F.lit(EPSILON)))
    best = F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(F.col("f1"), -F.col("threshold")))
    return rated.agg(best.alias("best")).select("best.*")


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "p", label: str = "label") -> DataFrame:
    said, was = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(
        F.count_if(~said & ~was).alias("tn"), F.count_if(said & ~was).alias("fp"),
        F.count_if(~said & was).alias("fn"), F.count_if(said & was).alias("tp"),
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class rows, accuracy and the two averages from one confusion row."""
    def safe(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    total = n0 + n1
    metrics = {}
    for name, hit, said, was in (("0", tn, tn + fn, n0), ("1", tp, tp + fp, n1)):
        precision, recall = safe(hit, said), safe(hit, was)
        metrics[name] = (precision, recall, safe(2.0 * precision * recall, precision + recall), was)
    pair = list(zip(metrics["0"][:3], metrics["1"][:3]))
    accuracy = safe(tn + tp, total)
    metrics["accuracy"] = (accuracy, accuracy, accuracy, total)
    metrics["macro avg"] = (*[(a + b) / 2.0 for a, b in pair], total)
    metrics["weighted avg"] = (*[safe(a * n0 + b * n1, total) for a, b in pair], total)
    rows = [
        F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                 s.cast("long").alias("support"))
        for name, (p, r, f, s) in metrics.items()
    ]
    return counts.select(F.inline(F.array(*rows)))


def prevalence(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.avg(label).alias("prevalence"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and balanced weight n/(2*n_c) per class, with the ratio n0/n1."""
    row = df.agg(
        F.count(label).alias("n"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )
    ratio = F.try_divide("n0", "n1")
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(f"n{c}").alias("rows"),
                 F.try_divide(F.col("n").cast("double"), 2 * F.col(f"n{c}")).alias("weight"), ratio.alias("ratio"))
        for c in (0, 1)
    ])))


def mean_and_spread(folds: DataFrame, keys: Sequence[str], score: str = "auc") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return folds.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def leaderboard(results: DataFrame, name: str = "model", score: str = "auc") -> DataFrame:
    return results.orderBy(F.desc(score), name)


def mean_absolute(contributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature, from one wide aggregate row."""
    means = contributions.agg(*[F.avg(F.abs(f"`{f}`")).alias(f) for f in features])
    return means.unpivot([], [f"`{f}`" for f in features], "feature", "importance")


def top_features(importances: DataFrame, rows: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(rows)


def evaluation_sample(df: DataFrame, ids: Sequence[str], rows: int = 1000, seed: int = 42) -> DataFrame:
    return hash_sample(df, ids, rows, seed)
