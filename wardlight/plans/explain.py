"""Which features drive a model's scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.operators.evaluation import evaluation_sample, grouped_auc, mean_absolute, top_features
from wardlight.operators.linear import LinearScorer
from wardlight.operators.ordering import row_hash
from wardlight.operators.scoring import with_probability
from wardlight.plans.ensembles import TreeScorer, contributions
from wardlight.plans.training import fit_scaling, numbers, scale
from wardlight.session import materialise

SAMPLE_ROWS = 1000
MOST_SAMPLE_ROWS = 100_000


def linear_attribution(
    model: PipelineModel | LinearScorer, train: DataFrame, df: DataFrame, features: Sequence[str], ids: Sequence[str],
    rows: int | None = SAMPLE_ROWS, top: int = 10,
) -> DataFrame:
    """Exact contributions of a logistic model or linear scorer, coefficient times distance from
    the training mean, as a mean of absolute values over a sample (``rows=None``: all rows)."""
    sample = df if rows is None else evaluation_sample(df, ids, rows)
    if isinstance(model, LinearScorer):
        weights = {f: model.coefficients.get(f, 0.0) for f in features}
        means = {f: (m, 1.0) for f, (m, _) in fit_scaling(numbers(train, features), features).items()}
        parts = scale(numbers(sample, features), means).select(*[(F.col(f"`{f}`") * F.lit(w)).alias(f) for f, w in weights.items()])
        return top_features(mean_absolute(parts, features), top)
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    if not isinstance(stage, LogisticRegressionModel):
        raise TypeError("linear attribution needs a logistic model")
    # The model works on scaled columns; scaling with the same figures centres them.
    scaled = scale(numbers(sample, features), fit_scaling(numbers(train, features), features))
    parts = scaled.select(*[
        (F.col(f"`{f}`") * F.lit(float(c))).alias(f) for f, c in zip(features, stage.coefficients)
    ])
    return top_features(mean_absolute(parts, features), top)


def permutation_attribution(
    model: Transformer, df: DataFrame, features: Sequence[str], ids: Sequence[str], label: str = fixed.LABEL,
    rows: int = SAMPLE_ROWS, top: int = 10, seed: int = 42,
) -> DataFrame:
    """Loss of AUC when one feature's values change places, over a sample.

    The sample is cut to ``rows`` rows by definition (at most 100,000), so ordering it as a whole
    to shuffle its columns is bounded work. One table holds every row once as it is and once
    for each feature with that value moved; it is scored once, and all areas come
    from one score table.
    """
    if rows > MOST_SAMPLE_ROWS:
        raise ValueError(f"a permutation sample has at most {MOST_SAMPLE_ROWS} rows")
    sample = evaluation_sample(df, ids, rows).select(label, *ids, *[f"`{f}`" for f in features if f not in ids])
    sample = materialise(sample, "permutation-sample")
    place = sample.withColumn("_to", F.row_number().over(Window.orderBy(row_hash(ids, seed), *ids)))
    source = sample.select(
        F.row_number().over(Window.orderBy(row_hash(ids, seed + 1), *ids)).alias("_to"),
        *[F.col(f"`{f}`").alias(f"_moved{i}") for i, f in enumerate(features)])
    names = F.array(F.lit(""), *[F.lit(f) for f in features])
    every = place.join(source, "_to").withColumn("_feature", F.explode(names))
    moved = every.select(label, "_feature", *[
        F.when(F.col("_feature") == f, F.col(f"_moved{i}")).otherwise(F.col(f"`{f}`")).alias(f) for i, f in enumerate(features)])
    areas = grouped_auc(with_probability(model, moved), ["_feature"], "p", label).collect()  # one row per feature
    found = {r["_feature"]: r["auc"] for r in areas}
    base = found.pop("", None)
    losses = [(f, base - auc if base is not None and auc is not None else None) for f, auc in found.items()]
    return top_features(df.sparkSession.createDataFrame(losses, "feature string, importance double"), top)


def tree_attribution(
    model: Transformer, df: DataFrame, features: Sequence[str], ids: Sequence[str], rows: int | None = SAMPLE_ROWS, top: int = 10,
) -> DataFrame:
    """Exact Shapley contributions along the paths of a tree model, as a mean of absolute values over a sample (``rows=None``: all rows)."""
    sample = df if rows is None else evaluation_sample(df, ids, rows)
    return top_features(mean_absolute(contributions(model, sample, features), features), top)


def attribution(
    model: Transformer, train: DataFrame, df: DataFrame, features: Sequence[str], ids: Sequence[str], label: str = fixed.LABEL,
    rows: int = SAMPLE_ROWS, top: int = 10,
) -> DataFrame:
    """The features that drive a model: exact for tree and linear models, by permutation for any other."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(last, (TreeScorer, RandomForestClassificationModel, GBTClassificationModel)):
        return tree_attribution(model, df, features, ids, rows, top)
    if isinstance(last, (LinearScorer, LogisticRegressionModel)):
        return linear_attribution(model, train, df, features, ids, rows, top)
    return permutation_attribution(model, df, features, ids, label, rows, top)


def split_importance(model: Transformer, features: Sequence[str], df: DataFrame, top: int = 10) -> DataFrame:
    """Importances a tree model has gathered while it was trained."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    found = last.importances() if isinstance(last, TreeScorer) else dict(zip(features, last.featureImportances.toArray()))
    values = [(f, float(found[f])) for f in features]
    return top_features(df.sparkSession.createDataFrame(values, "feature string, importance double"), top)
