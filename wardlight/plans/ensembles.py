"""Fitted trees as models: scoring, saving, and exact Shapley values along their paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators.cleaning import as_number
from wardlight.plans.trees import Tree
from wardlight.session import remove, scratch_path

_NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double"


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0))


def _inputs(df: DataFrame, features: Sequence[str]):
    """Features as one array, 0 where unknown."""
    return F.array(*[F.coalesce(as_number(df, f), F.lit(0.0)) for f in features]) if features else F.array().cast("array<double>")


@dataclass
class Ensemble:
    """Trees over named features. The margin is ``base`` plus the sum of leaf values; it is the probability itself where the
    trees are shares, else the probability is the logistic function of ``steepness`` times the margin."""

    features: list[str]
    trees: list[Tree]
    shares: bool
    base: float = 0.0
    steepness: float = 1.0

    def margins(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        for t in self.trees:
            out += t.value[t.leaves(rows)]
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        margin = self.margins(rows)
        return margin if self.shares else 1.0 / (1.0 + np.exp(-self.steepness * margin))


class TreeScorer(Transformer):
    """Scores rows with an ensemble, in Arrow batches; adds the two-class ``probability`` that fitted classifiers add."""

    def __init__(self, ensemble: Ensemble):
        super().__init__()
        self.ensemble = ensemble

    def _transform(self, df: DataFrame) -> DataFrame:
        ensemble = self.ensemble

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            return pd.Series(ensemble.probabilities(np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(ensemble.features)))))

        p = score(_inputs(df, ensemble.features))
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))

    @property
    def getNumTrees(self) -> int:
        return len(self.ensemble.trees)

    def importances(self) -> dict[str, float]:
        """Share of each feature in the spread of leaf values that splits have brought about, weighted by rows."""
        total = np.zeros(len(self.ensemble.features))
        for t in self.ensemble.trees:
            mean = _means(t)
            inner = np.flatnonzero(t.feature >= 0)
            low, high = t.left[inner], t.right[inner]
            gain = t.cover[low] * (mean[low] - mean[inner]) ** 2 + t.cover[high] * (mean[high] - mean[inner]) ** 2
            np.add.at(total, t.feature[inner], gain)
        return dict(zip(self.ensemble.features, (total / (total.sum() or 1.0)).tolist(), strict=True))

    def write(self) -> "_Writer":
        return _Writer(self.ensemble)


def _means(t: Tree) -> np.ndarray:
    """Mean leaf value below each node, by rows; children stand after their parents."""
    mean = t.value.astype(float).copy()
    for k in np.flatnonzero(t.feature >= 0)[::-1]:
        a, b = t.left[k], t.right[k]
        mean[k] = (t.cover[a] * mean[a] + t.cover[b] * mean[b]) / (t.cover[a] + t.cover[b])
    return mean


class _Writer:
    def __init__(self, ensemble: Ensemble):
        self.ensemble, self.mode = ensemble, "errorifexists"

    def overwrite(self) -> "_Writer":
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        """Nodes and description as two Parquet tables under the path."""
        spark, e = SparkSession.active(), self.ensemble
        if self.mode == "overwrite":
            remove(spark, path)
        nodes = [(i, k, int(t.feature[k]), float(t.threshold[k]), int(t.left[k]), int(t.right[k]), float(t.value[k]), float(t.cover[k]))
                 for i, t in enumerate(e.trees) for k in range(len(t.feature))]
        spark.createDataFrame(nodes, _NODES).write.mode(self.mode).parquet(f"{path}/nodes")
        spark.createDataFrame([(e.features, e.shares, e.base, e.steepness)], "features array<string>, shares boolean, base double, steepness double") \
            .write.mode(self.mode).parquet(f"{path}/about")


def load_scorer(spark: SparkSession, path: str) -> TreeScorer:
    about = spark.read.parquet(f"{path}/about").first()
    return TreeScorer(Ensemble(list(about["features"]), _trees(spark.read.parquet(f"{path}/nodes")), about["shares"], about["base"], about["steepness"]))


def _trees(nodes: DataFrame) -> list[Tree]:
    rows = nodes.orderBy("tree", "node").toPandas()
    out = []
    for _, t in rows.groupby("tree", sort=True):
        out.append(Tree(*(t[c].to_numpy().astype(k) for c, k in (
            ("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("value", float), ("cover", float)))))
    return out


def ensemble_of(model: Transformer, features: Sequence[str]) -> Ensemble:
    """The trees of a :class:`TreeScorer`, or of Spark's forests and boosted trees of two classes, also as the last stage of a pipeline.

    Spark's nodes are read from the model's saved form. ``cover`` is their weighted number of training rows; a forest's leaves
    are the shares of class 1, a boosted tree's values carry its weight.
    """
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(last, TreeScorer):
        return last.ensemble
    if not isinstance(last, (RandomForestClassificationModel, GBTClassificationModel)):
        raise TypeError("trees are needed")
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    last.write().save(path)
    try:
        n = F.col("nodeData")
        stats = n["impurityStats"]
        forest = isinstance(last, RandomForestClassificationModel)
        value = F.try_divide(stats[1], stats[0] + stats[1]) if forest else n["prediction"]
        cover = stats[0] + stats[1] if forest else stats[0]
        trees = _trees(spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
            F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"), n["leftChild"].alias("left"),
            n["rightChild"].alias("right"), value.alias("value"), cover.alias("cover")))
    finally:
        remove(spark, path)
    weights = [1.0 / len(trees)] * len(trees) if forest else last.treeWeights
    for t, w in zip(trees, weights, strict=True):
        t.feature = np.where(t.left < 0, -1, t.feature).astype(np.int32)
        t.value = t.value * w
    return Ensemble(list(features), trees, forest, steepness=1.0 if forest else 2.0)


def _paths(t: Tree) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """For each leaf its value and, for each feature on its path, ``(low, high, share)``: rows with low < x <= high stay on
    the path, and of rows that take the feature's splits by cover alone this share does."""
    todo = [(0, {})]
    while todo:
        k, path = todo.pop()
        f = int(t.feature[k])
        if f < 0:
            yield float(t.value[k]), path
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        cut = float(t.threshold[k])
        for child, bounds in ((int(t.left[k]), (low, min(high, cut))), (int(t.right[k]), (max(low, cut), high))):
            todo.append((child, {**path, f: (*bounds, share * float(t.cover[child] / t.cover[k]))}))


def expected(ensemble: Ensemble) -> float:
    """The margin when every split is taken by cover: what the contributions of a row start from."""
    return ensemble.base + sum(float(_means(t)[0]) for t in ensemble.trees)


def shapley_values(ensemble: Ensemble, rows: np.ndarray) -> np.ndarray:
    """Exact path-dependent Shapley values, one row of contributions for each row of feature values.

    A leaf's value reaches a set S of known features with the product of (row stays on the path) over S and of cover shares
    over the rest. The Shapley weight of |S| of m features is the integral of t^|S| (1-t)^(m-1-|S|), so a feature's
    contribution is one integral over t of a product of degree m-1, which Gauss-Legendre points give exactly.
    """
    out = np.zeros((len(rows), len(ensemble.features)))
    rules: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for t in ensemble.trees:
        for value, path in _paths(t):
            if not path or value == 0.0:
                continue
            m = len(path)
            if m not in rules:
                x, w = np.polynomial.legendre.leggauss(m // 2 + 1)
                rules[m] = ((x + 1) / 2)[:, None], (w / 2)[:, None]
            x, w = rules[m]
            stays = {f: (rows[:, f] > low) & (rows[:, f] <= high) for f, (low, high, _) in path.items()}
            parts = {f: (1 - x) * path[f][2] + x * stays[f] for f in path}
            whole = w * value
            for part in parts.values():
                whole = whole * part
            for f, part in parts.items():
                out[:, f] += (stays[f] - path[f][2]) * (whole / part).sum(axis=0)
    return out


def contributions(model: Transformer, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, one contribution for each feature (under its name), ``base_value`` and ``margin``.

    Contributions and base value add up to the margin of the row. Rows go by in Arrow batches.
    """
    ensemble = ensemble_of(model, features)
    start = expected(ensemble)
    kept = df.select(*[f"`{c}`" for c in keep], _inputs(df, ensemble.features).alias("_x"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]], *[f"`{f}` double" for f in features], "base_value double", "margin double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), len(ensemble.features))
            values = shapley_values(ensemble, x)
            columns = [*batch.columns[:-1], *[pa.array(values[:, k]) for k in range(len(features))], pa.array(np.full(len(x), start)), pa.array(ensemble.margins(x))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *features, "base_value", "margin"])

    return kept.mapInArrow(run, schema)
