"""A scorer with given coefficients."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators.cleaning import as_number


class LinearScorer(Transformer):
    """Logistic score of a few named features, 0 where one is unknown: for models fitted elsewhere.

    It adds the two-class ``probability`` that fitted classifiers add, so every job that takes a model takes it.
    """

    def __init__(self, coefficients: Mapping[str, float], intercept: float = 0.0):
        super().__init__()
        self.coefficients = dict(coefficients)
        self.intercept = intercept

    def _transform(self, df: DataFrame) -> DataFrame:
        margin = F.lit(float(self.intercept))
        for name, weight in self.coefficients.items():
            margin = margin + F.lit(float(weight)) * F.coalesce(as_number(df, name), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
