"""Projection, filtering and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions import fixed
from wardlight.functions.scalars import lenient_double


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _quoted(name: str) -> str:
    return f"`{name}`"


def tokens_to_null(df: DataFrame, tokens: Sequence[str] = fixed.NA_TOKENS) -> DataFrame:
    """Missing-value tokens of a text file to null, and NaN to null with them."""
    changed = {}
    for field in df.schema:
        column = F.col(_quoted(field.name))
        if isinstance(field.dataType, T.StringType):
            changed[field.name] = F.when(~column.isin(list(tokens)), column)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changed[field.name] = F.when(~F.isnan(column), column)
    return df.withColumns(changed) if changed else df


def sentinel_to_null(df: DataFrame, sentinel: str = fixed.MISSING_SENTINEL) -> DataFrame:
    """Whole-cell sentinel to null in every text column."""
    return df.replace(sentinel, None, subset=_text_columns(df))


def drop_strict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    return df.drop(*columns)


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def feature_names(df: DataFrame, label: str = fixed.LABEL) -> list[str]:
    """The feature contract: columns but for the label. Reads no data."""
    return [f.name for f in df.schema if f.name != label]


def find_label(columns: Sequence[str], part: str = "readmit") -> str:
    for name in columns:
        if part in name.lower():
            return name
    raise ValueError(f"no column name contains {part!r}")


def as_number(df: DataFrame, name: str) -> Column:
    """Column as double: booleans 0/1, texts parsed leniently, NaN as null."""
    kind = df.schema[name].dataType
    column = F.col(_quoted(name))
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(kind, T.StringType):
        return lenient_double(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    raise TypeError(f"column {name} of type {kind.simpleString()} is no feature")


def align_to_contract(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Contract columns in contract order as numbers; an absent one is 0."""
    present = set(df.columns)
    return df.select(
        *[F.col(_quoted(c)) for c in keep],
        *[
            (F.coalesce(as_number(df, f), F.lit(0.0)) if f in present else F.lit(0.0)).alias(f)
            for f in features
        ],
    )


def align_map(df: DataFrame, map_column: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The same for sparse requests held as a map from feature name to text.

    The texts that a request has are read once, not tried anew by an expression for each feature.
    """
    found = F.transform_values(map_column, lambda _, text: lenient_double(text))
    return df.select(
        *keep,
        *[F.coalesce(F.try_element_at(found, F.lit(f)), F.lit(0.0)).alias(f) for f in features],
    )


def coerce_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every column to a number; what cannot be read becomes 0."""
    return df.select(
        *[
            F.col(_quoted(c)) if c in keep else F.coalesce(as_number(df, c), F.lit(0.0)).alias(c)
            for c in df.columns
        ]
    )


def fill_numeric(df: DataFrame) -> DataFrame:
    """0 for null and NaN in numeric columns only; texts and dates stay."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=names) if names else df


def features_and_label(df: DataFrame, label: str = fixed.LABEL) -> tuple[list[str], str]:
    if label not in df.columns:
        raise KeyError(label)
    return feature_names(df, label), label


def exclude_dispositions(
    df: DataFrame, column: str = "discharge_disposition_id", ids: Sequence[int] = fixed.EXCLUDED_DISPOSITIONS
) -> DataFrame:
    """Leave out deceased and hospice patients; an unknown disposition stays."""
    return df.where(~F.coalesce(F.col(column).isin(list(ids)), F.lit(False)))


def at_or_above(df: DataFrame, score: str, threshold: float = fixed.DECISION_THRESHOLD) -> DataFrame:
    return df.where(F.col(score) >= threshold)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key in the given order.

    Spark prunes each task to one row per key before the shuffle, so a key that
    holds many rows does not travel whole.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def frequent_values(df: DataFrame, column: str, rows: int = 100_000) -> list:
    """Values (null too) that may stand in more than ``rows`` rows, from one pass over their column that moves sketches only.

    Counts are estimates, never too low where a value is listed; the list says how to deal rows, not which ones count. It
    holds 1,000 values at most, so what it leaves out is in no more than a thousandth of the rows or ``rows`` of them.
    """
    found = df.select(F.col(_quoted(column)).alias("v")).agg(F.expr("approx_top_k(v, 1000, 10000)").alias("top")).first()["top"]
    return [r["item"] for r in found if r["count"] > rows]


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int = 10) -> DataFrame:
    """The first ``rows`` rows of each key, for per-patient histories."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= rows)


def newest(df: DataFrame, order: Sequence[Column], rows: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def append_rows(log: DataFrame, new: DataFrame) -> DataFrame:
    return log.unionByName(new, allowMissingColumns=True)


def search_by_name(df: DataFrame, name: str = "", rows: int = 5, name_column: str = "name", order: str = "id") -> DataFrame:
    """Patients whose name contains a text, first ``rows`` in id order; '' matches all."""
    found = df.where(F.lower(name_column).contains(name.lower())) if name else df
    return found.orderBy(order).limit(rows)
