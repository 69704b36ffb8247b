"""Quantiles over growing data: one mergeable rank sketch for each day instead of the history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scalars import number

K = 2048


def rank_error(k: int = K) -> float:
    """By how much the rank of a returned value may differ from the wanted one, as a share of the rows (with 99 % confidence)."""
    return 2.296 / k**0.9021


def day_sketches(df: DataFrame, columns: Sequence[str], day: str, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """One row for each day (and key): a sketch of each column's numbers, of bounded size. Null and what is no number is left out."""
    return df.groupBy(*keys, day).agg(*[F.kll_sketch_agg_double(number(F.col(f"`{c}`").cast("double")), F.lit(k)).alias(c) for c in columns])


def append_sketches(df: DataFrame, path: str, columns: Sequence[str], day: str, keys: Sequence[str] = (), k: int = K) -> None:
    """Write the sketches of the days in ``df`` beside those of other days; a day that comes again replaces its sketches."""
    day_sketches(df, columns, day, keys, k).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merged(sketches: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """The sketch of all days together, for each key."""
    return sketches.groupBy(*keys).agg(*[F.kll_merge_agg_double(F.col(f"`{c}`"), F.lit(k)).alias(c) for c in columns])


def quantile(sketch: Column | str, fraction: float) -> Column:
    """The value at a fraction of the numbers in a sketch; null where it holds none."""
    held = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(count(held) > 0, F.kll_sketch_get_quantile_double(held, F.lit(float(fraction))))


def count(sketch: Column | str) -> Column:
    return F.kll_sketch_get_n_double(sketch)


def learned(sketches: DataFrame, fractions: dict[str, float], k: int = K) -> dict[str, float | None]:
    """One quantile of each column over all days, such as the median or the high-utilisation cut; reads as many sketches as there are days."""
    row = merged(sketches, list(fractions), (), k).select(*[quantile(f"`{c}`", f).alias(c) for c, f in fractions.items()]).first()
    return {c: row[c] for c in fractions}
