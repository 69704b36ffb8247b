"""Types of text columns, folded over all rows in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions.scalars import ISO_DATE, lenient_date, lenient_double
from wardlight.operators.cleaning import tokens_to_null
from wardlight.sources.readers import read_csv

WHOLE = r"^\s*[+-]?[0-9]+\s*$"
DAY = r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"
# From the narrowest to the widest: a column has the first type that all its values have.
LATTICE = ("bigint", "double", "date", "timestamp", "string")


def _time(text):
    return F.when(text.rlike(ISO_DATE), F.trim(text)).try_cast("timestamp")


def inferred_types(df: DataFrame, dates: bool = True, missing: Sequence[str] = ()) -> dict[str, str]:
    """The type of each text column: whole numbers, numbers, ISO dates or times (with ``dates``) or text.

    Missing-value tokens and the values in ``missing`` say nothing; a column of these alone is text. Every value counts, so one odd
    value anywhere makes a column text, and the order of rows and files has no effect: what comes back are counts of
    the values that each type can hold. Columns that are no text keep their type.
    """
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    found = {}
    if text:
        # One row for each cell: the counts of all columns are one small expression.
        cells = tokens_to_null(df.select(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(text)]).unpivot([], [str(i) for i in range(len(text))], "at", "value"))
        cells = cells.replace(list(missing), None, ["value"]) if missing else cells
        value = F.col("value")
        counted = cells.groupBy("at").agg(
            F.count(value).alias("n"), F.count(F.when(value.rlike(WHOLE), F.trim(value)).try_cast("bigint")).alias("bigint"),
            F.count(lenient_double(value)).alias("double"), F.count(F.when(value.rlike(DAY), lenient_date(value))).alias("date"),
            F.count(_time(value)).alias("timestamp"))
        found = {int(r["at"]): r for r in counted.collect()}  # one row for each column
    out = {f.name: f.dataType.simpleString() for f in df.schema}
    for i, c in enumerate(text):
        row = found.get(i)
        fits = [k for k in LATTICE[:-1] if row and row["n"] and row[k] == row["n"] and (dates or k not in ("date", "timestamp"))]
        out[c] = fits[0] if fits else "string"
    return out


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as their inferred types; missing-value tokens are null."""
    as_type = {"bigint": lambda c: F.trim(c).try_cast("bigint"), "double": lenient_double, "date": lenient_date, "timestamp": _time, "string": lambda c: c}
    now = dict(df.dtypes)
    return tokens_to_null(df).select(*[
        (as_type[types[c]](F.col(f"`{c}`")) if now[c] == "string" and c in types else F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_inferred(spark: SparkSession, path: str, dates: bool = False, multi_line: bool = False) -> DataFrame:
    """A CSV file or folder with the types its values have."""
    raw = read_csv(spark, path, None, multi_line)
    return typed(raw, inferred_types(raw, dates))
