"""Sources: CSV, Parquet and JSON files, logs and streams of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions import fixed
from wardlight.functions.scalars import lenient_double
from wardlight.operators.cleaning import align_map, feature_names, tokens_to_null
from wardlight.sources import schemas

BOM = "﻿"


def _typed(column: Column, kind: T.DataType) -> Column:
    """Text to a declared type. Whole numbers may be written as ``5.0``; ``5.5`` is none."""
    if not isinstance(kind, T.IntegralType):
        return column.try_cast(kind)
    value = lenient_double(column)
    return F.coalesce(column.try_cast(kind), F.when(value == F.floor(value), value).try_cast(kind))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header. Columns are matched by name; further columns are kept as
    text, and missing-value tokens become null before types are applied.

    Only the header line is looked at ahead of the read, never the rows. Quoted cells
    with line breaks need ``multi_line``; a file is then read by one task and not in splits.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", multi_line).option("escape", '"').csv(path)
    first = raw.columns[0] if raw.columns else ""
    if first.startswith(BOM):
        raw = raw.withColumnRenamed(first, first.lstrip(BOM))
    raw = tokens_to_null(raw)
    if schema is None:
        return raw
    declared = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    missing = [c for c in declared if c not in raw.columns]
    if missing:
        raise KeyError(f"{path} has no columns {missing}")
    return raw.select(*[
        _typed(F.col(f"`{c}`"), declared[c]).alias(c) if c in declared else F.col(f"`{c}`") for c in raw.columns
    ])


def read_encounters(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_csv(spark, path, schemas.ENCOUNTERS, multi_line)


def read_hospital(spark: SparkSession, folder: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """The five hospital tables of a folder, one CSV file (or folder) each."""
    return {
        name: read_csv(spark, f"{folder}/{name}.csv", schema, multi_line) for name, schema in schemas.HOSPITAL.items()
    }


def read_features(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Processed features. A CSV feature table is all numbers and flags."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind != "csv":
        raise ValueError(kind)
    raw = read_csv(spark, path)
    return raw.select(*[
        F.when(F.lower(f"`{c}`") == "true", F.lit(1.0)).when(F.lower(f"`{c}`") == "false", F.lit(0.0))
        .otherwise(F.col(f"`{c}`").try_cast("double")).alias(c)
        for c in raw.columns
    ])


def probe_features(spark: SparkSession, path: str, label: str = fixed.LABEL, kind: str = "parquet") -> list[str]:
    """Feature contract of a table from its schema alone."""
    return feature_names(read_csv(spark, path) if kind == "csv" else spark.read.parquet(path), label)


def _read_log(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    try:
        reader = spark.read.schema(schema)
        return reader.parquet(path) if kind == "parquet" else reader.option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_outcomes(spark: SparkSession, path: str, kind: str = "parquet", since: str | None = None) -> DataFrame:
    """Outcome log; a log that does not exist yet is empty. ``kind='json'`` reads a JSON array.

    ``since`` (a date) leaves out earlier days without reading them.
    """
    log = _read_log(spark, path, schemas.OUTCOMES, kind)
    if since:
        log = log.where(F.col("recorded_day" if "recorded_day" in log.columns else "recorded_at") >= F.lit(since).cast("date"))
    return log.drop("recorded_day")


def read_metrics(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _read_log(spark, path, schemas.METRICS, kind)


def read_fhir(spark: SparkSession, folder: str, whole_files: bool = False) -> dict[str, DataFrame]:
    """Bundle files, one folder per resource type: JSON lines, or one (indented) document or array per file.

    A record that cannot be read keeps its text in ``unreadable``; ``unreadable_records`` counts them.
    """
    return {
        name: spark.read.schema(f"{schema}, {schemas.UNREADABLE} string").option("columnNameOfCorruptRecord", schemas.UNREADABLE)
        .option("multiLine", whole_files).json(f"{folder}/{name}")
        for name, schema in schemas.FHIR.items()
    }


def unreadable_records(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Records and unreadable records of each table of ``read_fhir``, as (resource, records, unreadable)."""
    # Spark does not parse a file for the unreadable text alone, so every column takes part.
    counts = [
        df.agg(F.lit(name).alias("resource"), F.count(F.xxhash64(*df.columns)).alias("records"),
               F.count(F.when(F.col(schemas.UNREADABLE).isNotNull(), F.xxhash64(*df.columns))).alias("unreadable"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REQUESTS).json(path)


def aligned_requests(requests: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sparse requests to contract columns; a request without id is 'UNKNOWN'."""
    named = requests.withColumn("patient_id", F.coalesce("patient_id", F.lit("UNKNOWN")))
    return align_map(named, "patient_data", features, keep=["patient_id", "notify_email"])


def stream_requests(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Discharge events as they arrive in a folder."""
    return (
        spark.readStream.schema(schemas.REQUESTS).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def stream_outcomes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.OUTCOMES).option("maxFilesPerTrigger", files_per_batch).json(folder)
