"""Sinks. Tables are Parquet folders; CSV is there for exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.plans.ensembles import load_scorer
from wardlight.sources import schemas


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> tuple[int, int]:
    """Overwrite a table and return its (rows, columns), counted in what was written.

    A Parquet count is answered by the file footers.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    reader = df.sparkSession.read.option("header", True) if kind == "csv" else df.sparkSession.read
    return reader.format(kind).load(path).count(), len(df.columns)


write_features = write_table
write_predictions = write_table


def append_outcomes(outcomes: DataFrame, path: str) -> None:
    """Append outcomes: integer label, stamped now unless a time is given.

    The log is laid out by day, so that a report over recent days reads those only.
    """
    stamped = outcomes if "recorded_at" in outcomes.columns else outcomes.withColumn("recorded_at", F.current_timestamp())
    noted = stamped if "notes" in stamped.columns else stamped.withColumn("notes", F.lit(""))
    noted.select(
        "patient_id", "predicted_risk", F.col("actually_readmitted").cast("int").alias("actually_readmitted"),
        "recorded_at", "notes", F.to_date("recorded_at").alias("recorded_day"),
    ).write.mode("append").partitionBy("recorded_day").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    columns = [f.name for f in metrics.sparkSession.createDataFrame([], schemas.METRICS).schema]
    metrics.select(*columns).write.mode("append").parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").parquet(path)


def save_model(model: Transformer, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> Transformer:
    """A saved pipeline, or a saved tree scorer, which is known by its table of nodes."""
    spark = SparkSession.active()
    nodes = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    if nodes.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(nodes):
        return load_scorer(spark, path)
    return PipelineModel.load(path)
