"""From probabilities to decisions, bands, advice, summaries and alerts."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.functions.scalars import (
    decision, number, percent_text, recommendations, risk_band, risk_band_cut, round_half_even,
)


def with_probability(model: Transformer, df: DataFrame, output: str = "p") -> DataFrame:
    """Probability of class 1, null where it is not a number; columns the model adds on its way are dropped."""
    scored = model.transform(df)
    return scored.select(*[f"`{c}`" for c in df.columns], number(vector_to_array("probability")[1]).alias(output))


def prediction_columns(p: Column, threshold: float = fixed.DECISION_THRESHOLD) -> list[Column]:
    """Table form: rounded probability, 0/1 decision, right-closed band.

    Decision and band are taken before rounding.
    """
    return [
        round_half_even(number(p), 4).alias("readmission_probability"),
        decision(p, threshold).alias("predicted_readmission"),
        risk_band_cut(p).alias("risk_level"),
    ]


def response_columns(p: Column, threshold: float = fixed.DECISION_THRESHOLD, advice: bool = False) -> list[Column]:
    """Request form: left-closed band, percentage text, boolean decision."""
    columns = [
        round_half_even(number(p), 4).alias("readmission_probability"),
        percent_text(p).alias("readmission_percentage"),
        F.coalesce(number(p) >= threshold, F.lit(False)).alias("predicted_readmission"),
        risk_band(p).alias("risk_level"),
    ]
    return columns + [recommendations(risk_band(p)).alias("recommendations")] if advice else columns


def band_summary(predictions: DataFrame, band: str = "risk_level") -> DataFrame:
    """Count and share per band. Rows without a band stay in the denominator."""
    total = F.count("*")
    share = lambda name: F.avg(F.coalesce(F.col(band) == name, F.lit(False)).cast("int"))
    columns = [total.alias("total_patients")]
    for name in fixed.BANDS:
        columns += [
            F.count_if(F.col(band) == name).alias(f"{name.lower()}_risk"),
            share(name).alias(f"{name.lower()}_share"),
        ]
    return predictions.agg(*columns)


def daily_summary(scored: DataFrame, p: str = "p") -> DataFrame:
    """One pass over all scores: rows, bands, mean."""
    score = number(F.col(p))
    return scored.agg(
        F.count(score).alias("total_scored"),
        F.count_if(score >= fixed.HIGH_CUT).alias("high_risk"),
        F.count_if((score >= fixed.MEDIUM_CUT) & (score < fixed.HIGH_CUT)).alias("medium_risk"),
        F.count_if(score < fixed.MEDIUM_CUT).alias("low_risk"),
        round_half_even(F.avg(score), 4).alias("avg_risk"),
    )


def band_counts(scored: DataFrame, p: str = "p") -> DataFrame:
    """Rows per band, with a zero for a band nobody is in."""
    spark: SparkSession = scored.sparkSession
    bands = spark.createDataFrame([(b,) for b in fixed.BANDS], "risk_level string")
    counted = scored.groupBy(risk_band(F.col(p)).alias("risk_level")).agg(F.count("*").alias("patients"))
    # Both sides hold three rows.
    return bands.join(F.broadcast(counted), "risk_level", "left").fillna(0, subset=["patients"])


def batch_summary(scored: DataFrame, p: str = "p") -> DataFrame:
    """One row for a batch of requests: how many, and how many per band as a map."""
    band = risk_band(F.col(p))
    counts = F.array(*[F.count_if(band == name) for name in fixed.BANDS])
    return scored.agg(
        F.count("*").alias("total_patients"),
        F.map_from_arrays(F.array(*[F.lit(name) for name in fixed.BANDS]), counts).alias("risk_summary"),
    )


def alert_rows(scored: DataFrame, p: str = "p", email: str = "notify_email") -> DataFrame:
    """Alert for each High row that names an address."""
    high = scored.where((risk_band(F.col(p)) == "High") & F.col(email).isNotNull() & (F.col(email) != ""))
    band = F.upper(risk_band(F.col(p)))
    steps = "\n".join(f"{i}. {text}" for i, text in enumerate(fixed.RECOMMENDATIONS["High"], 1))
    patient = F.coalesce(F.col("patient_id").cast("string"), F.lit("UNKNOWN"))
    return high.select(
        patient.alias("patient_id"),
        F.col(email).alias("recipient"),
        F.concat(F.lit("HIGH READMISSION RISK - Patient "), patient).alias("subject"),
        F.concat(
            F.lit("Patient ID: "), patient, F.lit("\nRisk Level: "), band, F.lit("\nProbability: "),
            percent_text(F.col(p)), F.lit("\n\nRecommended actions:\n" + steps),
        ).alias("message"),
    )
