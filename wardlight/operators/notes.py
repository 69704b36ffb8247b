"""Structured note annotations folded into patient features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions import fixed
from wardlight.functions.scalars import round_half_even

# Scores are read as doubles: 1.5 in an integer field would come out as null.
ANNOTATION = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in fixed.NOTE_SCORES]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in fixed.NOTE_LISTS]
    + [T.StructField("summary", T.StringType())]
)


def annotation_prompt(note: Column) -> Column:
    """Request text for an annotator, whole note included."""
    fields = ", ".join([*fixed.NOTE_SCORES, *fixed.NOTE_LISTS, "summary"])
    return F.concat(
        F.lit(f"Read the discharge note and answer with one JSON object with the fields {fields}.\n\n"), note
    )


def annotate_notes(
    notes: DataFrame, annotate: Callable[[pd.Series], pd.Series], note: str = "note", output: str = "annotation_json"
) -> DataFrame:
    """Run a user-supplied batch annotator (prompts in, JSON texts out) over all notes."""
    prompted = notes.withColumn("_prompt", annotation_prompt(F.col(note))).drop(note)
    kept = [f for f in prompted.schema if f.name != "_prompt"]
    schema = T.StructType([*kept, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = annotate(batch.pop("_prompt"))
            batch[output] = answers.to_numpy()
            yield batch

    return prompted.mapInPandas(run, schema)


def parse_annotations(df: DataFrame, column: str = "annotation_json", output: str = "annotation") -> DataFrame:
    """JSON text to a struct; a text that is no JSON object gives the default record."""
    text = F.trim(F.col(column))
    # As the only element of an array: the parser alone would accept trailing text.
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    readable = F.coalesce(
        alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()
        & text.rlike(r"(?s)^\s*\{.*\}\s*$"),
        F.lit(False),
    )
    default = F.struct(
        *[F.lit(float(v)).alias(name) for name, v in fixed.NOTE_SCORES.items()],
        *[F.array().cast("array<string>").alias(name) for name in fixed.NOTE_LISTS],
        F.lit(fixed.NOTE_UNREADABLE).alias("summary"),
    )
    return df.withColumn(output, F.when(readable, F.from_json(text, ANNOTATION)).otherwise(default))


def merge_annotations(features: DataFrame, annotation: str = "annotation") -> DataFrame:
    """Copy six annotation fields into the features and raise the complexity score.

    A field the annotation lacks takes its default.
    """
    def value(name: str) -> Column:
        return F.coalesce(F.col(f"{annotation}.{name}"), F.lit(float(fixed.NOTE_SCORES[name])))

    score = F.coalesce(F.col("complexity_score").cast("double"), F.lit(0.0)) if "complexity_score" in features.columns else F.lit(0.0)
    merged = {feature: value(name) for name, feature in fixed.NOTE_FEATURES.items()}
    merged["complexity_score"] = round_half_even(score + value("overall_psychosocial_risk") * F.lit(0.5), 2)
    return features.withColumns(merged).drop(annotation)


def annotated_features(features: DataFrame, annotations: DataFrame, key: str = "patient_id") -> DataFrame:
    """Patients with their annotation (left join), merged. Patients without one keep the defaults."""
    parsed = parse_annotations(annotations).select(key, "annotation")
    return merge_annotations(features.join(parsed, key, "left"))
