"""Encounter rows to readmission features.

Each step is one projection. Table-wide figures (quantiles, category levels)
are learned once by ``fit_encounters`` and kept in ``EncounterStats``, so that
training and scoring use the same ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.functions.scalars import (
    age_band, age_midpoint, diagnosis_category, elderly_flag, nz, one_hot, ordinal,
    readmission_label, round_half_even,
)
from wardlight.operators.cleaning import (
    drop_present, drop_strict, exclude_dispositions, first_per_key, frequent_values, sentinel_to_null,
)
from wardlight.operators.ordering import approx_quantile, profile

HIGH_UTILISER_QUANTILE = 0.75
DEALT_ROWS = 100_000  # wide rows that a task sorts, until there are
DEALT_PARTS = 200  # partitions: for more, tasks sort (and spill) what they read before they write it


@dataclass(frozen=True)
class EncounterStats:
    visits_high: float | None
    labs_median: float | None
    levels: dict[str, list[str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "EncounterStats":
        return cls(**json.loads(text))


def encode_target(df: DataFrame, mode: str = "any") -> DataFrame:
    return df.withColumn(fixed.LABEL, readmission_label(F.col("readmitted"), mode))


def clean_encounters(df: DataFrame, order: Sequence[str | Column] = ("encounter_id",)) -> DataFrame:
    """One row per encounter, sentinel to null, unused columns and raw label gone.

    ``order`` says which of several rows of an encounter is the first. Columns
    are dropped before the shuffle that finds it. Rows are wide, and a task that
    sorts all it has read spills most of them; so they are dealt by encounter first, over
    as many partitions as their number asks for, up to a limit (adaptive execution merges
    small ones), and sorted there. Encounters of very many rows are looked for beforehand, and pruned in each
    task before they travel.
    """
    kept = drop_strict(sentinel_to_null(df), [*fixed.ENCOUNTER_UNUSED])
    first = lambda rows: first_per_key(rows, ["encounter_id"], order)
    hot = frequent_values(kept, "encounter_id")
    parts = min(max(1, -(-kept.count() // DEALT_ROWS)), DEALT_PARTS)
    dealt = lambda rows: rows.hint("rebalance", parts, "encounter_id")
    if not hot:
        return drop_strict(first(dealt(kept)), ["readmitted"])
    many = F.coalesce(F.col("encounter_id").isin([v for v in hot if v is not None]), F.lit(None in hot))
    both = first(dealt(kept.where(~many))).unionByName(first(kept.where(many)))
    return drop_strict(both, ["readmitted"])


def age_features(df: DataFrame) -> DataFrame:
    aged = df.withColumn("age_numeric", age_midpoint(F.col("age")))
    age = F.col("age_numeric")
    return drop_strict(aged.withColumns({"is_elderly": elderly_flag(age), "age_group": age_band(age)}), ["age"])


def prior_visits() -> Column:
    return F.col("number_outpatient") + F.col("number_inpatient") + F.col("number_emergency")


def utilisation_features(df: DataFrame, visits_high: float | None) -> DataFrame:
    return df.withColumns({
        "total_prior_visits": prior_visits(),
        "high_utiliser": nz(prior_visits() >= F.lit(visits_high)),
        "emergency_prone": nz(F.col("number_emergency") >= 2),
        "has_inpatient_history": nz(F.col("number_inpatient") >= 1),
    })


def clinical_features(df: DataFrame, labs_median: float | None) -> DataFrame:
    return df.withColumns({
        "polypharmacy": nz(F.col("num_medications") >= 5),
        "high_diagnosis_burden": nz(F.col("number_diagnoses") >= 5),
        "high_lab_use": nz(F.col("num_lab_procedures") > F.lit(labs_median)),
        "had_procedures": nz(F.col("num_procedures") > 0),
        "complexity_score": round_half_even(
            F.col("number_diagnoses") + F.col("num_medications") * F.lit(0.5) + F.col("num_lab_procedures") * F.lit(0.2), 2
        ),
    })


def glucose_features(df: DataFrame) -> DataFrame:
    glucose = ordinal(F.col("max_glu_serum"), fixed.GLUCOSE_LEVELS)
    a1c = ordinal(F.col("A1Cresult"), fixed.A1C_LEVELS)
    return drop_strict(
        df.withColumns({
            "glu_serum_num": glucose,
            "a1c_num": a1c,
            "metabolic_risk": glucose + a1c,
            "uncontrolled_diabetes": nz(glucose + a1c >= 4),
        }),
        ["max_glu_serum", "A1Cresult"],
    )


def discharge_features(df: DataFrame) -> DataFrame:
    flagged = df.withColumn(
        "high_risk_discharge", nz(F.col("discharge_disposition_id").isin(fixed.HIGH_RISK_DISPOSITIONS))
    )
    return exclude_dispositions(flagged)


def diagnosis_features(df: DataFrame) -> DataFrame:
    category = df.withColumn("primary_diag_category", diagnosis_category(F.col("primary_diagnosis_code")))
    return drop_strict(
        category.withColumns({
            "diabetes_primary": nz(F.col("primary_diag_category") == "Diabetes"),
            "cardiac_primary": nz(F.col("primary_diag_category") == "Circulatory"),
        }),
        ["primary_diagnosis_code", "other_diagnosis_codes"],
    )


def interaction_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "los_x_diagnoses": F.col("time_in_hospital") * F.col("number_diagnoses"),
        "elderly_x_complex": F.col("is_elderly") * F.col("complexity_score"),
        "inpatient_x_emergency": F.col("number_inpatient") * F.col("number_emergency"),
        "meds_x_los": F.col("num_medications") * F.col("time_in_hospital"),
    })


def encode_categoricals(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Binary columns and one flag per level but the first of each category."""
    present = [c for c in fixed.ENCOUNTER_CATEGORIES if c in df.columns]
    flags = [flag for c in present for flag in one_hot(c, levels[c])]
    gone = {"gender", "change", *present}
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in gone],
        nz(F.col("gender") == "Male").alias("gender_male"),
        nz(F.col("change") == "Ch").alias("medication_changed"),
        *flags,
    )


def drop_ids(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return drop_present(df, [c for c in fixed.ENCOUNTER_IDS if c not in keep])


def fit_encounters(cleaned: DataFrame, max_levels: int = 1000, exact: bool = True) -> EncounterStats:
    """Learn the table-wide figures from cleaned encounters, in one scan if they are exact.

    Quantiles are over all cleaned rows; levels only over rows that survive the
    disposition filter. Age bands are a fixed list, seen or not. With ``exact=False``
    quantiles have a small rank error.
    """
    stays = ~F.coalesce(F.col("discharge_disposition_id").isin(fixed.EXCLUDED_DISPOSITIONS), F.lit(False))
    seen = {
        "race": F.when(stays, F.col("race")),
        "medical_specialty": F.when(stays, F.col("medical_specialty")),
        "primary_diag_category": F.when(stays, diagnosis_category(F.col("primary_diagnosis_code"))),
    }
    wanted = {"visits": (prior_visits(), HIGH_UTILISER_QUANTILE), "labs": (F.col("num_lab_procedures"), 0.5)}
    quantiles, levels = profile(cleaned, wanted if exact else {}, seen, max_levels)
    if not exact:
        measured = cleaned.select(*[column.alias(name) for name, (column, _) in wanted.items()])
        quantiles = {name: approx_quantile(measured, name, fraction) for name, (_, fraction) in wanted.items()}
    levels["age_group"] = [name for name, _ in fixed.AGE_BANDS]
    return EncounterStats(quantiles["visits"], quantiles["labs"], levels)


def encounter_features(cleaned: DataFrame, stats: EncounterStats, keep_ids: bool | Sequence[str] = False) -> DataFrame:
    """Cleaned encounters to the feature table, steps in their fixed order.

    ``keep_ids`` names the id columns to keep beside the features; True keeps all.
    """
    featured = (
        cleaned.transform(age_features)
        .transform(utilisation_features, stats.visits_high)
        .transform(clinical_features, stats.labs_median)
        .transform(glucose_features)
        .transform(discharge_features)
        .transform(diagnosis_features)
        .transform(interaction_features)
        .transform(encode_categoricals, stats.levels)
    )
    return featured if keep_ids is True else drop_ids(featured, keep_ids or ())


def label_distribution(df: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), label)


def positive_rate(df: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    return df.agg(F.avg(label).alias("positive_rate"))
