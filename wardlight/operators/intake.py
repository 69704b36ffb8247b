"""Features of an intake form: raw counts with fixed cutoffs, for what-if scoring.

These differ on purpose from the learned encounter features: fixed cutoffs
instead of quantiles, and an elderly/complexity product without its lab term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scalars import elderly_flag, nz, round_half_even

HIGH_LABS = 40
HIGH_VISITS = 3


def derived_fields(
    age: Column, stay: Column, inpatient: Column, outpatient: Column, emergency: Column, diagnoses: Column,
    medications: Column, labs: Column, procedures: Column, visits: Column,
) -> dict[str, Column]:
    burden = diagnoses + medications * F.lit(0.5)
    return {
        "total_prior_visits": visits,
        "is_elderly": elderly_flag(age),
        "polypharmacy": nz(medications >= 5),
        "complexity_score": round_half_even(burden + labs * F.lit(0.2), 2),
        "los_x_diagnoses": stay * diagnoses,
        "meds_x_los": medications * stay,
        "elderly_x_complex": elderly_flag(age) * burden,
        "inpatient_x_emergency": inpatient * emergency,
        "high_diagnosis_burden": nz(diagnoses >= 5),
        "high_lab_use": nz(labs > HIGH_LABS),
        "had_procedures": nz(procedures > 0),
        "has_inpatient_history": nz(inpatient >= 1),
        "emergency_prone": nz(emergency >= 2),
        "high_utiliser": nz(visits >= HIGH_VISITS),
    }


def intake_features(df: DataFrame, include_outpatient: bool = True) -> DataFrame:
    """Derive the fields of a form from its counts.

    The web form leaves outpatient visits out of the prior visits
    (``include_outpatient=False``). ``is_elderly`` and ``polypharmacy`` are kept
    when the form already carries them, as its checkboxes may overrule them.
    """
    visits = F.col("number_inpatient") + F.col("number_emergency")
    if include_outpatient:
        visits = visits + F.col("number_outpatient")
    fields = derived_fields(
        F.col("age_numeric"), F.col("time_in_hospital"), F.col("number_inpatient"), F.col("number_outpatient"),
        F.col("number_emergency"), F.col("number_diagnoses"), F.col("num_medications"),
        F.col("num_lab_procedures"), F.col("num_procedures"), visits,
    )
    if "is_elderly" in df.columns:
        burden = F.col("number_diagnoses") + F.col("num_medications") * F.lit(0.5)
        fields["elderly_x_complex"] = F.col("is_elderly") * burden
    kept = {"is_elderly", "polypharmacy"} & set(df.columns)
    return df.withColumns({name: column for name, column in fields.items() if name not in kept})
