"""FHIR bundles to patient features.

A bundle table has one row per bundle page. Whose page it is says an added
``patient_id``; without one, the subject each resource refers to. A patient may
have any number of pages. Entries are exploded and counted with
two-stage aggregations, so no patient's entries are ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.functions.scalars import contains_any, encounter_class, full_name, lenient_date, nz, whole_age
from wardlight.operators.cleaning import search_by_name
from wardlight.operators.intake import derived_fields


def patient_rows(patients: DataFrame, asof: Column) -> DataFrame:
    """Identity and age of each FHIR Patient resource."""
    birth = F.coalesce(F.col("birthDate"), F.lit(""))
    return patients.select(
        F.col("id").alias("patient_id"),
        full_name(F.col("name")).alias("full_name"),
        F.coalesce("gender", F.lit("unknown")).alias("gender"),
        birth.alias("birth_date"),
        whole_age(lenient_date(birth), asof).alias("age"),
    )


def subject_id(reference: Column) -> Column:
    """Id in a reference such as ``Patient/42``, with or without an address or a version; null for other resources."""
    found = F.regexp_extract(reference, r"(?:^|/)Patient/([^/]+)", 1)
    return F.when(found != "", found)


def _has_subject(bundles: DataFrame) -> bool:
    return "subject" in bundles.schema["entry"].dataType.elementType["resource"].dataType.names


def _resources(bundles: DataFrame) -> DataFrame:
    """Resources with their patient; what names none keeps a null patient."""
    entries = bundles.select("patient_id", F.explode("entry").alias("entry")).select("patient_id", "entry.resource.*")
    if not _has_subject(bundles):
        return entries
    return entries.withColumn("patient_id", F.coalesce("patient_id", subject_id(F.col("subject.reference"))))


def condition_rows(bundles: DataFrame) -> DataFrame:
    """Text and first code of every condition, '' where absent."""
    coding = F.get(F.col("code.coding"), 0)
    return _resources(bundles).select(
        "patient_id",
        F.coalesce(F.col("code.text"), F.lit("")).alias("text"),
        F.coalesce(coding["code"], F.lit("")).alias("code"),
    )


def medication_rows(bundles: DataFrame) -> DataFrame:
    return _resources(bundles).select(
        "patient_id", F.coalesce(F.col("medicationCodeableConcept.text"), F.lit("Unknown")).alias("text")
    )


def encounter_rows(bundles: DataFrame) -> DataFrame:
    return _resources(bundles).select("patient_id", F.coalesce(F.col("class.code"), F.lit("")).alias("class_code"))


def lab_counts(bundles: DataFrame) -> DataFrame:
    """The total a bundle states, else the number of its entries.

    A page without ``patient_id`` belongs to the first subject its resources refer
    to; a search bundle is about one patient.
    """
    if _has_subject(bundles):
        subjects = F.transform("entry", lambda e: subject_id(e["resource"]["subject"]["reference"]))
        bundles = bundles.withColumn("patient_id", F.coalesce("patient_id", F.get(F.array_compact(subjects), 0)))
    return bundles.groupBy("patient_id").agg(
        F.coalesce(F.max("total"), F.sum(F.coalesce(F.size("entry"), F.lit(0))), F.lit(0)).cast("long").alias("lab_count")
    )


def encounter_counts(rows: DataFrame, fragments=fixed.CLASS_FRAGMENTS) -> DataFrame:
    """Encounters per class and in total; a code no class knows counts in the total only."""
    kind = encounter_class(F.col("class_code"), fragments)
    return rows.groupBy("patient_id").agg(
        *[F.count_if(kind == name).alias(name) for name, _ in fragments], F.count("*").alias("total")
    )


def condition_summary(
    rows: DataFrame,
    cardiac: Sequence[str] = fixed.CARDIAC_CODES,
    diabetes: Sequence[str] = fixed.DIABETES_CODES,
) -> DataFrame:
    """Conditions per patient and whether any code contains one of the listed codes."""
    return rows.groupBy("patient_id").agg(
        F.count("*").alias("n_conditions"),
        F.max(nz(contains_any(F.col("code"), cardiac))).alias("cardiac_primary"),
        F.max(nz(contains_any(F.col("code"), diabetes))).alias("diabetes_primary"),
    )


def medication_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("patient_id").agg(F.count("*").alias("n_medications"))


def patient_features(
    patients: DataFrame, conditions: DataFrame, medications: DataFrame, encounters: DataFrame, labs: DataFrame,
    length_of_stay: int = 5,
) -> DataFrame:
    """Feature record per patient: ``patients`` has (patient_id, age), the others
    one row per patient. Every side is already grouped by ``patient_id``, so the
    joins reuse that partitioning. A patient missing on a side counts as 0.
    """
    joined = (
        patients.select("patient_id", "age")
        .join(conditions, "patient_id", "left")
        .join(medications, "patient_id", "left")
        .join(encounters, "patient_id", "left")
        .join(labs, "patient_id", "left")
        .fillna(0)
    )
    stay, none = F.lit(length_of_stay), F.lit(0)
    base = {
        "age_numeric": F.col("age"),
        "time_in_hospital": stay,
        "number_inpatient": F.col("inpatient"),
        "number_outpatient": F.col("outpatient"),
        "number_emergency": F.col("emergency"),
        "number_diagnoses": F.col("n_conditions"),
        "num_medications": F.col("n_medications"),
        "num_lab_procedures": F.col("lab_count"),
        "num_procedures": none,
        "cardiac_primary": F.col("cardiac_primary"),
        "diabetes_primary": F.col("diabetes_primary"),
        "high_risk_discharge": none,
        "medication_changed": none,
    }
    derived = derived_fields(
        base["age_numeric"], stay, base["number_inpatient"], base["number_outpatient"], base["number_emergency"],
        base["number_diagnoses"], base["num_medications"], base["num_lab_procedures"], none, F.col("total"),
    )
    return joined.select("patient_id", *[c.alias(name) for name, c in {**base, **derived}.items()])


def bundle_features(
    patients: DataFrame, conditions: DataFrame, medications: DataFrame, encounters: DataFrame, observations: DataFrame,
    asof: Column, length_of_stay: int = 5,
) -> DataFrame:
    """The same from the five bundle tables."""
    return patient_features(
        patient_rows(patients, asof),
        condition_summary(condition_rows(conditions)),
        medication_counts(medication_rows(medications)),
        encounter_counts(encounter_rows(encounters)),
        lab_counts(observations),
        length_of_stay,
    )


def search_patients(patients: DataFrame, name: str = "", rows: int = 5) -> DataFrame:
    listed = patients.select(
        F.coalesce("id", F.lit("")).alias("id"), full_name(F.col("name")).alias("name"),
        F.coalesce("gender", F.lit("")).alias("gender"),
    )
    return search_by_name(listed, name, rows)
