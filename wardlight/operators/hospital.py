"""Hospital star: appointments with doctors, patients, billing and treatments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.functions.scalars import (
    age_in_years, elderly_flag, lenient_date, nz, one_hot, round_half_even, weekend_flag,
)
from wardlight.operators.cleaning import drop_present, fill_numeric
from wardlight.operators.ordering import approx_quantile, exact_quantile, grouped_quantile, profile
from wardlight.session import materialise

AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),  # a sum over nothing is 0
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def join_inner(left: DataFrame, right: DataFrame, on: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """Inner equi-join. ``null_safe`` also matches null keys with null keys.

    Then all rows with null keys meet in one task, and both sides' multiply: leave it
    off unless nulls are few.
    """
    names = [on] if isinstance(on, str) else list(on)
    if not null_safe:
        return left.join(right, names)
    other = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    same = None
    for n in names:
        equal = left[n].eqNullSafe(other[f"_r_{n}"])
        same = equal if same is None else same & equal
    return left.join(other, same).drop(*[f"_r_{n}" for n in names])


def aggregate_by(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Aggregates named by column, such as ``{"age": "mean"}``, as ``age_mean``.

    Rows with a null key form no group. A median is taken from value counts and
    joined on, as Spark's own one would hold all values of a group in one place. The
    columns in use are then written once, so that a join below runs once.
    """
    wanted = [(c, fn) for c, fns in aggregates.items() for fn in ([fns] if isinstance(fns, str) else fns)]
    unknown = sorted({fn for _, fn in wanted if fn not in AGGREGATES and fn != "median"})
    if unknown:
        raise ValueError(f"unknown aggregates {unknown}")
    rows = df.select(*dict.fromkeys([*keys, *(c for c, _ in wanted)])).dropna(subset=list(keys))
    if any(fn == "median" for _, fn in wanted):
        rows = materialise(rows, "aggregate-input")
    plain = [AGGREGATES[fn](c).alias(f"{c}_{fn}") for c, fn in wanted if fn != "median"]
    result = rows.groupBy(*keys).agg(*plain) if plain else rows.select(*keys).distinct()
    for c in [c for c, fn in wanted if fn == "median"]:
        result = result.join(grouped_quantile(rows, keys, c, 0.5, f"{c}_median"), list(keys), "left")
    return result.select(*keys, *[f"{c}_{fn}" for c, fn in wanted])


def join_then_aggregate(left, right, on, keys, aggregates) -> DataFrame:
    return aggregate_by(join_inner(left, right, on), keys, aggregates)


def _money(amount: str) -> Column:
    """Sum of amounts, 0 over nothing. Rounded far below a cent so that the order
    in which partial sums meet does not show in later comparisons."""
    return F.coalesce(round_half_even(F.sum(amount), 6), F.lit(0.0))


def billing_per_patient(billing: DataFrame) -> DataFrame:
    return (
        billing.where(F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(
            _money("amount").alias("total_billed"),
            F.avg("amount").alias("avg_bill"),
            F.count("amount").alias("num_bills"),
            F.count_if(F.col("payment_status") == "Pending").alias("unpaid_bills"),
            F.count_if(F.col("payment_method") == "Insurance").alias("insurance_used"),
        )
    )


def treatments_per_appointment(treatments: DataFrame) -> DataFrame:
    return (
        treatments.where(F.col("appointment_id").isNotNull())
        .groupBy("appointment_id")
        .agg(
            F.count("treatment_id").alias("num_treatments"),
            _money("cost").alias("total_treatment_cost"),
        )
    )


def merge_hospital(
    appointments: DataFrame, doctors: DataFrame, patients: DataFrame, billing: DataFrame, treatments: DataFrame
) -> DataFrame:
    """One row per appointment with doctor, patient, billing and treatment columns.

    Bills and treatments are aggregated before they are joined. Patients and
    bills meet first, so that the appointments are joined on ``patient_id`` once
    and Spark can split a patient with very many of them. No side carries a
    broadcast hint: doctors (or any other side) are broadcast when Spark finds
    them below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise.
    """
    doctor = doctors.select("doctor_id", "specialization", "years_experience", "hospital_branch")
    patient = patients.select("patient_id", "gender", "date_of_birth", "insurance_provider", "registration_date")
    account = patient.join(billing_per_patient(billing), "patient_id", "full")
    return (
        appointments.join(doctor, "doctor_id", "left")
        .join(treatments_per_appointment(treatments), "appointment_id", "left")
        .join(account, "patient_id", "left")
    )


def billed_median(merged: DataFrame, exact: bool = True) -> float | None:
    """Median of ``total_billed`` over appointment rows (not over patients)."""
    return (exact_quantile if exact else approx_quantile)(merged, "total_billed", 0.5)


def _dates(df: DataFrame, fmt: str | None) -> DataFrame:
    return df.withColumns({
        "appointment_date": lenient_date(F.col("appointment_date"), fmt),
        "date_of_birth": lenient_date(F.col("date_of_birth"), fmt),
    })


def hospital_features(
    merged: DataFrame, median: float | None, reference_date: str = fixed.HOSPITAL_AGE_DATE, date_format: str | None = None
) -> DataFrame:
    """Date, appointment, doctor and billing features of merged appointments.

    Dates are ISO dates unless ``date_format`` names another pattern.
    """
    df = _dates(merged, date_format)
    age = age_in_years(F.col("date_of_birth"), F.lit(reference_date).cast("date"))
    no_show = nz(F.col("status") == "No-show")
    cancelled = nz(F.col("status") == "Cancelled")
    return df.withColumns({
        "appt_month": F.month("appointment_date"),
        "appt_day_of_week": F.weekday("appointment_date"),
        "appt_is_weekend": weekend_flag(F.col("appointment_date")),
        "patient_age": age,
        "is_elderly": elderly_flag(age),
        "is_noshow": no_show,
        "is_cancelled": cancelled,
        "appointment_risk": no_show + cancelled,
        "junior_doctor": nz(F.col("years_experience") < 5),
        "senior_doctor": nz(F.col("years_experience") >= 10),
        "has_unpaid_bills": nz(F.col("unpaid_bills") > 0),
        "high_bill_amount": nz(F.col("total_billed") > F.lit(median)),
        "insurance_dependent": nz(F.col("insurance_used") == F.col("num_bills")),
        "bill_per_treatment": round_half_even(F.col("total_billed") / (F.col("num_treatments") + 1), 2),
        "gender_male": nz(F.col("gender") == "Male"),
        "high_risk_specialty": nz(F.col("specialization").isin(fixed.HIGH_RISK_SPECIALTIES)),
    })


def hospital_levels(merged: DataFrame, max_levels: int = 1000) -> dict[str, list[str]]:
    return profile(merged, {}, {c: F.col(c) for c in fixed.HOSPITAL_CATEGORIES}, max_levels)[1]


def fit_hospital(merged: DataFrame, exact: bool = True, max_levels: int = 1000) -> tuple[float | None, dict[str, list[str]]]:
    """Median of ``total_billed`` and levels of the categories, in one scan if the median is exact."""
    levels = {c: F.col(c) for c in fixed.HOSPITAL_CATEGORIES}
    if not exact:
        return billed_median(merged, exact=False), profile(merged, {}, levels, max_levels)[1]
    found, seen = profile(merged, {"median": (F.col("total_billed"), 0.5)}, levels, max_levels)
    return found["median"], seen


def finalise_hospital(featured: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One-hot the three categories, drop what no model uses, fill numbers with 0."""
    flags = [flag for c in fixed.HOSPITAL_CATEGORIES for flag in one_hot(c, levels[c])]
    encoded = featured.select("*", *flags)
    return fill_numeric(drop_present(encoded, [*fixed.HOSPITAL_CATEGORIES, *fixed.HOSPITAL_UNUSED]))


def hospital_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Patients, feature count and the three headline rates."""
    patients: Column = F.count_distinct("patient_id") if exact else F.approx_count_distinct("patient_id")
    return df.agg(
        patients.alias("total_patients"),
        F.lit(len(df.columns) - 1).alias("total_features"),
        F.avg("is_noshow").alias("noshow_rate"),
        F.avg("has_unpaid_bills").alias("unpaid_rate"),
        F.avg("is_elderly").alias("elderly_rate"),
    )


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table, counted on the executors."""
    counts = [
        df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))
        for name, df in tables.items()
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result
