"""Queries over the hospital star."""

from pyspark.sql import functions as F

from wardlight.catalog.registry import flag, query, r
from wardlight.catalog.views import table, view
from wardlight.functions.scalars import round_half_even
from wardlight.operators import hospital
from wardlight.operators.ordering import profile
from wardlight.plans.jobs import hospital_job
from wardlight.session import materialise

STAR = ("fx_appointments", "fx_doctors", "fx_patients", "fx_billing", "fx_treatments")

_AGGREGATES = """
billing AS (
  SELECT patient_id, coalesce(""" + r("sum(amount)", 6) + """, 0) AS total_billed, avg(amount) AS avg_bill,
    count(amount) AS num_bills, count(*) FILTER (WHERE payment_status = 'Pending') AS unpaid_bills,
    count(*) FILTER (WHERE payment_method = 'Insurance') AS insurance_used
  FROM fx_billing GROUP BY patient_id),
treatments AS (
  SELECT appointment_id, count(treatment_id) AS num_treatments, coalesce(""" + r("sum(cost)", 6) + """, 0) AS total_treatment_cost
  FROM fx_treatments GROUP BY appointment_id)
"""
_MERGED = _AGGREGATES + """,
merged AS (
  SELECT a.*, d.specialization, d.years_experience, d.hospital_branch, p.gender, p.date_of_birth, p.insurance_provider,
    p.registration_date, b.total_billed, b.avg_bill, b.num_bills, b.unpaid_bills, b.insurance_used,
    t.num_treatments, t.total_treatment_cost
  FROM fx_appointments a LEFT JOIN fx_doctors d USING (doctor_id) LEFT JOIN fx_patients p USING (patient_id)
    LEFT JOIN billing b USING (patient_id) LEFT JOIN treatments t USING (appointment_id))
"""
_FEATURED = _MERGED + f""",
dated AS (
  SELECT * REPLACE (try_cast(appointment_date AS DATE) AS appointment_date, try_cast(date_of_birth AS DATE) AS date_of_birth) FROM merged),
aged AS (
  SELECT *, {r("date_diff('day', date_of_birth, DATE '2024-01-01') / 365.25::DOUBLE", 1)} AS patient_age FROM dated),
featured AS (
  SELECT *,
    month(appointment_date)::INTEGER AS appt_month,
    (isodow(appointment_date) - 1)::INTEGER AS appt_day_of_week,
    {flag("isodow(appointment_date) >= 6")} AS appt_is_weekend,
    {flag("patient_age >= 65")} AS is_elderly,
    {flag("status = 'No-show'")} AS is_noshow,
    {flag("status = 'Cancelled'")} AS is_cancelled,
    {flag("status IN ('No-show', 'Cancelled')")} AS appointment_risk,
    {flag("years_experience < 5")} AS junior_doctor,
    {flag("years_experience >= 10")} AS senior_doctor,
    {flag("unpaid_bills > 0")} AS has_unpaid_bills,
    {flag("total_billed > (SELECT median(total_billed) FROM merged)")} AS high_bill_amount,
    {flag("insurance_used = num_bills")} AS insurance_dependent,
    {r("total_billed / (num_treatments + 1)", 2)} AS bill_per_treatment,
    {flag("gender = 'Male'")} AS gender_male,
    {flag("specialization IN ('Cardiology', 'Internal Medicine', 'Nephrology', 'Pulmonology')")} AS high_risk_specialty
  FROM aged)
"""
_DERIVED = [
    "appt_month", "appt_day_of_week", "appt_is_weekend", "patient_age", "is_elderly", "is_noshow", "is_cancelled",
    "appointment_risk", "junior_doctor", "senior_doctor", "has_unpaid_bills", "high_bill_amount", "insurance_dependent",
    "bill_per_treatment", "gender_male", "high_risk_specialty",
]


def star(spark, d):
    return {name.removeprefix("fx_"): view(spark, d, name) for name in STAR}


def merged(spark, d):
    tables = star(spark, d)
    return hospital.merge_hospital(*[tables[n] for n in ("appointments", "doctors", "patients", "billing", "treatments")])


def _featured(spark, d):
    joined = materialise(merged(spark, d), "merged-hospital")
    return hospital.hospital_features(joined, hospital.billed_median(joined))


@query(_AGGREGATES + f"SELECT * REPLACE ({r('avg_bill')} AS avg_bill) FROM billing", STAR)
def billing_per_patient(spark, d):
    bills = hospital.billing_per_patient(view(spark, d, "fx_billing"))
    return bills.withColumn("avg_bill", round_half_even(F.col("avg_bill"), 4))


@query(_AGGREGATES + "SELECT * FROM treatments", STAR)
def treatments_per_appointment(spark, d):
    return hospital.treatments_per_appointment(view(spark, d, "fx_treatments"))


@query(_MERGED + f"SELECT * REPLACE ({r('avg_bill')} AS avg_bill) FROM merged", STAR)
def hospital_merge(spark, d):
    return merged(spark, d).withColumn("avg_bill", round_half_even(F.col("avg_bill"), 4))


@query(_FEATURED + f"SELECT appointment_id, {', '.join(_DERIVED)} FROM featured", STAR)
def hospital_features(spark, d):
    return _featured(spark, d).select("appointment_id", *_DERIVED)


_KEPT = ["patient_id", "years_experience", "total_billed", "avg_bill", "num_bills", "unpaid_bills", "insurance_used",
         "num_treatments", "total_treatment_cost", *_DERIVED]
_LEVELS = {
    "specialization": ["Dermatology", "Nephrology", "Oncology", "Pediatrics"],
    "hospital_branch": ["East", "West"],
    "insurance_provider": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}
_FILLED = ", ".join(
    "patient_id" if c == "patient_id" else f"{r('coalesce(avg_bill, 0)')} AS avg_bill" if c == "avg_bill"
    else f"coalesce({c}, 0) AS {c}" for c in _KEPT
)
_FLAGS = ", ".join(f"{flag(f'{c} = ' + repr(v))} AS {c}_{v}" for c, values in _LEVELS.items() for v in values)


@query(_FEATURED + f"SELECT {_FILLED}, {_FLAGS} FROM featured", STAR)
def hospital_final(spark, d):
    final = hospital_job(star(spark, d))
    return final.withColumn("avg_bill", round_half_even(F.col("avg_bill"), 4))


@query(_FEATURED + f"""
SELECT count(DISTINCT patient_id) AS total_patients, {len(_KEPT) - 1} AS total_features,
  {r("avg(is_noshow)")} AS noshow_rate, {r("avg(has_unpaid_bills)")} AS unpaid_rate, {r("avg(is_elderly)")} AS elderly_rate
FROM featured""", STAR)
def hospital_summary(spark, d):
    summary = hospital.hospital_summary(_featured(spark, d).select(*_KEPT))
    return summary.withColumns({c: round_half_even(F.col(c), 4) for c in ("noshow_rate", "unpaid_rate", "elderly_rate")})


@query(f"""
SELECT c_mktsegment, {r("avg(c_acctbal)")} AS c_acctbal_mean, {r("sum(o_totalprice)", 2)} AS o_totalprice_sum,
  count(o_orderkey) AS o_orderkey_count, max(o_totalprice) AS o_totalprice_max, {r("median(o_totalprice)")} AS o_totalprice_median
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def join_then_aggregate(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    result = hospital.join_then_aggregate(
        orders, table(spark, d, "customer"), "c_custkey", ["c_mktsegment"],
        {"c_acctbal": "mean", "o_totalprice": ["sum", "max", "median"], "o_orderkey": "count"},
    )
    return result.withColumns({
        "c_acctbal_mean": round_half_even(F.col("c_acctbal_mean"), 4),
        "o_totalprice_sum": round_half_even(F.col("o_totalprice_sum"), 2),
        "o_totalprice_median": round_half_even(F.col("o_totalprice_median"), 4),
    })


@query("SELECT a.appointment_id, b.row_id FROM fx_appointments a JOIN (SELECT row_id, CASE WHEN patient_id % 9 = 0 THEN NULL ELSE patient_id END AS doctor_id FROM fx_scores) b "
       "ON (CASE WHEN a.doctor_id = 0 THEN NULL ELSE a.doctor_id END) IS NOT DISTINCT FROM b.doctor_id AND a.appointment_id = b.row_id",
       ("fx_appointments", "fx_scores"))
def join_null_safe(spark, d):
    left = view(spark, d, "fx_appointments").select(
        "appointment_id", F.when(F.col("doctor_id") != 0, F.col("doctor_id")).alias("doctor_id"),
        F.col("appointment_id").alias("key"),
    )
    right = view(spark, d, "fx_scores").select(
        "row_id", F.when(F.col("patient_id") % 9 != 0, F.col("patient_id")).alias("doctor_id"), F.col("row_id").alias("key"),
    )
    return hospital.join_inner(left, right, ["doctor_id", "key"], null_safe=True).select("appointment_id", "row_id")


@query("\nUNION ALL\n".join(
    [f"SELECT '{n.removeprefix('fx_')}' AS \"table\", count(*) AS rows, {w} AS columns FROM {n}"
     for n, w in zip(STAR, (7, 4, 5, 4, 3))]), STAR)
def table_shapes(spark, d):
    return hospital.table_shapes(star(spark, d))


@query(_MERGED + "SELECT median(total_billed) AS billed_median, quantile_cont(total_billed, 0.75) AS billed_q75 FROM merged", STAR)
def billed_quantiles(spark, d):
    billed = F.col("total_billed")
    found, _ = profile(merged(spark, d), {"median": (billed, 0.5), "q75": (billed, 0.75)}, {})
    row = (found["median"], found["q75"])
    return spark.createDataFrame([row], "billed_median double, billed_q75 double")
