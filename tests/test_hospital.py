from datetime import date

import pytest
from pyspark.sql import functions as F

from wardlight.operators import hospital as h
from wardlight.plans.jobs import hospital_job


@pytest.fixture
def star(spark):
    make = spark.createDataFrame
    return {
        "appointments": make([
            ("A1", "P1", "D1", "2023-06-03", "09:00", "x", "No-show"), ("A2", "P2", "D9", "garbage", "09:00", "x", "Cancelled"),
            ("A3", None, "D1", "2023-06-05", "09:00", "x", None), ("A4", "P1", None, "2023-06-05", "09:00", "x", "Scheduled")],
            "appointment_id string, patient_id string, doctor_id string, appointment_date string, appointment_time string, reason_for_visit string, status string"),
        "doctors": make([("D1", "Cardiology", 4, "East", "extra")], "doctor_id string, specialization string, years_experience int, hospital_branch string, email string"),
        "patients": make([("P1", "Male", "1958-12-31", "Acme", "2020-01-01")],
                         "patient_id string, gender string, date_of_birth string, insurance_provider string, registration_date string"),
        "billing": make([("P1", 100.0, "Pending", "Insurance"), ("P1", None, "Paid", "Insurance"), ("P1", 50.0, None, None),
                         ("P2", None, "Paid", "Cash"), (None, 9.0, "Paid", "Cash")],
                        "patient_id string, amount double, payment_status string, payment_method string"),
        "treatments": make([("T1", "A1", 10.0), ("T2", "A1", 5.5), (None, "A2", None)], "treatment_id string, appointment_id string, cost double"),
    }


def merged(star):
    return h.merge_hospital(*[star[n] for n in ("appointments", "doctors", "patients", "billing", "treatments")])


def test_billing_counts_and_sums_like_a_frame(star):
    got = {r["patient_id"]: tuple(r)[1:] for r in h.billing_per_patient(star["billing"]).collect()}
    assert got == {"P1": (150.0, 75.0, 2, 1, 2), "P2": (0.0, None, 0, 0, 0)}


def test_treatments(star):
    got = {r["appointment_id"]: tuple(r)[1:] for r in h.treatments_per_appointment(star["treatments"]).collect()}
    assert got == {"A1": (2, 15.5), "A2": (0, 0.0)}


def test_merge_keeps_every_appointment(star):
    rows = {r["appointment_id"]: r for r in merged(star).collect()}
    assert len(rows) == 4 and "email" not in merged(star).columns
    assert rows["A1"]["specialization"] == "Cardiology" and rows["A1"]["total_billed"] == 150.0
    # P2 has bills but no patient record.
    assert rows["A2"]["gender"] is None and rows["A2"]["total_billed"] == 0.0 and rows["A2"]["num_treatments"] == 0
    assert rows["A3"]["total_billed"] is None and rows["A4"]["specialization"] is None


def test_features(star):
    rows = {r["appointment_id"]: r for r in h.hospital_features(merged(star), 100.0).collect()}
    a1, a2, a3 = rows["A1"], rows["A2"], rows["A3"]
    assert (a1["appt_month"], a1["appt_day_of_week"], a1["appt_is_weekend"]) == (6, 5, 1)
    assert (a1["patient_age"], a1["is_elderly"], a1["is_noshow"], a1["appointment_risk"]) == (65.0, 1, 1, 1)
    assert (a1["junior_doctor"], a1["senior_doctor"], a1["has_unpaid_bills"], a1["high_bill_amount"]) == (1, 0, 1, 1)
    assert (a1["insurance_dependent"], a1["bill_per_treatment"], a1["gender_male"], a1["high_risk_specialty"]) == (1, 50.0, 1, 1)
    assert a2["appointment_date"] is None and a2["appt_is_weekend"] == 0 and a2["insurance_dependent"] == 1
    assert a3["high_bill_amount"] == 0 and a3["bill_per_treatment"] is None and a3["insurance_dependent"] == 0
    assert a3["appointment_date"] == date(2023, 6, 5)


def test_median_is_over_appointments(star):
    # Appointment rows with a known total: P1 twice (150), P2 once (0).
    assert h.billed_median(merged(star)) == 150.0
    assert h.billed_median(merged(star), exact=False) == 150.0


def test_job_is_all_numbers_but_the_patient(star, tmp_path):
    final = hospital_job(star, str(tmp_path / "final"))
    kinds = dict(final.dtypes)
    assert kinds.pop("patient_id") == "string" and set(kinds.values()) <= {"int", "bigint", "double"}
    assert final.count() == 4
    assert final.where("bill_per_treatment IS NULL").count() == 0


def test_job_options_and_nothing_left_behind(spark, star, tmp_path):
    import os

    from wardlight.session import shared_dir

    before = set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()
    other = {**star, "appointments": star["appointments"].withColumn("appointment_date", F.date_format(F.col("appointment_date").try_cast("date"), "dd/MM/yyyy"))}
    final = hospital_job(other, str(tmp_path / "final"), date_format="dd/MM/yyyy", exact=False)
    assert final.agg(F.max("appt_month")).first()[0] > 0
    assert hospital_job(other, str(tmp_path / "iso")).agg(F.max("appt_month")).first()[0] == 0
    with pytest.raises(ValueError):
        hospital_job(star, str(tmp_path / "none"), max_levels=0)
    assert set(os.listdir(shared_dir(spark))) == before


def test_summary(star):
    row = h.hospital_summary(h.hospital_features(merged(star), 0.0)).first()
    assert row["total_patients"] == 2 and row["noshow_rate"] == 0.25
    assert h.hospital_summary(h.hospital_features(merged(star), 0.0), exact=False).first()["total_patients"] == 2


def test_generic_join_and_aggregate(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (None, 30)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (None, "b")], "k int, g string")
    assert h.join_inner(left, right, "k").count() == 2
    assert h.join_inner(left, right, "k", null_safe=True).count() == 3
    got = h.join_then_aggregate(left, right, "k", ["g"], {"v": ["mean", "sum"]}).first()
    assert (got["g"], got["v_mean"], got["v_sum"]) == ("a", 15.0, 30)
    assert h.aggregate_by(left, ["k"], {"v": "sum"}).count() == 1
    assert tuple(h.aggregate_by(left, ["k"], {"v": ["median", "nunique"]}).first()) == (1, 15.0, 2)
    assert tuple(h.aggregate_by(left, ["k"], {"v": "median"}).first()) == (1, 15.0)
    with pytest.raises(ValueError):
        h.aggregate_by(left, ["k"], {"v": "nope"})


def test_a_patient_with_a_third_of_all_appointments_is_split(spark):
    """The join on patient_id is one Spark can split when a patient is hot."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    n = 30_000
    ids = F.col("id")
    appointments = spark.range(0, n, 1, 8).select(
        ids.alias("appointment_id"), F.when(ids < n // 3, 0).otherwise(ids).alias("patient_id"), (ids % 5).alias("doctor_id"),
        F.lit("2024-01-01").alias("appointment_date"), F.sha2(ids.cast("string"), 256).alias("reason_for_visit"), F.lit("x").alias("status"))
    doctors = spark.range(5).select(ids.alias("doctor_id"), F.lit("s").alias("specialization"), F.lit(1).alias("years_experience"), F.lit("b").alias("hospital_branch"))
    patients = spark.range(n).select(ids.alias("patient_id"), F.lit("Male").alias("gender"), F.lit("1950-01-01").alias("date_of_birth"),
                                     F.lit("i").alias("insurance_provider"), F.lit("2020-01-01").alias("registration_date"))
    billing = spark.range(n).select((ids % 100).alias("patient_id"), F.lit(1.0).alias("amount"), F.lit("Paid").alias("payment_status"), F.lit("Cash").alias("payment_method"))
    treatments = spark.range(n).select(ids.alias("treatment_id"), ids.alias("appointment_id"), F.lit(2.0).alias("cost"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        result = h.merge_hospital(appointments, doctors, patients, billing, treatments)
        assert len(result.collect()) == n
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
