"""Hospital-shaped views over the test tables.

Each view is a list of expressions over one table that Spark SQL and DuckDB read
alike, so the same text builds the Spark input and the oracle's ``WITH`` clause.
Views cover whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, str]] = {
    "fx_encounters": ("lineitem", """
        l_orderkey AS encounter_id, l_suppkey AS patient_nbr,
        CASE l_partkey % 5 WHEN 0 THEN '?' WHEN 1 THEN 'Caucasian' WHEN 2 THEN 'AfricanAmerican' WHEN 3 THEN 'Asian' ELSE 'Other' END AS race,
        CASE l_suppkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE NULL END AS gender,
        concat('[', cast((l_partkey % 10) * 10 AS string), '-', cast((l_partkey % 10) * 10 + 10 AS string), ')') AS age,
        '?' AS weight, '?' AS payer_code, '?' AS ndc_code, 1 AS admission_type_id, 7 AS admission_source_id,
        CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE cast(1 + l_orderkey % 25 AS int) END AS discharge_disposition_id,
        cast(1 + (l_partkey + l_linenumber) % 14 AS int) AS time_in_hospital,
        CASE l_suppkey % 4 WHEN 0 THEN '?' WHEN 1 THEN 'Cardiology' WHEN 2 THEN 'InternalMedicine' ELSE 'Surgery-General' END AS medical_specialty,
        CASE l_partkey % 14 WHEN 0 THEN '?' WHEN 1 THEN 'V57' WHEN 2 THEN 'E885' WHEN 3 THEN '428' WHEN 4 THEN '250.83' WHEN 5 THEN '786' WHEN 6 THEN '787' WHEN 7 THEN '820' WHEN 8 THEN '715' WHEN 9 THEN '599' WHEN 10 THEN '162' WHEN 11 THEN '428d' WHEN 12 THEN '459.5' ELSE '491' END AS primary_diagnosis_code,
        '401|272' AS other_diagnosis_codes,
        cast(l_suppkey % 4 AS int) AS number_outpatient, cast(l_orderkey % 4 AS int) AS number_inpatient,
        cast(l_partkey % 5 AS int) AS number_emergency, cast(1 + l_partkey % 97 AS int) AS num_lab_procedures,
        cast(l_partkey % 7 AS int) AS num_procedures, cast(1 + cast(l_quantity AS int) % 30 AS int) AS num_medications,
        cast(1 + l_orderkey % 16 AS int) AS number_diagnoses,
        CASE l_partkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Norm' WHEN 2 THEN '>200' ELSE '>300' END AS max_glu_serum,
        CASE l_orderkey % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'Norm' WHEN 2 THEN '>7' WHEN 3 THEN '>8' ELSE NULL END AS A1Cresult,
        CASE WHEN l_linestatus = 'O' THEN 'Ch' ELSE 'No' END AS change,
        CASE l_returnflag WHEN 'N' THEN 'NO' WHEN 'A' THEN '<30' ELSE '>30' END AS readmitted,
        l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"""),
    "fx_appointments": ("orders", """
        o_orderkey AS appointment_id, o_custkey AS patient_id, o_orderkey % 13 AS doctor_id,
        CASE WHEN o_orderkey % 41 = 0 THEN 'not a date' ELSE substr(cast(o_orderdate AS string), 1, 10) END AS appointment_date,
        '09:00' AS appointment_time, 'Checkup' AS reason_for_visit,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'No-show' WHEN '2-HIGH' THEN 'Cancelled' WHEN '3-MEDIUM' THEN 'Scheduled' ELSE 'Completed' END AS status"""),
    "fx_doctors": ("supplier", """
        s_suppkey AS doctor_id,
        CASE s_suppkey % 5 WHEN 0 THEN 'Cardiology' WHEN 1 THEN 'Dermatology' WHEN 2 THEN 'Nephrology' WHEN 3 THEN 'Pediatrics' ELSE 'Oncology' END AS specialization,
        cast(1 + s_suppkey * 2 % 15 AS int) AS years_experience,
        CASE s_nationkey % 3 WHEN 0 THEN 'Central' WHEN 1 THEN 'East' ELSE 'West' END AS hospital_branch"""),
    # Some patients and bills have a key that nothing matches, so that joins see missing sides.
    "fx_patients": ("customer", """
        CASE WHEN c_custkey % 50 = 0 THEN -c_custkey ELSE c_custkey END AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
        concat(cast(1930 + c_custkey % 80 AS string), '-0', cast(1 + c_custkey % 9 AS string), '-1', cast(c_custkey % 10 AS string)) AS date_of_birth,
        c_mktsegment AS insurance_provider, '2020-01-01' AS registration_date"""),
    "fx_billing": ("orders", """
        CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS patient_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS amount,
        CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Paid' ELSE 'Failed' END AS payment_status,
        CASE o_orderpriority WHEN '5-LOW' THEN 'Insurance' WHEN '3-MEDIUM' THEN 'Cash' ELSE 'Credit Card' END AS payment_method"""),
    "fx_treatments": ("lineitem", """
        l_orderkey * 10 + l_linenumber AS treatment_id, l_orderkey AS appointment_id, l_extendedprice AS cost"""),
    "fx_scores": ("events", """
        event_id AS row_id, user_id AS patient_id, ts AS scored_at,
        cast((event_id * 7919 + user_id * 104729) % 1001 AS double) / 1000.0 AS p,
        CASE WHEN (event_id * 7919 + user_id * 104729) % 1001 + event_id * 31 % 400 > 700 THEN 1 ELSE 0 END AS label,
        CASE WHEN event_type = 'error' THEN NULL ELSE concat('team', cast(user_id % 3 AS string), '@example.org') END AS notify_email"""),
    "fx_outcomes": ("events", """
        concat('P', cast(user_id AS string)) AS patient_id,
        cast((event_id * 7919 + user_id * 104729) % 1001 AS double) / 1000.0 AS predicted_risk,
        CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS actually_readmitted,
        ts AS recorded_at, '' AS notes"""),
    "fx_care_inputs": ("events", """
        event_id AS patient_id,
        CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS risk_level,
        CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS cardiac_primary,
        CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS diabetes_primary,
        CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS is_elderly,
        cast(20 + event_id % 75 AS int) AS age_numeric, cast(event_id % 2 AS int) AS mental_health_flag,
        cast(event_id % 4 AS int) AS social_isolation_score, cast(event_id % 3 AS int) AS medication_noncompliance_risk"""),
    "fx_annotations": ("events", """
        event_id AS patient_id, cast(event_id % 40 AS double) / 2.0 AS complexity_score,
        CASE WHEN event_id % 11 = 0 THEN 'no json here'
             ELSE concat('{"social_isolation_score": ', cast(event_id % 4 AS string), ', "mental_health_flag": ', cast(event_id % 2 AS string),
                         ', "overall_psychosocial_risk": ', cast(event_id % 11 AS string), '}') END AS annotation_json"""),
    "fx_metrics": ("events", """
        event_id AS retrain_id, ts AS retrained_at"""),
}


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    return f"SELECT {columns} FROM {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    source = VIEWS[name][0].split()[0]
    table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(view_sql(name))


def with_views(query: str, *names: str) -> str:
    """The oracle text: the named views as common table expressions before a query.

    ``query`` may begin with common table expressions of its own, without WITH.
    """
    ctes = ",\n".join(f"{name} AS ({view_sql(name)})" for name in names)
    text = query.strip()
    return f"WITH {ctes}\n{text}" if text.upper().startswith("SELECT") else f"WITH {ctes},\n{text}"
