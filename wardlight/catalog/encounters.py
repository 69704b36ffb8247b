"""Queries over encounters."""

from pyspark.sql import functions as F

from wardlight.catalog.registry import flag, query, r
from wardlight.catalog.views import table, view
from wardlight.functions import fixed
from wardlight.functions.scalars import round_half_even
from wardlight.operators import cleaning, encounters, intake
from wardlight.operators.ordering import exact_quantile
from wardlight.plans.jobs import encounter_job
from wardlight.session import materialise, scratch_path
from wardlight.sources import readers

ENC = ("fx_encounters",)
TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
ORDER = [*TIES, "change", "readmitted"]
COUNTS = ["number_outpatient", "number_inpatient", "number_emergency", "num_lab_procedures", "num_procedures",
          "num_medications", "number_diagnoses", "time_in_hospital"]

# -- the oracle's side ---------------------------------------------------------

_CLEAN = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY {', '.join(ORDER)}) AS rn FROM fx_encounters),
clean AS (
  SELECT encounter_id, patient_nbr, nullif(race, '?') AS race, gender, age, admission_type_id, admission_source_id,
    discharge_disposition_id, time_in_hospital, nullif(medical_specialty, '?') AS medical_specialty,
    nullif(primary_diagnosis_code, '?') AS primary_diagnosis_code, other_diagnosis_codes, number_outpatient, number_inpatient,
    number_emergency, num_lab_procedures, num_procedures, num_medications, number_diagnoses, max_glu_serum, A1Cresult, change,
    CASE WHEN readmitted = 'NO' THEN 0 ELSE 1 END AS readmitted_30d
  FROM ranked WHERE rn = 1)
"""
_AGE = "try_cast(regexp_extract(age, '^.(\\d+)-', 1) AS INTEGER) + 5"
_AGE_COLUMNS = f"""
    {_AGE} AS age_numeric, {flag(_AGE + ' >= 65')} AS is_elderly,
    CASE WHEN {_AGE} <= 30 THEN '<30' WHEN {_AGE} <= 50 THEN '30-50' WHEN {_AGE} <= 65 THEN '50-65' WHEN {_AGE} <= 80 THEN '65-80'
      WHEN {_AGE} <= 100 THEN '80+' END AS age_group"""
_VISITS = "number_outpatient + number_inpatient + number_emergency"
_USE_COLUMNS = f"""
    {_VISITS} AS total_prior_visits,
    {flag(f'{_VISITS} >= (SELECT quantile_cont({_VISITS}, 0.75) FROM clean)')} AS high_utiliser,
    {flag('number_emergency >= 2')} AS emergency_prone, {flag('number_inpatient >= 1')} AS has_inpatient_history"""
_COMPLEXITY = r("number_diagnoses + num_medications * 0.5::DOUBLE + num_lab_procedures * 0.2::DOUBLE", 2)
_CLINICAL_COLUMNS = f"""
    {flag('num_medications >= 5')} AS polypharmacy, {flag('number_diagnoses >= 5')} AS high_diagnosis_burden,
    {flag('num_lab_procedures > (SELECT median(num_lab_procedures) FROM clean)')} AS high_lab_use,
    {flag('num_procedures > 0')} AS had_procedures, {_COMPLEXITY} AS complexity_score"""
_GLU = "(CASE max_glu_serum WHEN 'Norm' THEN 1 WHEN '>200' THEN 2 WHEN '>300' THEN 3 ELSE 0 END)"
_A1C = "(CASE A1Cresult WHEN 'Norm' THEN 1 WHEN '>7' THEN 2 WHEN '>8' THEN 3 ELSE 0 END)"
_METABOLIC_COLUMNS = f"""
    {_GLU} AS glu_serum_num, {_A1C} AS a1c_num, {_GLU} + {_A1C} AS metabolic_risk, {flag(f'{_GLU} + {_A1C} >= 4')} AS uncontrolled_diabetes"""
_HIGH_RISK_DISCHARGE = flag("discharge_disposition_id IN (2, 3, 4, 5, 6, 8, 9, 15, 16, 17)") + " AS high_risk_discharge"
_STAYS = "(discharge_disposition_id IS NULL OR discharge_disposition_id NOT IN (11, 13, 14, 19, 20, 21))"
_C = "try_cast(primary_diagnosis_code AS DOUBLE)"
_CATEGORY = f"""CASE WHEN primary_diagnosis_code IS NULL THEN 'Unknown'
      WHEN primary_diagnosis_code LIKE 'V%' OR primary_diagnosis_code LIKE 'E%' THEN 'External'
      WHEN {_C} IS NULL THEN 'Unknown'
      WHEN {_C} BETWEEN 390 AND 459 OR {_C} = 785 THEN 'Circulatory'
      WHEN {_C} BETWEEN 460 AND 519 OR {_C} = 786 THEN 'Respiratory'
      WHEN {_C} BETWEEN 520 AND 579 OR {_C} = 787 THEN 'Digestive'
      WHEN {_C} BETWEEN 250 AND 250.99 THEN 'Diabetes'
      WHEN {_C} BETWEEN 800 AND 999 THEN 'Injury'
      WHEN {_C} BETWEEN 710 AND 739 THEN 'Musculoskeletal'
      WHEN {_C} BETWEEN 580 AND 629 OR {_C} = 788 THEN 'Genitourinary'
      WHEN {_C} BETWEEN 140 AND 239 THEN 'Neoplasms' ELSE 'Other' END"""
_STEPS = _CLEAN + f""",
steps AS (
  SELECT *, {_AGE_COLUMNS}, {_USE_COLUMNS}, {_CLINICAL_COLUMNS}, {_METABOLIC_COLUMNS}, {_HIGH_RISK_DISCHARGE},
    {_CATEGORY} AS primary_diag_category
  FROM clean),
stayed AS (SELECT * FROM steps WHERE {_STAYS})
"""
_INTERACTIONS = """time_in_hospital * number_diagnoses AS los_x_diagnoses, is_elderly * complexity_score AS elderly_x_complex,
    number_inpatient * number_emergency AS inpatient_x_emergency, num_medications * time_in_hospital AS meds_x_los"""
_ONE_HOT = {
    "race": ["Asian", "Caucasian", "Other"],
    "medical_specialty": ["InternalMedicine", "Surgery-General"],
    "primary_diag_category": ["Diabetes", "Digestive", "External", "Genitourinary", "Injury", "Musculoskeletal", "Neoplasms",
                              "Other", "Respiratory", "Unknown"],
    "age_group": ["30-50", "50-65", "65-80", "80+"],
}
_ONE_HOT_COLUMNS = ", ".join(f"{flag(f'{c} = ' + repr(v))} AS \"{c}_{v}\"" for c, values in _ONE_HOT.items() for v in values)

# -- the Spark side ------------------------------------------------------------


def raw(spark, d):
    return view(spark, d, "fx_encounters")


def cleaned(spark, d):
    return encounters.clean_encounters(encounters.encode_target(raw(spark, d)), ORDER).drop(*TIES)


def kept(spark, d, *columns):
    """Cleaned encounters, written once for queries that learn figures from them first; with ``columns`` only these travel."""
    rows = cleaned(spark, d)
    return materialise(rows.select(*columns) if columns else rows, "cleaned-encounters")


def features_table(spark, d, keep_ids=True):
    """Feature table with ids, as the training and scoring queries use it."""
    table, stats = encounter_job(raw(spark, d), order=ORDER, keep_ids=keep_ids)
    return table.drop(*TIES), stats


@query(_CLEAN + "SELECT * FROM clean", ENC)
def clean_encounters(spark, d):
    return cleaned(spark, d)


@query("SELECT CASE WHEN readmitted = 'NO' THEN 0 ELSE 1 END AS readmitted_30d, count(*) AS rows FROM fx_encounters GROUP BY 1", ENC)
def label_distribution(spark, d):
    return encounters.label_distribution(encounters.encode_target(raw(spark, d)))


@query(f"""SELECT {r("avg(CASE WHEN readmitted = 'NO' THEN 0 ELSE 1 END)")} AS positive_rate,
  {r("avg(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END)")} AS within_30_rate FROM fx_encounters""", ENC)
def positive_rate(spark, d):
    both = encounters.encode_target(raw(spark, d)).select(
        "readmitted_30d", encounters.readmission_label(F.col("readmitted"), "lt30").alias("within_30")
    )
    return both.agg(
        round_half_even(F.avg("readmitted_30d"), 4).alias("positive_rate"),
        round_half_even(F.avg("within_30"), 4).alias("within_30_rate"),
    )


@query(_CLEAN + f"SELECT encounter_id, {_AGE_COLUMNS} FROM clean", ENC)
def age_features(spark, d):
    return encounters.age_features(cleaned(spark, d)).select("encounter_id", "age_numeric", "is_elderly", "age_group")


@query(_CLEAN + f"SELECT encounter_id, {_USE_COLUMNS} FROM clean", ENC)
def utilisation(spark, d):
    rows = kept(spark, d, "encounter_id", "number_outpatient", "number_inpatient", "number_emergency")
    high = exact_quantile(rows.withColumn("visits", encounters.prior_visits()), "visits", encounters.HIGH_UTILISER_QUANTILE)
    return encounters.utilisation_features(rows, high).select(
        "encounter_id", "total_prior_visits", "high_utiliser", "emergency_prone", "has_inpatient_history"
    )


@query(_CLEAN + f"SELECT encounter_id, {_CLINICAL_COLUMNS} FROM clean", ENC)
def clinical(spark, d):
    rows = kept(spark, d, "encounter_id", *COUNTS)
    return encounters.clinical_features(rows, exact_quantile(rows, "num_lab_procedures", 0.5)).select(
        "encounter_id", "polypharmacy", "high_diagnosis_burden", "high_lab_use", "had_procedures", "complexity_score"
    )


@query(_CLEAN + f"SELECT encounter_id, {_METABOLIC_COLUMNS} FROM clean", ENC)
def metabolic(spark, d):
    return encounters.glucose_features(cleaned(spark, d)).select(
        "encounter_id", "glu_serum_num", "a1c_num", "metabolic_risk", "uncontrolled_diabetes"
    )


@query(_CLEAN + f"SELECT encounter_id, discharge_disposition_id, {_HIGH_RISK_DISCHARGE} FROM clean WHERE {_STAYS}", ENC)
def discharge(spark, d):
    return encounters.discharge_features(cleaned(spark, d)).select(
        "encounter_id", "discharge_disposition_id", "high_risk_discharge"
    )


@query(_CLEAN + f""", named AS (SELECT encounter_id, {_CATEGORY} AS primary_diag_category FROM clean)
SELECT *, {flag("primary_diag_category = 'Diabetes'")} AS diabetes_primary, {flag("primary_diag_category = 'Circulatory'")} AS cardiac_primary
FROM named""", ENC)
def diagnosis(spark, d):
    return encounters.diagnosis_features(cleaned(spark, d)).select(
        "encounter_id", "primary_diag_category", "diabetes_primary", "cardiac_primary"
    )


@query(_STEPS + f"SELECT encounter_id, {_INTERACTIONS} FROM steps", ENC)
def interactions(spark, d):
    rows = kept(spark, d, "encounter_id", "age", *COUNTS)
    median = exact_quantile(rows, "num_lab_procedures", 0.5)
    aged = encounters.clinical_features(encounters.age_features(rows), median)
    return encounters.interaction_features(aged).select(
        "encounter_id", "los_x_diagnoses", "elderly_x_complex", "inpatient_x_emergency", "meds_x_los"
    )


@query(_STEPS + f"""SELECT encounter_id, patient_nbr, admission_type_id, admission_source_id, discharge_disposition_id, readmitted_30d,
  {', '.join(COUNTS)}, age_numeric, is_elderly, total_prior_visits, high_utiliser, emergency_prone, has_inpatient_history,
  polypharmacy, high_diagnosis_burden, high_lab_use, had_procedures, complexity_score, glu_serum_num, a1c_num, metabolic_risk,
  uncontrolled_diabetes, high_risk_discharge, {flag("primary_diag_category = 'Diabetes'")} AS diabetes_primary,
  {flag("primary_diag_category = 'Circulatory'")} AS cardiac_primary, {_INTERACTIONS},
  {flag("gender = 'Male'")} AS gender_male, {flag("change = 'Ch'")} AS medication_changed, {_ONE_HOT_COLUMNS}
FROM stayed""", ENC)
def encounter_pipeline(spark, d):
    return features_table(spark, d)[0]


@query(_CLEAN + """SELECT quantile_cont(number_outpatient + number_inpatient + number_emergency, 0.75)::DOUBLE AS visits_q75,
  median(num_lab_procedures)::DOUBLE AS labs_median, 4 AS race_levels, 3 AS specialty_levels,
  (SELECT count(DISTINCT """ + _CATEGORY + f""") FROM clean WHERE {_STAYS})::INTEGER AS diagnosis_levels FROM clean""", ENC)
def encounter_stats(spark, d):
    stats = encounters.fit_encounters(cleaned(spark, d))
    sizes = [len(stats.levels[c]) for c in ("race", "medical_specialty", "primary_diag_category")]
    return spark.createDataFrame(
        [(stats.visits_high, stats.labs_median, *sizes)],
        "visits_q75 double, labs_median double, race_levels int, specialty_levels int, diagnosis_levels int",
    )


# -- intake forms and the feature contract -------------------------------------


def _intake_sql(visits: str) -> str:
    age = _AGE
    burden = "(number_diagnoses + num_medications * 0.5::DOUBLE)"
    return _CLEAN + f"""SELECT encounter_id, {visits} AS total_prior_visits, {flag(age + ' >= 65')} AS is_elderly,
  {flag('num_medications >= 5')} AS polypharmacy, {_COMPLEXITY} AS complexity_score,
  time_in_hospital * number_diagnoses AS los_x_diagnoses, num_medications * time_in_hospital AS meds_x_los,
  {flag(age + ' >= 65')} * {burden} AS elderly_x_complex, number_inpatient * number_emergency AS inpatient_x_emergency,
  {flag('number_diagnoses >= 5')} AS high_diagnosis_burden, {flag('num_lab_procedures > 40')} AS high_lab_use,
  {flag('num_procedures > 0')} AS had_procedures, {flag('number_inpatient >= 1')} AS has_inpatient_history,
  {flag('number_emergency >= 2')} AS emergency_prone, {flag(visits + ' >= 3')} AS high_utiliser FROM clean"""


def _intake(spark, d, include_outpatient):
    form = cleaned(spark, d).select(
        "encounter_id", encounters.age_midpoint(F.col("age")).alias("age_numeric"), *COUNTS
    )
    return intake.intake_features(form, include_outpatient).drop("age_numeric", *COUNTS)


@query(_intake_sql("number_inpatient + number_emergency + number_outpatient"), ENC)
def intake_features(spark, d):
    return _intake(spark, d, True)


@query(_intake_sql("number_inpatient + number_emergency"), ENC)
def intake_features_web(spark, d):
    return _intake(spark, d, False)


_NUMBER_SQL = "try_cast(primary_diagnosis_code AS DOUBLE)"


@query(f"""SELECT l_partkey * 1000 + l_linenumber AS key, l_suppkey AS owner, time_in_hospital::DOUBLE AS time_in_hospital,
  coalesce({_NUMBER_SQL}, 0) AS primary_diagnosis_code, 0.0::DOUBLE AS never_seen,
  coalesce(discharge_disposition_id, 0)::DOUBLE AS discharge_disposition_id,
  (CASE WHEN change = 'Ch' THEN 1 ELSE 0 END)::DOUBLE AS changed FROM fx_encounters""", ENC)
def align_and_coerce(spark, d):
    rows = raw(spark, d).select(
        (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("key"), F.col("l_suppkey").alias("owner"),
        "time_in_hospital", "primary_diagnosis_code", "discharge_disposition_id", (F.col("change") == "Ch").alias("changed"),
        "race",
    )
    contract = ["time_in_hospital", "primary_diagnosis_code", "never_seen", "discharge_disposition_id", "changed"]
    return cleaning.align_to_contract(rows, contract, keep=["key", "owner"])


@query("""SELECT o_orderkey, coalesce(try_cast(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderkey % 17 AS VARCHAR) END AS DOUBLE), 0) AS visits,
  o_totalprice AS cost, 0.0::DOUBLE AS status, 0.0::DOUBLE AS age_numeric FROM orders""")
def align_sparse_requests(spark, d):
    requests = table(spark, d, "orders").select("o_orderkey", F.map_filter(
        F.create_map(
            F.lit("visits"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 17).cast("string")),
            F.lit("cost"), F.col("o_totalprice").cast("string"),
            F.lit("status"), F.col("o_orderstatus"),
            F.lit("unknown_key"), F.lit("1"),
        ), lambda k, v: v.isNotNull()).alias("patient_data"))
    return cleaning.align_map(requests, "patient_data", ["visits", "cost", "status", "age_numeric"], keep=["o_orderkey"])


@query("SELECT encounter_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, discharge_disposition_id FROM fx_encounters "
       f"WHERE {_STAYS}", ENC)
def exclude_dispositions(spark, d):
    return cleaning.exclude_dispositions(raw(spark, d)).select(
        "encounter_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "discharge_disposition_id"
    )


# -- files ---------------------------------------------------------------------


@query("""SELECT CASE WHEN max_glu_serum = 'None' THEN NULL ELSE max_glu_serum END AS max_glu_serum,
  CASE WHEN A1Cresult = 'None' THEN NULL ELSE A1Cresult END AS A1Cresult, count(*) AS rows, count(discharge_disposition_id) AS dispositions,
  sum(num_medications)::BIGINT AS medications FROM fx_encounters GROUP BY 1, 2""", ENC)
def encounters_from_csv(spark, d):
    """Encounters written as CSV text and read back with their schema."""
    path = scratch_path(spark, "encounters-csv")
    raw(spark, d).drop(*TIES).write.option("header", True).csv(path)
    return readers.read_encounters(spark, path).groupBy("max_glu_serum", "A1Cresult").agg(
        F.count("*").alias("rows"), F.count("discharge_disposition_id").alias("dispositions"),
        F.sum("num_medications").alias("medications"),
    )
