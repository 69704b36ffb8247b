"""Queries over scores, evaluation, care plans, notes, FHIR records and feedback."""

import pandas as pd
from pyspark.sql import functions as F

from wardlight.catalog.registry import flag, query, r
from wardlight.catalog.views import table, view
from wardlight.functions import fixed
from wardlight.functions.scalars import round_half_even
from wardlight.operators import cleaning, evaluation, fhir, notes, pathways, scoring
from wardlight.session import scratch_path
from wardlight.sources import schemas
from wardlight.sources.readers import read_fhir
from wardlight.streaming import feedback

SCORES = ("fx_scores",)
ASOF = "2024-06-30"

_BAND = "CASE WHEN p >= 0.6 THEN 'High' WHEN p >= 0.3 THEN 'Medium' ELSE 'Low' END"
_CUT = "CASE WHEN p <= 0 OR p > 1 THEN NULL WHEN p <= 0.3 THEN 'Low' WHEN p <= 0.6 THEN 'Medium' ELSE 'High' END"
_PERCENT = "printf('%.1f%%', " + r("p * 100", 1) + ")"


def scores(spark, d):
    return view(spark, d, "fx_scores")


def _text(items) -> str:
    return "'" + " | ".join(items).replace("'", "''") + "'"


_ADVICE = "CASE " + " ".join(
    f"WHEN p >= {low} THEN {_text(fixed.RECOMMENDATIONS[b])}" for b, low in (("High", 0.6), ("Medium", 0.3), ("Low", 0))
) + " END"


@query(f"""SELECT row_id, {r('p')} AS readmission_probability, {_PERCENT} AS readmission_percentage, p >= 0.369 AS predicted_readmission,
  {_BAND} AS risk_level, {_ADVICE} AS recommendations, {flag('p >= 0.369')} AS decision, {_CUT} AS risk_level_cut FROM fx_scores""", SCORES)
def risk_bands(spark, d):
    p = F.col("p")
    _, decision, cut = scoring.prediction_columns(p)
    return scores(spark, d).select(
        "row_id", *scoring.response_columns(p, advice=True), decision.alias("decision"), cut.alias("risk_level_cut")
    ).withColumn("recommendations", F.array_join("recommendations", " | "))


@query("SELECT row_id, p FROM fx_scores WHERE p >= 0.369", SCORES)
def above_threshold(spark, d):
    return cleaning.at_or_above(scores(spark, d), "p").select("row_id", "p")


@query(f"""banded AS (SELECT {_CUT} AS risk_level FROM fx_scores)
SELECT count(*) AS total_patients, """ + ", ".join(
    f"count(*) FILTER (WHERE risk_level = '{b}') AS {b.lower()}_risk, {r(f'avg(' + flag(f'risk_level = {chr(39)}{b}{chr(39)}') + ')')} AS {b.lower()}_share"
    for b in fixed.BANDS) + " FROM banded", SCORES)
def band_summary(spark, d):
    predictions = scores(spark, d).select(*scoring.prediction_columns(F.col("p")))
    summary = scoring.band_summary(predictions)
    return summary.withColumns({f"{b.lower()}_share": round_half_even(F.col(f"{b.lower()}_share"), 4) for b in fixed.BANDS})


@query(f"""SELECT count(p) AS total_scored, count(*) FILTER (WHERE p >= 0.6) AS high_risk, count(*) FILTER (WHERE p >= 0.3 AND p < 0.6) AS medium_risk,
  count(*) FILTER (WHERE p < 0.3) AS low_risk, {r('avg(p)')} AS avg_risk FROM fx_scores""", SCORES)
def daily_summary(spark, d):
    return scoring.daily_summary(scores(spark, d))


@query(f"""SELECT b.risk_level, count(s.risk_level) AS patients FROM (VALUES ('High'), ('Medium'), ('Low')) b(risk_level)
LEFT JOIN (SELECT {_BAND} AS risk_level FROM fx_scores) s USING (risk_level) GROUP BY b.risk_level""", SCORES)
def band_counts(spark, d):
    return scoring.band_counts(scores(spark, d))


@query(f"""SELECT count(*) AS total_patients, 'High=' || count(*) FILTER (WHERE p >= 0.6) || ', Medium=' || count(*) FILTER (WHERE p >= 0.3 AND p < 0.6)
  || ', Low=' || count(*) FILTER (WHERE p < 0.3) AS risk_summary FROM fx_scores""", SCORES)
def batch_summary(spark, d):
    summary = scoring.batch_summary(scores(spark, d))
    pairs = F.transform(F.map_entries("risk_summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summary.withColumn("risk_summary", F.array_join(pairs, ", "))


_STEPS = "\n".join(f"{i}. {t}" for i, t in enumerate(fixed.RECOMMENDATIONS["High"], 1))
ALERTS_SQL = f"""SELECT cast(patient_id AS VARCHAR) AS patient_id, notify_email AS recipient,
  'HIGH READMISSION RISK - Patient ' || patient_id AS subject,
  'Patient ID: ' || patient_id || chr(10) || 'Risk Level: HIGH' || chr(10) || 'Probability: ' || {_PERCENT} || chr(10) || chr(10)
    || 'Recommended actions:' || chr(10) || '{_STEPS}' AS message
FROM fx_scores WHERE p >= 0.6 AND notify_email IS NOT NULL AND notify_email <> ''"""


@query(ALERTS_SQL, SCORES)
def alerts(spark, d):
    return scoring.alert_rows(scores(spark, d))


@query(f"SELECT row_id, patient_id, {r('p')} AS p FROM fx_scores ORDER BY scored_at DESC, row_id DESC LIMIT 10", SCORES)
def recent_predictions(spark, d):
    latest = cleaning.newest(scores(spark, d), [F.desc("scored_at"), F.desc("row_id")])
    return latest.select("row_id", "patient_id", round_half_even(F.col("p"), 4).alias("p"))


@query("""SELECT row_id, patient_id, position FROM (SELECT row_id, patient_id,
  row_number() OVER (PARTITION BY patient_id ORDER BY scored_at DESC, row_id DESC)::INTEGER AS position FROM fx_scores) WHERE position <= 10""", SCORES)
def recent_per_patient(spark, d):
    ranked = cleaning.newest_per_key(scores(spark, d), ["patient_id"], [F.desc("scored_at"), F.desc("row_id")])
    return ranked.select("row_id", "patient_id", "position")


@query(f"SELECT row_id, {r('p')} AS readmission_probability, {flag('p >= 0.369')} AS predicted_readmission, {_CUT} AS risk_level "
       "FROM fx_scores ORDER BY row_id LIMIT 10", SCORES)
def predictions_preview(spark, d):
    return scores(spark, d).select("row_id", *scoring.prediction_columns(F.col("p"))).orderBy("row_id").limit(10)


# -- evaluation ----------------------------------------------------------------

_CURVE = """
hist AS (SELECT p AS threshold, sum(label) AS pos, count(*) - sum(label) AS neg FROM fx_scores GROUP BY p),
curve AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
  (SELECT sum(pos) FROM hist) AS positives, (SELECT sum(neg) FROM hist) AS negatives FROM hist),
pr AS (SELECT threshold, tp::DOUBLE / (tp + fp)::DOUBLE AS precision, tp::DOUBLE / positives::DOUBLE AS recall, pos FROM curve)
"""


def _hist(spark, d):
    return evaluation.kept_scores(scores(spark, d))


def _rounded(df, *columns):
    return df.withColumns({c: round_half_even(F.col(c), 4) for c in columns})


@query(_CURVE + f"SELECT {r('sum(neg * (tp - pos + pos / 2.0::DOUBLE))::DOUBLE / (max(positives)::DOUBLE * max(negatives)::DOUBLE)', 6)} AS auc FROM curve", SCORES)
def roc_auc(spark, d):
    return evaluation.roc_auc(_hist(spark, d)).select(round_half_even(F.col("auc"), 6).alias("auc"))


@query(_CURVE + f"""SELECT threshold, {r('fp::DOUBLE / negatives::DOUBLE')} AS fpr, {r('tp::DOUBLE / positives::DOUBLE')} AS tpr FROM curve
UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""", SCORES)
def roc_curve(spark, d):
    return _rounded(evaluation.roc_points(_hist(spark, d)), "fpr", "tpr")


@query(_CURVE + f"""SELECT threshold, {r('precision')} AS precision, {r('recall')} AS recall FROM pr
UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""", SCORES)
def pr_curve(spark, d):
    return _rounded(evaluation.pr_points(_hist(spark, d)), "precision", "recall")


@query(_CURVE + f"SELECT {r('sum(pos * precision) / sum(pos)::DOUBLE')} AS average_precision FROM pr", SCORES)
def average_precision(spark, d):
    return _rounded(evaluation.average_precision(_hist(spark, d)), "average_precision")


@query(_CURVE + f""", rated AS (SELECT *, 2.0::DOUBLE * precision * recall / (precision + recall + 1e-9::DOUBLE) AS f1 FROM pr)
SELECT threshold, {r('f1')} AS f1, {r('precision')} AS precision, {r('recall')} AS recall FROM rated ORDER BY rated.f1 DESC, threshold LIMIT 1""", SCORES)
def best_f1(spark, d):
    return _rounded(evaluation.best_f1(_hist(spark, d)), "f1", "precision", "recall")


_CONFUSION = """
m AS (SELECT count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp FROM fx_scores)
"""


@query(_CONFUSION + "SELECT * FROM m", SCORES)
def confusion(spark, d):
    return evaluation.confusion(scores(spark, d))


@query(_CONFUSION + f""",
c AS (SELECT '0' AS class, tn::DOUBLE / (tn + fn) AS precision, tn::DOUBLE / (tn + fp) AS recall, 2.0 * tn / (2 * tn + fn + fp)::DOUBLE AS f1, tn + fp AS support FROM m
  UNION ALL SELECT '1', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), 2.0 * tp / (2 * tp + fn + fp)::DOUBLE, fn + tp FROM m),
every AS (SELECT * FROM c
  UNION ALL SELECT 'accuracy', (tn + tp)::DOUBLE / (tn + fp + fn + tp), (tn + tp)::DOUBLE / (tn + fp + fn + tp), (tn + tp)::DOUBLE / (tn + fp + fn + tp), tn + fp + fn + tp FROM m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM c
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM c)
SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support FROM every""", SCORES)
def classification_report(spark, d):
    report = evaluation.classification_report(evaluation.confusion(scores(spark, d)))
    return _rounded(report, "precision", "recall", "f1")


@query(f"SELECT {r('avg(label)')} AS prevalence FROM fx_scores", SCORES)
def prevalence(spark, d):
    return _rounded(evaluation.prevalence(scores(spark, d)), "prevalence")


@query(f"""t AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM fx_scores)
SELECT 0 AS label, n0 AS rows, {r('n::DOUBLE / (2 * n0)')} AS weight, {r('n0::DOUBLE / n1')} AS ratio FROM t
UNION ALL SELECT 1, n1, {r('n::DOUBLE / (2 * n1)')}, {r('n0::DOUBLE / n1')} FROM t""", SCORES)
def class_weights(spark, d):
    return _rounded(evaluation.class_weights(scores(spark, d)), "weight", "ratio")


_FOLDS = """
folds AS (SELECT 'team' || patient_id % 3 AS model, row_id % 5 AS fold, avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS auc
  FROM fx_scores GROUP BY ALL),
spread AS (SELECT model, avg(auc) AS mean, stddev_pop(auc) AS std FROM folds GROUP BY model)
"""


@query(_FOLDS + f"SELECT model, {r('mean')} AS mean, {r('std')} AS std FROM spread", SCORES)
def fold_scores(spark, d):
    return _rounded(_fold_scores(spark, d), "mean", "std")


def _fold_scores(spark, d):
    right = ((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double")
    folds = scores(spark, d).groupBy(
        F.concat(F.lit("team"), (F.col("patient_id") % 3).cast("string")).alias("model"), (F.col("row_id") % 5).alias("fold")
    ).agg(F.avg(right).alias("auc"))
    return evaluation.mean_and_spread(folds, ["model"])


@query(_FOLDS + f"SELECT max_by(model, mean) AS best, {r('max(mean)')} AS mean FROM spread", SCORES)
def model_leaderboard(spark, d):
    board = evaluation.leaderboard(_fold_scores(spark, d), "model", "mean")
    return _rounded(board.agg(F.max_by("model", "mean").alias("best"), F.max("mean").alias("mean")), "mean")


# -- care pathways ---------------------------------------------------------------

CARE = ("fx_care_inputs",)
_PATHS = "paths AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{pid}', '{name}', '{priority}', '{color}', {days}, [" + ", ".join(f"'{a}'" for a in actions) + "], ["
    + ", ".join(f"'{s}'" for s in specialists) + "])"
    for pid, name, priority, color, days, actions, specialists in fixed.PATHWAYS
) + ") t(id, name, priority, color, days, actions, specialists))"
_ASSIGNED = """
elderly AS (SELECT *, (is_elderly <> 0 OR age_numeric >= 65) AS old FROM fx_care_inputs),
rules AS (
  SELECT patient_id, 1 AS position, 'cardiac_high_risk' AS id FROM elderly WHERE risk_level = 'High' AND cardiac_primary <> 0
  UNION ALL SELECT patient_id, 2, 'diabetes_high_risk' FROM elderly WHERE risk_level = 'High' AND diabetes_primary <> 0
  UNION ALL SELECT patient_id, 3, 'elderly_high_risk' FROM elderly WHERE risk_level = 'High' AND (old OR (cardiac_primary = 0
    AND diabetes_primary = 0 AND mental_health_flag = 0 AND social_isolation_score < 2 AND medication_noncompliance_risk < 1))
  UNION ALL SELECT patient_id, 4, 'mental_health_risk' FROM elderly WHERE risk_level IN ('High', 'Medium') AND mental_health_flag <> 0
  UNION ALL SELECT patient_id, 5, 'social_isolation_risk' FROM elderly WHERE risk_level = 'High' AND social_isolation_score >= 2
  UNION ALL SELECT patient_id, 6, 'medication_risk' FROM elderly WHERE (risk_level = 'High' AND medication_noncompliance_risk >= 1)
    OR (risk_level = 'Medium' AND medication_noncompliance_risk >= 2)
  UNION ALL SELECT patient_id, 0, 'standard_medium_risk' FROM elderly WHERE risk_level = 'Medium'
  UNION ALL SELECT patient_id, 0, 'standard_low_risk' FROM elderly WHERE risk_level NOT IN ('High', 'Medium')),
""" + _PATHS + """,
actions AS (SELECT r.patient_id, unnest(p.actions) AS action, r.position * 100 + unnest(range(1, len(p.actions) + 1)) AS place
  FROM rules r JOIN paths p USING (id)),
firsts AS (SELECT patient_id, action, min(place) AS place FROM actions GROUP BY patient_id, action),
plans AS (SELECT patient_id, count(*)::INTEGER AS total_actions, array_to_string(list(action ORDER BY place)[1:10], ' | ') AS action_plan FROM firsts GROUP BY patient_id),
experts AS (SELECT patient_id, array_to_string(list(DISTINCT s ORDER BY s), ' | ') AS required_specialists
  FROM (SELECT r.patient_id, unnest(p.specialists) AS s FROM rules r JOIN paths p USING (id)) GROUP BY patient_id),
heads AS (SELECT r.patient_id, array_to_string(list(r.id ORDER BY r.position), ' | ') AS pathways, min(p.days)::INTEGER AS follow_up_in_days,
  max(CASE p.priority WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS rank
  FROM rules r JOIN paths p USING (id) GROUP BY r.patient_id)
"""


@query(_ASSIGNED + f"""SELECT patient_id, pathways, CASE rank WHEN 4 THEN 'URGENT' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS overall_priority,
  total_actions, action_plan, required_specialists, follow_up_in_days, strftime(DATE '{ASOF}' + follow_up_in_days, '%Y-%m-%d') AS follow_up_date,
  '{ASOF} 00:00:00' AS generated_at
FROM heads JOIN plans USING (patient_id) JOIN experts USING (patient_id)""", CARE)
def care_plan(spark, d):
    plans = pathways.care_plans(view(spark, d, "fx_care_inputs"), F.lit(ASOF).cast("date"))
    return plans.select(
        "patient_id", F.array_join(F.transform("assigned_pathways", lambda p: p["id"]), " | ").alias("pathways"),
        "overall_priority", "total_actions", F.array_join("action_plan", " | ").alias("action_plan"),
        F.array_join("required_specialists", " | ").alias("required_specialists"), "follow_up_in_days", "follow_up_date",
        "generated_at",
    )


@query(_ASSIGNED + "SELECT id, priority, count(*) AS patients, min(days) AS follow_up_days FROM rules JOIN paths USING (id) GROUP BY id, priority", CARE)
def pathway_load(spark, d):
    return pathways.pathway_load(view(spark, d, "fx_care_inputs"))


# -- note annotations --------------------------------------------------------------


def _number(field, default):
    return f"coalesce(json_extract(j, '$.{field}')::DOUBLE, {default}.0::DOUBLE)"


@query(f"""parsed AS (SELECT *, CASE WHEN json_valid(annotation_json) THEN annotation_json ELSE '{{}}' END::JSON AS j FROM fx_annotations)
SELECT patient_id, {_number('social_isolation_score', 0)} AS social_isolation_score,
  {_number('medication_noncompliance_risk', 0)} AS medication_noncompliance, {_number('mental_health_flag', 0)} AS mental_health_flag,
  {_number('caregiver_support', 2)} AS caregiver_support, {_number('follow_up_arranged', 0)} AS follow_up_arranged,
  {_number('overall_psychosocial_risk', 0)} AS psychosocial_risk_score,
  {r('complexity_score + 0.5::DOUBLE * ' + _number('overall_psychosocial_risk', 0), 2)} AS complexity_score FROM parsed""", ("fx_annotations",))
def note_merge(spark, d):
    rows = view(spark, d, "fx_annotations")
    return notes.annotated_features(rows.select("patient_id", "complexity_score"), rows.select("patient_id", "annotation_json"))


def keyword_annotator():
    """Stand-in for a model: scores a note by words it contains.

    Made inside a function so that it travels to the workers by value.
    """
    def annotate(prompts: pd.Series) -> pd.Series:
        low = prompts.str.partition("\n\n")[2].str.lower()
        risk = low.str.contains("risk", regex=False).astype(int) * 3 + low.str.contains("the", regex=False).astype(int)
        fall = low.str.contains("fall", regex=False).astype(int)
        return '{"fall_risk": ' + fall.astype(str) + ', "overall_psychosocial_risk": ' + risk.astype(str) + "}"

    return annotate


@query(f"""found AS (SELECT doc_id, (contains(lower(text), 'risk')::INTEGER * 3 + contains(lower(text), 'the')::INTEGER)::DOUBLE AS risk,
  contains(lower(text), 'fall')::INTEGER::DOUBLE AS fall_risk FROM documents)
SELECT doc_id, fall_risk, risk AS psychosocial_risk_score, 2.0::DOUBLE AS caregiver_support, {r('risk * 0.5', 2)} AS complexity_score FROM found""".replace(
    "found AS", "WITH found AS", 1))
def note_annotation(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.col("text").alias("note"))
    parsed = notes.parse_annotations(notes.annotate_notes(texts, keyword_annotator()))
    merged = notes.merge_annotations(parsed.withColumn("fall_risk", F.col("annotation.fall_risk")))
    return merged.select("doc_id", "fall_risk", "psychosocial_risk_score", "caregiver_support", "complexity_score")


# -- FHIR ------------------------------------------------------------------------------
# Bundle pages are made from the tables: one page per order, line, event or customer.

_CODE = "CASE o_orderkey % 8 WHEN 0 THEN 'I21.9' WHEN 1 THEN 'E11.9' WHEN 2 THEN '428.0' WHEN 3 THEN 'J18' WHEN 4 THEN '' WHEN 5 THEN '250.00' ELSE 'Z00' END"
_CLASS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'EMER' WHEN '2-HIGH' THEN 'inpatient' WHEN '3-MEDIUM' THEN 'Outpatient' WHEN '4-NOT SPECIFIED' THEN 'IMP' ELSE NULL END"
_DRUG = "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('Drug ', cast(l_partkey % 50 AS string)) END"
_BIRTH = "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE concat(cast(1930 + c_custkey % 80 AS string), '-0', cast(1 + c_custkey % 9 AS string), '-1', cast(c_custkey % 10 AS string)) END"


def _pages(rows, key, body, schema, as_json):
    """Bundle pages, as they are or written to JSON and parsed with the declared schema."""
    page = F.expr(f"named_struct('patient_id', cast({key} AS string), {body})")
    if as_json:
        page = F.from_json(F.to_json(page), schema)
    return rows.select(page.alias("page")).select("page.*")


def bundles(spark, d, as_json=False):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    code = f"named_struct('text', o_orderstatus, 'coding', array(named_struct('code', {_CODE})))"
    extra = "named_struct('text', 'uncoded', 'coding', cast(NULL AS array<struct<code:string>>))"
    entries = (f"'entry', CASE WHEN o_orderkey % 3 = 0 THEN array(named_struct('resource', named_struct('code', {code})), "
               f"named_struct('resource', named_struct('code', {extra}))) ELSE array(named_struct('resource', named_struct('code', {code}))) END")
    return {
        "Patient": table(spark, d, "customer").selectExpr(
            "cast(c_custkey AS string) AS id", "array(named_struct('given', array('Pat', 'Q'), 'family', c_name)) AS name",
            "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender",
            f"{_BIRTH} AS birthDate",
        ),
        "Condition": _pages(orders, "o_custkey", entries, schemas.FHIR_CONDITION, as_json),
        "MedicationRequest": _pages(
            lines, "l_suppkey", f"'entry', array(named_struct('resource', named_struct('medicationCodeableConcept', named_struct('text', {_DRUG}))))",
            schemas.FHIR_MEDICATION, as_json),
        "Encounter": _pages(
            orders, "o_custkey", f"'entry', array(named_struct('resource', named_struct('class', named_struct('code', {_CLASS}))))",
            schemas.FHIR_ENCOUNTER, as_json),
        "Observation": _pages(
            table(spark, d, "events"), "user_id",
            "'total', CASE WHEN user_id % 5 = 0 THEN 57 END, 'entry', array_repeat(named_struct('resource', named_struct('id', cast(event_id AS string))), cast(event_id % 3 AS int))",
            schemas.FHIR_OBSERVATION, as_json),
    }


_FHIR = f"""WITH born AS (SELECT c_custkey AS pid, c_name, try_cast({_BIRTH} AS DATE) AS birth,
  CASE WHEN c_custkey % 4 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender FROM customer),
people AS (SELECT *, coalesce(floor(date_diff('day', birth, DATE '{ASOF}') / 365.0::DOUBLE), 0)::INTEGER AS age FROM born),
codes AS (SELECT o_custkey AS pid, {_CODE} AS code, o_orderstatus AS text FROM orders UNION ALL SELECT o_custkey, '', 'uncoded' FROM orders WHERE o_orderkey % 3 = 0),
conditions AS (SELECT pid, count(*) AS n, max({flag("regexp_matches(code, 'I21|I22|I50|I48|410|428')")}) AS cardiac, max({flag("regexp_matches(code, 'E11|E12|E13|250')")}) AS diabetes
  FROM codes GROUP BY pid),
drugs AS (SELECT l_suppkey AS pid, coalesce({_DRUG}, 'Unknown') AS text FROM lineitem),
meds AS (SELECT pid, count(*) AS n FROM drugs GROUP BY pid),
visits AS (SELECT o_custkey AS pid, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS inpatient, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS outpatient,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS emergency, count(*) AS total FROM orders GROUP BY o_custkey),
labs AS (SELECT user_id AS pid, CASE WHEN user_id % 5 = 0 THEN 57 ELSE sum(event_id % 3) END::BIGINT AS n FROM events GROUP BY user_id),
j AS (SELECT pid, age, coalesce(c.n, 0) AS c, coalesce(cardiac, 0) AS cardiac, coalesce(diabetes, 0) AS diabetes, coalesce(m.n, 0) AS m, coalesce(inpatient, 0) AS i,
  coalesce(outpatient, 0) AS o, coalesce(emergency, 0) AS e, coalesce(total, 0) AS t, coalesce(l.n, 0) AS l
  FROM people LEFT JOIN conditions c USING (pid) LEFT JOIN meds m USING (pid) LEFT JOIN visits v USING (pid) LEFT JOIN labs l USING (pid))
"""


def bundle_files(spark, d):
    """The bundles written as JSON files and read back: resources name their patient, pages do so only when empty."""
    folder = scratch_path(spark, "fhir")
    for name, pages in bundles(spark, d).items():
        if name != "Patient":
            reference = F.struct(F.concat(F.lit("Patient/"), F.col("patient_id")).alias("reference"))
            pages = pages.withColumn("entry", F.transform("entry", lambda e: e.withField("resource", e["resource"].withField("subject", reference))))
            pages = pages.withColumn("patient_id", F.when(F.size("entry") == 0, F.col("patient_id")))
        pages.write.json(f"{folder}/{name}")
    return read_fhir(spark, folder)


@query(_FHIR + f"""SELECT cast(pid AS VARCHAR) AS patient_id, age AS age_numeric, 5 AS time_in_hospital, i AS number_inpatient, o AS number_outpatient,
  e AS number_emergency, c AS number_diagnoses, m AS num_medications, l AS num_lab_procedures, 0 AS num_procedures, cardiac AS cardiac_primary,
  diabetes AS diabetes_primary, 0 AS high_risk_discharge, 0 AS medication_changed, t AS total_prior_visits, {flag('age >= 65')} AS is_elderly,
  {flag('m >= 5')} AS polypharmacy, {r('c + m * 0.5::DOUBLE + l * 0.2::DOUBLE', 2)} AS complexity_score, 5 * c AS los_x_diagnoses, m * 5 AS meds_x_los,
  {flag('age >= 65')} * (c + m * 0.5::DOUBLE) AS elderly_x_complex, i * e AS inpatient_x_emergency, {flag('c >= 5')} AS high_diagnosis_burden,
  {flag('l > 40')} AS high_lab_use, 0 AS had_procedures, {flag('i >= 1')} AS has_inpatient_history, {flag('e >= 2')} AS emergency_prone,
  {flag('t >= 3')} AS high_utiliser FROM j""")
def fhir_features(spark, d):
    b = bundle_files(spark, d)
    return fhir.bundle_features(
        b["Patient"], b["Condition"], b["MedicationRequest"], b["Encounter"], b["Observation"], F.lit(ASOF).cast("date")
    )


@query(_FHIR + f"SELECT cast(pid AS VARCHAR) AS patient_id, 'Pat Q ' || c_name AS full_name, gender, coalesce(cast(birth AS VARCHAR), '') AS birth_date, age FROM people")
def fhir_patients(spark, d):
    return fhir.patient_rows(bundles(spark, d)["Patient"], F.lit(ASOF).cast("date"))


@query(_FHIR + "SELECT text, code, count(*) AS n, count(DISTINCT pid) AS patients FROM codes GROUP BY text, code")
def fhir_conditions(spark, d):
    rows = fhir.condition_rows(bundles(spark, d, as_json=True)["Condition"])
    return rows.groupBy("text", "code").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


@query(_FHIR + "SELECT text, count(*) AS n FROM drugs GROUP BY text")
def fhir_medications(spark, d):
    return fhir.medication_rows(bundles(spark, d, as_json=True)["MedicationRequest"]).groupBy("text").agg(F.count("*").alias("n"))


@query(_FHIR + "SELECT cast(pid AS VARCHAR) AS patient_id, inpatient, outpatient, emergency, total FROM visits")
def fhir_encounters(spark, d):
    return fhir.encounter_counts(fhir.encounter_rows(bundles(spark, d, as_json=True)["Encounter"]))


@query(_FHIR + "SELECT cast(pid AS VARCHAR) AS patient_id, n AS lab_count FROM labs")
def fhir_labs(spark, d):
    return fhir.lab_counts(bundles(spark, d, as_json=True)["Observation"])


@query(_FHIR + "SELECT cast(pid AS VARCHAR) AS id, 'Pat Q ' || c_name AS name, CASE WHEN gender = 'unknown' THEN '' ELSE gender END AS gender "
       "FROM people WHERE contains(lower('Pat Q ' || c_name), '#00000001') ORDER BY id LIMIT 5")
def patient_search(spark, d):
    return fhir.search_patients(bundles(spark, d)["Patient"], "#00000001")


# -- feedback ---------------------------------------------------------------------------

OUT = ("fx_outcomes", "fx_metrics")
_DRIFT = """
hist AS (SELECT predicted_risk AS s, sum(actually_readmitted) AS pos, count(*) - sum(actually_readmitted) AS neg FROM fx_outcomes GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp FROM hist),
area AS (SELECT sum(neg * (tp - pos + pos / 2.0::DOUBLE))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auc FROM cum),
drift AS (SELECT auc, auc < 0.6 AS drifted, (SELECT count(*) FROM fx_outcomes) AS n FROM area)
"""


def outcomes(spark, d):
    return view(spark, d, "fx_outcomes")


@query("""every AS (SELECT patient_id, actually_readmitted FROM fx_outcomes UNION ALL SELECT 'P' || patient_id, label FROM fx_scores)
SELECT patient_id, count(*) AS outcomes, sum(actually_readmitted)::BIGINT AS readmitted FROM every GROUP BY patient_id""", ("fx_outcomes", "fx_scores"))
def outcome_append(spark, d):
    new = scores(spark, d).select(
        F.concat(F.lit("P"), F.col("patient_id").cast("string")).alias("patient_id"), F.col("label").alias("actually_readmitted"))
    log = cleaning.append_rows(outcomes(spark, d), new)
    return log.groupBy("patient_id").agg(F.count("*").alias("outcomes"), F.sum("actually_readmitted").alias("readmitted"))


@query(_DRIFT + f"""SELECT CASE WHEN drifted THEN 'drift_detected' ELSE 'no_drift' END AS status, n AS outcomes_count, NULL::INTEGER AS min_required,
  NULL::VARCHAR AS message, {r('auc')} AS current_auc, 0.6812::DOUBLE AS baseline_auc, drifted AS drift_detected,
  CASE WHEN drifted THEN 'Retrain model immediately' ELSE 'Model performing well' END AS recommendation FROM drift""", OUT)
def drift_report(spark, d):
    return feedback.drift_report(outcomes(spark, d))


@query("""SELECT 'insufficient_data' AS status, count(*) AS outcomes_count, 1000000000 AS min_required,
  'Need ' || (1000000000 - count(*)) || ' more outcomes to detect drift' AS message, NULL::DOUBLE AS current_auc, NULL::DOUBLE AS baseline_auc,
  NULL::BOOLEAN AS drift_detected, NULL::VARCHAR AS recommendation FROM fx_outcomes""", OUT)
def drift_insufficient(spark, d):
    return feedback.drift_report(outcomes(spark, d), min_outcomes=1_000_000_000)


@query(_DRIFT + """SELECT 'boosting_tuned' AS model_version, 0.6812::DOUBLE AS baseline_auc, n AS outcomes_recorded, (SELECT count(*) FROM fx_metrics) AS retraining_count,
  CASE WHEN drifted THEN 'drift_detected' ELSE 'no_drift' END AS drift_status,
  (SELECT strftime(max(retrained_at), '%Y-%m-%d %H:%M:%S') FROM fx_metrics) AS last_retrain, 'healthy' AS system_status FROM drift""", OUT)
def system_health(spark, d):
    return feedback.system_health(outcomes(spark, d), view(spark, d, "fx_metrics"))
