"""Intake forms, FHIR bundles, note annotations and care pathways."""

import json
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from wardlight.functions import fixed
from wardlight.operators import fhir, notes, pathways
from wardlight.operators.intake import intake_features
from wardlight.sources.readers import read_fhir

def asof():
    return F.lit(date(2024, 6, 30))

FORM = dict(age_numeric=70, time_in_hospital=5, number_inpatient=1, number_outpatient=2, number_emergency=2, number_diagnoses=6,
            num_medications=8, num_lab_procedures=41, num_procedures=0)


def test_intake_variants(spark):
    df = spark.createDataFrame([tuple(FORM.values())], ", ".join(f"{n} int" for n in FORM))
    full, web = intake_features(df).first(), intake_features(df, include_outpatient=False).first()
    assert (full["total_prior_visits"], web["total_prior_visits"]) == (5, 3)
    assert full["complexity_score"] == 18.2 and full["elderly_x_complex"] == 10.0
    assert (full["high_lab_use"], full["high_utiliser"], full["emergency_prone"], full["polypharmacy"]) == (1, 1, 1, 1)


def test_intake_checkbox_overrules(spark):
    df = spark.createDataFrame([tuple(FORM.values())], ", ".join(f"{n} int" for n in FORM)).withColumn("is_elderly", F.lit(0))
    row = intake_features(df).first()
    assert row["is_elderly"] == 0 and row["elderly_x_complex"] == 0.0


@pytest.fixture(scope="module")
def bundles(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fhir")
    resource = lambda **body: {"resource": body}
    lines = {
        "Patient": [
            {"id": "p1", "name": [{"given": ["Ann", "B"], "family": "Lee"}], "gender": "female", "birthDate": "1950-01-01"},
            {"id": "p2", "name": []}, {"id": "p3", "birthDate": "not-a-date"}],
        "Condition": [
            {"patient_id": "p1", "entry": [resource(code={"text": "MI", "coding": [{"code": "I21.9"}, {"code": "E11"}]}), resource(code={"coding": []})]},
            {"patient_id": "p1", "entry": [resource(code={"coding": [{"code": "250.0"}]}), {}]},
            {"patient_id": "p2"}],
        "MedicationRequest": [{"patient_id": "p1", "entry": [resource(medicationCodeableConcept={"text": "Aspirin"}), resource()]}],
        "Encounter": [{"patient_id": "p1", "entry": [resource(**{"class": {"code": c}}) for c in ("inp", "acute", "out", "eme", "IMP")] + [resource()]}],
        "Observation": [{"patient_id": "p1", "total": 77, "entry": [resource(id="o1")]}, {"patient_id": "p2", "entry": [resource(id="o1"), resource(id="o2")]},
                        {"patient_id": "p3"}],
    }
    for name, rows in lines.items():
        (folder / name).mkdir()
        (folder / name / "part.json").write_text("\n".join(json.dumps(r) for r in rows))
    return read_fhir(spark, str(folder))


def test_fhir_patients(bundles):
    rows = {r["patient_id"]: r for r in fhir.patient_rows(bundles["Patient"], asof()).collect()}
    assert tuple(rows["p1"]) == ("p1", "Ann B Lee", "female", "1950-01-01", 74)
    assert tuple(rows["p2"]) == ("p2", "", "unknown", "", 0)
    assert rows["p3"]["age"] == 0


def test_fhir_rows(bundles):
    conditions = [tuple(r) for r in fhir.condition_rows(bundles["Condition"]).collect()]
    assert sorted(conditions) == sorted([("p1", "MI", "I21.9"), ("p1", "", ""), ("p1", "", "250.0"), ("p1", "", "")])
    assert sorted(r["text"] for r in fhir.medication_rows(bundles["MedicationRequest"]).collect()) == ["Aspirin", "Unknown"]
    counts = fhir.encounter_counts(fhir.encounter_rows(bundles["Encounter"])).first()
    assert tuple(counts) == ("p1", 2, 1, 1, 6)
    assert {r[0]: r[1] for r in fhir.lab_counts(bundles["Observation"]).collect()} == {"p1": 77, "p2": 2, "p3": 0}


def test_fhir_features(bundles):
    table = fhir.bundle_features(*[bundles[n] for n in ("Patient", "Condition", "MedicationRequest", "Encounter", "Observation")], asof())
    rows = {r["patient_id"]: r for r in table.collect()}
    p1 = rows["p1"]
    assert len(table.columns) == 28 and len(rows) == 3
    assert (p1["cardiac_primary"], p1["diabetes_primary"], p1["number_diagnoses"], p1["num_medications"]) == (1, 1, 4, 2)
    assert (p1["complexity_score"], p1["elderly_x_complex"], p1["total_prior_visits"], p1["high_lab_use"]) == (20.4, 5.0, 6, 1)
    assert rows["p2"]["num_lab_procedures"] == 2 and rows["p2"]["number_diagnoses"] == 0


def test_fhir_search(bundles):
    assert [tuple(r) for r in fhir.search_patients(bundles["Patient"], "LEE").collect()] == [("p1", "Ann B Lee", "female")]
    assert fhir.search_patients(bundles["Patient"], rows=2).count() == 2


def test_annotation_parsing(spark):
    texts = ['{"mental_health_flag": 1, "overall_psychosocial_risk": 1.5, "key_risk_factors": ["a"]}', "no json", "[1]", '{"a": 1} tail',
             '{"a": 1} junk }', '{"a": 1}, {"a": 2}', "", None, ' {"summary": "s"} ', '{"mental_health_flag": "x"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, annotation_json string")
    got = {r["i"]: r["annotation"] for r in notes.parse_annotations(df).collect()}
    assert got[0]["overall_psychosocial_risk"] == 1.5 and got[0]["key_risk_factors"] == ["a"] and got[0]["caregiver_support"] is None
    for i in (1, 2, 3, 4, 5, 6, 7):
        assert got[i]["summary"] == fixed.NOTE_UNREADABLE and got[i]["caregiver_support"] == 2.0, texts[i]
    assert got[8]["summary"] == "s" and got[9]["mental_health_flag"] is None and got[9]["summary"] is None


def test_annotation_merge(spark):
    features = spark.createDataFrame([("a", 10.123), ("b", None), ("c", 1.0)], "patient_id string, complexity_score double")
    annotated = spark.createDataFrame([
        ("a", '{"overall_psychosocial_risk": 5, "medication_noncompliance_risk": 2, "caregiver_support": 0}'), ("b", "bad")],
        "patient_id string, annotation_json string")
    rows = {r["patient_id"]: r for r in notes.annotated_features(features, annotated).collect()}
    assert (rows["a"]["complexity_score"], rows["a"]["medication_noncompliance"], rows["a"]["caregiver_support"]) == (12.62, 2.0, 0.0)
    assert (rows["b"]["complexity_score"], rows["b"]["caregiver_support"]) == (0.0, 2.0)
    assert (rows["c"]["complexity_score"], rows["c"]["psychosocial_risk_score"]) == (1.0, 0.0)


def test_annotator_sees_whole_notes(spark):
    long = "x" * 300_000 + " fall"
    df = spark.createDataFrame([(1, long), (2, "fine")], "id long, note string")

    def annotate(prompts: pd.Series) -> pd.Series:
        return '{"fall_risk": ' + prompts.str.endswith("fall").astype(int).astype(str) + "}"

    got = notes.parse_annotations(notes.annotate_notes(df, annotate)).select("id", "annotation.fall_risk").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1.0), (2, 0.0)]


def plan(spark, **features):
    df = spark.createDataFrame([tuple(features.values())], ", ".join(
        f"{n} {'string' if isinstance(v, str) else 'int'}" for n, v in features.items()))
    return pathways.care_plans(df, F.lit(datetime(2024, 2, 28, 10, 30)).cast("timestamp")).first()


def test_high_risk_rules_in_order(spark):
    row = plan(spark, risk_level="High", cardiac_primary=1, diabetes_primary=1, is_elderly=0, age_numeric=65, mental_health_flag=1,
               social_isolation_score=2, medication_noncompliance_risk=1)
    assert [p["id"] for p in row["assigned_pathways"]] == [p[0] for p in fixed.PATHWAYS[:6]]
    assert row["overall_priority"] == "URGENT" and row["follow_up_in_days"] == 1 and row["follow_up_date"] == "2024-02-29"
    assert row["total_actions"] == 31 and len(row["action_plan"]) == 10
    assert row["action_plan"][0] == fixed.PATHWAYS[0][5][0] and row["action_plan"][5] == fixed.PATHWAYS[1][5][0]
    assert row["required_specialists"] == sorted(set(row["required_specialists"]))
    assert row["generated_at"] == "2024-02-28 10:30:00"


def test_fallbacks(spark):
    ids = lambda row: [p["id"] for p in row["assigned_pathways"]]
    assert ids(plan(spark, risk_level="High")) == ["elderly_high_risk"]
    assert ids(plan(spark, risk_level="Medium", mental_health_flag=1, medication_noncompliance_risk=1)) == ["standard_medium_risk", "mental_health_risk"]
    assert ids(plan(spark, risk_level="Medium", medication_noncompliance_risk=2)) == ["standard_medium_risk", "medication_risk"]
    low = plan(spark, risk_level="odd", cardiac_primary=1)
    assert ids(low) == ["standard_low_risk"] and low["overall_priority"] == "LOW" and low["total_actions"] == 3


def test_unknown_and_repeated_ids(spark):
    df = spark.createDataFrame([(["nope"],), (["medication_risk", "medication_risk"],)], "ids array<string>")
    none, twice = pathways.care_plans(df, asof(), F.col("ids")).collect()
    assert none["assigned_pathways"] == [] and none["follow_up_in_days"] == 999 and none["overall_priority"] == "LOW"
    assert twice["total_actions"] == 5 and len(twice["assigned_pathways"]) == 2


def test_plans_need_no_shuffle(spark):
    df = spark.createDataFrame([("High", 1)], "risk_level string, cardiac_primary int")
    assert "Exchange" not in plan_of(pathways.care_plans(df, asof()))


def test_pathway_rows_agree_with_plans(spark):
    df = spark.createDataFrame([(1, "High", 1), (2, "Medium", 0)], "patient_id int, risk_level string, cardiac_primary int")
    rows = [(r["patient_id"], r["position"], r["id"]) for r in pathways.assigned_rows(df).orderBy("patient_id").collect()]
    assert rows == [(1, 0, "cardiac_high_risk"), (2, 0, "standard_medium_risk")]
    assert pathways.pathway_table(spark).count() == 8


def test_plain_bundles_without_patient_column(spark, tmp_path):
    subject = {"subject": {"reference": "http://host/fhir/Patient/p1/_history/2"}}
    documents = {
        "Patient": {"id": "p1", "birthDate": "1950-01-01"},
        "Condition": {"resourceType": "Bundle", "entry": [{"resource": {"code": {"coding": [{"code": "I21.9"}]}, **subject}},
                                                          {"resource": {"code": {"text": "x"}, "subject": {"reference": "Group/g"}}}]},
        "MedicationRequest": {"entry": [{"resource": {"medicationCodeableConcept": {"text": "Aspirin"}, "subject": {"reference": "Patient/p1"}}}]},
        "Encounter": {"entry": [{"resource": {"class": {"code": "IMP"}, **subject}}]},
        "Observation": {"entry": [{"resource": {"id": "o", **subject}}, {"resource": {"id": "o2", **subject}}]},
    }
    for name, body in documents.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "Condition" / "bad.json").write_text("{ no json")
    tables = read_fhir(spark, str(tmp_path), whole_files=True)
    row = fhir.bundle_features(*[tables[n] for n in documents], asof()).first()
    assert (row["patient_id"], row["number_diagnoses"], row["cardiac_primary"], row["num_medications"], row["num_lab_procedures"],
            row["number_inpatient"]) == ("p1", 1, 1, 1, 2, 0)
    from wardlight.sources.readers import unreadable_records
    assert {r["resource"]: (r["records"], r["unreadable"]) for r in unreadable_records(tables).collect()}["Condition"] == (2, 1)
