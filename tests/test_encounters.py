import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from wardlight.functions import fixed
from wardlight.operators import encounters as e
from wardlight.plans.jobs import encounter_job
from wardlight.sources import schemas

BASE = dict(
    patient_nbr=1, race="Asian", gender="Male", age="[60-70)", weight="?", admission_type_id=1, discharge_disposition_id=1,
    admission_source_id=7, time_in_hospital=3, payer_code="?", medical_specialty="Cardiology", primary_diagnosis_code="428",
    other_diagnosis_codes="401", number_outpatient=0, number_inpatient=1, number_emergency=0, num_lab_procedures=40,
    number_diagnoses=5, num_medications=10, num_procedures=0, ndc_code="?", max_glu_serum=">300", A1Cresult=">7", change="Ch",
    readmitted="NO",
)


@pytest.fixture
def raw(spark):
    def make(*changes):
        names = [c.split("`")[1] for c in schemas.ENCOUNTERS.split(", ")]
        rows = [{**BASE, "encounter_id": i + 1, **change} for i, change in enumerate(changes)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.ENCOUNTERS)

    return make


def test_clean_keeps_first_row_in_the_given_order(raw):
    df = e.encode_target(raw(
        {"encounter_id": 1, "time_in_hospital": 9, "race": "?"}, {"encounter_id": 1, "time_in_hospital": 2, "race": "?"},
        {"encounter_id": 2, "readmitted": None}))
    rows = {r["encounter_id"]: r for r in e.clean_encounters(df, ["time_in_hospital"]).collect()}
    assert rows[1]["time_in_hospital"] == 2 and rows[1]["race"] is None
    assert rows[2]["readmitted_30d"] == 1
    assert not {"weight", "ndc_code", "payer_code", "readmitted"} & set(rows[1].asDict())


def test_clean_deals_wide_rows_before_it_sorts_them(raw, monkeypatch):
    df = e.encode_target(raw(*[{"encounter_id": None if i % 5 == 0 else i % 5 // 2, "num_medications": i} for i in range(40)]))
    want = [(-1, 0), (0, 1), (1, 2), (2, 4)]
    found = lambda d: sorted((-1 if r["encounter_id"] is None else r["encounter_id"], r["num_medications"]) for r in d.collect())

    def steps(cleaned):
        plan = plan_of(cleaned)
        return [n for n in ("REBALANCE_PARTITIONS_BY_COL", "ENSURE_REQUIREMENTS", "WindowGroupLimit") if n in plan[plan.index("Physical Plan"):]]

    dealt = e.clean_encounters(df, ["num_medications"])
    assert steps(dealt) == ["REBALANCE_PARTITIONS_BY_COL", "WindowGroupLimit"] and found(dealt) == want
    # Encounters of many rows, and rows without one, are pruned before they travel.
    few = e.frequent_values
    assert few(df, "encounter_id", 9) == [1] and set(few(df, "encounter_id", 7)) == {None, 0, 1, 2}
    for rows in (9, 7):
        monkeypatch.setattr(e, "frequent_values", lambda d, c, rows=rows: few(d, c, rows))
        pruned = e.clean_encounters(df, ["num_medications"])
        assert found(pruned) == want and "ENSURE_REQUIREMENTS" in steps(pruned)


def test_null_parts_make_totals_null_and_flags_zero(raw):
    df = raw({"number_outpatient": None}, {"number_emergency": 3})
    got = [r.asDict() for r in e.utilisation_features(df, 1.0).orderBy("encounter_id").collect()]
    assert (got[0]["total_prior_visits"], got[0]["high_utiliser"], got[0]["has_inpatient_history"]) == (None, 0, 1)
    assert (got[1]["total_prior_visits"], got[1]["high_utiliser"], got[1]["emergency_prone"]) == (4, 1, 1)


def test_clinical_features(raw):
    got = e.clinical_features(raw({}), 40.0).first()
    assert (got["polypharmacy"], got["high_diagnosis_burden"], got["high_lab_use"], got["had_procedures"]) == (1, 1, 0, 0)
    assert got["complexity_score"] == 18.0


def test_metabolic_and_interactions(raw):
    df = e.glucose_features(e.clinical_features(e.age_features(raw({})), None))
    got = e.interaction_features(df).first()
    assert (got["glu_serum_num"], got["a1c_num"], got["metabolic_risk"], got["uncontrolled_diabetes"]) == (3, 2, 5, 1)
    assert (got["los_x_diagnoses"], got["elderly_x_complex"], got["inpatient_x_emergency"], got["meds_x_los"]) == (15, 18.0, 0, 30)
    assert got["high_lab_use"] == 0


def test_figures_are_learned_before_the_disposition_filter_and_levels_after(raw):
    df = raw(
        {"discharge_disposition_id": 11, "num_lab_procedures": 100, "race": "OnlyDeceased"},
        {"discharge_disposition_id": None, "num_lab_procedures": 10}, {"num_lab_procedures": 20, "race": "Other"})
    stats = e.fit_encounters(e.clean_encounters(e.encode_target(df)))
    assert stats.labs_median == 20.0
    assert stats.levels["race"] == ["Asian", "Other"]
    assert stats.levels["age_group"] == [name for name, _ in fixed.AGE_BANDS]
    assert e.EncounterStats.from_json(stats.to_json()) == stats


def test_pipeline_columns_and_unseen_levels(raw):
    train = raw({"race": "Asian"}, {"race": "Other", "readmitted": "<30"}, {"discharge_disposition_id": 13})
    features, stats = encounter_job(train)
    assert features.count() == 2
    assert "race_Other" in features.columns and "race_Asian" not in features.columns
    assert not set(fixed.ENCOUNTER_IDS) & set(features.columns)
    assert all(t in ("int", "bigint", "double") for _, t in features.dtypes)
    scored, same = encounter_job(raw({"race": "Unseen", "medical_specialty": None}), stats=stats)
    assert same is stats and scored.columns == features.columns
    assert scored.first()["race_Other"] == 0
    kept, _ = encounter_job(train, stats=stats, keep_ids=["encounter_id"])
    assert set(kept.columns) - set(features.columns) == {"encounter_id"}


def test_job_writes_its_table(raw, spark, tmp_path):
    features, _ = encounter_job(raw({}, {"race": "Other"}), str(tmp_path / "features"))
    assert features.count() == 2
    assert spark.read.parquet(str(tmp_path / "features")).columns == features.columns


def test_no_python_in_the_plan(raw):
    cleaned = e.clean_encounters(e.encode_target(raw({}, {})))
    plan = plan_of(e.encounter_features(cleaned, e.EncounterStats(1.0, 1.0, {
        "race": ["a", "b"], "medical_specialty": [], "primary_diag_category": ["x"], "age_group": ["<30", "80+"]})))
    assert "EvalPython" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_label_distribution_and_rate(raw):
    df = e.encode_target(raw({}, {"readmitted": ">30"}, {"readmitted": ">30"}))
    assert [tuple(r) for r in e.label_distribution(df).collect()] == [(1, 2), (0, 1)]
    assert e.positive_rate(df).first()[0] == pytest.approx(2 / 3)


def test_clean_deals_rows_by_their_number(raw, monkeypatch):
    # Partitions follow the rows, not a setting, and stay few enough to be written without a sort.
    df = e.encode_target(raw(*[{"encounter_id": i // 2, "num_medications": i} for i in range(40)]))
    for rows, limit, parts in ((100_000, 200, 1), (8, 200, 5), (1, 6, 6)):
        monkeypatch.setattr(e, "DEALT_ROWS", rows)
        monkeypatch.setattr(e, "DEALT_PARTS", limit)
        cleaned = e.clean_encounters(df, ["num_medications"])
        plan = plan_of(cleaned)
        assert f", {parts}), REBALANCE_PARTITIONS_BY_COL" in plan
        assert sorted((r["encounter_id"], r["num_medications"]) for r in cleaned.collect()) == [(i, 2 * i) for i in range(20)]
