import json

import pytest
from pyspark.sql import functions as F

from wardlight import session
from wardlight.sources import readers, schemas, writers


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv_by_name_with_tokens(spark, tmp_path):
    path = write(tmp_path / "d.csv", "hospital_branch,doctor_id,years_experience,specialization,extra\nEast,D1,12,NA,x\n,D2,n/a,Cardiology,\nWest,D3,bad,None,y\n")
    df = readers.read_csv(spark, path, schemas.DOCTORS)
    rows = [tuple(r) for r in df.orderBy("doctor_id").collect()]
    assert rows == [("East", "D1", 12, None, "x"), (None, "D2", None, "Cardiology", None), ("West", "D3", None, None, "y")]
    with pytest.raises(KeyError):
        readers.read_csv(spark, path, schemas.PATIENTS)


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = write(tmp_path / "f.csv", "a,flag,readmitted_30d\n1.5,True,1\nbad,False,0\n", "utf-8-sig")
    assert readers.probe_features(spark, path, kind="csv") == ["a", "flag"]
    rows = [tuple(r) for r in readers.read_features(spark, path, "csv").collect()]
    assert rows == [(1.5, 1.0, 1.0), (None, 0.0, 0.0)]
    with pytest.raises(ValueError):
        readers.read_features(spark, path, "xml")


def test_encounters_and_hospital_files(spark, tmp_path):
    names = [c.split("`")[1] for c in schemas.ENCOUNTERS.split(", ")]
    path = write(tmp_path / "e.csv", ",".join(names) + "\n" + ",".join(["7"] * len(names)) + "\n")
    row = readers.read_encounters(spark, path).first()
    assert row["encounter_id"] == 7 and row["race"] == "7"
    for name, schema in schemas.HOSPITAL.items():
        columns = [c.split("`")[1] for c in schema.split(", ")]
        write(tmp_path / f"{name}.csv", ",".join(columns) + "\n" + ",".join(["1"] * len(columns)) + "\n")
    tables = readers.read_hospital(spark, str(tmp_path))
    assert set(tables) == set(schemas.HOSPITAL) and tables["billing"].first()["amount"] == 1.0


def test_table_round_trip(spark, tmp_path):
    df = spark.range(10).withColumn("day", F.col("id") % 2)
    assert writers.write_table(df, str(tmp_path / "t"), partition_by=["day"]) == (10, 2)
    assert readers.probe_features(spark, str(tmp_path / "t"), label="day") == ["id"]
    assert writers.write_table(df, str(tmp_path / "c"), kind="csv") == (10, 2)
    assert readers.read_csv(spark, str(tmp_path / "c")).count() == 10


def test_outcome_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert readers.read_outcomes(spark, path).count() == 0
    new = spark.createDataFrame([("P1", 0.7, True)], "patient_id string, predicted_risk double, actually_readmitted boolean")
    writers.append_outcomes(new, path)
    writers.append_outcomes(new, path)
    old = new.withColumn("recorded_at", F.lit("2020-05-05 10:00:00").cast("timestamp"))
    writers.append_outcomes(old, path)
    recent = readers.read_outcomes(spark, path, since="2024-01-01")
    assert "PartitionFilters: [isnotnull(recorded_day" in recent._jdf.queryExecution().toString()
    assert readers.read_outcomes(spark, path).count() == 3
    rows = recent.collect()
    assert len(rows) == 2 and rows[0]["actually_readmitted"] == 1 and rows[0]["notes"] == "" and rows[0]["recorded_at"] is not None


def test_json_outcomes(spark, tmp_path):
    records = [{"patient_id": f"P{i}", "predicted_risk": 0.7, "actually_readmitted": 1 - i % 2, "recorded_at": "2026-03-23T18:45:04.553774", "notes": ""} for i in range(3)]
    path = write(tmp_path / "o.json", json.dumps(records, indent=2))
    rows = readers.read_outcomes(spark, path, "json").orderBy("patient_id").collect()
    assert [r["actually_readmitted"] for r in rows] == [1, 0, 1] and rows[0]["recorded_at"].microsecond == 553774
    assert readers.read_metrics(spark, str(tmp_path / "none.json"), "json").count() == 0


def test_metrics_log(spark, tmp_path):
    path = str(tmp_path / "m")
    row = spark.sql("SELECT 'improved' status, 0.5D current_auc, 0.6D new_auc, 0.1D improvement, true model_saved, timestamp'2024-01-01' retrained_at, 10L training_samples")
    writers.append_metrics(row, path)
    assert readers.read_metrics(spark, path).first()["new_auc"] == 0.6


def test_requests(spark, tmp_path):
    lines = [{"patient_id": "p", "patient_data": {"a": "2", "z": "1"}, "notify_email": "x@y"}, {"patient_data": {"a": "bad"}}]
    path = write(tmp_path / "r.json", "\n".join(json.dumps(x) for x in lines))
    rows = readers.aligned_requests(readers.read_requests(spark, path), ["a", "b"]).collect()
    assert sorted(tuple(r) for r in rows) == [("UNKNOWN", None, 0.0, 0.0), ("p", "x@y", 2.0, 0.0)]


def test_shared_folder(spark, monkeypatch, tmp_path):
    named = session.shared_dir(spark)
    assert named == session.shared_dir(spark)

    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: "/shared/")

    assert session.shared_dir(Fake) == "/shared"

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: "/house" if "warehouse" in key else default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)
    Cluster.sparkContext.master = "local[2]"
    assert session.shared_dir(Cluster) == "/house/_scratch"


def test_a_workspace_goes_with_its_job(spark):
    import os

    with pytest.raises(KeyError), session.workspace(spark, "job") as folder:
        session.materialise(spark.range(3), "t", folder)
        assert os.listdir(folder)
        raise KeyError
    assert not os.path.exists(folder)


def test_whole_numbers_with_a_point_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "n.csv", 'a,t\n5.0,"one\ntwo"\n5.5,x\n7,"say ""hi"""\n')
    rows = readers.read_csv(spark, path, "a int", multi_line=True).orderBy("t").collect()
    assert [(r["a"], r["t"]) for r in rows] == [(5, "one\ntwo"), (7, 'say "hi"'), (None, "x")]


def test_materialise_cuts_the_plan(spark):
    df = session.materialise(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()
