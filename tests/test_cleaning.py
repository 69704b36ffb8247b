import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from wardlight.operators import cleaning as c


def test_sentinel_is_whole_cell_and_text_only(spark):
    df = spark.createDataFrame([("?", 1, "a?b"), ("x", 2, None)], "a string, n int, b string")
    assert [tuple(r) for r in c.sentinel_to_null(df).collect()] == [(None, 1, "a?b"), ("x", 2, None)]


def test_tokens_and_nan_to_null(spark):
    df = spark.createDataFrame([("NA", float("nan")), ("ok", 1.0), ("None", 2.0)], "a string, x double")
    assert [tuple(r) for r in c.tokens_to_null(df).collect()] == [(None, None), ("ok", 1.0), (None, 2.0)]


def test_drop_strict_and_present(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert c.drop_strict(df, ["a"]).columns == ["b"]
    with pytest.raises(KeyError):
        c.drop_strict(df, ["nope"])
    assert c.drop_present(df, ["nope", "b"]).columns == ["a"]


def test_contract_alignment(spark):
    df = spark.createDataFrame([(True, "7", "x", float("nan"), None)], "b boolean, s string, t string, d double, i int")
    got = c.align_to_contract(df, ["i", "missing", "d", "t", "s", "b"])
    assert got.columns == ["i", "missing", "d", "t", "s", "b"]
    assert tuple(got.first()) == (0.0, 0.0, 0.0, 0.0, 7.0, 1.0)


def test_align_map_ignores_extra_keys(spark):
    df = spark.createDataFrame([("p", {"a": "1.5", "z": "9"}), ("q", None)], "id string, m map<string,string>")
    got = [tuple(r) for r in c.align_map(df, "m", ["a", "b"], keep=["id"]).collect()]
    assert got == [("p", 1.5, 0.0), ("q", 0.0, 0.0)]


def test_align_map_reads_a_rows_texts_once(spark):
    df = spark.createDataFrame([("p", {"f3": " 1.5 ", "f7": "428d", "f9": None, "z": "9"}), ("q", {}), ("r", None)], "id string, m map<string,string>")
    names = [f"f{i}" for i in range(50)]
    rows = {r["id"]: [r[n] for n in names] for r in c.align_map(df, "m", names, keep=["id"]).collect()}
    assert rows["p"] == [1.5 if n == "f3" else 0.0 for n in names] and rows["q"] == rows["r"] == [0.0] * 50
    # Texts are matched inside one expression over the map, which all features share; not by one of their own.
    plan = c.align_map(df, "m", names[:10])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") == plan.count("transform_values(") > 0


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1", True, None, "id1"), ("bad", False, 2, "id2")], "s string, b boolean, i int, key string")
    assert [tuple(r) for r in c.coerce_numeric(df, keep=["key"]).collect()] == [(1.0, 1.0, 0.0, "id1"), (0.0, 0.0, 2.0, "id2")]
    with pytest.raises(TypeError):
        c.coerce_numeric(spark.sql("SELECT current_date() AS d"))


def test_fill_numeric_leaves_texts(spark):
    df = spark.createDataFrame([(None, None)], "x double, t string")
    assert tuple(c.fill_numeric(df).first()) == (0.0, None)


def test_label_search(spark):
    assert c.find_label(["a", "Readmitted_30d", "readmit2"]) == "Readmitted_30d"
    with pytest.raises(ValueError):
        c.find_label(["a"])
    df = spark.createDataFrame([(1, 0)], "a int, readmitted_30d int")
    assert c.features_and_label(df) == (["a"], "readmitted_30d")
    with pytest.raises(KeyError):
        c.features_and_label(df, "other")


def test_disposition_filter_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (11,), (13,), (19,), (25,), (None,)], "discharge_disposition_id int")
    assert [r[0] for r in c.exclude_dispositions(df).collect()] == [1, 25, None]


def test_first_per_key_prunes_before_the_shuffle(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id").repartition(8)
    first = c.first_per_key(df, ["k"], ["id"])
    plan = plan_of(first)
    assert plan.count("WindowGroupLimit") >= 2
    assert first.where("k = 0").first()["id"] == 0 and first.count() == 2001
    nulls = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, id int")
    assert sorted((r["k"] or 0, r["id"]) for r in c.first_per_key(nulls, ["k"], ["id"]).collect()) == [(0, 1), (1, 3)]


def test_newest(spark):
    df = spark.createDataFrame([("a", i) for i in range(15)] + [("b", 1)], "k string, t int")
    assert [r["t"] for r in c.newest(df, [F.desc("t")], 3).collect()] == [14, 13, 12]
    per_key = c.newest_per_key(df, ["k"], [F.desc("t")]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in per_key} == {"a": 10, "b": 1}


def test_append_rows(spark):
    log = spark.createDataFrame([("a", 1)], "k string, n int")
    new = spark.createDataFrame([(2, "b")], "n int, k string")
    assert sorted(tuple(r) for r in c.append_rows(log, new).collect()) == [("a", 1), ("b", 2)]


def test_search_by_name(spark):
    df = spark.createDataFrame([("2", "Ann Lee"), ("1", "ANNA"), ("3", "Bob")], "id string, name string")
    assert [r["id"] for r in c.search_by_name(df, "ann").collect()] == ["1", "2"]
    assert [r["id"] for r in c.search_by_name(df, "", 2).collect()] == ["1", "2"]
