"""Type inference, the gram index and rank sketches."""

import datetime as dt

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wardlight.catalog import views
from wardlight.operators import grams, sketches
from wardlight.sources import inference, readers, schemas

SF = "/root/testdata/sf0.001"


def test_types_of_columns(spark):
    rows = [("1", "1", "2024-01-05", "a", "NA", "428", "1e3", " 7", "x"), ("-20", "2.5", "2024-02-30", "1", "", "428d", "nan", "+8 ", None),
            (None, "None", None, None, None, "250.83", "2", "9", None), ("9223372036854775808", "3", "2024-01-06", "2", "NULL", "1", "3", "1", "2024-01-01")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    got = inference.inferred_types(df)
    assert got == {"a": "double", "b": "double", "c": "string", "d": "string", "e": "string", "f": "string", "g": "double", "h": "bigint", "i": "string"}
    good = df.filter("c is null or c <> '2024-02-30'")
    assert inference.inferred_types(good)["c"] == "date" and inference.inferred_types(good, dates=False)["c"] == "string"
    assert inference.inferred_types(df.limit(0)) == dict.fromkeys(df.columns, "string")
    typed = inference.typed(good, inference.inferred_types(good))
    assert dict(typed.dtypes)["c"] == "date" and [r["h"] for r in typed.orderBy("h").collect()] == [1, 7, 9]
    assert typed.filter("c = date'2024-01-05'").count() == 1
    times = spark.createDataFrame([("2024-01-05", "2024-01-05 10:00:00"), ("2024-01-06T11:30:00Z", "x")], "a string, b string")
    found = inference.inferred_types(times)
    assert found == {"a": "timestamp", "b": "string"}
    assert inference.typed(times, found).filter("a = timestamp'2024-01-06 11:30:00'").count() == 1


def test_a_late_odd_value_is_found_whatever_the_order_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        body = "\n".join(f"{i},{i}.5" for i in range(k * 500, k * 500 + 500)) + ("\nodd,1" if k == 3 else "")
        (tmp_path / "in" / f"part{(7 * k) % 4}.csv").write_text("x,y\n" + body + "\n")
    assert dict(inference.read_inferred(spark, str(tmp_path / "in")).dtypes) == {"x": "string", "y": "double"}


def test_same_types_as_the_given_schemas(spark, tmp_path):
    kinds = {"long": "bigint", "int": "bigint", "bigint": "bigint", "double": "double", "string": "string"}
    given = {"fx_encounters": schemas.ENCOUNTERS, **{f"fx_{n}": s for n, s in schemas.HOSPITAL.items()}}
    for name, schema in given.items():
        declared = dict(spark.createDataFrame([], schema).dtypes)
        view = views.view(spark, SF, name)
        view = view.select(*[c for c in view.columns if c in declared])
        view.write.option("header", True).csv(str(tmp_path / name))
        found = dict(inference.read_inferred(spark, str(tmp_path / name)).dtypes)
        for c in view.columns:
            # Ids and codes that are declared as text but hold nothing but numbers here are numbers to any inference.
            text = declared[c] == "string" and view.filter(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).isEmpty() and found[c] != "string"
            assert text or found[c] == kinds[declared[c]], (name, c)


NAMES = ["Anna Maria", "ann", "Joanna Ångström", "Bo", "", None, "ABCABC", "xyz Anna", "Ünal", "aaaaa"]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(0)
    names = NAMES + ["".join(rng.choice(list("abcå "), rng.integers(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "id int, name string, gram string")
    grams.write_index(df, str(tmp_path / "i"), file_rows=500)
    for needle in ["", "a", "bo", "ann", "ANNA", "abcabc", "anna m", "ång", "zzz", "aaa", "a b", "cab", "%", "_"]:
        got = grams.search(spark, str(tmp_path / "i"), needle)
        want = df.filter(F.lower("name").contains(needle.lower())) if needle else df
        assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), needle
    grams.write_index(df.limit(0), str(tmp_path / "none"))
    assert grams.search(spark, str(tmp_path / "none"), "anna").count() == 0


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    df = spark.range(20_000).select("id", F.concat(F.lit("common "), F.hex(F.xxhash64("id"))).alias("name"))
    path = str(tmp_path / "i")
    grams.write_index(df, path, file_rows=50_000, group_bytes=1 << 16)
    groups = hit = 0
    gram = grams.rarest_gram(spark, path, "common 0A3")
    assert gram != "com"
    for file in (tmp_path / "i" / "postings").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(0).statistics
            groups += 1
            hit += stats.min <= gram <= stats.max
    assert groups > 20 and hit <= 0.15 * groups
    plan = grams.candidates(spark, path, "common 0A3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram," in plan


@pytest.mark.parametrize("kind", ["skewed", "ties", "sorted"])
def test_rank_error_stays_within_the_bound(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    n = 40_000
    values = {"skewed": rng.lognormal(0, 3, n), "ties": rng.integers(0, 7, n).astype(float), "sorted": np.arange(n, dtype=float)}[kind]
    rows = [(dt.date(2024, 1, 1 + int(k * 12 // n)), None if k % 97 == 0 else float("nan") if k % 89 == 0 else float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "day date, x double")
    path = str(tmp_path / "s")
    for day in range(1, 13):  # day by day, one of them twice
        sketches.append_sketches(df.filter(F.dayofmonth("day") == day), path, ["x"], "day")
    sketches.append_sketches(df.filter(F.dayofmonth("day") == 3), path, ["x"], "day")
    held = spark.read.parquet(path)
    assert held.count() == 12
    good = np.sort([x for _, x in rows if x is not None and not np.isnan(x)])
    assert sketches.merged(held, ["x"]).select(sketches.count("x")).first()[0] == len(good)
    for fraction in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0):
        found = sketches.learned(held, {"x": fraction})["x"]
        low, high = np.searchsorted(good, found, "left") / len(good), np.searchsorted(good, found, "right") / len(good)
        assert low - sketches.rank_error() <= fraction <= high + sketches.rank_error()
    keyed = sketches.day_sketches(df, ["x"], "day").limit(0)
    assert sketches.learned(keyed, {"x": 0.5})["x"] is None


def test_inference_skips_given_types(spark):
    df = spark.createDataFrame([(1, "2")], "a int, b string")
    assert inference.inferred_types(df) == {"a": "int", "b": "bigint"}
    assert readers.read_csv is not None
