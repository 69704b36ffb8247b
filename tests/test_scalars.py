from datetime import date

import pytest
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.functions import scalars as s


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_flags_never_null(spark):
    assert values(spark, s.elderly_flag(F.col("a")), [64, 65, None], "a int") == [0, 1, 0]
    assert values(spark, s.nz(F.col("a") == "Ch"), ["Ch", "No", None], "a string") == [1, 0, 0]


def test_label_modes(spark):
    rows = ["NO", ">30", "<30", None]
    assert values(spark, s.readmission_label(F.col("a")), rows, "a string") == [0, 1, 1, 1]
    assert values(spark, s.readmission_label(F.col("a"), "lt30"), rows, "a string") == [0, 0, 1, 0]
    with pytest.raises(ValueError):
        s.readmission_label(F.col("a"), "other")


def test_age_midpoint_and_band(spark):
    brackets = [*fixed.AGE_MIDPOINTS, "[100-110)", None]
    assert values(spark, s.age_midpoint(F.col("a")), brackets, "a string") == [5, 15, 25, 35, 45, 55, 65, 75, 85, 95, None, None]
    ages = [0, 1, 30, 31, 50, 65, 66, 80, 81, 100, 101, None]
    assert values(spark, s.age_band(F.col("a")), ages, "a int") == [
        None, "<30", "<30", "30-50", "30-50", "50-65", "65-80", "65-80", "80+", "80+", None, None]


def test_diagnosis_category(spark):
    cases = {"428": "Circulatory", "785": "Circulatory", "459": "Circulatory", "459.5": "Other", "786": "Respiratory",
             "787": "Digestive", "250.83": "Diabetes", "250.99": "Diabetes", "251": "Other", "800": "Injury", "999": "Injury",
             "739": "Musculoskeletal", "788": "Genitourinary", "239": "Neoplasms", "V57": "External", "E885": "External",
             "428d": "Unknown", "?": "Unknown", "nan": "Unknown", " 428 ": "Circulatory", "1_0": "Unknown"}
    got = values(spark, s.diagnosis_category(F.col("a")), [*cases, None], "a string")
    assert dict(zip([*cases, None], got)) == {**cases, None: "Unknown"}


def test_ordinal_levels(spark):
    assert values(spark, s.ordinal(F.col("a"), fixed.GLUCOSE_LEVELS), ["None", "Norm", ">200", ">300", "?", None], "a string") == [0, 1, 2, 3, 0, 0]


def test_lenient_parsing(spark):
    texts = ["1", " 2.5 ", "+3e2", "-.5", "428d", "nan", "inf", "1_000", "", None]
    assert values(spark, s.lenient_double(F.col("a")), texts, "a string") == [1.0, 2.5, 300.0, -0.5, None, None, None, None, None, None]
    dates = ["2024-02-29", "2023-02-29", "garbage", " 2024-1-5", None]
    assert values(spark, s.lenient_date(F.col("a")), dates, "a string") == [date(2024, 2, 29), None, None, date(2024, 1, 5), None]
    assert values(spark, s.lenient_date(F.col("a"), "dd/MM/yyyy"), ["05/02/2024", "x"], "a string") == [date(2024, 2, 5), None]


def test_rounding_follows_array_libraries(spark):
    import numpy as np

    numbers = [0.125, 1.005, 1.015, 2.675, -0.125, 50.005]
    assert values(spark, s.round_half_even(F.col("a"), 2), numbers, "a double") == list(np.round(numbers, 2))


def test_weekend_and_ages(spark):
    saturday, monday = date(2024, 6, 29), date(2024, 7, 1)
    assert values(spark, s.weekend_flag(F.col("a")), [saturday, monday, None], "a date") == [1, 0, 0]
    births = [date(1958, 12, 31), None]
    assert values(spark, s.age_in_years(F.col("a"), F.lit(date(2024, 1, 1))), births, "a date") == [65.0, None]
    assert values(spark, s.whole_age(F.col("a"), F.lit(date(2024, 1, 1))), births, "a date") == [65, 0]


def test_bands_disagree_at_the_cuts(spark):
    p = [0.0, 0.3, 0.369, 0.6, 1.0]
    assert values(spark, s.risk_band(F.col("a")), p, "a double") == ["Low", "Medium", "Medium", "High", "High"]
    assert values(spark, s.risk_band_cut(F.col("a")), p, "a double") == [None, "Low", "Medium", "Medium", "High"]
    assert values(spark, s.decision(F.col("a")), [0.36899, 0.369, None], "a double") == [0, 1, 0]


def test_percent_text(spark):
    assert values(spark, s.percent_text(F.col("a")), [0.1225, 0.5, 1.0], "a double") == ["12.2%", "50.0%", "100.0%"]


def test_recommendations(spark):
    got = values(spark, s.recommendations(F.col("a")), ["High", "Medium", "Low", "Unknown"], "a string")
    assert [len(x) for x in got] == [4, 3, 2, 0]


def test_encounter_class_order(spark):
    codes = ["inp", "ACUTE", "outp", "Emer", "IMP", "", "outinp"]
    assert values(spark, s.encounter_class(F.col("a")), codes, "a string") == ["inpatient", "inpatient", "outpatient", "emergency", None, None, "inpatient"]


def test_full_name(spark):
    schema = "name array<struct<given:array<string>,family:string>>"
    rows = [([(["Ann", "B"], "Lee")],), ([(["Ann"], None)],), ([(None, "Lee")],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(s.full_name(F.col("name"))).collect()]
    assert got == ["Ann B Lee", "Ann", "Lee", "", ""]


def test_one_hot_drops_first_level(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "k string")
    got = df.select(*s.one_hot("k", ["a", "b", "c"]))
    assert got.columns == ["k_b", "k_c"]
    assert [tuple(r) for r in got.collect()] == [(0, 0), (1, 0), (0, 1), (0, 0), (0, 0)]


def test_dates_end_with_the_date_or_a_time(spark):
    texts = ["2024-01-05", " 2024-1-5 ", "2024-01-05 10:30:00", "2024-01-05T10:30:00Z", "2024-01-05 junk", "01/02/2024", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(s.lenient_date(F.col("t"))).collect()]
    assert [str(x) if x else None for x in got] == ["2024-01-05"] * 4 + [None] * 3
    assert str(df.select(s.lenient_date(F.col("t"), "dd/MM/yyyy")).collect()[5][0]) == "2024-02-01"


def test_text_of_no_probability(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "p double")
    assert [tuple(r) for r in df.select(s.percent_text(F.col("p")), s.risk_band(F.col("p")), s.risk_band_cut(F.col("p")), s.decision(F.col("p"))).collect()] \
        == [(None, "Low", None, 0)] * 2
