import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.operators import ordering


@pytest.fixture
def small_ranges(monkeypatch):
    """Make a handful of rows count as many, so that several ranges are used."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_ranges_equal_one_sweep(spark, small_ranges, descending):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 500)
    rows = [(k / 7.0, rng.randint(0, 5), rng.randint(0, 5)) for k in keys]
    df = spark.createDataFrame(rows, "k double, a long, b long").repartition(7)
    points = ordering.split_points(df, "k")
    assert len(points) > 10
    got = {r["k"]: (r["ca"], r["cb"]) for r in ordering.running_totals(df, "k", {"a": "ca", "b": "cb"}, descending).collect()}
    a = b = 0
    for k, x, y in sorted(rows, reverse=descending):
        a, b = a + x, b + y
        assert got[k] == (a, b)
    assert len(got) == len(rows)


def test_any_split_points_give_the_same_totals(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("k"), F.lit(1).alias("n"))
    expected = [(float(i), i + 1) for i in range(100)]
    for points in ([], [50.0], [-5.0, 0.0, 99.0, 1000.0]):
        got = ordering.running_totals(df, "k", {"n": "upto"}, points=points).orderBy("k").select("k", "upto")
        assert [tuple(r) for r in got.collect()] == expected


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_exact_quantile_with_a_hot_value(spark, small_ranges, fraction):
    rng = random.Random(2)
    numbers = [7.5] * 400 + [rng.uniform(0, 20) for _ in range(801)]
    df = spark.createDataFrame([(x,) for x in numbers] + [(None,), (float("nan"),)], "x double").repartition(5)
    assert ordering.exact_quantile(df, "x", fraction) == pytest.approx(float(np.quantile(numbers, fraction)), abs=1e-12)


def test_quantile_by_rank_equals_quantile_by_aggregate(spark, monkeypatch):
    df = spark.createDataFrame([(float(x % 37),) for x in range(500)], "x double")
    direct = ordering.exact_quantile(df, "x", 0.75)
    monkeypatch.setattr(ordering, "RANGE_ROWS", 5)
    assert ordering.exact_quantile(df, "x", 0.75) == direct


def test_quantile_of_nothing(spark):
    assert ordering.exact_quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None


def test_profile_collects_levels_and_refuses_too_many(spark):
    df = spark.createDataFrame([(1, "b"), (3, "a"), (None, None), (2, "b")], "x int, t string")
    quantiles, levels = ordering.profile(df, {"x": (F.col("x"), 0.5)}, {"t": F.col("t")})
    assert quantiles == {"x": 2.0} and levels == {"t": ["a", "b"]}
    with pytest.raises(ValueError):
        ordering.profile(df, {}, {"t": F.col("t")}, max_levels=1)


def test_hash_cutoffs_are_exact_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g")).repartition(6)
    ranks = {0: [0, 1, 777, 3333], 1: [1, 1667]}
    cuts = ordering.hash_cutoffs(df, F.col("g"), ["id"], 42, ranks)
    again = ordering.hash_cutoffs(df.repartition(3), F.col("g"), ["id"], 42, ranks)
    assert cuts == again
    for g, wanted in ranks.items():
        for k, cut in zip(wanted, cuts[g]):
            kept = df.where((F.col("g") == g) & ordering.at_most(ordering.row_hash(["id"], 42), cut)).count()
            assert kept == k


def test_hash_cutoffs_more_than_there_is(spark):
    df = spark.range(10).select("id", F.lit(0).alias("g"))
    (cut,) = ordering.hash_cutoffs(df, F.col("g"), ["id"], 1, {0: [50]})[0]
    assert df.where(ordering.at_most(ordering.row_hash(["id"], 1), cut)).count() == 10


def test_rows_of_one_id_stay_together(spark):
    """A third of all rows share an id; they fall on one side as a whole."""
    df = spark.range(3000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("id"), F.lit(0).alias("g"))
    (cut,) = ordering.hash_cutoffs(df, F.col("g"), ["id"], 42, {0: [600]})[0]
    hot = df.where(F.col("id") == -1).where(ordering.at_most(ordering.row_hash(["id"], 42), cut)).count()
    assert hot in (0, 1000)


def test_first_positions_with_ties(spark, small_ranges):
    """A third of the rows share one order value and the cut falls among them."""
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("t"))
    first = ordering.first_positions(df, "t", ["id"], 0.8)
    kept = df.where(first)
    assert kept.count() == 720
    rest = df.where(~first)
    assert kept.agg(F.max("t")).first()[0] <= rest.agg(F.min("t")).first()[0]
    tied = ordering.first_positions(df, "t", ["id"], 0.5)
    assert df.where(tied).count() == 450


def test_first_positions_edges(spark):
    df = spark.range(10)
    assert df.where(ordering.first_positions(df, "id", ["id"], 0.0)).count() == 0
    assert df.where(ordering.first_positions(df, "id", ["id"], 1.0)).count() == 10


def test_hash_sample(spark):
    df = spark.range(100).repartition(5)
    one = sorted(r[0] for r in ordering.hash_sample(df, ["id"], 10).collect())
    two = sorted(r[0] for r in ordering.hash_sample(df.repartition(2), ["id"], 10).collect())
    assert one == two and len(one) == 10
    assert ordering.hash_sample(df, ["id"], 1000).count() == 100


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 1.0])
def test_grouped_quantile_spreads_a_hot_key(spark, small_ranges, fraction):
    rng = random.Random(4)
    rows = [("hot", rng.uniform(0, 100)) for _ in range(400)] + [(f"k{i % 7}", float(rng.randint(0, 30))) for i in range(300)]
    df = spark.createDataFrame([*rows, ("hot", None), ("empty", None), (None, 1.0)], "k string, v double").repartition(4)
    got = {r["k"]: r["q"] for r in ordering.grouped_quantile(df, ["k"], "v", fraction, "q").collect()}
    expected = {k: float(np.quantile([v for n, v in rows if n == k], fraction)) for k in {k for k, _ in rows}}
    assert got == pytest.approx(expected)


def test_as_many_ranges_as_the_rows_need(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("k"), F.lit(1).alias("n"))
    points = ordering.split_points(df, "k", 20)
    assert len(points) > 900
    got = ordering.running_totals(df, "k", {"n": "upto"}, points=points)
    assert got.where("upto <> k + 1").count() == 0 and got.count() == 20_000


def test_both_ways_of_grouped_quantiles_agree(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101).cast("double").alias("v"))
    one = {r["k"]: r["q"] for r in ordering.grouped_quantile(df, ["k"], "v", 0.3, "q").collect()}
    for limit in (99, 100, 101, 102, 5):
        assert {r["k"]: r["q"] for r in ordering.grouped_quantile(df, ["k"], "v", 0.3, "q", limit).collect()} == pytest.approx(one)


def test_first_positions_by_date(spark, small_ranges):
    df = spark.range(300).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("day"))
    first = ordering.first_positions(df, "day", ["id"], 0.5)
    assert df.where(first).count() == 150
    assert df.where(first).agg(F.max("day")).first()[0] <= df.where(~first).agg(F.min("day")).first()[0]
