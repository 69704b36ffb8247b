"""Grown trees against plain searches; their contributions against all subsets of features; proposals."""

from itertools import combinations
from math import factorial
from random import Random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wardlight.operators import scoring
from wardlight.plans import ensembles as e, proposals, training, trees as t
from wardlight.sources import writers

NAMES = ["a", "b", "c", "d"]


def table(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 2, n), rng.normal(size=n).round(1), rng.integers(0, 4, n)], axis=1).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 0.3) & (rng.random(n) < 0.9)).astype(float)
    return x, y


def block_of(x, y, folds=None):
    layout = t.Layout(NAMES, [np.unique(c)[:-1] for c in x.T])
    hashes = t._mixed(np.arange(len(y), dtype=np.uint64))
    return t.Block(layout.bin(list(x.T)).astype(np.int64), y, hashes, np.zeros(len(y), np.int32) if folds is None else folds), layout


def plain_tree(x, g, h, how, depth_of=None):
    """Best-first growth by trying every split of every leaf: nested dicts."""
    def shrink(v):
        return np.sign(v) * max(abs(v) - how.alpha, 0)

    def worth(rows):
        return shrink(g[rows].sum()) ** 2 / (h[rows].sum() + how.lam)

    def best(rows, depth):
        found = (t.LEAST_GAIN, None)
        if depth < how.max_depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(low), len(high)) >= how.min_rows and min(h[low].sum(), h[high].sum()) >= how.min_curvature:
                        gain = worth(low) + worth(high) - worth(rows)
                        if gain > found[0] + 1e-9:
                            found = (gain, (f, cut, low, high))
        return found

    leaf = lambda rows, depth: {"rows": rows, "depth": depth, "best": best(rows, depth)}
    leaves = [leaf(np.arange(len(g)), 0)]
    while len(leaves) < how.max_leaves:
        top = max(leaves, key=lambda n: n["best"][0])
        if top["best"][1] is None:
            break
        leaves = [n for n in leaves if n is not top]
        leaves += [leaf(r, top["depth"] + 1) for r in top["best"][1][2:]]
    out = np.zeros(len(g))
    for n in leaves:
        out[n["rows"]] = -how.learning_rate * shrink(g[n["rows"]].sum()) / (h[n["rows"]].sum() + how.lam)
    return out, len(leaves)


@pytest.mark.parametrize("how", [
    t.Growth(1, 0.3, 3), t.Growth(1, 1.0, 9, max_leaves=7), t.Growth(1, 0.1, 6, 12, min_rows=25), t.Growth(1, 1.0, 5, min_curvature=6.0),
    t.Growth(1, 0.5, 6, 10, 5, alpha=2.0, lam=3.0), t.Growth(1, 0.5, 6, alpha=1e6)])
def test_a_tree_equals_a_plain_best_first_search(how):
    x, y = table()
    block, layout = block_of(x, y)
    margins = np.linspace(-1, 1, len(y))
    fit = t.Fit(how, (0.7, 1.9))
    tree, leaf = t._grow_here(block, layout, fit, 0, margins)
    g, h = t._gradients(block, fit, margins, np.ones(len(y)))
    want, leaves = plain_tree(x, g / t.ONE, h / t.ONE, how)
    assert tree.value[leaf] == pytest.approx(want) and (tree.feature < 0).sum() == leaves
    assert (tree.leaves(x) == leaf).all() and tree.cover[0] == len(y)


def test_every_range_takes_effect():
    x, y = table()
    block, layout = block_of(x, y)
    base = {"trees": 3, "learning_rate": 0.1, "max_depth": 6, "max_leaves": 20, "min_rows": 5, "subsample": 0.9, "columns": 0.9, "alpha": 0.01, "lam": 0.01}
    margins = lambda **c: t._fit_here(block, layout, t.Fit(t.Growth(**{**base, **c})), 0, {**base, **c}["trees"])[1]
    other = {"trees": 4, "learning_rate": 0.2, "max_depth": 3, "max_leaves": 4, "min_rows": 60, "subsample": 0.5, "columns": 0.5, "alpha": 5.0, "lam": 9.0}
    assert set(other) == set(training.RANGES)
    for name, value in other.items():
        assert not np.allclose(margins(), margins(**{name: value})), name


def test_draws_have_their_shares():
    x, y = table(20_000)
    block, _ = block_of(x, y)
    assert t._drawn(block, t.Fit(t.Growth(1, subsample=0.7)), 3).mean() == pytest.approx(0.7, abs=0.02)
    times = t._drawn(block, t.Fit(t.Growth(1, forest=True)), 3)
    assert times.mean() == pytest.approx(1.0, abs=0.03) and (times == 0).mean() == pytest.approx(0.368, abs=0.02)
    assert len(t._tree_columns(t.Fit(t.Growth(1, columns=0.5)), 0, 10)) == 5


@pytest.fixture(scope="module")
def rows(spark):
    x, y = table(700)
    return spark.createDataFrame([(i, *map(float, r), int(v), i % 3, "x") for i, (r, v) in enumerate(zip(x, y, strict=True))],
                                 "id long, a double, b double, c double, d double, y int, fold int, other string").persist()


FITS = {
    "boosted": t.Fit(t.Growth(4, 0.3, 4, 9, 8, subsample=0.8, columns=0.8, alpha=0.1, lam=0.2), (1.2, 0.8), 1),
    "plain": t.Fit(t.Growth(2, 0.3, 2), fold=0),
    "deep": t.Fit(t.Growth(1, 0.3, 30, 40), fold=2),
    "forest": t.Fit(t.Growth(7, max_depth=5, forest=True, node_columns=2, min_curvature=0.0), (1.0, 2.0), 2)}


def test_blocks_do_not_change_the_trees(rows):
    layout = t.fit_layout(rows, NAMES)
    results = []
    for size in (1000, 300, 64):
        blocks, number = t.to_blocks(rows, layout, "y", ["id"], "fold", size)
        assert (number == 1) == (size == 1000) and blocks.agg(F.sum("rows")).first()[0] == 700
        grown = t.grow(FITS, blocks, number, layout)
        held = t.grow(FITS, blocks, number, layout, scores=True).scores
        results.append((grown.trees, sorted((r["model"], round(r["p"], 12), r["label"]) for r in held.collect())))
    first, scores = results[0]
    assert {n: len(v) for n, v in first.items()} == {n: f.growth.trees for n, f in FITS.items()} and len(scores) > 700
    for trees, other in results[1:]:
        assert other == scores
        for name in FITS:
            for a, b in zip(first[name], trees[name], strict=True):
                for field in ("feature", "threshold", "left", "right", "value", "cover"):
                    assert (getattr(a, field) == getattr(b, field)).all()


def test_margins_are_written_seldom(rows, monkeypatch):
    layout = t.fit_layout(rows, NAMES)
    blocks, number = t.to_blocks(rows, layout, "y", ["id"], "fold", 64)
    names, kept = [], t.materialise
    monkeypatch.setattr(t, "materialise", lambda df, name, folder=None: names.append(name) or kept(df, name, folder))
    first = t.grow(FITS, blocks, number, layout).trees
    assert "margins" not in names
    # Written twice, and with one tree of the forest at a time, the trees are the same.
    monkeypatch.setattr(t, "MARGIN_TREES", 2)
    monkeypatch.setattr(t, "OPEN_BYTES", 1)
    again = t.grow(FITS, blocks, number, layout).trees
    assert names.count("margins") == 2
    for name in FITS:
        for a, b in zip(first[name], again[name], strict=True):
            assert all((getattr(a, c) == getattr(b, c)).all() for c in ("feature", "threshold", "left", "right", "value", "cover"))


def test_odd_tables(spark, rows):
    for some in (rows.filter("y = 1"), rows.limit(1), rows.withColumn("a", F.lit(1.0)).select("id", "a", "y")):
        names = [n for n in NAMES if n in some.columns]
        model = training.fit(training.bootstrap_model().with_params(trees=2), some, names, "y", ids=["id"])
        assert scoring.with_probability(model, some).filter("p between 0 and 1").count() == some.count()
    gaps = rows.withColumn("b", F.when(F.col("id") % 2 == 0, F.col("b")))
    model = training.fit(training.default_models()["boosting_a"].with_params(trees=3), gaps, NAMES, "y")
    same = scoring.with_probability(model, gaps.fillna(0.0)).select("id", "p")
    assert sorted(same.collect()) == sorted(scoring.with_probability(model, gaps).select("id", "p").collect())
    with pytest.raises(ValueError):
        training.fit(training.bootstrap_model(), rows.limit(0), NAMES, "y")


def test_scores_survive_saving(rows, tmp_path):
    for kind in ("forest", "boosting_b"):
        model = training.fit(training.default_models()[kind].with_params(trees=4), rows, NAMES, "y", ids=["id"])
        loaded = writers.load_model(writers.save_model(model, str(tmp_path / kind)))
        both = [sorted(scoring.with_probability(m, rows).select("id", "p").collect()) for m in (model, loaded)]
        assert both[0] == both[1] and training.model_auc(model, rows, "y") > 0.8


# -- contributions ---------------------------------------------------------------------


def shapley_by_subsets(tree, row):
    """Contributions of one tree by the definition, over all subsets of features."""
    width = len(row)

    def value(known, k=0):
        f = tree.feature[k]
        if f < 0:
            return tree.value[k]
        a, b = tree.left[k], tree.right[k]
        if f in known:
            return value(known, a if row[f] <= tree.threshold[k] else b)
        return (tree.cover[a] * value(known, a) + tree.cover[b] * value(known, b)) / tree.cover[k]

    out = np.zeros(width)
    for f in range(width):
        others = [x for x in range(width) if x != f]
        for size in range(width):
            weight = factorial(size) * factorial(width - size - 1) / factorial(width)
            out[f] += weight * sum(value({*s, f}) - value(set(s)) for s in combinations(others, size))
    return out


@pytest.mark.parametrize("how", [t.Growth(3, 0.5, 3), t.Growth(2, 0.5, 12, 60), t.Growth(4, max_depth=6, forest=True, node_columns=2, min_curvature=0.0)])
def test_contributions_equal_the_definition(how):
    x, y = table()
    block, layout = block_of(x, y)
    grown, total = t._fit_here(block, layout, t.Fit(how), 0, how.trees)
    ensemble = e.Ensemble(NAMES, grown, how.forest, base=0.25)
    some = np.concatenate([x[:20], [[np.inf, -5, 0, 0]]])
    got = e.shapley_values(ensemble, some)
    want = np.array([sum(shapley_by_subsets(tree, row) for tree in grown) for row in some])
    assert got == pytest.approx(want, abs=1e-12)
    assert got.sum(axis=1) + e.expected(ensemble) == pytest.approx(ensemble.margins(some), abs=1e-9)


def test_contributions_of_any_tree_model(spark, rows):
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=4, seed=1).fit(vectors)
    boosted = GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(vectors)
    own = training.fit(training.default_models()["boosting_b"].with_params(trees=5), rows, NAMES, "y", ids=["id"])
    for model, df in ((forest, vectors), (boosted, vectors), (own, rows)):
        p = {r["id"]: r["p"] for r in scoring.with_probability(model, df).select("id", "p").collect()}
        found = e.contributions(model, rows, NAMES, keep=["id"])
        assert found.columns == ["id", *NAMES, "base_value", "margin"]
        ensemble = e.ensemble_of(model, NAMES)
        for r in found.collect():
            assert sum(r[f] for f in NAMES) + r["base_value"] == pytest.approx(r["margin"], abs=1e-9)
            shown = r["margin"] if ensemble.shares else 1 / (1 + np.exp(-ensemble.steepness * r["margin"]))
            assert shown == pytest.approx(p[r["id"]], abs=1e-9)
    with pytest.raises(TypeError):
        e.ensemble_of(training.fit(training.default_models()["logistic"], rows, NAMES, "y"), NAMES)


# -- proposals -------------------------------------------------------------------------


def goal(values):
    """Highest, 0, in one place of the tuned ranges."""
    best = {"trees": 0.8, "learning_rate": 0.3, "max_depth": 0.5, "max_leaves": 0.2, "min_rows": 0.9, "subsample": 0.5, "columns": 0.4, "alpha": 0.7, "lam": 0.1}
    return -sum((r.unit(values[n]) - best[n]) ** 2 for n, r in training.RANGES.items())


def test_proposals_beat_random_draws_by_a_third():
    informed, random = [], []
    for seed in range(10):
        study = proposals.Study(training.RANGES, seed)
        while len(study.trials) < 50:
            for p in study.propose(10):
                study.learn(p.values, goal(p.values))
        informed.append(-max(s for _, s in study.trials))
        blind = proposals.Study(training.RANGES, seed, startup=50)
        random.append(-max(goal(p.values) for p in blind.propose(50)))
    assert np.mean(informed) < 0.67 * np.mean(random)


def test_proposals_are_seeded_and_in_range():
    def run():
        study = proposals.Study(training.RANGES, 5, startup=3)
        out = []
        for n in (3, 4, 4):
            asked = study.propose(n)
            out += asked
            for p in asked:
                study.learn(p.values, 0.5)  # ties
        return out

    first = run()
    assert first == run() and [p.log_ratio is None for p in first] == [True] * 3 + [False] * 8
    for p in first:
        for n, r in training.RANGES.items():
            assert r.low <= p.values[n] <= r.high and isinstance(p.values[n], int) == r.whole
    for r in training.RANGES.values():
        assert r.value(0.0) == pytest.approx(r.low) and r.value(1.0) == pytest.approx(r.high)


def test_density_is_one():
    d = proposals.Density([0.0, 0.2, 0.2, 1.0])
    x = (np.arange(20_000) + 0.5) / 20_000
    assert np.mean([d.at(v) for v in x]) == pytest.approx(1.0, abs=1e-3)
    assert 0 <= d.draw(Random(1)) <= 1


def test_features_of_few_bins_are_counted_together():
    rng = np.random.default_rng(3)
    n, sizes = 500, [2, 2, 3, 2, 300, 2, 4, 1, 2]
    layout = t.Layout([f"f{k}" for k in range(len(sizes))], [np.arange(s - 1.0) for s in sizes])
    assert layout.groups == [(0, 4), (4, 5), (5, 9)]
    bins = layout.bin([rng.integers(0, s, n).astype(float) for s in sizes])
    g, h, slot = rng.integers(-9, 9, n).astype(float), rng.integers(1, 9, n).astype(float), rng.integers(0, 3, n)
    wanted = np.array([True, False, True, True, True, False, False, False, True])
    rows = np.flatnonzero(rng.random(n) < 0.7)
    block = t.Block(bins, np.zeros(n), np.zeros(n, np.uint64), np.zeros(n, np.int32))
    got = t.histograms(block.coded(layout), layout, wanted, rows, slot[rows], 3, g[rows], h[rows])
    want = np.zeros((3, 3, layout.total))
    for r in rows:
        for b in bins[r, wanted]:
            want[:, slot[r], b] += g[r], h[r], 1
    assert (got == want).all()


def _sums_by_rows(layout, bins, rows, slot, g, h, slots):
    want = np.zeros((3, slots, layout.total))
    for column in bins.T:
        for n, weight in enumerate((g, h, np.ones(len(g)))):
            np.add.at(want[n], (slot[rows], column[rows]), weight[rows])
    return want


def test_features_that_follow_from_others_add_no_codes():
    rng = np.random.default_rng(5)
    n = 3000
    a, b, kind = rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(0, 12, n)
    columns = [a, kind == 3, b, *[kind == k for k in range(4, 12)], a + b, a * b, a > 4, b > 4, (a + b) % 7]
    layout = t.Layout([f"f{k}" for k in range(len(columns))], [np.unique(c)[:-1].astype(float) for c in columns])
    bins = layout.bin([c.astype(float) for c in columns])
    codes = t.Block(bins, np.zeros(n), np.zeros(n, np.uint64), np.zeros(n, np.int32)).coded(layout)
    assert len(codes) == 2 and max(c.size for c in codes) <= t.OCCURRING
    assert sorted(f for c in codes for f in c.features) == list(range(len(columns)))
    for c in codes:
        assert (c.bins[:, c.code].T == bins[:, c.features]).all()


def test_codes_are_those_of_all_rows_not_of_the_sample():
    rng = np.random.default_rng(6)
    n = 3 * t.SAMPLED
    x = rng.integers(0, 200, (n, 3))
    x[::3] = 0  # all that the sample sees
    layout = t.Layout(["a", "b", "c"], [np.arange(199.0)] * 3)
    bins = layout.bin(list(x.T.astype(float)))
    g, h, slot = rng.integers(-9, 9, n).astype(float), rng.integers(1, 9, n).astype(float), rng.integers(0, 2, n)
    codes = t.Block(bins, np.zeros(n), np.zeros(n, np.uint64), np.zeros(n, np.int32)).coded(layout)
    assert len(codes) == 3
    rows = np.flatnonzero(rng.random(n) < 0.5)
    got = t.histograms(codes, layout, np.ones(3, bool), rows, slot[rows], 2, g[rows], h[rows])
    assert (got == _sums_by_rows(layout, bins, rows, slot, g, h, 2)).all()


def test_half_a_million_rows_are_one_block(spark):
    rows = spark.range(550_000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    layout = t.fit_layout(rows, ["a"])
    blocks, number = t.to_blocks(rows, layout, "y", ["id"])
    assert number == 1
    tree = t.grow({"m": t.Fit(t.Growth(1, max_depth=2))}, blocks, number, layout).trees["m"][0]
    assert tree.cover[0] == 550_000


def test_models_over_several_blocks_grow_without_a_job_for_each_level(rows, monkeypatch):
    layout = t.fit_layout(rows, NAMES)
    blocks, number = t.to_blocks(rows, layout, "y", ["id"], "fold", 64)
    fits = {**FITS, "none": t.Fit(t.Growth(0), fold=1)}
    jobs = lambda: rows.sparkSession.sparkContext.statusTracker().getJobIdsForGroup("trees")
    rows.sparkSession.sparkContext.setJobGroup("trees", "")
    try:
        grown = t.grow(fits, blocks, number, layout)
        assert len(jobs()) < 6
        held = t.grow(fits, blocks, number, layout, scores=True).scores
    finally:
        rows.sparkSession.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Without tasks side by side, a pass for each level.
    monkeypatch.setattr(t.exchange, "side_by_side", lambda spark: 0)
    passes = t.grow(fits, blocks, number, layout)
    scored = lambda df: sorted((r["model"], r["p"], r["label"]) for r in df.collect())
    assert scored(held) == scored(t.grow(fits, blocks, number, layout, scores=True).scores)
    for name in fits:
        assert len(grown.trees[name]) == fits[name].growth.trees
        for a, b in zip(grown.trees[name], passes.trees[name], strict=True):
            assert all((getattr(a, c) == getattr(b, c)).all() for c in ("feature", "threshold", "left", "right", "value", "cover"))


def test_more_tasks_than_features_share_the_bins():
    layout = t.Layout(["a", "b", "c"], [np.arange(200.0), np.arange(1.0), np.arange(30.0)])
    for tasks in (1, 2, 3, 8):
        shares = t._shares(layout, tasks)
        assert len(shares) == tasks and [f for a, b in shares for f in range(a, b)] == [0, 1, 2]
