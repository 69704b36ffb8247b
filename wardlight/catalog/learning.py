"""Queries that split, scale, train, search, explain, score and stream."""

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.catalog import encounters as enc
from wardlight.catalog import scoring as sco
from wardlight.catalog.registry import flag, query, r
from wardlight.catalog.views import VIEWS, table
from wardlight.functions import fixed
from wardlight.functions.scalars import round_half_even
from wardlight.operators import encounters, evaluation
from wardlight.operators.linear import LinearScorer
from wardlight.plans import ensembles, explain, jobs, training
from wardlight.session import materialise, scratch_path
from wardlight.sources.readers import read_metrics, stream_requests
from wardlight.streaming import discharge, feedback, running

SCORES = ("fx_scores",)
IDS = ["encounter_id"]
NOT_FEATURES = {*fixed.ENCOUNTER_IDS, fixed.LABEL}

# -- splits and scaling, compared with SQL ---------------------------------------


@query("""sizes AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM fx_scores GROUP BY label),
shares AS (SELECT *, ceil(total * 0.2) AS tests, n * ceil(total * 0.2) / total AS exact FROM sizes),
given AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC) <= tests - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS k FROM shares)
SELECT label, 'test' AS part, k::BIGINT AS rows FROM given UNION ALL SELECT label, 'train', (n - k)::BIGINT FROM given""", SCORES)
def stratified_split_counts(spark, d):
    train, test = training.stratified_split(sco.scores(spark, d), ["row_id"], "label")
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("label", "part").agg(F.count("*").alias("rows"))


@query("""sizes AS (SELECT label, count(*) AS n FROM fx_scores GROUP BY label)
SELECT label, fold::INTEGER AS fold, (n * (fold + 1) // 5 - n * fold // 5)::BIGINT AS rows FROM sizes, range(5) t(fold)""", SCORES)
def stratified_fold_counts(spark, d):
    folds = training.stratified_folds(sco.scores(spark, d), ["row_id"], "label", output="fold")
    return folds.groupBy("label", "fold").agg(F.count("*").alias("rows"))


@query("""placed AS (SELECT label, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS total FROM fx_scores)
SELECT label, CASE WHEN place < floor(total * 0.8) THEN 'train' ELSE 'held' END AS part, count(*) AS rows FROM placed GROUP BY ALL""", SCORES)
def positional_split_counts(spark, d):
    train, held = training.positional_split(sco.scores(spark, d), "row_id", ["row_id"])
    parts = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("held")))
    return parts.groupBy("label", "part").agg(F.count("*").alias("rows"))


@query("""placed AS (SELECT label, row_number() OVER (ORDER BY row_id) - 1 AS place, DATE '2020-01-01' + (row_id % 9000)::INTEGER AS day FROM fx_scores),
cut AS (SELECT day FROM placed ORDER BY day LIMIT 1 OFFSET (SELECT floor(count(*) * 0.8)::BIGINT FROM placed)),
parts AS (SELECT CASE WHEN day < (SELECT day FROM cut) THEN 'before' WHEN day > (SELECT day FROM cut) THEN 'after' ELSE 'on the day' END AS side FROM placed)
SELECT side, count(*) AS rows, (SELECT floor(count(*) * 0.8)::BIGINT FROM placed) AS train_rows FROM parts GROUP BY side""", SCORES)
def positional_split_by_date(spark, d):
    """Split by a date: rows before, on and after the day where the training part ends."""
    rows = sco.scores(spark, d).withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("row_id") % 9000).cast("int")))
    train, held = training.positional_split(rows, "day", ["row_id"])
    last, first = train.agg(F.max("day")).first()[0], held.agg(F.min("day")).first()[0]
    side = F.when(F.col("day") < first, "before").when(F.col("day") > first, "after").otherwise("on the day")
    both = train.unionByName(held) if first >= last else held.limit(0)
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("rows"), F.lit(train.count()).cast("long").alias("train_rows"))


_Z = [f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in enc.COUNTS]


@query(enc._CLEAN + "SELECT encounter_id, " + ", ".join(f"{r(z)} AS {c}" for z, c in zip(_Z, enc.COUNTS)) + " FROM clean", enc.ENC)
def standardise(spark, d):
    rows = enc.kept(spark, d, "encounter_id", *enc.COUNTS)
    scaled = training.scale(rows, training.fit_scaling(rows, enc.COUNTS))
    return scaled.withColumns({c: round_half_even(F.col(c), 4) for c in enc.COUNTS})


@query(enc._CLEAN + ", z AS (SELECT " + ", ".join(f"{z} AS {c}" for z, c in zip(_Z, enc.COUNTS)) + " FROM clean), m AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs({c})) AS importance FROM z" for c in enc.COUNTS)
       + f") SELECT feature, {r('importance')} AS importance FROM m ORDER BY m.importance DESC LIMIT 5", enc.ENC)
def mean_absolute_features(spark, d):
    rows = enc.kept(spark, d, *enc.COUNTS)
    scaled = training.scale(rows, training.fit_scaling(rows, enc.COUNTS))
    top = evaluation.top_features(evaluation.mean_absolute(scaled, enc.COUNTS), 5)
    return top.withColumn("importance", round_half_even(F.col("importance"), 4))


# -- fitted models ----------------------------------------------------------------
# SQL cannot say what a fitted model answers, but it knows the rows of each part, how
# many trees, folds and trials there are, that a figure must equal its recount, and how
# well one feature does by itself: ``signal`` is the label, turned round where the id is
# divisible by 5. A model that finds it cannot score far below its area.
# All runs use the settings of default_models(), bootstrap_model() and RANGES.

TRIALS = 50  # of the search, as in the reference
SIGNAL = "signal"
NEAR = 0.05  # sampling error of an area on the smallest tables


def prepared(spark, d):
    """Training table, feature names, train and test rows."""
    features, stats = enc.features_table(spark, d)
    turned = F.when(F.col("encounter_id") % 5 == 0, 1 - F.col(fixed.LABEL)).otherwise(F.col(fixed.LABEL))
    data = materialise(features.withColumn(SIGNAL, turned), "encounter-features")
    names = [c for c in data.columns if c not in NOT_FEATURES]
    train, test = training.stratified_split(data, IDS)
    return data, names, train, test, stats


def signal_area(data):
    """The area of the signal alone, over all rows."""
    return evaluation.auc_value(data, SIGNAL, fixed.LABEL)


_SIGNALS = enc._STEPS + f""",
turned AS (SELECT readmitted_30d AS label, CASE WHEN encounter_id % 5 = 0 THEN 1 - readmitted_30d ELSE readmitted_30d END AS signal FROM stayed),
known AS (SELECT {r('(avg(signal) FILTER (WHERE label = 1) + avg(1 - signal) FILTER (WHERE label = 0)) / 2')} AS signal_auc FROM turned)"""
_PARTS = _SIGNALS + """,
sizes AS (SELECT readmitted_30d AS label, count(*) AS n, sum(count(*)) OVER () AS total FROM stayed GROUP BY 1),
shares AS (SELECT *, ceil(total * 0.2) AS tests, n * ceil(total * 0.2) / total AS exact FROM sizes),
given AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC) <= tests - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS k FROM shares),
parts AS (SELECT (sum(n) - sum(k))::BIGINT AS train_rows, sum(k)::BIGINT AS test_rows, sum(n - k) FILTER (WHERE label = 1)::BIGINT AS train_positives,
  sum(k) FILTER (WHERE label = 1)::BIGINT AS test_positives FROM given)
"""


def _facts_sql(name, trees):
    return _PARTS + f"SELECT '{name}' AS model, {trees} AS trees, parts.*, TRUE AS auc_is_its_recount, signal_auc, TRUE AS finds_signal FROM parts, known"


def _area(data):
    return F.lit(signal_area(data))


def _facts(spark, name, spec, d):
    """What was fitted, on which rows, whether its area on the test rows equals a recount by Spark's own evaluator and is not below that of one feature."""
    data, names, train, test, _ = prepared(spark, d)
    n0, n1 = training.class_ratio(train, fixed.LABEL)
    model = training.fit(spec, train, names, sizes=(n0, n1), ids=IDS)
    trees = 0 if spec.kind == "logistic" else model.getNumTrees
    t0, t1 = training.class_ratio(test, fixed.LABEL)
    recount = BinaryClassificationEvaluator(labelCol=fixed.LABEL, rawPredictionCol="probability", numBins=0).evaluate(model.transform(test))
    board = training.evaluate_all({name: model}, test)
    same, area = F.abs(F.col("auc") - F.lit(recount)) < 1e-9, _area(data)
    return board.select(
        "model", F.lit(trees).alias("trees"), F.lit(n0 + n1).cast("long").alias("train_rows"), F.lit(t0 + t1).cast("long").alias("test_rows"),
        F.lit(n1).cast("long").alias("train_positives"), F.lit(t1).cast("long").alias("test_positives"), same.alias("auc_is_its_recount"),
        round_half_even(area, 4).alias("signal_auc"), (F.col("auc") > area - NEAR).alias("finds_signal"))


def _train(spark, d, name):
    return _facts(spark, name, training.default_models()[name], d)


@query(_facts_sql("logistic", 0), enc.ENC)
def train_logistic(spark, d):
    return _train(spark, d, "logistic")


@query(_facts_sql("forest", 300), enc.ENC)
def train_forest(spark, d):
    return _train(spark, d, "forest")


@query(_facts_sql("boosting_a", 300), enc.ENC)
def train_boosting_a(spark, d):
    return _train(spark, d, "boosting_a")


@query(_facts_sql("boosting_b", 300), enc.ENC)
def train_boosting_b(spark, d):
    return _train(spark, d, "boosting_b")


@query(_facts_sql("bootstrap", 100), enc.ENC)
def train_bootstrap(spark, d):
    return _facts(spark, "bootstrap", training.bootstrap_model(), d)


@query(_SIGNALS + """ SELECT unnest(['logistic', 'forest', 'boosting_a', 'boosting_b']) AS model, 5 AS folds, signal_auc, TRUE AS finds_signal, TRUE AS is_a_share,
  TRUE AS std_is_its_recount FROM known""", enc.ENC)
def cross_validate(spark, d):
    """All four models in five folds; mean and deviation against the fold areas themselves and the area of the signal."""
    data, names, train, _, _ = prepared(spark, d)
    scores = training.cross_validated(training.default_models(), train, names, IDS)
    board = evaluation.mean_and_spread(scores, ["model"])
    recount = scores.groupBy("model").agg(F.count("auc").cast("int").alias("folds"), F.avg(F.col("auc") * F.col("auc")).alias("square"))
    spread, area = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), _area(data)
    return board.join(recount, "model").select(
        "model", "folds", round_half_even(area, 4).alias("signal_auc"), (F.col("mean") > area - NEAR).alias("finds_signal"),
        F.col("mean").between(0.0, 1.0).alias("is_a_share"), (F.abs(F.col("std") - spread) < 1e-6).alias("std_is_its_recount"))


_searched: dict[tuple[str, str], tuple] = {}


def _search(spark, d):
    """The search over a folder's tables; its two queries in one session share one run."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _searched:
        data, names, train, test, _ = prepared(spark, d)
        _searched[key] = (data, names, train, test, *training.search(train, names, IDS, TRIALS))
    return _searched[key]


@query(_SIGNALS + f" SELECT t::INTEGER AS trial, t < 10 AS drawn_at_random, TRUE AS in_all_ranges, signal_auc, TRUE AS finds_signal FROM range({TRIALS}) r(t), known", enc.ENC)
def random_search(spark, d):
    """The search: ten trials drawn at random, the others proposed from their scores, each in five folds."""
    data, _, _, _, board, _ = _search(spark, d)
    inside = F.lit(True)
    for n, x in training.RANGES.items():
        inside = inside & F.col(n).between(x.low, x.high)
    area = _area(data)
    return board.select("trial", F.col("log_ratio").isNull().alias("drawn_at_random"), inside.alias("in_all_ranges"),
                        round_half_even(area, 4).alias("signal_auc"), (F.col("mean") > area - NEAR).alias("finds_signal"))


@query(_PARTS + "SELECT TRUE AS best_has_the_highest_mean, TRUE AS improvement_is_the_difference, signal_auc, TRUE AS finds_signal, train_rows FROM parts, known", enc.ENC)
def refit_best(spark, d):
    data, names, train, test, board, best = _search(spark, d)
    baseline = training.fit(training.retrain_model(), train, names, ids=IDS)
    model, report = training.refit_best(best, baseline, train, test, names, ids=IDS)
    first = board.orderBy(F.desc("mean"), "trial").first()
    gain, area = (F.col("tuned_auc") - F.col("baseline_auc")) * 100, _area(data)
    return report.select(
        F.lit(all(first[n] == v for n, v in best.items()) and model.getNumTrees == first["trees"]).alias("best_has_the_highest_mean"),
        (F.abs(F.col("improvement") - gain) < 1e-9).alias("improvement_is_the_difference"), round_half_even(area, 4).alias("signal_auc"),
        (F.col("tuned_auc") > area - NEAR).alias("finds_signal"), F.lit(train.count()).cast("long").alias("train_rows"))


def _quick(spark, d):
    data, names, train, test, stats = prepared(spark, d)
    return data, names, train, test, stats, training.fit(training.default_models()["logistic"], train, names)


_RETRAINED = enc._STEPS + """, kept AS (SELECT floor(count(*) * 0.8)::BIGINT AS training_samples FROM stayed)
SELECT training_samples, TRUE AS champion_rule_kept, TRUE AS improvement_is_the_difference, '2024-06-30 00:00:00' AS retrained_at FROM kept"""


def _retrained(metrics):
    better = F.col("new_auc") > F.col("current_auc")
    return metrics.select(
        "training_samples", ((F.col("status") == F.when(better, "improved").otherwise("no_improvement")) & (F.col("model_saved") == better)).alias("champion_rule_kept"),
        (F.abs(F.col("improvement") - (F.col("new_auc") - F.col("current_auc"))) < 2e-4).alias("improvement_is_the_difference"),
        F.date_format("retrained_at", "yyyy-MM-dd HH:mm:ss").alias("retrained_at"))


@query(_RETRAINED, enc.ENC)
def retrain_gate(spark, d):
    data, names, _, _, _, current = _quick(spark, d)
    return _retrained(training.retrain(data, current, names, "encounter_id", IDS, "2024-06-30 00:00:00")[1])


@query(sco._DRIFT.strip() + ", " + enc._STEPS.strip() + f""", kept AS (SELECT floor(count(*) * 0.8)::BIGINT AS training_samples FROM stayed)
SELECT CASE WHEN drifted THEN 'drift_detected' ELSE 'no_drift' END AS status, {r('auc')} AS current_auc,
  CASE WHEN drifted THEN training_samples END AS training_samples, CASE WHEN drifted THEN 1 ELSE 0 END::BIGINT AS metrics_rows
FROM drift, kept""", ("fx_outcomes", *enc.ENC))
def learning_run(spark, d):
    """Drift check on the outcomes; if they call for it, a retraining whose metrics are appended and read back."""
    data, names, _, _, _, current = _quick(spark, d)
    base = scratch_path(spark, "learning")
    report, _ = jobs.learning_job(sco.outcomes(spark, d), data, current, names, "encounter_id", IDS, "2024-06-30 00:00:00",
                                  f"{base}/metrics", save_to=f"{base}/challenger")
    history = read_metrics(spark, f"{base}/metrics").agg(F.max("training_samples").alias("training_samples"), F.count("*").alias("metrics_rows")).first()
    return report.select("status", "current_auc", F.lit(history["training_samples"]).cast("long").alias("training_samples"),
                         F.lit(history["metrics_rows"]).cast("long").alias("metrics_rows"))


_RANKED = f"SELECT 10::BIGINT AS rows, 10::BIGINT AS features, TRUE AS in_order, TRUE AS known_features, '{SIGNAL}' AS first"


def _ranked(top, names):
    """How many features a top list holds, whether they are in order and all among the model's, and which is the first."""
    listed = [(i, r["feature"], r["importance"]) for i, r in enumerate(top.collect())]
    return top.sparkSession.createDataFrame(listed, "place int, feature string, importance double").agg(
        F.count("*").alias("rows"), F.count_distinct("feature").alias("features"),
        F.lit(all(a[2] >= b[2] for a, b in zip(listed, listed[1:]))).alias("in_order"), F.bool_and(F.col("feature").isin(names)).alias("known_features"),
        F.min_by("feature", "place").alias("first"))


@query(_RANKED)
def attribution_linear(spark, d):
    _, names, train, test, _, model = _quick(spark, d)
    return _ranked(explain.linear_attribution(model, train, test, names, IDS), names)


@query(_RANKED)
def attribution_permutation(spark, d):
    _, names, train, test, _ = prepared(spark, d)
    model = training.fit(training.default_models()["boosting_b"], train, names, ids=IDS)
    return _ranked(explain.permutation_attribution(model, test, names, IDS), names)


@query(_RANKED)
def attribution_splits(spark, d):
    _, names, train, _, _ = prepared(spark, d)
    return _ranked(explain.split_importance(training.fit(training.default_models()["forest"], train, names, ids=IDS), names, train), names)


_SHAPLEY = _PARTS + f"SELECT least(1000, test_rows)::BIGINT AS rows, TRUE AS parts_add_up, 10::BIGINT AS listed, '{SIGNAL}' AS first FROM parts"


def _shapley(spark, d, name):
    """Contributions of a sample: their sums with the base value against the margins, and the ten features with the largest mean."""
    _, names, train, test, _ = prepared(spark, d)
    model = training.fit(training.default_models()[name], train, names, ids=IDS)
    found = materialise(ensembles.contributions(model, evaluation.evaluation_sample(test, IDS), names, keep=IDS), "contributions")
    top = _ranked(evaluation.top_features(evaluation.mean_absolute(found, names), 10), names).first()
    off = F.abs(sum((F.col(f"`{n}`") for n in names), F.col("base_value")) - F.col("margin"))
    return found.agg(F.count("*").alias("rows"), (F.max(off) < 1e-9).alias("parts_add_up"),
                     F.lit(top["rows"]).cast("long").alias("listed"), F.lit(top["first"]).alias("first"))


@query(_SHAPLEY, enc.ENC)
def attribution_boosting(spark, d):
    return _shapley(spark, d, "boosting_b")


@query(_SHAPLEY, enc.ENC)
def attribution_forest(spark, d):
    return _shapley(spark, d, "forest")


_EDGE = 1e-4  # probabilities come rounded to four places, decisions and bands are taken before


def _follows(p, outcome, edges):
    """Whether an outcome is the one of its rounded probability; near an edge both neighbours are."""
    ok = F.lit(False)
    for low, high, value in edges:
        ok = ok | (p.between(low - _EDGE, high + _EDGE) & (outcome == value))
    return F.bool_and(F.coalesce(ok, F.lit(False)))


_CUT_BANDS = [(0.0, 0.3, "Low"), (0.3, 0.6, "Medium"), (0.6, 1.0, "High")]
_SCORE_FACTS = _SIGNALS + """ SELECT count(*) AS rows, sum(label)::BIGINT AS positives, TRUE AS decisions_follow, TRUE AS bands_follow, any_value(signal_auc) AS signal_auc,
  TRUE AS finds_signal FROM turned, known"""


def _score_facts(data, scored):
    p = F.col("readmission_probability")
    area, found = signal_area(data), evaluation.auc_value(scored, "readmission_probability", "actual")
    return scored.agg(
        F.count(p).alias("rows"), F.sum("actual").alias("positives"), _follows(p, F.col("predicted_readmission"), [(0.0, 0.369, 0), (0.369, 1.0, 1)]).alias("decisions_follow"),
        _follows(p, F.col("risk_level"), _CUT_BANDS).alias("bands_follow"), round_half_even(F.lit(area), 4).alias("signal_auc"), F.lit(found > area - NEAR).alias("finds_signal"))


@query(_SCORE_FACTS, enc.ENC)
def batch_score(spark, d):
    """Batch scores of a fitted model, written and read back: rows, decisions and bands that follow from the probability, and an area that finds the signal."""
    data, names, _, _, _, model = _quick(spark, d)
    return _score_facts(data, jobs.prediction_job(model, data, names, scratch_path(spark, "predictions"), keep=IDS))


@query(enc._STEPS + " SELECT count(*) AS rows, sum(readmitted_30d)::BIGINT AS positives, TRUE AS decisions_follow, TRUE AS bands_follow, count(DISTINCT encounter_id) AS encounters FROM stayed", enc.ENC)
def score_raw(spark, d):
    """Raw encounter rows through cleaning, features and a fitted model; the signal is not among them and counts as 0."""
    _, names, _, _, stats, model = _quick(spark, d)
    scored = jobs.score_raw(model, enc.raw(spark, d), names, stats, order=enc.ORDER, keep=IDS)
    p = F.col("readmission_probability")
    return scored.agg(
        F.count(p).alias("rows"), F.sum("actual").alias("positives"), _follows(p, F.col("predicted_readmission"), [(0.0, 0.369, 0), (0.369, 1.0, 1)]).alias("decisions_follow"),
        _follows(p, F.col("risk_level"), _CUT_BANDS).alias("bands_follow"), F.count_distinct("encounter_id").alias("encounters"))


@query(enc._STEPS + " SELECT count(*) AS total_scored, TRUE AS bands_add_up, TRUE AS mean_is_a_share FROM stayed", enc.ENC)
def daily_score(spark, d):
    data, names, _, _, _, model = _quick(spark, d)
    bands = F.col("high_risk") + F.col("medium_risk") + F.col("low_risk")
    return jobs.daily_job(model, data, names).select(
        "total_scored", (bands == F.col("total_scored")).alias("bands_add_up"), F.col("avg_risk").between(0.0, 1.0).alias("mean_is_a_share"))


def requests(spark, d):
    """Sparse discharge requests made from orders."""
    o = table(spark, d, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey").cast("string")).alias("patient_id"),
        F.map_filter(F.create_map(
            F.lit("time_in_hospital"), (F.col("o_orderkey") % 14).cast("string"),
            F.lit("number_inpatient"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 5).cast("string")),
            F.lit("age_numeric"), (F.col("o_custkey") % 100).cast("string"),
            F.lit("num_medications"), F.lit("unknown"),
        ), lambda k, v: v.isNotNull()).alias("patient_data"),
        F.when(F.col("o_orderkey") % 4 != 0, F.lit("team@example.org")).alias("notify_email"),
    )


_LEFT_BANDS = [(0.0, 0.3, "Low"), (0.3, 0.6, "Medium"), (0.6, 1.0, "High")]


def _response_facts(scored, *more):
    p = F.col("readmission_probability")
    percent = F.abs(F.regexp_extract("readmission_percentage", r"[0-9.]+", 0).try_cast("double") - p * 100) < 0.06
    return scored.agg(
        F.count(p).alias("rows"), F.count_distinct("patient_id").alias("patients"), F.bool_and(percent).alias("percentages_follow"),
        _follows(p, F.col("predicted_readmission"), [(0.0, 0.369, False), (0.369, 1.0, True)]).alias("decisions_follow"),
        _follows(p, F.col("risk_level"), _LEFT_BANDS).alias("bands_follow"), *more)


_FOLLOW = "TRUE AS percentages_follow, TRUE AS decisions_follow, TRUE AS bands_follow"
_ASKED = f"SELECT count(*) AS rows, count(DISTINCT CASE WHEN o_orderkey % 10 <> 0 THEN cast(o_custkey AS VARCHAR) ELSE 'UNKNOWN' END) AS patients, {_FOLLOW}"


@query(_ASKED + ", TRUE AS advised FROM orders")
def score_requests(spark, d):
    _, names, _, _, _, model = _quick(spark, d)
    return _response_facts(jobs.score_requests(model, requests(spark, d), names), F.bool_and(F.size("recommendations") > 0).alias("advised"))


@query(sco._FHIR + f" SELECT count(*) AS rows, count(DISTINCT pid) AS patients, {_FOLLOW} FROM j")
def score_fhir(spark, d):
    _, names, _, _, _, model = _quick(spark, d)
    return _response_facts(jobs.score_patients(model, sco.fhir_features(spark, d), names))


@query(_PARTS + """, one AS (SELECT test_rows - test_positives AS n0, test_positives AS n1, signal_auc FROM parts, known)
SELECT unnest(['0', '1']) AS class, unnest([n0, n1])::BIGINT AS support, TRUE AS f1_follows, signal_auc, TRUE AS finds_signal FROM one""", enc.ENC)
def evaluation_report(spark, d):
    """Support of each class in the report, F1 from its precision and recall, and the area."""
    data, names, _, test, _, model = _quick(spark, d)
    report = jobs.evaluation_job(model, test, scratch_path(spark, "evaluation"), features=names, ids=IDS)
    both = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    area, found = signal_area(data), report["roc_auc"].first()["auc"]
    return report["classification_report"].filter(F.col("class").isin("0", "1")).select(
        "class", F.col("support").cast("long").alias("support"), (F.abs(F.col("f1") - F.coalesce(both, F.lit(0.0))) < 1e-9).alias("f1_follows"),
        round_half_even(F.lit(area), 4).alias("signal_auc"), F.lit(found > area - NEAR).alias("finds_signal"))


# -- the same jobs with given coefficients, which SQL can follow --------------------
# Binary fractions, so that sums are exact in any order.

LINEAR = LinearScorer({
    "age_numeric": 0.015625, "total_prior_visits": 0.125, "num_medications": 0.03125, "high_risk_discharge": 0.5,
    "gender_male": -0.25, "time_in_hospital": 0.0625}, -3.0)
REQUEST = LinearScorer({"age_numeric": 0.015625, "time_in_hospital": 0.0625, "number_inpatient": 0.5, "num_medications": 1.0}, -2.0)
PATIENT = LinearScorer({"age_numeric": 0.015625, "num_medications": 0.03125, "number_diagnoses": 0.0625, "emergency_prone": 0.5}, -3.0)


def _linear_sql(scorer, columns=None):
    """The probability in SQL; ``columns`` says how a feature is spelt there."""
    terms = "".join(f" + {w!r}::DOUBLE * coalesce({(columns or {}).get(f, f)}, 0)" for f, w in scorer.coefficients.items())
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({scorer.intercept!r}::DOUBLE{terms})))"


_SCORED = enc._STEPS + f""",
flagged AS (SELECT *, {flag("gender = 'Male'")} AS gender_male FROM stayed),
scored AS (SELECT encounter_id, readmitted_30d AS label, {_linear_sql(LINEAR)} AS p FROM flagged)
"""
_PREDICTED = _SCORED + f"SELECT encounter_id, {r('p')} AS readmission_probability, {flag('p >= 0.369')} AS predicted_readmission, {sco._CUT} AS risk_level, label AS actual FROM scored"
_REQUESTS = f"""WITH sent AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN cast(o_custkey AS VARCHAR) ELSE 'UNKNOWN' END AS patient_id, o_custkey % 100 AS age,
  o_orderkey % 14 AS stay, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS inpatient FROM orders),
scored AS (SELECT patient_id, {_linear_sql(REQUEST, {'age_numeric': 'age', 'time_in_hospital': 'stay', 'number_inpatient': 'inpatient', 'num_medications': '0'})} AS p FROM sent)
SELECT patient_id, {r('p')} AS readmission_probability, {sco._PERCENT} AS readmission_percentage, p >= 0.369 AS predicted_readmission, {sco._BAND} AS risk_level"""


@query(_PREDICTED, enc.ENC)
def linear_batch_score(spark, d):
    data, _ = enc.features_table(spark, d)
    return jobs.score_features(LINEAR, data, list(LINEAR.coefficients), keep=IDS)


@query(_PREDICTED, enc.ENC)
def linear_score_raw(spark, d):
    learned = ["discharge_disposition_id", "race", "medical_specialty", "primary_diagnosis_code", "number_outpatient", "number_inpatient", "number_emergency", "num_lab_procedures"]
    stats = encounters.fit_encounters(enc.kept(spark, d, *learned))
    return jobs.score_raw(LINEAR, enc.raw(spark, d), list(LINEAR.coefficients), stats, order=enc.ORDER, keep=IDS)


@query(_SCORED + f"""SELECT count(p) AS total_scored, count(*) FILTER (WHERE p >= 0.6) AS high_risk, count(*) FILTER (WHERE p >= 0.3 AND p < 0.6) AS medium_risk,
  count(*) FILTER (WHERE p < 0.3) AS low_risk, {r('avg(p)')} AS avg_risk FROM scored""", enc.ENC)
def linear_daily_score(spark, d):
    return jobs.daily_job(LINEAR, enc.features_table(spark, d)[0], list(LINEAR.coefficients))


@query(_REQUESTS + f", {sco._ADVICE} AS recommendations FROM scored")
def linear_score_requests(spark, d):
    scored = jobs.score_requests(REQUEST, requests(spark, d), list(REQUEST.coefficients))
    return scored.withColumn("recommendations", F.array_join("recommendations", " | "))


@query(sco._FHIR + f""", scored AS (SELECT pid, {_linear_sql(PATIENT, {'age_numeric': 'age', 'num_medications': 'm', 'number_diagnoses': 'c', 'emergency_prone': flag('e >= 2')})} AS p FROM j)
SELECT cast(pid AS VARCHAR) AS patient_id, {r('p')} AS readmission_probability, {sco._PERCENT} AS readmission_percentage, p >= 0.369 AS predicted_readmission,
  {sco._BAND} AS risk_level FROM scored""")
def linear_score_fhir(spark, d):
    return jobs.score_patients(PATIENT, sco.fhir_features(spark, d), list(PATIENT.coefficients))


@query(_REQUESTS + " FROM scored")
def linear_stream_discharge(spark, d):
    """Requests as a stream of files, scored, written with their time and read back."""
    base = scratch_path(spark, "requests")
    requests(spark, d).write.json(f"{base}/in")
    scored = discharge.score_events(stream_requests(spark, f"{base}/in"), REQUEST, list(REQUEST.coefficients))
    discharge.run_stream(scored, f"{base}/scores", f"{base}/alerts", f"{base}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/scores").drop("query", "batch", "scored_at", "scored_day")


_PULL = [f"avg(abs({w!r}::DOUBLE * (coalesce({f}, 0) - mean_{i})))" for i, (f, w) in enumerate(LINEAR.coefficients.items())]


@query(enc._STEPS + f""",
flagged AS (SELECT *, {flag("gender = 'Male'")} AS gender_male FROM stayed),
means AS (SELECT {', '.join(f'avg(coalesce({f}, 0)) AS mean_{i}' for i, f in enumerate(LINEAR.coefficients))} FROM flagged),
pulls AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {x} AS importance FROM flagged, means" for f, x in zip(LINEAR.coefficients, _PULL))})
SELECT feature, {r('importance')} AS importance FROM pulls ORDER BY pulls.importance DESC LIMIT 5""", enc.ENC)
def linear_attribution(spark, d):
    data = materialise(enc.features_table(spark, d)[0], "encounter-features")
    top = explain.linear_attribution(LINEAR, data, data, list(LINEAR.coefficients), IDS, rows=None, top=5)
    return top.withColumn("importance", round_half_even(F.col("importance"), 4))


_REPORT = _SCORED.replace("AS p FROM flagged)", "AS p FROM flagged),\nfx_scores AS (SELECT p, label FROM scored)", 1) + "," + sco._CURVE.strip() + f""",
rated AS (SELECT *, 2.0::DOUBLE * precision * recall / (precision + recall + 1e-9::DOUBLE) AS f1 FROM pr),
best AS (SELECT * FROM rated ORDER BY f1 DESC, threshold LIMIT 1),
m AS (SELECT (count(*) FILTER (WHERE p < threshold AND label = 0))::DOUBLE AS tn, (count(*) FILTER (WHERE p >= threshold AND label = 0))::DOUBLE AS fp,
  (count(*) FILTER (WHERE p < threshold AND label = 1))::DOUBLE AS fn, (count(*) FILTER (WHERE p >= threshold AND label = 1))::DOUBLE AS tp FROM scored, best),
every AS (
  SELECT 'roc_auc' AS "table", 'auc' AS figure, sum(neg * (tp - pos + pos / 2.0::DOUBLE))::DOUBLE / (max(positives)::DOUBLE * max(negatives)::DOUBLE) AS value FROM curve
  UNION ALL SELECT 'average_precision', 'average_precision', sum(pos * precision) / sum(pos)::DOUBLE FROM pr
  UNION ALL SELECT 'best_threshold', unnest(['threshold', 'f1', 'precision', 'recall']), unnest([threshold, f1, precision, recall]) FROM best
  UNION ALL SELECT 'confusion', unnest(['tn', 'fp', 'fn', 'tp']), unnest([tn, fp, fn, tp]) FROM m
  UNION ALL SELECT 'prevalence', 'prevalence', avg(label) FROM scored
  UNION ALL SELECT 'classification_report', 'accuracy', (tn + tp) / (tn + fp + fn + tp) FROM m
  UNION ALL SELECT 'classification_report', 'recall of 1', coalesce(tp / nullif(tp + fn, 0), 0) FROM m
  UNION ALL SELECT 'roc_points', 'rows', count(*) + 1.0::DOUBLE FROM curve
  UNION ALL SELECT 'roc_points', 'mean tpr', sum(tp::DOUBLE / positives::DOUBLE) / (count(*) + 1) FROM curve
  UNION ALL SELECT 'pr_points', 'rows', count(*) + 1.0::DOUBLE FROM pr
  UNION ALL SELECT 'pr_points', 'mean precision', (sum(precision) + 1) / (count(*) + 1) FROM pr)
SELECT "table", figure, {r('value')} AS value FROM every"""


@query(_REPORT, enc.ENC)
def linear_evaluation_report(spark, d):
    """Figures from every table of the evaluation report but the attribution."""
    data = materialise(enc.features_table(spark, d)[0], "encounter-features")
    t = jobs.evaluation_job(LINEAR, data, scratch_path(spark, "evaluation"))
    wide = {
        "roc_auc": t["roc_auc"], "average_precision": t["average_precision"], "best_threshold": t["best_threshold"],
        "confusion": t["confusion"].select(*[F.col(c).cast("double").alias(c) for c in ("tn", "fp", "fn", "tp")]), "prevalence": t["prevalence"],
        "classification_report": t["classification_report"].agg(
            F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"), F.max(F.when(F.col("class") == "1", F.col("recall"))).alias("recall of 1")),
        "roc_points": t["roc_points"].agg(F.count("*").cast("double").alias("rows"), F.avg("tpr").alias("mean tpr")),
        "pr_points": t["pr_points"].agg(F.count("*").cast("double").alias("rows"), F.avg("precision").alias("mean precision")),
    }
    long = [df.unpivot([], df.columns, "figure", "value").withColumn("table", F.lit(name)) for name, df in wide.items()]
    return reduce(DataFrame.unionByName, long).withColumn("value", round_half_even(F.col("value"), 4))


# -- streams ---------------------------------------------------------------------


def _event_stream(spark, d, name):
    """A view over the events table, read as a stream of files."""
    events = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(d)
    stream.createOrReplaceTempView("events_stream")
    return spark.sql(f"SELECT {VIEWS[name][1]} FROM events_stream")


@query(f"""SELECT cast(patient_id AS VARCHAR) AS patient_id, {r('p')} AS readmission_probability, {sco._PERCENT} AS readmission_percentage,
  p >= 0.369 AS predicted_readmission, {sco._BAND} AS risk_level FROM fx_scores""", SCORES)
def stream_scores(spark, d):
    return _run_stream(spark, d)[0]


@query(sco.ALERTS_SQL, SCORES)
def stream_alerts(spark, d):
    return _run_stream(spark, d)[1]


def _run_stream(spark, d):
    scored = _event_stream(spark, d, "fx_scores").select(F.col("patient_id").cast("string"), "notify_email", "p")
    base = scratch_path(spark, "discharges")
    discharge.run_stream(scored, f"{base}/scores", f"{base}/alerts", f"{base}/checkpoint", once=True).awaitTermination()
    return (
        spark.read.parquet(f"{base}/scores").drop("query", "batch", "scored_at", "scored_day"),
        spark.read.parquet(f"{base}/alerts").drop("query", "batch"),
    )


@query("SELECT patient_id, actually_readmitted, count(*) AS rows, " + r("sum(predicted_risk)", 3) + " AS risk FROM fx_outcomes GROUP BY 1, 2",
       ("fx_outcomes",))
def stream_outcomes(spark, d):
    base = scratch_path(spark, "outcomes")
    arriving = _event_stream(spark, d, "fx_outcomes").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    feedback.append_outcome_stream(arriving, f"{base}/log", f"{base}/checkpoint", once=True).awaitTermination()
    log = spark.read.parquet(f"{base}/log")
    return log.groupBy("patient_id", "actually_readmitted").agg(
        F.count("*").alias("rows"), round_half_even(F.sum("predicted_risk"), 3).alias("risk")
    )


@query(_ASKED + " FROM orders")
def stream_discharge(spark, d):
    """A fitted model over a stream of discharge requests."""
    _, names, _, _, _, model = _quick(spark, d)
    base = scratch_path(spark, "requests")
    requests(spark, d).write.json(f"{base}/in")
    scored = discharge.score_events(stream_requests(spark, f"{base}/in"), model, names)
    discharge.run_stream(scored, f"{base}/scores", f"{base}/alerts", f"{base}/checkpoint", once=True).awaitTermination()
    return _response_facts(spark.read.parquet(f"{base}/scores"))


# -- streams with state ------------------------------------------------------------


def _arriving(spark, rows, order, files=4):
    """Rows as a stream that brings them in several batches, in ranges of a column."""
    path = scratch_path(spark, "arriving")
    rows.repartitionByRange(files, order).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(sco._DRIFT + f"""SELECT 'boosting_tuned' AS model, CASE WHEN drifted THEN 'drift_detected' ELSE 'no_drift' END AS status, n AS outcomes_count, NULL::INTEGER AS min_required,
  NULL::VARCHAR AS message, {r('auc')} AS current_auc, 0.6812::DOUBLE AS baseline_auc, drifted AS drift_detected,
  CASE WHEN drifted THEN 'Retrain model immediately' ELSE 'Model performing well' END AS recommendation FROM drift""", ("fx_outcomes",))
def running_drift(spark, d):
    """Drift after the last of several batches of outcomes, from state alone."""
    base = scratch_path(spark, "drift")
    arriving = _arriving(spark, sco.outcomes(spark, d).withColumn("recorded_at", F.col("recorded_at").cast("timestamp")), "recorded_at")
    running.run_drift(arriving, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    reports = spark.read.parquet(f"{base}/out/reports")
    return reports.filter(F.col("batch") == reports.agg(F.max("batch")).first()[0]).drop("batch")


@query("""sent AS (SELECT 'P' || patient_id AS patient_id, scored_at FROM fx_scores WHERE row_id % 2 = 0),
met AS (SELECT s.patient_id, s.scored_at, o.actually_readmitted, o.recorded_at FROM sent s LEFT JOIN fx_outcomes o ON o.patient_id = s.patient_id
  AND o.recorded_at >= s.scored_at AND o.recorded_at <= s.scored_at + INTERVAL 6 HOURS)
SELECT patient_id, count(*) AS rows, count(DISTINCT scored_at) AS discharges, count(recorded_at) AS outcomes, coalesce(sum(actually_readmitted), 0)::BIGINT AS readmitted
FROM met GROUP BY patient_id""", ("fx_scores", "fx_outcomes"))
def outcomes_meet_predictions(spark, d):
    """Scored discharges and the outcomes of the six hours after them, joined as two streams; a last row on each side lets the time pass."""
    base = scratch_path(spark, "met")
    sent = sco.scores(spark, d).filter("row_id % 2 = 0").select(F.concat(F.lit("P"), F.col("patient_id").cast("string")).alias("patient_id"), "p", F.col("scored_at").cast("timestamp").alias("scored_at"))
    told = sco.outcomes(spark, d).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    late = F.lit("2100-01-01").cast("timestamp")
    for name, rows, time in (("sent", sent, "scored_at"), ("told", told, "recorded_at")):
        end = rows.limit(1).withColumns({"patient_id": F.lit("end"), time: late})
        rows.unionByName(end).repartitionByRange(3, time).write.parquet(f"{base}/{name}")
    read = lambda name, rows: spark.readStream.schema(rows.schema).parquet(f"{base}/{name}")
    met = running.meet_outcomes(read("sent", sent), read("told", told), "6 hours")
    met.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out").filter("patient_id <> 'end'").groupBy("patient_id").agg(
        F.count("*").alias("rows"), F.count_distinct("scored_at").alias("discharges"), F.count("recorded_at").alias("outcomes"),
        F.coalesce(F.sum("actually_readmitted"), F.lit(0)).alias("readmitted"))


@query("""SELECT row_id, patient_id, position FROM (SELECT row_id, patient_id,
  row_number() OVER (PARTITION BY patient_id ORDER BY scored_at DESC, row_id DESC)::INTEGER AS position FROM fx_scores) WHERE position <= 10""", SCORES)
def running_histories(spark, d):
    """The ten newest rows of each patient, kept by state over several batches."""
    base = scratch_path(spark, "histories")
    rows = sco.scores(spark, d).select("row_id", "patient_id", F.col("scored_at").cast("timestamp").alias("scored_at"))
    running.run_history(_arriving(spark, rows, "row_id"), f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return running.latest_histories(spark.read.parquet(f"{base}/out")).select("row_id", "patient_id", "position")
