"""Training jobs: split, scale, fit, cross-validate, tune, retrain. Logistic models are Spark's, trees are grown by ``plans.trees``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from math import ceil, sqrt
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import fixed
from wardlight.operators.cleaning import as_number
from wardlight.operators.evaluation import auc_value, grouped_auc, mean_and_spread
from wardlight.operators.ordering import at_most, first_positions, hash_cutoffs, row_hash
from wardlight.operators.scoring import with_probability
from wardlight.plans import proposals, trees
from wardlight.plans.ensembles import Ensemble, TreeScorer
from wardlight.session import materialise, workspace

SEED = 42
WEIGHT = "_weight"
FOLD = "_fold"
PARTITION_ROWS = 50_000


# -- splits -------------------------------------------------------------------

def _class_sizes(df: DataFrame, label: str) -> dict[object, int]:
    rows = df.groupBy(label).count().limit(4).collect()
    if len([r for r in rows if r[label] is not None]) > 2:
        raise ValueError(f"{label} has more than two classes")
    return {r[label]: r["count"] for r in sorted(rows, key=lambda r: (r[label] is None, r[label]))}


def _shares(sizes: Mapping[object, int], total: int) -> dict[object, int]:
    """Spread ``total`` over the classes in proportion, largest remainders first."""
    everything = sum(sizes.values())
    exact = {c: n * total / everything for c, n in sizes.items()}
    given = {c: int(x) for c, x in exact.items()}
    by_remainder = sorted(exact, key=lambda c: given[c] - exact[c])
    for c in by_remainder[: total - sum(given.values())]:
        given[c] += 1
    return given


def stratified_split(
    df: DataFrame, ids: Sequence[str], label: str = fixed.LABEL, test_size: float = 0.2, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the class ratio kept, exact when ids are unique.

    A row is a test row if the hash of its id is at or below the cutoff of its
    class, so both parts are filters on the input; only counts were shuffled.
    """
    sizes = _class_sizes(df, label)
    wanted = _shares(sizes, ceil(test_size * sum(sizes.values())))
    cuts = hash_cutoffs(df, F.col(label), ids, seed, {c: [k] for c, k in wanted.items()})
    hashed = row_hash(ids, seed)
    test = F.lit(False)
    for c, (cut,) in cuts.items():
        test = test | (F.col(label).eqNullSafe(F.lit(c)) & at_most(hashed, cut))
    return df.where(~test), df.where(test)


def stratified_folds(
    df: DataFrame, ids: Sequence[str], label: str = fixed.LABEL, folds: int = 5, seed: int = SEED, output: str = FOLD
) -> DataFrame:
    """Add a fold number 0..folds-1; the sizes within a class differ by at most one."""
    sizes = _class_sizes(df, label)
    edges = {c: [n * i // folds for i in range(1, folds)] for c, n in sizes.items()}
    cuts = hash_cutoffs(df, F.col(label), ids, seed, edges)
    hashed = row_hash(ids, seed)
    number = None
    for c, values in cuts.items():
        within = F.lit(0)
        for cut in values:
            within = within + (~at_most(hashed, cut)).cast("int")
        here = F.col(label).eqNullSafe(F.lit(c))
        number = F.when(here, within) if number is None else number.when(here, within)
    return df.withColumn(output, number)


def positional_split(
    df: DataFrame, order: str, ids: Sequence[str], share: float = 0.8, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """First ``share`` of the rows in the order of a column, and the rest."""
    first = first_positions(df, order, ids, share, seed)
    return df.where(first), df.where(~first)


# -- scaling and weights -------------------------------------------------------

def fit_scaling(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature in one pass; deviation 0 scales by 1."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df.select(*[f"`{f}`" for f in features]))
    row = vectors.agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("s")).first()["s"]
    n = row["count"]
    if not n:
        return {f: (0.0, 1.0) for f in features}
    spread = [sqrt(v * (n - 1) / n) for v in row["variance"]]
    return {f: (float(m), float(s) or 1.0) for f, m, s in zip(features, row["mean"], spread)}


def scale(df: DataFrame, scaling: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f"`{f}`") - F.lit(m)) / F.lit(s) for f, (m, s) in scaling.items()})


def numbers(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features as numbers, 0 where they are unknown, beside the ``keep`` columns."""
    return df.select(
        *[f"`{c}`" for c in keep], *[F.coalesce(as_number(df, f), F.lit(0.0)).alias(f) for f in features if f not in keep])


def _scaling_stage(scaling: Mapping[str, tuple[float, float]]) -> SQLTransformer:
    """Numbers, 0 where unknown, scaled. The stage is part of the model, so scoring treats nulls as training does."""
    known = [f"coalesce(nanvl(try_cast(`{f}` AS DOUBLE), NULL), 0D)" for f in scaling]
    scaled = ", ".join(f"({k} - ({m!r}D)) / {s!r}D AS `_z{i}`" for i, (k, (m, s)) in enumerate(zip(known, scaling.values())))
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def class_ratio(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    return row["n0"], row["n1"]


def class_weight(scheme: str, sizes: tuple[int, int]) -> tuple[float, float]:
    """Weights of the two classes: ``balanced``, ``ratio`` (positives n0/n1) or ``none``."""
    n0, n1 = sizes
    if scheme not in ("none", "balanced", "ratio"):
        raise ValueError(scheme)
    if scheme == "none" or not n0 or not n1:
        return 1.0, 1.0
    return ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if scheme == "balanced" else (1.0, n0 / n1)


def weighted(df: DataFrame, label: str, scheme: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Add the row weight of a scheme."""
    zero, one = class_weight(scheme, sizes or class_ratio(df, label))
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(one)).otherwise(F.lit(zero)))


# -- models -------------------------------------------------------------------

@dataclass(frozen=True)
class ModelSpec:
    """What to fit: a kind, its class weighting and its parameters."""

    kind: str
    weighting: str
    params: Mapping[str, object]
    scaled: bool = False

    def with_params(self, **changes) -> "ModelSpec":
        return ModelSpec(self.kind, self.weighting, {**self.params, **changes}, self.scaled)


def default_models() -> dict[str, ModelSpec]:
    """The four models that are trained and compared."""
    return {
        "logistic": ModelSpec("logistic", "balanced", {"c": 0.1, "maxIter": 1000}, scaled=True),
        "forest": ModelSpec("forest", "balanced", {"trees": 300, "max_depth": 8}),
        "boosting_a": ModelSpec("boosting", "ratio", {
            "trees": 300, "learning_rate": 0.05, "max_depth": 5, "subsample": 0.8, "columns": 0.8, "lam": 1.0, "min_curvature": 1.0}),
        "boosting_b": ModelSpec("boosting", "balanced", {
            "trees": 300, "learning_rate": 0.05, "max_depth": 6, "max_leaves": 31, "min_rows": 20}),
    }


def retrain_model() -> ModelSpec:
    return default_models()["boosting_b"]


def bootstrap_model(balanced: bool = False) -> ModelSpec:
    """The quick model a fresh installation starts with."""
    return ModelSpec("boosting", "balanced" if balanced else "none", {"trees": 100, "learning_rate": 0.05, "max_depth": 3})


def logistic(spec: ModelSpec, rows: int, label: str) -> LogisticRegression:
    params = dict(spec.params)
    # The penalty is stated per data set; Spark's is per unit of weight.
    strength = 1.0 / (params.pop("c") * rows)
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol=WEIGHT, regParam=strength, elasticNetParam=0.0,
                              standardization=False, **params)


def growth(spec: ModelSpec, features: int) -> trees.Growth:
    """How a tree model grows. A forest looks at the root of the number of features at each node."""
    if spec.kind == "boosting":
        return trees.Growth(**spec.params)
    if spec.kind == "forest":
        return trees.Growth(**{"forest": True, "min_curvature": 0.0, "node_columns": max(1, int(sqrt(features))), **spec.params})
    raise ValueError(spec.kind)


def _inputs(spec: ModelSpec, df: DataFrame, features: Sequence[str]) -> list:
    scaling = fit_scaling(numbers(df, features), features) if spec.scaled else {f: (0.0, 1.0) for f in features}
    names = [f"_z{i}" for i in range(len(features))]
    return [_scaling_stage(scaling), VectorAssembler(inputCols=names, outputCol="features")]


def compact(df: DataFrame, rows: int) -> DataFrame:
    """As few partitions as ``rows`` need: every step of a fit is a job over all of them."""
    return df.coalesce(max(1, -(-rows // PARTITION_ROWS)))


def _tree_table(df: DataFrame, features: Sequence[str], ids: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    return numbers(df, features, dict.fromkeys([label, *ids, *keep]))


def fit(
    spec: ModelSpec, train: DataFrame, features: Sequence[str], label: str = fixed.LABEL, sizes: tuple[int, int] | None = None,
    ids: Sequence[str] = (), block_rows: int = trees.BLOCK_ROWS,
) -> PipelineModel | TreeScorer:
    """Fit one model. It makes numbers of its features (0 where unknown) and holds its own scaling,
    learned on ``train``. ``sizes`` are the rows of both classes, where the caller knows them. Which rows a tree
    sees is drawn by the hash of their ``ids``, without any by that of their features."""
    n0, n1 = sizes or class_ratio(train, label)
    if spec.kind != "logistic":
        how = growth(spec, len(features))
        table = _tree_table(train, features, ids, label)
        layout = trees.fit_layout(table, features)
        with workspace(train.sparkSession, "fit") as folder:
            blocks, number = trees.to_blocks(table, layout, label, ids or features, block_rows=block_rows, rows=n0 + n1, folder=folder)
            found = trees.grow({"model": trees.Fit(how, class_weight(spec.weighting, (n0, n1)))}, blocks, number, layout, folder=folder)
        return _scorer(found.trees["model"], how, features)
    data = weighted(train.select(label, *[f"`{f}`" for f in features]), label, spec.weighting, (n0, n1))
    inputs = _inputs(spec, train, features)
    assembled = Pipeline(stages=inputs).fit(data).transform(data).select(label, WEIGHT, "features")
    kept = compact(assembled, n0 + n1).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel(stages=[*inputs, logistic(spec, n0 + n1, label).fit(kept)])
    finally:
        kept.unpersist()


def _scorer(grown: list[trees.Tree], how: trees.Growth, features: Sequence[str]) -> TreeScorer:
    if how.forest:
        for t in grown:
            t.value = t.value / len(grown)
    return TreeScorer(Ensemble(list(features), grown, how.forest))


def fit_all(
    specs: Mapping[str, ModelSpec], train: DataFrame, features: Sequence[str], label: str = fixed.LABEL,
    sizes: tuple[int, int] | None = None, ids: Sequence[str] = (),
) -> dict[str, PipelineModel | TreeScorer]:
    sizes = sizes or class_ratio(train, label)
    return {name: fit(spec, train, features, label, sizes, ids) for name, spec in specs.items()}


def model_auc(model: PipelineModel, df: DataFrame, label: str = fixed.LABEL) -> float | None:
    return auc_value(with_probability(model, df), "p", label)


def evaluate_all(models: Mapping[str, PipelineModel], test: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    """Leaderboard of test AUC, best first."""
    rows = [(name, model_auc(model, test, label)) for name, model in models.items()]
    rows.sort(key=lambda r: (-(r[1] or 0.0), r[0]))
    return test.sparkSession.createDataFrame(rows, "model string, auc double")


# -- cross-validation and search ----------------------------------------------

def fold_scores(
    spec: ModelSpec, prepared: DataFrame, rows: int, label: str, folds: int, parallelism: int | None = None,
) -> list[tuple[int, float]]:
    """``(fold, AUC)`` of a logistic model on every fold.

    Folds are filters on the numbered rows, so no row leaves the JVM; the rows
    are kept once for all fits. A fit knows the rows of its own training part.
    ``parallelism`` fits are submitted side by side, by default as many as the cores have room for.
    """
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    kept = compact(prepared.select(label, WEIGHT, FOLD, "features"), rows).persist(StorageLevel.MEMORY_AND_DISK)
    room = prepared.sparkSession.sparkContext.defaultParallelism // max(1, -(-rows // PARTITION_ROWS))
    held = {r[FOLD]: r["count"] for r in kept.groupBy(FOLD).count().collect()}

    def score(fold: int) -> tuple[int, float]:
        model = logistic(spec, rows - held.get(fold, 0), label).fit(kept.where(F.col(FOLD) != fold))
        return fold, evaluator.evaluate(model.transform(kept.where(F.col(FOLD) == fold)))

    try:
        with ThreadPool(parallelism or max(2, min(room, folds))) as pool:
            return pool.map(inheritable_thread_target(prepared.sparkSession)(score), range(folds))
    finally:
        kept.unpersist()


@dataclass
class FoldedTrees:
    """Training rows with their folds, binned once; tree models are grown on all folds together."""

    blocks: DataFrame
    number: int
    layout: trees.Layout
    sizes: tuple[int, int]
    folds: int
    folder: str

    def areas(self, specs: Mapping[str, ModelSpec]) -> dict[str, list[float | None]]:
        """Fold AUCs of each model, in order of the folds."""
        fits = {f"{fold} {name}": trees.Fit(growth(spec, len(self.layout.features)), class_weight(spec.weighting, self.sizes), fold)
                for name, spec in specs.items() for fold in range(self.folds)}
        scored = trees.grow(fits, self.blocks, self.number, self.layout, True, self.folder).scores
        found = {r["model"]: r["auc"] for r in grouped_auc(scored, ["model"], folder=self.folder).collect()}  # one row for each model and fold
        return {name: [found.get(f"{fold} {name}") for fold in range(self.folds)] for name in specs}


@contextmanager
def folded_trees(
    train: DataFrame, features: Sequence[str], ids: Sequence[str], label: str = fixed.LABEL, folds: int = 5,
    sizes: tuple[int, int] | None = None, block_rows: int = trees.BLOCK_ROWS,
) -> Iterator[FoldedTrees]:
    sizes = sizes or class_ratio(train, label)
    with workspace(train.sparkSession, "folds") as folder:
        table = materialise(_tree_table(stratified_folds(train, ids, label, folds), features, ids, label, [FOLD]), "rows", folder)
        layout = trees.fit_layout(table, features)
        blocks, number = trees.to_blocks(table, layout, label, ids, FOLD, block_rows, sum(sizes), folder)
        yield FoldedTrees(blocks, number, layout, sizes, folds, folder)


def cross_validated(
    specs: Mapping[str, ModelSpec], train: DataFrame, features: Sequence[str], ids: Sequence[str],
    label: str = fixed.LABEL, folds: int = 5, parallelism: int | None = None, sizes: tuple[int, int] | None = None,
    block_rows: int = trees.BLOCK_ROWS,
) -> DataFrame:
    """Fold AUCs of each model. All tree models grow on all folds together."""
    n0, n1 = sizes or class_ratio(train, label)
    grown = {name: spec for name, spec in specs.items() if spec.kind != "logistic"}
    rows = []
    if grown:
        with folded_trees(train, features, ids, label, folds, (n0, n1), block_rows) as prepared:
            areas = prepared.areas(grown)
        rows += [(name, fold, auc) for name, own in areas.items() for fold, auc in enumerate(own)]
    numbered = stratified_folds(train, ids, label, folds)
    for name, spec in specs.items():
        if name not in grown:
            prepared = weighted(numbered, label, spec.weighting, (n0, n1))
            prepared = Pipeline(stages=_inputs(spec, train, features)).fit(prepared).transform(prepared)
            rows += [(name, fold, auc) for fold, auc in fold_scores(spec, prepared, n0 + n1, label, folds, parallelism)]
    return train.sparkSession.createDataFrame(rows, "model string, fold int, auc double")


def cross_validate(
    specs: Mapping[str, ModelSpec], train: DataFrame, features: Sequence[str], ids: Sequence[str],
    label: str = fixed.LABEL, folds: int = 5, parallelism: int | None = None, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Mean and population deviation of the fold AUCs of each model."""
    return mean_and_spread(cross_validated(specs, train, features, ids, label, folds, parallelism, sizes), ["model"])


# The tuned ranges.
RANGES = {
    "trees": proposals.Range(100, 500, whole=True), "learning_rate": proposals.Range(0.01, 0.2, log=True),
    "max_depth": proposals.Range(3, 9, whole=True), "max_leaves": proposals.Range(20, 150, whole=True),
    "min_rows": proposals.Range(10, 100, whole=True), "subsample": proposals.Range(0.5, 1.0), "columns": proposals.Range(0.5, 1.0),
    "alpha": proposals.Range(1e-4, 10.0, log=True), "lam": proposals.Range(1e-4, 10.0, log=True),
}
TRIALS_SCHEMA = "trial int, mean double, std double, log_ratio double, " + ", ".join(f"{n} {'int' if x.whole else 'double'}" for n, x in RANGES.items())


def search(
    train: DataFrame, features: Sequence[str], ids: Sequence[str], trials: int = 50, label: str = fixed.LABEL, folds: int = 5,
    sizes: tuple[int, int] | None = None, startup: int = 10, batch: int = 10, seed: int = SEED,
    ranges: Mapping[str, proposals.Range] = RANGES, block_rows: int = trees.BLOCK_ROWS,
) -> tuple[DataFrame, dict[str, object]]:
    """Fold AUC of every trial, best first, and the best parameters.

    The first ``startup`` trials are drawn at random, later ones proposed from what the earlier ones scored, ``batch`` at a
    time; the trials of a batch and all folds grow together. ``log_ratio`` says how much denser good trials lie than others at
    a proposal, null for the drawn ones. Rows with one class score no trial.
    """
    study = proposals.Study(ranges, seed, startup)
    tried: list[tuple[dict, float | None, list]] = []
    with folded_trees(train, features, ids, label, folds, sizes, block_rows) as prepared:
        while len(tried) < trials:
            asked = study.propose(min(startup - len(tried) if len(tried) < startup else batch, trials - len(tried)))
            areas = prepared.areas({str(k): ModelSpec("boosting", "balanced", a.values) for k, a in enumerate(asked)})
            for k, a in enumerate(asked):
                known = [x for x in areas[str(k)] if x is not None]
                study.learn(a.values, fmean(known) if known else 0.0)
                tried.append((a.values, a.log_ratio, known))
    rows = []
    for i, (values, ratio, known) in enumerate(tried):
        rows.append((i, fmean(known) if known else None, pstdev(known) if known else None, ratio, *[values[n] for n in ranges]))
    rows.sort(key=lambda r: (-(r[1] or 0.0), r[0]))
    return train.sparkSession.createDataFrame(rows, TRIALS_SCHEMA), dict(tried[rows[0][0]][0])


def refit_best(
    best: Mapping[str, object], baseline: PipelineModel | TreeScorer, train: DataFrame, test: DataFrame, features: Sequence[str],
    label: str = fixed.LABEL, ids: Sequence[str] = (),
) -> tuple[PipelineModel | TreeScorer, DataFrame]:
    """Fit the best trial on all training rows and compare it with a baseline; no gain is stated where test rows have one class."""
    model = fit(ModelSpec("boosting", "balanced", best), train, features, label, ids=ids)
    tuned, base = model_auc(model, test, label), model_auc(baseline, test, label)
    gain = None if tuned is None or base is None else (tuned - base) * 100
    report = test.sparkSession.createDataFrame(
        [(tuned, base, gain)], "tuned_auc double, baseline_auc double, improvement double"
    )
    return model, report


# -- retraining ---------------------------------------------------------------

def retrain(
    df: DataFrame, current: PipelineModel | TreeScorer, features: Sequence[str], order: str, ids: Sequence[str], retrained_at: str,
    label: str = fixed.LABEL, spec: ModelSpec | None = None, save_to: str | None = None,
) -> tuple[PipelineModel | None, DataFrame]:
    """Champion and challenger on the last fifth of the rows.

    The challenger is saved only if it is strictly better, beside the champion
    and not in its place. If the last fifth holds one class only, the status is
    ``not_comparable`` and the champion stays. Returns the challenger (or None) and the metrics row.
    """
    from pyspark.sql import Row

    train, held = positional_split(df, order, ids)
    challenger = fit(spec or retrain_model(), train, features, label, ids=ids)
    before, after = model_auc(current, held, label), model_auc(challenger, held, label)
    known = before is not None and after is not None
    improved = known and after > before
    status = "improved" if improved else "no_improvement" if known else "not_comparable"
    figures = (round(before, 4), round(after, 4), round(after - before, 4)) if known else (before, after, None)
    if improved and save_to:
        challenger.write().overwrite().save(save_to)
    spark: SparkSession = df.sparkSession
    metrics = spark.createDataFrame(
        [Row(status, *figures, improved, retrained_at, train.count())],
        "status string, current_auc double, new_auc double, improvement double, model_saved boolean, "
        "retrained_at string, training_samples long",
    ).withColumn("retrained_at", F.col("retrained_at").cast("timestamp"))
    return (challenger if improved else None), metrics
