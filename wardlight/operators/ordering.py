"""Global order without a global task.

Running totals, exact quantiles and exact cut positions over a whole table are
all expressed on *distinct values with counts*. The counting is an ordinary
two-stage aggregation, so a value that holds a third of the rows reaches the
shuffle as one partial row per task. Distinct values are then cut into ranges
that are handled side by side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.session import materialise

RANGE_ROWS = 50_000   # distinct values of a range; below that one range is enough
_RANGE = "_range"


def as_double(df: DataFrame, by: str) -> Column:
    """Position of a numeric, date or time value on a line; its order is that of the values."""
    if isinstance(df.schema[by].dataType, T.DateType):
        return F.unix_date(by).cast("double")
    return F.col(by).cast("double")


def split_points(df: DataFrame, by: str, range_rows: int | None = None) -> list[float]:
    """Values that cut the rows of ``df`` into even ranges of about ``range_rows`` each, as many as that takes.

    They only balance the work: any choice of points gives the same result.
    """
    value = as_double(df, by)
    size = df.agg(F.count(value)).first()[0]
    wanted = -(-size // (range_rows or RANGE_ROWS))
    if wanted <= 1:
        return []
    cuts = df.agg(F.percentile_approx(value, [i / wanted for i in range(1, wanted)], max(10_000, 20 * wanted))).first()[0]
    return sorted(set(cuts))


def _with_range(df: DataFrame, by: str, points: Sequence[float]) -> DataFrame:
    if not points:
        return df.withColumn(_RANGE, F.lit(0.0))
    edges = [float("-inf"), *points, float("inf")]
    cutter = Bucketizer(splits=edges, inputCol="_by", outputCol=_RANGE)
    return cutter.transform(df.withColumn("_by", as_double(df, by))).drop("_by")


def running_totals(
    df: DataFrame,
    by: str,
    totals: Mapping[str, str],
    descending: bool = False,
    points: Sequence[float] | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add running sums in the order of ``by``, over the table or within keys.

    ``df`` holds one row per distinct non-null value of ``by`` (and key);
    ``totals`` maps a column to the name of its running sum (the row itself
    included). Sums run inside each range; what lies before a range comes from a
    table of one row per range (and key). So even a single key is spread over
    all ranges.
    """
    points = split_points(df, by) if points is None else points
    direction = F.desc if descending else F.asc
    ranged = _with_range(df, by, points)
    inside = Window.partitionBy(*within, _RANGE).orderBy(direction(by)).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(c).over(inside).alias(name) for c, name in totals.items()])
    if not points:
        return summed.drop(_RANGE)
    # One row per range (and key): a share of RANGE_ROWS of the values. Spark checks
    # its size before it is broadcast.
    before = Window.partitionBy(*within).orderBy(direction(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*within, _RANGE)
        .agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
        .select(*within, _RANGE,
                *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in totals])
    )
    joined = summed.join(offsets, [*within, _RANGE])
    kept = [c for c in df.columns if c not in totals.values()]
    return joined.select(
        *kept, *[(F.col(name) + F.col(f"_before_{c}")).alias(name) for c, name in totals.items()]
    )


def values_at(counts: DataFrame, value: str, number: str, ranks: Sequence[int]) -> list[tuple]:
    """``(value, rows before it)`` at zero-based ranks of a value/count table."""
    if not ranks:
        return []
    wanted = sorted(set(ranks))
    hit = None
    for rank in wanted:
        covers = (F.col("_upto") > rank) & (F.col("_upto") - F.col(number) <= rank)
        hit = covers if hit is None else hit | covers
    rows = (
        running_totals(counts, value, {number: "_upto"})
        .where(hit)
        .select(value, (F.col("_upto") - F.col(number)).alias("_before"), "_upto")
        .collect()  # at most one row per rank
    )
    rows.sort(key=lambda r: r["_before"])
    found = {rank: next(r for r in rows if r["_before"] <= rank < r["_upto"]) for rank in wanted}
    return [(found[rank][value], found[rank]["_before"]) for rank in ranks]


def _quantiles(counts: DataFrame, fractions: Mapping[str, float]) -> dict[str, float | None]:
    """Interpolated quantiles of a (name, value, n) table, one per name.

    Names with few distinct values share one aggregate. The others go by rank.
    """
    sizes = {
        r["name"]: (r["values"], r["rows"])
        for r in counts.groupBy("name").agg(F.count("value").alias("values"), F.sum("n").alias("rows")).collect()
    }
    found: dict[str, float | None] = {name: None for name in fractions}
    few = [name for name in fractions if 0 < sizes.get(name, (0, 0))[0] <= RANGE_ROWS]
    if few:
        row = counts.where(F.col("name").isin(few)).agg(*[
            F.percentile(F.when(F.col("name") == name, F.col("value")), fractions[name], F.col("n")).alias(f"q{i}")
            for i, name in enumerate(few)
        ]).first()
        found.update({name: row[f"q{i}"] for i, name in enumerate(few)})
    for name in set(fractions) - set(few):
        rows = sizes.get(name, (0, 0))[1]
        if not rows:
            continue
        position = fractions[name] * (rows - 1)
        low = int(position)
        share = position - low
        one = counts.where(F.col("name") == name).select("value", "n")
        (below, _), (above, _) = values_at(one, "value", "n", [low, min(low + 1, rows - 1)])
        found[name] = float(below) if share == 0 else float(below) * (1 - share) + float(above) * share
    return found


def exact_quantile(df: DataFrame, column: str, fraction: float) -> float | None:
    """Quantile with linear interpolation over the non-null values, exact at any size."""
    return profile(df, {column: (F.col(column), fraction)}, {})[0][column]


def grouped_quantile(
    df: DataFrame, keys: Sequence[str], column: str, fraction: float, output: str, range_rows: int | None = None
) -> DataFrame:
    """The same per key (non-null keys), from value counts that are written once.

    Keys of up to ``range_rows`` distinct values share one aggregate. If a key has more, its
    values are not gathered in one task: all keys then go by rank.
    """
    counts = materialise(
        df.select(*keys, _finite(F.col(column)).alias("_value"))
        .dropna(subset=[*keys, "_value"])
        .groupBy(*keys, "_value").agg(F.count("*").alias("_n")),
        "value-counts",
    )
    widest = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if widest <= (range_rows or RANGE_ROWS):
        return counts.groupBy(*keys).agg(F.percentile("_value", fraction, F.col("_n")).alias(output))
    position = F.lit(fraction) * (F.col("_rows") - 1)
    low = F.floor(position)
    points = split_points(counts, "_value", range_rows)
    placed = running_totals(counts, "_value", {"_n": "_upto"}, points=points, within=keys).join(
        counts.groupBy(*keys).agg(F.sum("_n").alias("_rows")), list(keys)
    )

    def value_at(rank: Column) -> Column:
        covers = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        return F.max(F.when(covers, F.col("_value")))

    ends = placed.groupBy(*keys).agg(
        value_at(low).alias("_below"), value_at(F.least(low + 1, F.col("_rows") - 1)).alias("_above"),
        F.max(position - low).alias("_share"),
    )
    return ends.select(
        *keys, (F.col("_below") * (1 - F.col("_share")) + F.col("_above") * F.col("_share")).alias(output)
    )


def approx_quantile(df: DataFrame, column: str, fraction: float, accuracy: int = 10_000) -> float | None:
    """One-pass alternative with a rank error of ``1/accuracy``."""
    return df.agg(F.percentile_approx(F.col(column).cast("double"), fraction, accuracy)).first()[0]


def _finite(column: Column) -> Column:
    number = column.cast("double")
    return F.when(~F.isnan(number), number)


def profile(
    df: DataFrame,
    quantiles: Mapping[str, tuple[Column, float]],
    levels: Mapping[str, Column],
    max_levels: int = 1000,
) -> tuple[dict[str, float | None], dict[str, list[str]]]:
    """Several quantiles and the sorted levels of several text columns in one scan.

    Each row is turned into (name, value) entries that are counted together. A
    column with more than ``max_levels`` levels is an error, not a cut.
    """
    none = F.lit(None)
    entries = [
        F.struct(F.lit(name).alias("name"), _finite(column).alias("value"), none.cast("string").alias("text"))
        for name, (column, _) in quantiles.items()
    ] + [
        F.struct(F.lit(name).alias("name"), none.cast("double").alias("value"), column.alias("text"))
        for name, column in levels.items()
    ]
    counts = (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull() | F.col("text").isNotNull())
        .groupBy("name", "value", "text").agg(F.count("*").alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        found = _quantiles(
            counts.where(F.col("value").isNotNull()), {name: fraction for name, (_, fraction) in quantiles.items()}
        ) if quantiles else {}
        texts: dict[str, list[str]] = {name: [] for name in levels}
        most = max_levels * len(levels)
        if levels:
            rows = counts.where(F.col("text").isNotNull()).select("name", "text").limit(most + 1).collect()
            for row in rows:
                texts[row["name"]].append(row["text"])
            too_many = [name for name, values in texts.items() if len(values) > max_levels]
            if len(rows) > most or too_many:
                raise ValueError(f"more than {max_levels} levels in {too_many or list(levels)}")
        return found, {name: sorted(values) for name, values in texts.items()}
    finally:
        counts.unpersist()


# -- exact cuts of hashed rows -------------------------------------------------

_DIGIT = 12  # bits looked at per pass


def row_hash(ids: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(c) for c in ids], F.lit(seed))


def _prefix(value: Column, level: int) -> Column:
    return F.shiftright(value, max(64 - _DIGIT * level, 0))


def hash_cutoffs(
    df: DataFrame, group: Column, ids: Sequence[str], seed: int, ranks: Mapping[object, Sequence[int]]
) -> dict[object, list[int]]:
    """For each group the hash values below or at which exactly ``k`` rows lie.

    Works by radix descent: one pass counts rows per leading digit of the hash
    (at most 4096 counts per open cut), the next one looks only into the digit
    that holds the cut. Rows that share an id share a hash and so always fall on
    the same side; with unique ids the count is exact.
    """
    hashed = df.select(group.alias("g"), row_hash(ids, seed).alias("h"))
    done: dict[tuple, int] = {}
    open_cuts: dict[tuple, tuple[int, int | None]] = {}
    for g, wanted in ranks.items():
        for k in wanted:
            if k <= 0:
                done[g, k] = -(2**63) - 1
            else:
                open_cuts[g, k] = (0, None)  # rows before the open prefix, the prefix
    level = 0
    while open_cuts:
        level += 1
        scope = None
        for g, prefix in {(g, prefix) for (g, _), (_, prefix) in open_cuts.items()}:
            here = F.col("g").eqNullSafe(F.lit(g))
            if prefix is not None:
                here = here & (_prefix(F.col("h"), level - 1) == prefix)
            scope = here if scope is None else scope | here
        counts: dict[object, list[tuple[int, int]]] = {}
        for row in hashed.where(scope).groupBy("g", _prefix(F.col("h"), level).alias("p")).count().collect():
            counts.setdefault(row["g"], []).append((row["p"], row["count"]))
        for (g, k), (before, parent) in list(open_cuts.items()):
            inside = sorted(
                (p, n) for p, n in counts.get(g, [])
                if parent is None or p >> (min(_DIGIT * level, 64) - _DIGIT * (level - 1)) == parent
            )
            for p, n in inside:
                if before + n >= k:
                    if before + n == k or _DIGIT * level >= 64:
                        done[g, k] = ((p + 1) << max(64 - _DIGIT * level, 0)) - 1
                        del open_cuts[g, k]
                    else:
                        open_cuts[g, k] = (before, p)
                    break
                before += n
            else:
                done[g, k] = 2**63 - 1  # fewer rows than asked for: all of them
                del open_cuts[g, k]
    return {g: [done[g, k] for k in wanted] for g, wanted in ranks.items()}


def at_most(value: Column, cutoff: int) -> Column:
    """``value <= cutoff`` where the cutoff may lie outside the 64-bit range."""
    if cutoff < -(2**63):
        return F.lit(False)
    return value <= F.lit(min(cutoff, 2**63 - 1))


def hash_sample(df: DataFrame, ids: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of at most ``rows`` rows: those with the smallest hash."""
    return df.orderBy(row_hash(ids, seed), *ids).limit(rows)


def first_positions(df: DataFrame, order: str, ids: Sequence[str], share: float, seed: int = 42) -> Column:
    """Condition that holds for the first ``int(n * share)`` rows in the order of
    one numeric, date or time column; equal values are ordered by the hash of ids.

    A filter on the row itself: no row is moved to find out its position.
    """
    counts = (
        df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        take = int(total * share)
        if take == 0:
            return F.lit(False)
        if take >= total:
            return F.col(order).isNotNull()
        edge, before = values_at(counts, order, "n", [take])[0]
    finally:
        counts.unpersist()
    column = F.col(order)
    edge = F.lit(edge)
    if take == before:
        return F.coalesce(column < edge, F.lit(False))
    tied = df.where(column == edge)
    cutoff = hash_cutoffs(tied, F.lit(0), ids, seed, {0: [take - before]})[0][0]
    return F.coalesce((column < edge) | ((column == edge) & at_most(row_hash(ids, seed), cutoff)), F.lit(False))
