"""Rule-based care pathways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions import fixed

PATHWAY = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("follow_up_days", T.IntegerType()),
    T.StructField("actions", T.ArrayType(T.StringType())),
    T.StructField("specialists", T.ArrayType(T.StringType())),
])


def pathway_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.PATHWAYS, PATHWAY)


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _catalogue() -> Column:
    """The pathways as one literal map by id, for lookups inside an expression."""
    return F.create_map(*[
        part
        for pid, name, priority, color, days, actions, specialists in fixed.PATHWAYS
        for part in (F.lit(pid), F.struct(
            F.lit(pid).alias("id"), F.lit(name).alias("name"), F.lit(priority).alias("priority"),
            F.lit(color).alias("color"), F.lit(days).alias("follow_up_days"),
            _texts(actions).alias("actions"), _texts(specialists).alias("specialists"),
        ))
    ])


def _value(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)


def assigned_ids(df: DataFrame, risk: str = "risk_level") -> Column:
    """Pathway ids of a patient in rule order. Missing features count as 0."""
    def rule(condition: Column, pid: str) -> Column:
        return F.when(condition, F.lit(pid))

    mental = _value(df, "mental_health_flag") != 0
    compliance = _value(df, "medication_noncompliance_risk")
    high = F.array_compact(F.array(
        rule(_value(df, "cardiac_primary") != 0, "cardiac_high_risk"),
        rule(_value(df, "diabetes_primary") != 0, "diabetes_high_risk"),
        rule((_value(df, "is_elderly") != 0) | (_value(df, "age_numeric") >= fixed.ELDERLY_AGE), "elderly_high_risk"),
        rule(mental, "mental_health_risk"),
        rule(_value(df, "social_isolation_score") >= 2, "social_isolation_risk"),
        rule(compliance >= 1, "medication_risk"),
    ))
    medium = F.array_compact(F.array(
        F.lit("standard_medium_risk"),
        rule(mental, "mental_health_risk"),
        rule(compliance >= 2, "medication_risk"),
    ))
    return (
        F.when((F.col(risk) == "High") & (F.size(high) == 0), F.array(F.lit("elderly_high_risk")))
        .when(F.col(risk) == "High", high)
        .when(F.col(risk) == "Medium", medium)
        .otherwise(F.array(F.lit("standard_low_risk")))
    )


def care_plans(df: DataFrame, asof: Column, ids: Column | None = None) -> DataFrame:
    """Add the care plan of every patient in one projection, without a shuffle.

    ``asof`` is the day (or time) the plan is made. Unknown pathway ids are
    skipped. Actions keep their first-seen order and are counted before the plan
    is cut to its first ten; specialists are sorted.
    """
    named = df.withColumn("_ids", assigned_ids(df) if ids is None else ids)
    catalogue = _catalogue()
    found = F.array_compact(F.transform("_ids", lambda pid: F.try_element_at(catalogue, pid)))
    planned = named.withColumn("_paths", found)
    ranks = F.array_max(F.transform("_paths", lambda p: F.coalesce(_rank(p["priority"]), F.lit(0))))
    days = F.coalesce(F.array_min(F.transform("_paths", lambda p: p["follow_up_days"])), F.lit(fixed.NO_FOLLOW_UP_DAYS))
    actions = F.array_distinct(F.flatten(F.transform("_paths", lambda p: p["actions"])))
    specialists = F.sort_array(F.array_distinct(F.flatten(F.transform("_paths", lambda p: p["specialists"]))))
    summarised = planned.withColumns({
        "assigned_pathways": F.transform(
            "_paths",
            lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["priority"].alias("priority"),
                               p["color"].alias("color"), p["actions"].alias("actions")),
        ),
        "overall_priority": _priority(F.greatest(F.coalesce(ranks, F.lit(1)), F.lit(1))),
        "_actions": actions,
        "required_specialists": specialists,
        "follow_up_in_days": days,
        "generated_at": F.date_format(asof, "yyyy-MM-dd HH:mm:ss"),
    })
    return summarised.withColumns({
        "total_actions": F.size("_actions"),
        "action_plan": F.slice("_actions", 1, fixed.ACTION_PLAN_LENGTH),
        "follow_up_date": F.date_format(F.date_add(asof.cast("date"), F.col("follow_up_in_days")), "yyyy-MM-dd"),
    }).drop("_ids", "_paths", "_actions")


def _rank(priority: Column) -> Column:
    chain = None
    for name, rank in fixed.PRIORITY_RANK.items():
        chain = F.when(priority == name, rank) if chain is None else chain.when(priority == name, rank)
    return chain


def _priority(rank: Column) -> Column:
    chain = None
    for name, number in fixed.PRIORITY_RANK.items():
        chain = F.when(rank == number, name) if chain is None else chain.when(rank == number, name)
    return chain


def assigned_rows(df: DataFrame, key: str = "patient_id") -> DataFrame:
    """Long form: one row per patient and assigned pathway, with its definition."""
    ids = df.select(key, F.posexplode(assigned_ids(df)).alias("position", "id"))
    # The pathway table is a constant of eight rows.
    return ids.join(F.broadcast(pathway_table(df.sparkSession)), "id")


def pathway_load(df: DataFrame, key: str = "patient_id") -> DataFrame:
    """Patients and earliest follow-up per pathway."""
    return assigned_rows(df, key).groupBy("id", "priority").agg(
        F.count("*").alias("patients"), F.min("follow_up_days").alias("follow_up_days")
    )
