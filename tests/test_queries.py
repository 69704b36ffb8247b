"""Every registered query: agreement with its SQL, plan shape, entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import plan_of
from tools.check_oracle import TABLES, kind, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# These fit hundreds of trees many times over; tests/test_learning.py covers their parts on small models.
LONG = {"train_boosting_a", "train_boosting_b", "train_forest", "train_bootstrap", "cross_validate", "random_search", "refit_best", "retrain_gate",
        "learning_run", "attribution_permutation", "attribution_splits", "attribution_boosting", "attribution_forest"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in LONG and not n.startswith("op")))
def test_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert {f.name: kind(f.dataType.simpleString()) for f in df.schema} == {c[0]: kind(str(c[1])) for c in cursor.description}
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1500 and "bill_per_treatment" in df.columns
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["utilisation", "clinical", "interactions", "standardise", "hospital_features", "hospital_final", "pr_curve",
                                  "best_f1", "drift_report", "system_health", "join_then_aggregate"])
def test_the_source_is_read_before_the_result(spark, name):
    """What is learned first is learned from a written table, which the result reads and not the source."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "/testdata/" not in plan and 1 <= plan.count("Scan parquet") <= 3


def test_fixed_values_by_hand():
    from wardlight.functions import fixed

    assert (fixed.HIGH_CUT, fixed.MEDIUM_CUT, fixed.DECISION_THRESHOLD, fixed.DRIFT_AUC, fixed.MIN_OUTCOMES) == (0.6, 0.3, 0.369, 0.60, 50)
    assert fixed.AGE_MIDPOINTS["[70-80)"] == 75 and fixed.A1C_LEVELS[">8"] == 3 and fixed.GLUCOSE_LEVELS[">300"] == 3
    assert [p[0] for p in fixed.PATHWAYS][:2] == ["cardiac_high_risk", "diabetes_high_risk"]
