"""The two operators whose results SQL can state, on tables with copies."""

import duckdb
import pytest

from tools.check_oracle import TABLES, rows_of
from wardlight.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_agrees_with_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
