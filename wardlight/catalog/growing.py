"""Queries over data that grows: types of new files, an index for searches, sketches instead of history."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.catalog import encounters as enc
from wardlight.catalog.registry import query
from wardlight.catalog.views import view
from wardlight.functions import fixed
from wardlight.operators import grams, sketches
from wardlight.session import scratch_path
from wardlight.sources import inference, readers

_TOKENS = ", ".join(f"'{t}'" for t in fixed.NA_TOKENS)
_INFERRED = ("fx_encounters", "fx_billing", "fx_patients", "fx_appointments")


def _types_sql(name):
    return f"""SELECT '{name}' AS "table", name AS "column", CASE WHEN count(v) = 0 THEN 'string' WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN 'bigint'
  WHEN bool_and(regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')) THEN 'double'
  WHEN bool_and(try_cast(v AS DATE) IS NOT NULL AND length(v) = 10) THEN 'date' WHEN bool_and(try_cast(v AS TIMESTAMP) IS NOT NULL) THEN 'timestamp' ELSE 'string' END AS type
FROM (SELECT name, CASE WHEN v IN ({_TOKENS}) THEN NULL ELSE v END AS v FROM (UNPIVOT (SELECT coalesce(CAST(COLUMNS(*) AS VARCHAR), '') FROM {name}) ON COLUMNS(*) INTO NAME name VALUE v)) GROUP BY name"""


@query(" UNION ALL ".join(_types_sql(n) for n in _INFERRED), _INFERRED)
def inferred_types(spark, d):
    """Types of four tables from their CSV text alone."""
    found = []
    for name in _INFERRED:
        path = scratch_path(spark, name)
        view(spark, d, name).write.option("header", True).csv(path)
        found += [(name, c, t) for c, t in inference.inferred_types(readers.read_csv(spark, path)).items()]
    return spark.createDataFrame(found, "table string, column string, type string")


NEEDLES = ["pat", "#000000", "00012", "Q CUSTOMER#", "0001", "9", "no such name", "#00000007"]


@query(f"""SELECT needle, count(c_custkey) AS patients, min(c_custkey) AS first FROM (SELECT unnest([{', '.join(f"'{n}'" for n in NEEDLES)}]) AS needle)
LEFT JOIN customer ON contains(lower('Pat Q ' || c_name), lower(needle)) GROUP BY needle""")
def patient_search_indexed(spark, d):
    """Substrings of patient names, looked up in an index of grams."""
    path = scratch_path(spark, "grams")
    people = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("Pat Q "), "c_name").alias("name"))
    grams.write_index(people, path)
    counted = [grams.search(spark, path, n).agg(F.lit(n).alias("needle"), F.count("*").alias("patients"), F.min("c_custkey").alias("first")) for n in NEEDLES]
    return reduce(DataFrame.unionByName, counted)


FRACTIONS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query("""numbers AS (SELECT num_lab_procedures AS v FROM fx_encounters UNION ALL SELECT num_medications FROM fx_encounters)
SELECT unnest(['num_lab_procedures', 'num_medications']) AS feature, (SELECT count(*) FROM fx_encounters) AS rows, 6 AS fractions, TRUE AS within_the_bound,
  (SELECT count(DISTINCT date_trunc('quarter', l_shipdate)) FROM fx_encounters) AS parts""", ("fx_encounters",))
def sketched_quantiles(spark, d):
    """Quantiles from one sketch for each quarter of the year, their ranks counted in the data."""
    columns, path = ["num_lab_procedures", "num_medications"], scratch_path(spark, "sketches")
    rows = enc.raw(spark, d).select(F.trunc("l_shipdate", "quarter").alias("part"), *columns)
    sketches.append_sketches(rows, path, columns, "part")
    held = spark.read.parquet(path)
    parts = held.count()
    values = sketches.merged(held, columns).select(*[sketches.quantile(c, f).alias(f"{c}_{k}") for c in columns for k, f in enumerate(FRACTIONS)]).first()
    below, upto = (lambda c, v: F.avg((F.col(c) < v).cast("int"))), (lambda c, v: F.avg((F.col(c) <= v).cast("int")))
    near = sketches.rank_error()
    out = []
    for c in columns:
        inside = [F.lit(f).between(below(c, values[f"{c}_{k}"]) - near, upto(c, values[f"{c}_{k}"]) + near) for k, f in enumerate(FRACTIONS)]
        out.append(rows.agg(F.lit(c).alias("feature"), F.count(c).alias("rows"), F.lit(len(FRACTIONS)).alias("fractions"),
                            reduce(lambda a, b: a & b, inside).alias("within_the_bound"), F.lit(parts).cast("long").alias("parts")))
    return reduce(DataFrame.unionByName, out)
