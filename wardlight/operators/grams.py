"""Substring search over an index of three-letter grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
FILE_ROWS = 2_000_000
GROUP_BYTES = 1 << 20


def write_index(df: DataFrame, path: str, name_column: str = "name", file_rows: int = FILE_ROWS, group_bytes: int = GROUP_BYTES) -> None:
    """Write the posting lists of all lower-cased names to ``path``.

    ``postings`` has one row for each distinct gram of each row, with all its columns, sorted by gram (and by name within
    one, so that a very frequent gram spreads over files); its row groups are small and carry the least and greatest gram.
    ``counts`` says how many rows a gram has, ``rows`` holds the rows themselves for needles without a gram. Null names have none.
    """
    name = F.lower(F.col(name_column))
    starts = F.sequence(F.lit(1), F.length(name) - GRAM + 1)
    grams = F.when(F.length(name) >= GRAM, F.array_distinct(F.transform(starts, lambda k: F.substr(name, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))
    df.write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    postings = rows.select(F.explode(grams).alias("gram"), F.struct(*[f"`{c}`" for c in df.columns]).alias("row"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")  # as many rows as there are grams
    total = df.sparkSession.read.parquet(f"{path}/counts").agg(F.sum("n")).first()[0] or 0
    by_name = F.col(f"row.`{name_column}`")
    ordered = postings.repartitionByRange(max(1, -(-total // file_rows)), "gram", by_name).sortWithinPartitions("gram", by_name)
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(f"{path}/postings")


def rarest_gram(spark: SparkSession, path: str, needle: str) -> str | None:
    """The gram of a needle with the fewest rows, one that has none first; null where the needle is too short."""
    needle = needle.lower()
    grams = sorted({needle[k:k + GRAM] for k in range(len(needle) - GRAM + 1)})
    if not grams:
        return None
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(grams)).collect()}
    return min(grams, key=lambda g: (counts.get(g, 0), g))


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """Rows that can hold a needle: those of its rarest gram, read from the row groups that hold the gram; all rows for a needle without one."""
    gram = rarest_gram(spark, path, needle)
    if gram is None:
        return spark.read.parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/postings").filter(F.col("gram") == gram).select("row.*")


def search(spark: SparkSession, path: str, needle: str, name_column: str = "name") -> DataFrame:
    """All rows whose lower-cased name contains the lower-cased needle; '' matches every row."""
    found = candidates(spark, path, needle)
    return found.filter(F.lower(F.col(name_column)).contains(needle.lower())) if needle else found
