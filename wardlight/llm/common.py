"""Pieces that several operators share: tables, hashes of a table, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import materialise

ROUNDS = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with what its task has freed given back to the system at the end.

    Python workers outlive their tasks; without this each would hold on to the most that any of its tasks needed.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only the GNU C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def text_bytes(text: str):
    """UTF-8 bytes of a text column, none for null."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def _state(edges: DataFrame) -> tuple:
    """Figures that change whenever the set of edges does."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                    F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` as ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps: every node hangs its larger (then its
    smaller) neighbours on the smallest one it knows. Edges that no step changes are
    stars around the roots. Each step is one aggregate and one join on the node, whose
    hot side adaptive execution splits; each round is written to the shared folder, so
    the plan does not grow. Nodes without an edge are not returned; null nodes are left
    out. Raises if ``rounds`` do not suffice, which takes more than 2^rounds nodes.
    """
    edges = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    if state[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = larger.filter("a <> b").distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", "m"))
        edges = materialise(small.filter("a <> b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
    raise RuntimeError("components did not settle; raise the number of rounds")
