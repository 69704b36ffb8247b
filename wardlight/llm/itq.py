"""Embedding near-duplicates: balanced binary codes by iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.common import components
from wardlight.session import materialise

THRESHOLD = 0.98
SAMPLE = 20_000
ITERATIONS = 50
MAX_BITS = 64
LISTINGS = 2048
BLOCK = 128
_SLACK = 1e-6
_BUCKET = ["label", "width", "ring", "code"]


@dataclass
class Codes:
    """Rotation for vectors of one width, and how its bits are dealt to tables."""

    mean: np.ndarray
    axes: np.ndarray
    tables: int

    @property
    def cuts(self) -> list[int]:
        return [round(k * self.axes.shape[1] / self.tables) for k in range(self.tables + 1)]

    def project(self, unit: np.ndarray) -> np.ndarray:
        """Coordinates whose signs are the bits; rounded, so that every task sees the same signs."""
        return np.round((unit - self.mean) @ self.axes, 9)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, at length one; scaled by the largest entry first, so nothing over- or underflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(unit: np.ndarray, rows: int, iterations: int = ITERATIONS, max_bits: int = MAX_BITS, seed: int = 0) -> Codes:
    """Iterative quantisation: principal axes, then a rotation that is fitted in turns to the signs it yields.

    Axes along which the sample hardly varies are left out. ``rows`` is the size of the
    whole index: tables get about as many bits as its binary logarithm.
    """
    mean = unit.mean(axis=0)
    _, size, axes = np.linalg.svd(unit - mean, full_matrices=False)
    keep = max(1, min(max_bits, int((size**2 > 1e-3 * (size**2).mean()).sum())))
    axes = axes[:keep].T
    flat = (unit - mean) @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(keep, keep)))
    for _ in range(iterations):
        signs = np.where(flat @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(flat.T @ signs)
        rotation = left @ right
    bits = max(8.0, log2(max(2, rows)))
    return Codes(mean, axes @ rotation, max(1, round(keep / bits)))


def plain_codes(width: int, rows: int, max_bits: int = MAX_BITS) -> Codes:
    """Codes for a width that the sample did not show: the vector's own first entries."""
    keep = min(width, max_bits)
    return Codes(np.zeros(width), np.eye(width)[:, :keep], max(1, round(keep / max(8.0, log2(max(2, rows))))))


def listed(z: np.ndarray, codes: Codes, apart: float, limit: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each table the ``(row, code)`` under which rows are listed, and which rows would be listed more than ``limit`` times in a table.

    Two vectors at squared distance ``apart`` at most are, in some table, at most ``apart / tables``
    from each other. Take there, wherever their signs differ, the sign of the larger coordinate: that code is
    their meeting place. A row has to flip only coordinates that are smaller than the other's, and
    the two are at least twice that size away from each other. So a row is listed under
    its own code with every set of coordinates flipped whose squares sum to a quarter of the
    share, and no pair is missed.
    """
    budget = apart / codes.tables / 4 + _SLACK
    many = np.zeros(len(z), bool)
    out, cuts = [], codes.cuts
    for a, b in zip(cuts, cuts[1:], strict=False):
        square = z[:, a:b] ** 2
        row, flips, total = np.arange(len(z)), np.zeros(len(z), np.int64), np.zeros(len(z))
        for bit in range(b - a):
            more = total + square[row, bit]
            fits = (more <= budget) & ~many[row]
            row, flips, total = (np.concatenate([x, y[fits]]) for x, y in ((row, row), (flips, flips | 1 << bit), (total, more)))
            many |= np.bincount(row, minlength=len(z)) > limit
        out.append((row, _bits(z[:, a:b] >= 0)[row] ^ flips))
    return out, many


def _bits(flags: np.ndarray) -> np.ndarray:
    return (flags.astype(np.uint64) << np.arange(flags.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _meeting(zx: np.ndarray, zy: np.ndarray, codes: Codes, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows the first table in which they are near enough, and the code there under which both are listed."""
    budget = apart / codes.tables + _SLACK
    square = (zx - zy) ** 2
    larger = np.where(np.abs(zx) > np.abs(zy), zx >= 0, np.where(np.abs(zx) < np.abs(zy), zy >= 0, (zx >= 0) | (zy >= 0)))
    cuts = list(zip(codes.cuts, codes.cuts[1:], strict=False))
    table = np.argmax(np.stack([square[:, a:b].sum(axis=1) for a, b in cuts], axis=1) <= budget, axis=1)
    code = np.stack([_bits(larger[:, a:b]) for a, b in cuts], axis=1)
    return table, code[np.arange(len(table)), table]


def _may_link(a: str, b: str) -> Column:
    """Hamming check on all bits. ``sign`` has the signs, ``big`` marks coordinates of at least half the largest distance.

    A differing bit adds a quarter of the largest squared distance if one side is big there, all of it if both are.
    """
    differ = F.col(f"{a}.sign").bitwiseXOR(F.col(f"{b}.sign"))
    both = F.bit_count(differ.bitwiseAND(F.col(f"{a}.big")).bitwiseAND(F.col(f"{b}.big")))
    one = F.bit_count(differ.bitwiseAND(F.col(f"{a}.big").bitwiseXOR(F.col(f"{b}.big"))))
    return one + 4 * both <= 4


def _usable(vector: str, kind: T.DataType) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    zero = F.lit(0).cast(kind)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != zero), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest place (left ones first) that each left and right member of a block pair reaches over its links."""
    a, b = linked.shape
    left, right = np.arange(a), np.arange(a, a + b)
    while True:
        near = np.minimum(left, np.where(linked, right[None, :], a + b).min(axis=1, initial=a + b))
        far = np.minimum(right, np.where(linked, near[:, None], a + b).min(axis=0, initial=a + b))
        if (near == left).all() and (far == right).all():
            return left, right
        left, right = near, far


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, sample: int = SAMPLE, listing_limit: int = LISTINGS, block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component)`` per row: rows of one label are linked at a cosine of ``threshold`` or more.

    Equal vectors of a label are one class and are never paired. The rotation is
    fitted on at most ``sample`` classes, those with the smallest hash; every class is indexed. Which pairs are
    found does not depend on the rotation (see ``listed``): all are, and the cosine of
    the original vectors decides. Of those listed under a code, only those that pass the Hamming
    check with another one are looked at. A class that would be listed more than ``listing_limit`` times in
    a table is compared with its whole label instead.

    Buckets are cut into blocks of about ``block`` classes; a task compares two
    blocks by one matrix product and returns a count and a root for each class, never
    pairs; a pair that meets in several buckets counts in one. Null labels, null or zero vectors and those with null or non-finite
    components have no links; vectors of different lengths have no cosine and are not linked; repeated rows count as
    other vectors; a null id is never the smallest unless there is no other.
    """
    kind = vectors.schema[vector_col].dataType.elementType
    apart = 2 * (1 - threshold)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = F.col("label").isNotNull() & _usable("vector", kind)
    found = rows.filter(usable).groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    found = found.select("label", "vector", F.size("vector").alias("width"), "least", "rows", F.monotonically_increasing_id().alias("cls"))
    classes = materialise(found, "vector-classes")
    total = classes.count()
    models = _fit_all(classes, total, sample)
    number = {"float": pa.float32(), "double": pa.float64()}.get(kind.simpleString(), pa.float64())

    def model(width: int) -> Codes:
        return models.get(width) or models.setdefault(width, plain_codes(width, total))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                codes = model(int(width))
                for first in range(0, len(at), 1000):
                    some = pa.array(at[first:first + 1000])
                    cls = batch.column(0).take(some).to_numpy()
                    z = codes.project(unit_rows(_matrix(batch.column(2).take(some))))
                    tables, many = listed(z, codes, apart, listing_limit)
                    row, code, ring = [np.flatnonzero(many)], [np.zeros(many.sum(), np.int64)], [np.full(many.sum(), -1)]
                    for number_, (rows_, codes_) in enumerate(tables):
                        few = ~many[rows_]
                        row.append(rows_[few])
                        code.append(codes_[few])
                        ring.append(np.full(few.sum(), number_))
                    place = np.concatenate(row)
                    sign, big = _bits(z >= 0), _bits(np.abs(z) > apart**0.5 / 2 * (1 + _SLACK) + _SLACK)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cls[place]), pa.array(np.concatenate(ring), pa.int32()), pa.array(np.concatenate(code)),
                        pa.array(sign[place]), pa.array(big[place])], ["cls", "ring", "code", "sign", "big"])

    keyed = classes.select("cls", "width", "vector").mapInArrow(coded, "cls bigint, ring int, code bigint, sign bigint, big bigint")
    keyed = materialise(keyed.join(classes.select("cls", "label", "width"), "cls"), "vector-codes")
    narrow = keyed.filter("ring >= 0")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in _BUCKET]
    met = narrow.alias("a").join(narrow.alias("b"), [*same, F.col("a.cls") != F.col("b.cls"), _may_link("a", "b")], "left_semi")
    met = materialise(met.select("cls", *_BUCKET), "vector-met")
    wide = keyed.filter("ring < 0").select("cls", *_BUCKET)
    everyone = classes.select("cls", "label", "width", F.lit(-1).alias("ring"), F.lit(0).cast("bigint").alias("code"))
    everyone = everyone.join(wide.select("label", "width").distinct(), ["label", "width"], "left_semi").select("cls", *_BUCKET)
    asks = wide.select("cls", F.lit(True).alias("wide"))
    vector = classes.join(asks, "cls", "left").select("cls", "vector", "rows", F.coalesce("wide", F.lit(False)).alias("wide"))

    def blocks(members: DataFrame, name: str) -> DataFrame:
        sizes = members.groupBy(*_BUCKET).agg(F.count("*").alias("size"))
        dealt = members.join(sizes, _BUCKET).withColumn("block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / block)))
        dealt = dealt.join(vector, "cls")
        return dealt.groupBy(*_BUCKET, "block").agg(F.collect_list(F.struct("cls", "rows", "wide", "vector")).alias(name)).drop("block")

    pairs = blocks(met.union(wide), "left").join(blocks(met.union(everyone), "right"), _BUCKET).select("width", "ring", "code", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for k in range(batch.num_rows):
                codes, ring, code = model(batch.column(0)[k].as_py()), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                left, right = batch.column(3)[k].values, batch.column(4)[k].values
                lc, rc = left.field(0).to_numpy(), right.field(0).to_numpy()
                lu, ru = (unit_rows(_matrix(side.field(3).cast(pa.list_(number)))) for side in (left, right))
                linked = (lu @ ru.T >= threshold) & (lc[:, None] != rc[None, :])
                i, j = np.nonzero(linked)
                if not len(i):
                    continue
                near, far = _forest(linked)
                backward = np.zeros(len(rc), np.int64)
                if ring >= 0:
                    lz, rz = codes.project(lu), codes.project(ru)
                    here = np.zeros(len(i), bool)
                    for s in range(0, len(i), 20_000):
                        table, place = _meeting(lz[i[s:s + 20_000]], rz[j[s:s + 20_000]], codes, apart)
                        here[s:s + 20_000] = (table == ring) & (place == code)
                    i, j = i[here], j[here]
                else:  # the right side meets these classes nowhere else, unless it asks here itself
                    alone = ~right.field(2).to_numpy(zero_copy_only=False)[j]
                    backward = np.bincount(j[alone], left.field(1).to_numpy()[i[alone]], len(rc)).astype(np.int64)
                forward = np.bincount(i, right.field(1).to_numpy()[j], len(lc)).astype(np.int64)
                both = np.concatenate([lc, rc])
                out.append(np.stack([both, both[np.concatenate([near, far])], np.concatenate([forward, backward])]))
            a = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
            a = a[:, (a[0] != a[1]) | (a[2] > 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in a], ["cls", "root", "links"])

    linked = materialise(pairs.mapInArrow(compare, "cls bigint, root bigint, links bigint"), "vector-links")
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(linked.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").join(counts, "cls", "left")
    named = named.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component")
    good = rows.filter(usable).join(named, ["label", "vector"]).select("id", "n_links", "component")
    alone = rows.filter(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return good.union(alone)


def _fit_all(classes: DataFrame, total: int, sample: int) -> dict[int, Codes]:
    """Codes for every width of which the sample holds at least two vectors."""
    drawn = classes.select("width", "vector", F.xxhash64("vector").alias("order")).orderBy("order", "width").limit(sample)
    by_width: dict[int, list] = {}
    for r in drawn.select("width", "vector").collect():
        by_width.setdefault(r.width, []).append(r.vector)
    return {w: fit(unit_rows(np.array(v)), total) for w, v in by_width.items() if len(v) > 1}
