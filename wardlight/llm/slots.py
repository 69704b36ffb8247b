"""Hard-negative mining by slot-decomposed selection.

The upper limits that an anchor's positives set split scores into disjoint slots. Every block of rows keeps the best few
of each slot, blocks are merged slot by slot, and joining the slots from the lowest up answers all windows of an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.files import read_blocks, table_files
from wardlight.session import materialise

POSITIVES = 5
NEGATIVES = 10
LOWER, UPPER, WHOLE = 30, 90, 100
SCALE = 256
BLOCK_ROWS = 65_536
LEAST_ROWS = 4096
ANCHORS = 256
_EXACT_FLOAT, _EXACT_INT = 2.0**53, 2.0**56


@dataclass
class _Vectors:
    """Vectors of one width, scaled to whole numbers."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    positives: list[list[dict]] | None

    def scores(self, other: "_Vectors") -> np.ndarray:
        """Inner products as exact integers."""
        most = self.values.shape[1] * np.abs(self.values).max(initial=0) * np.abs(other.values).max(initial=0)
        if most < _EXACT_FLOAT:
            return (self.values @ other.values.T).astype(np.int64)
        if most < _EXACT_INT:
            return self.values.astype(np.int64) @ other.values.T.astype(np.int64)
        raise ValueError("scores of 2^56 and more are not supported")


def _by_width(table: pa.Table | pa.RecordBatch, scale: int) -> dict[int, _Vectors]:
    out = {}
    lists = table.column("v")
    widths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        some = table.filter(pa.array(widths == width))
        flat = pc.list_flatten(some.column("v")).to_numpy(zero_copy_only=False).astype(np.float64)
        out[width] = _Vectors(
            some.column("id").to_numpy(zero_copy_only=False), some.column("label").to_numpy(zero_copy_only=False),
            np.floor(scale * flat).reshape(some.num_rows, width),
            some.column("positives").to_pylist() if "positives" in some.schema.names else None)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores in falling order, ties by the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def limits(score: int) -> tuple[int, int]:
    """Least and greatest whole score of a positive's window."""
    return -(-LOWER * score // WHOLE), UPPER * score // WHOLE


def _nearest(anchors: _Vectors, rows: _Vectors, positives: int) -> Iterator[tuple]:
    """``(anchor, slot 0, id, score)`` of the best rows of the anchor's label."""
    scores = anchors.scores(rows)
    for k, anchor in enumerate(anchors.ids.tolist()):
        own = np.flatnonzero((rows.labels == anchors.labels[k]) & (rows.ids != anchor))
        for j in own[best(scores[k, own], rows.ids[own], positives)].tolist():
            yield anchor, 0, int(rows.ids[j]), int(scores[k, j])


def _slotted(anchors: _Vectors, rows: _Vectors, negatives: int) -> Iterator[tuple]:
    """``(anchor, slot, id, score)`` of the best rows of other labels in each slot of an anchor."""
    scores = anchors.scores(rows)
    for k, anchor in enumerate(anchors.ids.tolist()):
        windows = [limits(p["score"]) for p in anchors.positives[k]]
        upper = sorted({high for _, high in windows})
        other = np.flatnonzero((rows.labels != anchors.labels[k]) & (scores[k] <= upper[-1]) & (scores[k] >= min(low for low, _ in windows)))
        slot = np.searchsorted(upper, scores[k, other], "left")
        for s in np.unique(slot).tolist():
            some = other[slot == s]
            for j in some[best(scores[k, some], rows.ids[some], negatives)].tolist():
                yield anchor, s, int(rows.ids[j]), int(scores[k, j])


_KEPT = "anchor bigint, slot int, id bigint, score bigint"


def _against_all(rows: DataFrame, anchors: DataFrame, keep: Callable[[_Vectors, _Vectors], Iterator[tuple]], scale: int, k: int,
                 block_rows: int, anchor_rows: int) -> DataFrame:
    """What ``keep`` finds for each block of anchors in each block of rows, merged to the best ``k`` of each anchor and slot.

    A task holds one block of rows and reads the written anchors block by block; neither table is broadcast or collected.
    """
    files = table_files(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _by_width(pa.Table.from_batches(held), scale)
            for some in read_blocks(files, anchor_rows):
                kept = [x for width, a in _by_width(some, scale).items() if width in block for x in keep(a, block[width])]
                columns = list(zip(*kept, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == 1 else pa.int64()) for n, c in enumerate(columns)],
                                                 ["anchor", "slot", "id", "score"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block_rows:
                yield from found(held)
                held, size = [], 0
        if size:
            yield from found(held)

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return rows.mapInArrow(run, _KEPT).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: str, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows for which the condition ``anchors`` holds. Scores are integer inner products of ``floor(scale * x)``;
    higher ones come first, ties by the smaller id. An anchor's positives are its first ``positives`` other rows of
    the same label; for each, the first ``negatives`` rows of other labels with ``30 p <= 100 n <= 90 p`` are returned (a
    negative p has no such row). Rows with a null id, label or vector or with a component that is null or not finite take no part; of
    rows with one id the one with the smallest label, then vector, counts. Only vectors of one width meet. An anchor without
    positives, and a positive without negatives, have no row; so has an empty table. Scores of 2^56 and more are an error.
    """
    x = F.col(vector_col)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    named = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & sound)
    named = named.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), x.alias("v"), F.expr(anchors).alias("asks"))
    one = named.groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r")).select("id", "r.label", "r.v", "r.asks")
    every = materialise(one, "vectors")
    blocks = max(1, -(-every.count() // block_rows))
    # Small tables are cut further, as far as there are cores, but not into blocks that keep more than they leave out.
    blocks = max(blocks, min(every.sparkSession.sparkContext.defaultParallelism, -(-every.count() // LEAST_ROWS)))
    rows = every.select("id", "label", "v").repartition(blocks, "id")
    asking = materialise(every.filter("asks").select("id", "label", "v"), "anchors")
    near = _against_all(rows, asking, lambda a, r: _nearest(a, r, positives), scale, positives, block_rows, anchor_rows)
    near = near.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    asking = materialise(asking.join(near, "id"), "positives")
    kept = _against_all(rows, asking, lambda a, r: _slotted(a, r, negatives), scale, negatives, block_rows, anchor_rows)
    kept = kept.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("slot", "place", "id", "score")).alias("kept"))
    return _windows(asking.select("id", "positives").join(kept, "id"), negatives)


def _windows(found: DataFrame, negatives: int) -> DataFrame:
    """All windows of each anchor from its slots: slots are joined from the lowest up, so that each list holds the best rows up to an upper limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                upper = sorted({limits(p["score"])[1] for p in row["positives"]})
                slots: list[list[dict]] = [[] for _ in upper]
                for r in sorted(row["kept"], key=lambda r: r["place"]):
                    slots[r["slot"]].append(r)
                up_to, below = {}, []
                for high, slot in zip(upper, slots, strict=True):
                    below = up_to[high] = (slot + below)[:negatives]
                for p in row["positives"]:
                    low, high = limits(p["score"])
                    out += [(row["id"], p["id"], rank, r["id"], p["score"], r["score"])
                            for rank, r in enumerate((r for r in up_to[high] if r["score"] >= low), 1)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(columns)],
                                             ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return found.mapInArrow(run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
