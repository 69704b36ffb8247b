"""Packing: vector bins with simultaneous limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import frugal
from wardlight.llm.tokens import encoder, slices
from wardlight.session import materialise

TOKENS = 2048
SEGMENTS = 256
GROUP_PIECES = 4096


def fill(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each row of ``demands`` (every row fits into an empty bin).

    Dot-product heuristic: of the rows that still fit in the open bin, take the one with
    the largest product of demand and what is left of each limit, both as shares of the
    limits and weighted by the mean demand; open a new bin when none fits. Ties go to
    the earlier row. Rows of equal demand are one kind, so a step looks at each kind once.
    """
    kinds, kind, number = np.unique(demands, axis=0, return_inverse=True, return_counts=True)
    kind = kind.ravel()
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(number)[:-1])
    share = kinds / limits
    weight = share * (share * number[:, None]).sum(axis=0) / max(1, len(demands))
    taken = np.zeros(len(kinds), np.int64)
    bins, places = np.zeros(len(demands), np.int64), np.zeros(len(demands), np.int64)
    left, bin_no, place, todo = limits.astype(np.int64), 0, 0, len(demands)
    while todo:
        fits = (kinds <= left).all(axis=1)
        if not fits.any():
            left, bin_no, place = limits.astype(np.int64), bin_no + 1, 0
            continue
        best = int(np.argmax(np.where(fits, weight @ (left / limits), -1.0)))
        row = members[best][taken[best]]
        bins[row], places[row] = bin_no, place
        left, place, todo = left - kinds[best], place + 1, todo - 1
        taken[best] += 1
        if taken[best] == number[best]:
            alive = np.arange(len(kinds)) != best
            kinds, weight, taken, number = kinds[alive], weight[alive], taken[alive], number[alive]
            members.pop(best)
    return bins, places


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int = TOKENS, id_col: str = "doc_id",
                  text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """Pieces ``(doc_id, start, length, loss, doc_tokens, ids)`` of at most ``max_tokens`` ids, with the end id.

    Documents longer than a sequence are cut at its length; the rest of each is a piece of
    its own. ``loss`` is the piece's ids but the first, which nothing in its sequence
    precedes; with ``loss_col`` (first loss-bearing place of a document, as in an
    instruction and its answer) only those from there on, null meaning from the start.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for first, number in slices(texts):
                flat, lengths = encode.ids(texts.slice(first, number))
                ends = np.cumsum(lengths)
                docs_, loss_from = batch.column(0).slice(first, number).to_pylist(), batch.column(2).slice(first, number).to_pylist()
                out: list[list] = [[], [], [], [], [], []]
                for doc, bears, end, n in zip(docs_, loss_from, ends.tolist(), lengths.tolist(), strict=True):
                    ids = np.append(flat[end - n:end], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), max_tokens):
                        part = ids[start:start + max_tokens]
                        loss = max(0, min(len(part) - 1, start + len(part) - (bears or 0)))
                        for column, value in zip(out, (doc, start, len(part), loss, len(ids), part.tobytes()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.binary())],
                    ["doc_id", "start", "length", "loss", "doc_tokens", "ids"])

    bears = F.col(loss_col).cast("bigint") if loss_col else F.lit(None).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), bears.alias("bears"))
    return rows.mapInArrow(frugal(run), "doc_id bigint, start bigint, length bigint, loss bigint, doc_tokens bigint, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int = TOKENS, max_segments: int = SEGMENTS,
         max_loss: int | None = None, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with ``sequence_id``, ``segment`` (its place among the sequence's pieces) and ``offset`` in it.

    A sequence holds at most ``max_tokens`` ids, ``max_segments`` pieces and ``max_loss``
    loss-bearing ids (by default as many as there can be; a piece that alone has more is an error). Pieces
    of full length are sequences by themselves and are not moved. The others are dealt by number into
    groups of about ``group_pieces``, and each group is packed in one task; a group's
    size does not depend on the data. Null texts are empty and consist of the end id; null ids and
    repeated rows are packed like others. Sequences are padded by the reader.
    """
    max_loss = max_tokens if max_loss is None else max_loss
    limits = np.array([max_tokens, max_segments, max_loss], np.int64)
    pieces = cut_documents(docs, tokenizer, end_id, max_tokens, id_col, text_col, loss_col)
    pieces = materialise(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    if pieces.filter(F.col("loss") > max_loss).limit(1).count():
        raise ValueError("a piece bears more loss than a sequence may")
    full = pieces.filter(F.col("length") == max_tokens)
    rest = pieces.filter(F.col("length") < max_tokens)
    groups = max(1, -(-rest.count() // group_pieces))
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "segment", "offset"]

    def run(table: pa.Table) -> pa.Table:
        length, loss = (table.column(c).to_numpy() for c in ("length", "loss"))
        bins, place = fill(np.stack([length, np.ones_like(length), loss], axis=1), limits)
        order = np.lexsort((place, bins))
        sizes = length[order]
        upto = np.cumsum(sizes) - sizes
        first = np.append(True, np.diff(bins[order]) > 0)
        offset = np.zeros(len(bins), np.int64)
        offset[order] = upto - np.maximum.accumulate(np.where(first, upto, 0))
        group = table.column("group")[0].as_py()
        columns = [table.column(c) for c in names[:5]]
        return pa.table([*columns, pa.array(((group + 1) << 32) + bins), pa.array(place), pa.array(offset)], names)

    types = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, segment bigint, offset bigint"
    packed = rest.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups))).groupBy("group").applyInArrow(run, types)
    # Numbers of single sequences are negative, those of groups positive.
    alone = full.select(*names[:5], (-F.col("piece") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("segment"),
                        F.lit(0).cast("bigint").alias("offset"))
    return alone.union(packed)


def sequences(packed: DataFrame, pad_id: int = 0, max_tokens: int = TOKENS) -> DataFrame:
    """The sequences themselves: ``(sequence_id, ids, segments)``, ids padded to ``max_tokens`` as little-endian 32-bit integers.

    A sequence's pieces are bounded by its limits, so its group is too.
    """
    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        raw = b"".join(table.column("ids").to_pylist())
        pad = np.full(max_tokens - len(raw) // 4, pad_id, "<u4").tobytes()
        return pa.table([table.column("sequence_id").slice(0, 1), pa.array([raw + pad], pa.binary()), pa.array([table.num_rows], pa.int64())],
                        ["sequence_id", "ids", "segments"])

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id bigint, ids binary, segments bigint")
