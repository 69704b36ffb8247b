"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import frugal
from wardlight.llm.files import locate, qualified
from wardlight.llm.tokens import ENCODED_BYTES, encoder, slices
from wardlight.session import materialise, scratch_path

MAGIC = b"VBT1"
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 26
_HEAD = struct.Struct("<4sIQQQ")  # mark, documents, ids, control bytes, data bytes
# For each control byte the lengths of its four ids, two bits each, lowest first.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes: each rank takes as many little-endian bytes as it needs, one to four."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[:len(ranks)] = size - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """Ranks by table lookup: lengths of each control byte, then four bytes at each place, masked."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    value = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        value |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & _MASKS[size]


def pack_block(ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    """Documents of one block: head, document ids and which are null, numbers of ids, control bytes, data bytes."""
    control, data = encode(ranks)
    null = np.array([i is None for i in ids], np.uint8).tobytes()
    head = _HEAD.pack(MAGIC, len(ids), len(ranks), len(control), len(data))
    return b"".join([head, np.array([i or 0 for i in ids], "<i8").tobytes(), null, lengths.astype("<u8").tobytes(), control, data])


def unpack_block(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    mark, docs, count, controls, datas = _HEAD.unpack_from(raw)
    if mark != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    null = raw[at + 8 * docs:at + 9 * docs]
    lengths = np.frombuffer(raw[at + 9 * docs:at + 17 * docs], "<u8").astype(np.int64)
    at += 17 * docs
    ranks = decode(raw[at:at + controls], raw[at + controls:at + controls + datas], count)
    return [None if n else i for i, n in zip(ids, null, strict=True)], lengths, ranks


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` per row, the ids with ``end_id`` as compressed little-endian 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, squeeze = encoder(tokenizer), zstandard.ZstdCompressor(3)
        for batch in batches:
            texts = batch.column(1)
            for first, number in slices(texts, ENCODED_BYTES):
                flat, lengths = encode_texts.ids(texts.slice(first, number))
                ends = np.cumsum(lengths)
                rows = [squeeze.compress(_narrow(np.append(flat[e - n:e], end_id)))
                        for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, number), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id bigint, ids binary")


def _narrow(ids: np.ndarray) -> bytes:
    """A leading byte says whether 16 or 32 bits are used for each id."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")


def frequencies(tokens: DataFrame) -> DataFrame:
    """``(id, n)`` for each id over the whole table: one count per id and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for raw in batch.column(0):
                n = np.bincount(_widen(expand.decompress(raw.as_py())))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[:len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(frugal(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> tuple[DataFrame, list[int]]:
    """Write the ids of every document, in ascending id order, to ``folder`` in the shared file system.

    Returns the manifest, one row per block (``file``, ``at``, ``size``, ``start``: ids of all documents before it), and the
    ids by rank; both suffice to read back. Ranks are by falling count over all documents,
    ties by id; the list is bounded by the vocabulary. A null text is empty; null ids
    come first; documents of equal id stand in order of their ids' hash. A range of ids
    is one file, written under a name of its own by each attempt of a task, and only files in the manifest count.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "token-files"))
    tokens = materialise(tokenise(docs, tokenizer, end_id, id_col, text_col), "tokens")
    counts = sorted((-r.n, r.id) for r in frequencies(tokens).collect())
    by_rank = [i for _, i in counts]
    rank = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    total = -sum(n for n, _ in counts)
    files = max(1, min(spark.sparkContext.defaultParallelism * 2, -(-total // block_tokens)), -(-total // file_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}.vbt"
        expand, system, out = zstandard.ZstdDecompressor(), None, None
        rows: list[tuple] = []
        ids, held, size, done = [], [], 0, 0

        def flush():
            nonlocal ids, held, size, done, system, out
            if out is None:
                system, path = locate(name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            raw = pack_block(ids, np.array([len(h) for h in held]), rank[np.concatenate(held)])
            rows.append((part, name, out.tell(), len(raw), done, size))
            out.write(raw)
            ids, held, size, done = [], [], 0, done + size

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                held.append(_widen(expand.decompress(raw.as_py())))
                size += len(held[-1])
                if size >= block_tokens:
                    flush()
        if ids:
            flush()
        if out is not None:
            out.close()
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[k], pa.string() if k == 1 else pa.int64()) for k in range(6)],
                                         ["part", "file", "at", "size", "within", "count"])

    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = ordered.select("doc_id", "ids").mapInArrow(frugal(run), "part bigint, file string, at bigint, size bigint, within bigint, count bigint")
    blocks = materialise(blocks, "token-blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = blocks.groupBy("part").agg(F.sum("count").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    manifest = blocks.join(offsets, "part").select("file", "at", "size", (F.col("offset") + F.col("within")).alias("start"))
    return manifest, by_rank


def read_tokens(manifest: DataFrame, by_rank: list[int]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document from the files, ids as little-endian 32-bit integers."""
    table = np.array([*by_rank, 0], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = locate(row["file"])
                with system.open_input_file(path) as f:
                    f.seek(row["at"])
                    docs, lengths, ranks = unpack_block(f.read(row["size"]))
                ids, ends = table[ranks], np.cumsum(lengths)
                raw = [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(row["start"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    blocks = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return blocks.mapInArrow(frugal(run), "doc_id bigint, start bigint, n_tokens bigint, ids binary")

