"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import components, frugal, text_bytes
from wardlight.session import materialise

BITS = 64
SHINGLE = 3
MAX_BITS = 2
SEED = 42
SEGMENTS = 5
BUCKET_ROWS = 64
_STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed long.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are
    ``shingle`` words joined by a space, repeats counted; a shorter text is one shingle
    and a text without words has fingerprint zero. A bit is set if it is set in more
    than half of the shingles' XXH64 (seed 42).
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1]
    ends = ends[width - 1:]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        spans = zip(starts[at:at + _STEP].tolist(), ends[at:at + _STEP].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, hash, fp)`` per row: its id, XXH64 of its text, its fingerprint; a null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["id", "hash", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), text_bytes(text_col).alias("bytes"))
    return rows.mapInArrow(frugal(run), f"id {rows.schema['id'].dataType.simpleString()}, hash bigint, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def rings(max_bits: int, segments: int) -> list[list[int]]:
    """For each start on the ring, masks of the first one, two, ... segments from there."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(segments)]
    out = []
    for start in range(segments):
        mask, masks = 0, []
        for step in range(segments):
            mask |= parts[(start + step) % segments]
            masks.append(mask)
        out.append(masks)
    return out


def link_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints (distinct, column ``fp``) at most ``max_bits`` apart.

    Pigeonring: the bits are ``segments`` parts on a ring. If two fingerprints differ in
    at most ``max_bits`` bits, then from some part on every chain of ``l`` parts holds at
    most ``l * max_bits / segments`` of them. The leading parts of that chain, whose
    budget is below one bit, must be equal: they are the bucket key. The budgets of the
    longer chains prune the pairs of a bucket before the full Hamming check.

    A bucket of more than ``bucket_rows`` fingerprints is not paired. There each one is
    listed under itself and its neighbours at ``max_bits // 2`` flipped bits outside the
    key (for odd ``max_bits`` also with one bit blanked). Two fingerprints meet under such a
    middle if and only if they are close enough, and whatever meets is hung on
    the smallest, so rows grow in proportion to the bucket. Both ways are exact; they
    return different edges but the same components.
    """
    if max_bits == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if segments <= max_bits:
        raise ValueError("segments must be more than max_bits")
    budget = [(length * max_bits) // segments for length in range(1, segments + 1)]
    lead = sum(b == 0 for b in budget)
    ring = rings(max_bits, segments)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(masks[lead - 1]))) for masks in ring])
    keyed = prints.select("fp", F.posexplode(keys).alias("ring", "key"))
    sizes = keyed.groupBy("ring", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = materialise(keyed.join(sizes, ["ring", "key"]), "simhash-keys")

    cool = keyed.filter(F.col("n") <= bucket_rows).groupBy("ring", "key").agg(F.collect_list("fp").alias("group"))
    pairs = cool.select("ring", "group", F.explode("group").alias("a"))
    pairs = pairs.select("ring", "a", F.explode(F.filter("group", lambda x: x < F.col("a"))).alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    for length in range(lead, segments - 1):
        masks = F.array(*[F.lit(_signed(m[length])) for m in ring])
        pairs = pairs.filter(F.bit_count(differ.bitwiseAND(masks[F.col("ring")])) <= budget[length])
    pairs = pairs.filter(F.bit_count(differ) <= max_bits).select("a", "b")

    free = F.array(*[F.array(*[F.lit(_signed(1 << b)) for b in range(BITS) if not masks[lead - 1] >> b & 1])
                     for masks in ring])[F.col("ring")]
    hot = keyed.filter(F.col("n") > bucket_rows).select("ring", "fp", F.col("fp").alias("middle"), F.lit(0).cast("long").alias("blank"))
    if max_bits % 2:
        hot = hot.select("ring", "fp", "middle", F.explode(free).alias("blank"))
        hot = hot.withColumn("middle", F.col("middle").bitwiseAND(F.bitwise_not("blank")))
    for _ in range(max_bits // 2):
        flips = F.concat(F.array(F.lit(0).cast("long")), F.filter(free, lambda x: x != F.col("blank")))
        hot = hot.select("ring", "fp", "middle", "blank", F.explode(flips).alias("flip"))
        hot = hot.select("ring", "fp", "blank", F.col("middle").bitwiseXOR(F.col("flip")).alias("middle"))
    met = hot.groupBy("ring", "blank", "middle").agg(F.collect_set("fp").alias("group")).filter("size(group) > 1")
    stars = met.select(F.explode("group").alias("a"), F.array_min("group").alias("b")).filter("a <> b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: ``id``, ``hash``, ``fp``, ``root`` (smallest fingerprint reachable), ``component``
    (smallest id reachable).

    Rows of equal fingerprint are one node, so copies are never paired. Null texts have
    fingerprint zero like empty ones. A null id is never the smallest unless all ids of
    its component are null; then the component is null. Repeated rows stay repeated.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    links = components(link_fingerprints(nodes.select("fp"), max_bits, segments, bucket_rows))
    linked = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    found = linked.select("fp", "root").join(roots, "root")
    return rows.join(found, "fp").select("id", "hash", "fp", "root", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row left of each component.

    That is a row with the component's smallest id (a null id if it has no other). Where
    several rows carry that id, the one whose text has the smallest XXH64 stays; where
    the whole text repeats too, any one of the rows. A row is named by its id and the
    XXH64 of its text.
    """
    found = near_duplicates(docs, id_col, text_col, **options).filter(F.col("id").eqNullSafe(F.col("component")))
    rows = found.groupBy("root", "id", "hash").agg(F.count("*").alias("n"))
    keep = rows.groupBy("root").agg(F.min(F.struct("id", "hash", "n")).alias("k")).select("k.*")
    keep = materialise(keep, "simhash-keep")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash"))

    def chosen(part: DataFrame) -> DataFrame:
        return whole.join(part, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")), "left_semi")

    out = chosen(keep.filter("n = 1"))
    repeats = keep.filter("n > 1")
    if not repeats.isEmpty():
        out = out.union(chosen(repeats).dropDuplicates(["row_id", "row_hash"]))
    return out.select("row.*")
