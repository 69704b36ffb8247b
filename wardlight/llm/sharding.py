"""Shards of near equal bytes by histogram sort, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.session import materialise, scratch_path

SHARDS = 16
TOLERANCE = 0.005
PROBE_BITS = 10
PIECE_ROWS = 50_000
PIECE_BYTES = 8 << 20
PART_BYTES = 64 << 20
MAX_PARTS = 10_000
WIDTH = 64
LOWEST = -(1 << (WIDTH - 1))


@dataclass
class _Probe:
    """Where a splitter is sought: rows whose key starts with ``prefix`` (its first ``depth`` bits), on the text
    hash, or below one text hash ``text`` on the id hash. ``below`` is the exact size before that range."""

    target: float
    prefix: int = 0
    depth: int = 0
    below: int = 0
    text: int | None = None


def _prefix(col: str, depth: int) -> Column:
    """The first ``depth`` bits of a signed 64-bit hash; their order is that of the hash."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftright(F.col(col), WIDTH - depth)


def _counts(rows: DataFrame, probes: list[_Probe], bits: int) -> dict[tuple, list[tuple[int, int, int]]]:
    """For each open range the exact size and rows of its sub-ranges, in key order: at most 2^bits for each probe."""
    first = probes[0]
    if first.text is None:
        wanted = rows.filter(_prefix("text_key", first.depth).isin([p.prefix for p in probes]))
        keys = [F.lit(None).cast("long").alias("text"), _prefix("text_key", first.depth + bits).alias("part")]
    else:
        here = [(F.col("text_key") == p.text) & (_prefix("id_key", p.depth) == p.prefix) for p in probes]
        wanted = rows.filter(F.expr("false") if not here else here[0] if len(here) == 1 else _any(here))
        keys = [F.col("text_key").alias("text"), _prefix("id_key", first.depth + bits).alias("part")]
    found: dict[tuple, list] = {}
    for r in wanted.groupBy(*keys).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        found.setdefault((r.text, r.part >> bits if first.depth else 0), []).append((r.part, r["size"], r.n))
    return {k: sorted(v) for k, v in found.items()}


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def splitters(rows: DataFrame, shards: int, tolerance: float, probe_bits: int = PROBE_BITS) -> list[tuple[int, int]]:
    """Ascending keys ``(text_key, id_key)`` that cut ``rows`` into parts of near equal ``size``.

    Each round counts, over all rows, the exact size below evenly spread candidate keys
    within every range that still holds a splitter. A splitter is settled once a
    candidate is within ``tolerance`` (a share of a shard) of its target, or its range
    holds a single row or key; otherwise the next round refines the range around the target.
    The text hash is refined to its last bit before the id hash, so equal texts
    are cut only if no candidate between texts is near enough. The driver sees at most
    2^probe_bits counts for each splitter.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    open_probes = [_Probe(target=j * total / shards) for j in range(1, shards)]
    settled: list[tuple[float, int, int]] = []
    while open_probes:
        on_text = [p for p in open_probes if p.text is None]
        on_id = [p for p in open_probes if p.text is not None]
        open_probes = []
        for level in {(p.text is None, p.depth) for p in [*on_text, *on_id]}:
            probes = [p for p in [*on_text, *on_id] if (p.text is None, p.depth) == level]
            bits = min(probe_bits, WIDTH - probes[0].depth)
            counts = _counts(rows, probes, bits)
            for p in probes:
                _settle(p, counts.get((p.text, p.prefix), []), bits, allowed, settled, open_probes)
    return [(a, b) for _, a, b in sorted(settled)]


def _settle(p: _Probe, parts: list[tuple[int, int, int]], bits: int, allowed: float, settled: list, still_open: list) -> None:
    below = p.below
    depth = p.depth + bits
    for part, size, n in parts:
        if below + size >= p.target:
            before, after = p.target - below, below + size - p.target
            fine = depth == WIDTH
            if min(before, after) <= allowed or n == 1 or (fine and p.text is not None):
                settled.append((p.target, *_key(p.text, part if before <= after else part + 1, WIDTH - depth)))
            elif fine:
                still_open.append(_Probe(p.target, 0, 0, below, text=part))
            else:
                still_open.append(_Probe(p.target, part, depth, below, p.text))
            return
        below += size
    settled.append((p.target, -LOWEST, LOWEST))  # no rows: behind the last key


def _key(text: int | None, part: int, shift: int) -> tuple[int, int]:
    at = part << shift
    if text is None:
        return at, LOWEST
    return (text, at) if at < -LOWEST else (text + 1, LOWEST)


def _at_or_above(cut: tuple[int, int]) -> Column:
    text, own = cut
    if text >= -LOWEST:
        return F.lit(False)
    return (F.col("text_key") > text) | ((F.col("text_key") == text) & (F.col("id_key") >= own))


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE,
                 probe_bits: int = PROBE_BITS, piece_rows: int = PIECE_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The sharded tables, written to the shared folder: ``row`` (all columns of ``docs`` as they are), ``slot`` and ``shard``.

    The rows are sorted by (XXH64 of the text, XXH64 of the id, id); a shard is a range of that order and
    ``slot`` a row's place in it, from 0. A size is the text's UTF-8 bytes plus 1. Equal
    texts stand side by side and in one shard, unless a cut between texts is too far
    from the target (see ``splitters``). A null text counts as empty, null ids come
    first, repeated rows get slots of their own; of an empty table nothing is written.

    Each shard is a folder ``shard=K``. Its files hold consecutive slots, in order, about ``part_bytes`` of text each (more if
    that made over ``MAX_PARTS`` files). ``docs`` is read twice and must be the same rows both times: ids, hashes and sizes are
    counted in pieces, ranges of the order that start at the shard cuts and at fixed prefixes of the
    text hash; then the whole rows are moved once, to runs of pieces. A text with more than a
    thousandth of all rows is cut further by its id hash, so no piece holds a hot text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    keys = [F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_key"), F.xxhash64(F.col(f"`{id_col}`")).alias("id_key")]
    rows = materialise(docs.select((F.octet_length(text) + 1).cast("long").alias("size"), *keys[1:]), "shard-keys")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = splitters(rows, shards, tolerance, probe_bits)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(_at_or_above(cut), 1).otherwise(0)

    bits = max(10, min(20, max(count // piece_rows, total // PIECE_BYTES).bit_length()))
    hot = rows.groupBy("text_key").agg(F.count("*").alias("n")).filter(F.col("n") > max(100, count // 1000))
    hot = hot.groupBy(_prefix("text_key", bits).alias("range")).agg(F.collect_list("text_key").alias("hot"))
    marked = rows.withColumn("shard", shard.cast("int")).withColumn("range", _prefix("text_key", bits))
    marked = marked.join(F.broadcast(hot), "range", "left")  # at most a thousand keys
    is_hot = F.coalesce(F.array_contains("hot", F.col("text_key")), F.lit(False))
    between = F.coalesce(F.size(F.filter("hot", lambda x: x < F.col("text_key"))), F.lit(0)) * 2 + is_hot.cast("int")
    marked = marked.withColumn("between", between)
    marked = marked.withColumn("within", F.when(is_hot, _prefix("id_key", bits)).otherwise(F.lit(0).cast("long"))).drop("hot")

    piece = ["shard", "range", "between", "within"]
    key = F.struct("text_key", "id_key")
    pieces = marked.groupBy(*piece).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min(key).alias("low"), F.max(key).alias("high"))
    before = Window.partitionBy("shard").orderBy("range", "between", "within").rowsBetween(Window.unboundedPreceding, -1)
    upto = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "size")}
    pieces = pieces.withColumns({"offset": upto["n"], "part": F.floor(upto["size"] / max(part_bytes, total // MAX_PARTS))})
    parts = materialise(pieces.groupBy("shard", "part").agg(
        F.min("offset").alias("offset"), F.min("low").alias("low"), F.max("high").alias("high")), "shard-parts")
    most = (parts.agg(F.max("part")).first()[0] or 0) + 1
    # For each short prefix the parts that have keys there: at most 1024 more entries than parts.
    near = parts.select(
        F.explode(F.sequence(*[_prefix(f"{c}.text_key", PROBE_BITS) for c in ("low", "high")])).alias("prefix"),
        F.struct("low", "high", "shard", "offset", (F.col("shard") * most + F.col("part")).cast("int").alias("number")).alias("part"))
    near = near.groupBy("prefix").agg(F.collect_list("part").alias("parts"))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)
    whole = whole.withColumn("prefix", _prefix("text_key", PROBE_BITS)).join(F.broadcast(near), "prefix")
    whole = whole.withColumn("part", F.filter("parts", lambda p: key.between(p["low"], p["high"]))[0])
    whole = whole.select("row", "id", "text_key", "id_key", "part.number", "part.shard", "part.offset")
    inside = Window.partitionBy("number").orderBy("text_key", "id_key", "id")
    placed = whole.repartitionById(shards * most, F.col("number")).withColumn("slot", F.col("offset") + F.row_number().over(inside) - 1)
    placed = placed.select("row", F.col("slot").cast("long").alias("slot"), "shard").sortWithinPartitions("shard", "slot")
    path = scratch_path(spark, "shards")
    placed.write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def read_shard(tables: DataFrame, shard: int) -> DataFrame:
    """The rows of one shard in slot order, columns as they came."""
    return tables.filter(F.col("shard") == shard).orderBy("slot").select("row.*")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
               tolerance: float = TOLERANCE, probe_bits: int = PROBE_BITS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(id, size, text_crc32, shard, slot, text_key, id_key)`` of every row of the sharded tables (see ``write_shards``)."""
    tables = write_shards(docs, id_col, text_col, shards, tolerance, probe_bits, piece_rows)
    own, text = F.col(f"row.`{id_col}`"), F.coalesce(F.col(f"row.`{text_col}`").cast("binary"), F.lit(b""))
    return tables.select(own.alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                         "shard", "slot", F.xxhash64(text).alias("text_key"), F.xxhash64(own).alias("id_key"))
