"""Prefix tries of conversations: a z-fast trie whose dictionary is a table.

Compacted nodes are hashed at the two-fattest depth of their edge. Conversations look for the node they leave the trie
at by fat binary search, a join with the dictionary for each probe; those that leave at one place are inserted in
batches, one of them for each new edge. Edges are expanded to all depths at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.session import materialise

ROOT = bytes(16)
_WORDS = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``, one row for each id, turns in order as ``(symbol, words)``.

    Turns are ordered by their number, null first, ties by their content's hash. A null role or text is empty. Rows
    without an id belong to no conversation. A conversation is 16 bytes and a count for each turn, never its texts.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    each = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("symbol"), F.regexp_count(text, F.lit(_WORDS)).alias("words"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "symbol", "words")))
    return each.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["symbol"].alias("symbol"), t["words"].alias("words"))).alias("turns"))


def with_shared_openings(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c opens with the first h turns of c - c % ``every`` (all if fewer, none if there is none), h being
    crc32 of c's decimal digits modulo ``most``; its own turns after the first h follow."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    return joined.select("conv_id", F.concat(F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice("turns", 1, 0)), rest).alias("turns"))


def with_prefixes(convs: DataFrame) -> DataFrame:
    """``(conv_id, n, p, w)``: number of turns, hash of every prefix and words in every prefix, the empty one first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            symbols, words = flat.field("symbol").to_pylist(), flat.field("words").to_numpy(zero_copy_only=False)
            p, w = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                chain = [ROOT]
                for symbol in symbols[a:b]:
                    chain.append(xxhash.xxh3_128_digest(chain[-1] + symbol))
                p.append(chain)
                w.append(np.concatenate([[0], np.cumsum(words[a:b], dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(ends).astype(np.int32)), pa.array(p, pa.list_(pa.binary())), pa.array(w, pa.list_(pa.int64()))],
                ["conv_id", "n", "p", "w"])

    return convs.select("conv_id", "turns").mapInArrow(run, "conv_id bigint, n int, p array<binary>, w array<bigint>")


def _at(prefixes: Column | str, depth: Column | str) -> Column:
    """The prefix hash of a depth; null beyond the end."""
    return F.try_element_at(prefixes, (F.col(depth) if isinstance(depth, str) else depth) + 1)


def two_fattest(low: Column, high: Column) -> Column:
    """The number in ``(low, high]`` with the most trailing zeros."""
    bits = F.length(F.bin(low.bitwiseXOR(high).cast("bigint"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def _exits(todo: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """Depth ``lo`` of the deepest node on each sequence's path, by fat binary search.

    A handle that is found belongs to a node on the path (then the search goes on below it) or to
    the node whose edge the sequence leaves; its parent is the answer then.
    """
    handles = nodes.filter("handle IS NOT NULL").select("handle", F.col("depth").alias("xd"), F.col("h").alias("xh"), F.col("pd").alias("xp"))
    s = todo.withColumn("hi", F.col("n"))
    for _ in range(steps):
        f = two_fattest(F.col("lo"), F.col("hi"))
        # A search that has ended probes with a key of its own that is no handle, so such rows do not meet in one task.
        s = s.withColumn("f", F.when(F.col("lo") < F.col("hi"), f)).withColumn("handle", F.coalesce(_at("p", "f"), F.unhex(F.sha1(F.col("rep").cast("string").cast("binary")))))
        s = s.join(handles, "handle", "left")
        on = F.coalesce(_at("p", "xd") == F.col("xh"), F.lit(False))
        hit = F.col("xh").isNotNull()
        s = s.select("rep", "n", "p", F.when(on, F.col("xd")).when(hit, F.col("xp")).otherwise(F.col("lo")).alias("lo"),
                     F.when(on, F.col("hi")).when(hit, F.col("xp")).otherwise(F.coalesce(F.col("f") - 1, F.col("hi"))).alias("hi"))
    return s.drop("hi")


def _keyed(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Nodes ``(h, depth, ph, pd, rep)`` with the prefixes they are found by: handle, and first turn of the edge."""
    paths = sequences.select("rep", "p")
    return nodes.join(paths, "rep").select(
        "h", "depth", "ph", "pd", "rep", _at("p", F.col("pd") + 1).alias("first"), _at("p", two_fattest(F.col("pd"), F.col("depth"))).alias("handle"))


def build(sequences: DataFrame) -> DataFrame:
    """Compacted nodes ``(h, depth, ph, pd, rep, first, handle)`` of distinct sequences ``(rep, n, p)``.

    Each round is one batch: all sequences that are not in the trie yet look for their exit, edges are split where some
    leave them (all places of an edge at once), and of those that begin the same new edge the one with the smallest hash
    is inserted whole. The others stay, below the place where they left. A sequence meets about logarithmically
    many such choices, whatever the number of sequences on an edge, and no group is gathered.
    """
    spark = sequences.sparkSession
    nodes = spark.createDataFrame([(bytearray(ROOT), 0, None, -1, None, None, None)],
                                  "h binary, depth int, ph binary, pd int, rep bigint, first binary, handle binary")
    todo, started = sequences.select("rep", "n", "p", F.lit(0).alias("lo")), False
    paths = sequences.select(F.col("rep").alias("e_rep"), F.col("p").alias("e_p"))
    while True:
        left, longest = todo.agg(F.count("*"), F.max("n")).first()
        if not left:
            return nodes
        if started:
            s = _exits(todo, nodes, int(longest).bit_length())
            edges = nodes.filter("first IS NOT NULL").select("first", F.col("h").alias("e_h"), F.col("depth").alias("e_depth"), F.col("rep").alias("e_rep"))
            s = s.withColumn("first", _at("p", F.col("lo") + 1)).join(edges, "first", "left").drop("first").join(paths, "e_rep", "left")
            common = F.size(F.filter(F.zip_with("p", "e_p", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)) - 1
            s = s.withColumn("lcp", F.when(F.col("e_h").isNull(), F.col("lo")).otherwise(F.least(common, "e_depth"))).drop("e_p")
        else:
            none = F.lit(None)
            s = todo.select("*", none.cast("bigint").alias("e_rep"), none.cast("binary").alias("e_h"), none.cast("int").alias("e_depth"), F.col("lo").alias("lcp"))
            started = True
        left_at = materialise(s, "exits")
        # Places where edges are split, and the edges that begin at the last of them.
        cuts = left_at.filter("e_h IS NOT NULL AND lcp > lo").groupBy("e_h", "lcp").agg(
            F.first(_at("p", "lcp")).alias("h"), F.first("lo").alias("lo"), F.first(_at("p", "lo")).alias("above"),
            F.first("e_rep").alias("rep"), F.first("e_depth").alias("e_depth"))
        along = Window.partitionBy("e_h").orderBy("lcp")  # at most as many as the edge has turns
        cuts = materialise(cuts.withColumns({
            "ph": F.coalesce(F.lag("h").over(along), F.col("above")), "pd": F.coalesce(F.lag("lcp").over(along), F.col("lo")),
            "last": F.lead("lcp").over(along).isNull()}), "cuts")
        split = cuts.select("h", F.col("lcp").alias("depth"), "ph", "pd", "rep")
        moved = cuts.filter("last").select(F.col("e_h").alias("h"), F.col("e_depth").alias("depth"), F.col("h").alias("ph"), F.col("lcp").alias("pd"), "rep")
        longer = left_at.filter("lcp < n")
        chosen = longer.groupBy(_at("p", F.col("lcp") + 1).alias("edge")).agg(F.min(F.struct(F.xxhash64("rep").alias("by"), "rep")).alias("c")).select("c.rep")
        chosen = materialise(chosen, "chosen")
        leaves = longer.join(chosen, "rep").select(_at("p", "n").alias("h"), F.col("n").alias("depth"), _at("p", "lcp").alias("ph"), F.col("lcp").alias("pd"), "rep")
        fresh = _keyed(split.unionByName(moved).unionByName(leaves), sequences)
        nodes = materialise(nodes.join(moved.select("h"), "h", "left_anti").unionByName(fresh), "nodes")
        todo = materialise(longer.join(chosen, "rep", "left_anti").select("rep", "n", "p", F.col("lcp").alias("lo")), "todo")


def _climbs(nodes: DataFrame) -> list[DataFrame]:
    """Tables ``(h, up)`` of the node 1, 2, 4, ... steps above, as long as there is one."""
    out = [materialise(nodes.filter("ph IS NOT NULL").select("h", F.col("ph").alias("up")), "climb")]
    while not out[-1].isEmpty():
        last = out[-1]
        further = last.filter(F.col("up") != F.lit(ROOT)).join(last.select(F.col("h").alias("up"), F.col("up").alias("next")), "up")
        out.append(materialise(further.select("h", F.col("next").alias("up")), "climb"))
    return out[:-1]


def _gathered(values: DataFrame, climbs: list[DataFrame], how: dict[str, str]) -> DataFrame:
    """Columns of ``(h, ...)`` gathered over every node's subtree, doubling the reach with each step."""
    for climb in climbs:
        below = values.join(climb, "h").groupBy("up").agg(*[F.expr(f"{f}({c})").alias(f"_{c}") for c, f in how.items()]).withColumnRenamed("up", "h")
        both = {"sum": lambda c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)), "min": lambda c: F.least(c, f"_{c}")}
        values = materialise(values.join(below, "h", "left").select("h", *[both[f](c).alias(c) for c, f in how.items()]), "gathered")
    return values


def prefix_trie(convs: DataFrame) -> DataFrame:
    """All nodes of the trie of ``(conv_id, n, p, w)``, a written table of :func:`with_prefixes`.

    Per node: ``h`` (hash of the prefix), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends`` (members that end there). Equal conversations are one
    sequence with a count; an empty table has no node, and conversations without a turn end at the root.
    """
    ends = convs.groupBy(_at("p", "n").alias("end")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("ends"))
    sequences = materialise(convs.join(ends, "conv_id").withColumnRenamed("conv_id", "rep"), "sequences")
    nodes = build(sequences)
    if sequences.isEmpty():
        nodes = nodes.limit(0)
    children = nodes.filter("ph IS NOT NULL").groupBy("ph").agg(F.count("*").alias("n_children")).withColumnRenamed("ph", "h")
    here = sequences.select(F.col("end").alias("h"), F.col("rep").alias("conv_id"), "ends")
    nodes = materialise(nodes.join(children, "h", "left").join(here, "h", "left").fillna(0, ["n_children", "ends"]), "trie")
    climbs = _climbs(nodes)
    counts = _gathered(nodes.select("h", F.col("ends").alias("n_convs"), "conv_id", (F.col("n_children") == 0).cast("bigint").alias("n_leaves")), climbs,
                       {"n_convs": "sum", "conv_id": "min", "n_leaves": "sum"})
    words = sequences.select("rep", "w")
    edge = F.coalesce((F.col("n_convs") - 1) * (_at("w", "depth") - _at("w", "pd")), F.lit(0))
    known = materialise(nodes.drop("conv_id").join(counts, "h").join(words, "rep", "left").withColumn("own", edge), "counted")
    saved = _gathered(known.select("h", F.col("own").alias("below")), climbs, {"below": "sum"})
    parents = counts.select(F.col("h").alias("ph"), F.col("conv_id").alias("above"))
    known = known.join(saved, "h").join(parents, "ph", "left")
    # Edges are expanded: nodes inside an edge have its members and one child.
    levels = F.transform(F.sequence(F.col("pd") + 1, F.col("depth")), lambda d: F.struct(d.alias("depth"), _at("w", d - 1).alias("before")))
    path = sequences.select("rep", "p")
    flat = known.join(path, "rep", "left").withColumn("last", F.col("depth")).withColumn("level", F.explode(levels))
    d = F.col("level.depth")
    on_edge = F.coalesce((F.col("n_convs") - 1) * (_at("w", "last") - F.col("level.before")), F.lit(0))
    return flat.select(
        F.coalesce(_at("p", d), F.lit(ROOT)).alias("h"), "conv_id", d.cast("bigint").alias("depth"),
        F.when(d == F.col("pd") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(d == F.col("last"), F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below") - F.col("own") + on_edge).alias("saved_tokens"), F.when(d == F.col("last"), F.col("ends")).otherwise(0).alias("ends"))


def end_digests(convs: DataFrame) -> DataFrame:
    """``(h, digest)``: SHA-256 of the ids that end at a prefix, in ascending order, comma-joined.

    The ids of one prefix are streamed in order through one task, since the digest is sequential; none are gathered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for h, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h != at:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = h, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["h", "digest"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["h", "digest"])

    rows = convs.select(_at("p", "n").alias("h"), "conv_id").repartition("h").sortWithinPartitions("h", "conv_id")
    return rows.mapInArrow(run, "h binary, digest string")
