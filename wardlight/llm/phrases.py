"""Substring dedup: repeated-phrase automata.

Passages that recur are confirmed by sampled phrases, the phrases are compiled into sharded
Aho-Corasick automata over words, and the documents that hold some are streamed through the automata
of their shards to locate every occurrence. Windows around the places found are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import frugal
from wardlight.llm.tokens import ragged, slices
from wardlight.session import materialise, remove, scratch_path

WINDOW = 50
PHRASE = 8
SHARD_PHRASES = 20_000
STREAM_WORDS = 1 << 22
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95], np.uint64)  # odd, 5 modulo 8: of full order
_KNOWN_WORDS = 1_000_000
_NARROW = np.uint64(0xFFFFFFFF)


class _Values(dict):
    """64-bit values of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class _Rolling:
    """Hashes of any runs of words, modulo 2^64 over two bases."""

    def __init__(self) -> None:
        self.power = np.ones((2, 1), np.uint64)
        self.inverse = self.power

    def over(self, values: np.ndarray) -> "_Rolling":
        size = len(values) + 1
        if self.power.shape[1] < size:
            grown = np.repeat(_BASES[:, None], size, axis=1)
            back = np.repeat(np.array([[pow(int(b), -1, 1 << 64)] for b in _BASES], np.uint64), size, axis=1)
            grown[:, 0] = back[:, 0] = 1
            self.power, self.inverse = np.multiply.accumulate(grown, axis=1), np.multiply.accumulate(back, axis=1)
        self.sums = np.zeros((2, size), np.uint64)
        np.cumsum(values * self.power[:, :size - 1], axis=1, out=self.sums[:, 1:])
        return self

    def hashes(self, base: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        sums = self.sums[base]
        return (sums[starts + lengths] - sums[starts]) * self.inverse[base][starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values whose order has nothing to do with that of the input."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every run of ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:len(x) - step], x[step:])
        done += step
    return x


def sampled(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Places whose phrase hash is the least in some window of a document (``starts`` to ``ends``).

    Which places of a window are chosen depends on the window's words alone, so equal windows share a phrase.
    """
    span = window - phrase + 1
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, span, np.minimum)
    valid = np.zeros(len(least) + 1, np.int64)
    whole = ends - starts >= window
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, np.minimum(ends[whole] - window + 1, len(least)), -1)
    valid = np.cumsum(valid[:-1]) > 0
    # Hashes are shifted by one bit, so that 0 can stand for windows that are none.
    marks = np.where(valid, (least >> np.uint64(1)) + np.uint64(1), np.uint64(0))
    room = np.zeros(span - 1, np.uint64)
    reach = _sliding(np.concatenate([room, marks, room]), span, np.maximum)
    return np.flatnonzero(reach[:len(hashes)] == (hashes >> np.uint64(1)) + np.uint64(1))


def _split(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts one after the other, and how many each has."""
    lists = [t.split() for t in texts.cast(pa.binary()).to_pylist()]
    return [w for words in lists for w in words], np.array([len(x) for x in lists], np.int64)


def _sample_phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(a, doc_id, place)``: hash and place of every sampled phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = _Values(), _Rolling()
        for batch in batches:
            for first, number in slices(batch.column(1)):
                words, counts = _split(batch.column(1).slice(first, number))
                ends = np.cumsum(counts)
                if len(words) < phrase:
                    continue
                rolling.over(known.of(words))
                hashes = _mixed(rolling.hashes(0, np.arange(len(words) - phrase + 1), phrase))
                at = sampled(hashes, ends - counts, ends, window, phrase)
                owner = np.searchsorted(ends, at, "right")
                ids = batch.column(0).slice(first, number).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(ids[owner], pa.int64()), pa.array((at - (ends - counts)[owner]).astype(np.int32))],
                    ["a", "doc_id", "place"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(frugal(run), "a bigint, doc_id bigint, place int")


def _squeezed(docs: DataFrame) -> DataFrame:
    """``(doc_id, t, z)``: id, hash of the text and the text compressed, so that it moves at a third of its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            for first, number in slices(batch.column(2)):
                part = batch.slice(first, number)
                z = [squeeze.compress(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], ["doc_id", "t", "z"])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(frugal(run), "doc_id bigint, t bigint, z binary")


_STREAMED = "shard int, kind int, doc_id bigint, t bigint, start int, words int, part binary"


def _route(placed: DataFrame, window: int, phrase: int) -> DataFrame:
    """For each shard that a document's phrases belong to: the phrases it owns (kind 0), and the
    stretches of words that hold every window around its phrases (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, squeeze, expand = _Values(), zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                doc, t = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                values = known.of(expand.decompress(batch.column(2)[row].as_py()).split())
                found = batch.column(3).slice(row, 1).flatten()
                place, shard, own = (found.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                out = []
                for s in np.unique(shard).tolist():
                    at = np.sort(place[(shard == s) & (place + phrase <= len(values))]).astype(np.int64)
                    if not len(at):
                        continue
                    mine = place[(shard == s) & own & (place + phrase <= len(values))].astype(np.int64)
                    if len(mine):
                        keys = (values[mine[:, None] + np.arange(phrase)] & _NARROW).astype("<u4")
                        out.append((s, 0, doc, t, 0, len(mine), keys.tobytes()))
                    left, right = np.maximum(at + phrase - window, 0), np.minimum(at + window, len(values))
                    cut = np.append(True, left[1:] > right[:-1])
                    for a, b in zip(left[cut].tolist(), right[np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1)].tolist(), strict=True):
                        if b - a >= window:
                            out.append((s, 1, doc, t, a, b - a, squeeze.compress(values[a:b].tobytes())))
                if out:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (
                            pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                        ["shard", "kind", "doc_id", "t", "start", "words", "part"])

    return placed.select("doc_id", "t", "z", "found").mapInArrow(frugal(run), _STREAMED)


_LOCATED = "a bigint, c bigint, doc_id bigint, t bigint, start int, number int, hashes binary"


def _locate(streams: DataFrame, window: int, phrase: int) -> DataFrame:
    """Every occurrence of a phrase, with the windows that it is the first phrase of.

    Rows arrive by shard and stream, phrases first. The automaton of a shard is compiled when its first
    stretch comes and finds its phrases at all their places. ``a`` is the phrase and ``c`` the words its windows
    cover, hashed over different bases; ``start`` and ``number`` are the windows, whose hashes come once for each such run of words in a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, expand = _Rolling(), zstandard.ZstdDecompressor()
        at, automaton, ready, seen = None, None, False, set()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        names = [c.split()[0] for c in _LOCATED.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            shards, salts, types, docs, texts, starts = (batch.column(k).to_pylist() for k in range(6))
            for row, part in enumerate(batch.column(6)):
                if (shards[row], salts[row]) != at:
                    at, ready, seen = (shards[row], salts[row]), False, set()
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
                if not types[row]:
                    for key in np.frombuffer(part.as_py(), "<u4").reshape(-1, phrase).tolist():
                        automaton.add_word(tuple(key))
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if not len(automaton):
                    continue
                values = np.frombuffer(expand.decompress(part.as_py()), np.uint64)
                place = np.array([e for e, _ in automaton.iter(tuple((values & _NARROW).tolist()))], np.int64) - phrase + 1
                low = np.maximum(np.append(-1, place[:-1]) + 1, np.maximum(place + phrase - window, 0))
                high = np.minimum(place, len(values) - window)
                keep = low <= high
                place, low, number = place[keep], low[keep], (high - low + 1)[keep]
                if not len(place):
                    continue
                rolling.over(values)
                covered = number + window - 1
                lead = ((place - low) * 4096 + covered).astype(np.uint64)
                c = _mixed(rolling.hashes(1, low, covered) + lead).view(np.int64)
                fresh = np.array([x not in seen and not seen.add(x) for x in c.tolist()])
                every = rolling.hashes(1, ragged(low[fresh], number[fresh]), window).astype("<u8").tobytes()
                upto = 8 * np.cumsum(np.append(0, number[fresh]))
                hashes = np.full(len(place), None, object)
                hashes[fresh] = [every[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                same = (np.full(len(place), v, np.int64) for v in (docs[row], texts[row]))
                for column, value in zip(out, (rolling.hashes(0, place, phrase).view(np.int64), c, *same, starts[row] + low, number, hashes), strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([
                    *[pa.array(np.concatenate(c), k) for c, k in zip(out, kinds, strict=False)], pa.array(np.concatenate(out[6]), pa.binary())], names)

    return streams.mapInArrow(frugal(run), _LOCATED)


def _opened(rows: DataFrame) -> DataFrame:
    """``(a, c, first, h, place)``: the windows of each run of words, from their packed hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(h.as_py(), np.int64) for h in batch.column(3)]
            sizes = np.array([len(h) for h in packed], np.int64)
            take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            if len(take):
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).take(take) for k in range(3)], pa.array(np.concatenate(packed)),
                    pa.array(ragged(np.zeros(len(sizes), np.int64), sizes).astype(np.int32))], ["a", "c", "first", "h", "place"])

    return rows.select("a", "c", "first", "hashes").mapInArrow(frugal(run), "a bigint, c bigint, first bigint, h bigint, place int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_phrases: int = SHARD_PHRASES,
                     stream_words: int = STREAM_WORDS) -> DataFrame:
    """``(doc_id, t, runs)`` for documents ``(doc_id, text)``: runs ``(start, number)`` of windows whose words also start in
    a document with a smaller id; ``t`` is ``xxhash64(text)``.

    Every window of a document has a sampled phrase that depends on its words alone. Phrases seen under two ids recur;
    each belongs to the shard of the smallest id that has it. In a shard a window goes by the first phrase located in
    it, and occurrences of a phrase whose windows cover the same words are decided at once, by the smallest id among
    them. Only where a phrase occurs amid different words are single windows compared, once for each run of words.
    """
    spark = docs.sparkSession
    early, late = scratch_path(spark, "phrases"), scratch_path(spark, "streams")
    sample = materialise(_sample_phrases(docs, window, phrase), "sample", early)
    recurring = sample.groupBy("a").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").drop("last")
    recurring = materialise(recurring, "recurring", early)
    shards = max(1, -(-recurring.count() // shard_phrases))
    recurring = recurring.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int"))
    found = sample.join(recurring, "a").groupBy("doc_id").agg(
        F.collect_set(F.struct("place", "shard", (F.col("doc_id") == F.col("owner")).alias("own"))).alias("found"))
    routed = materialise(_route(_squeezed(docs).join(found, "doc_id"), window, phrase), "routed", late)
    remove(spark, early)

    # Streams of bounded length: a shard whose phrases are in a third of all documents is dealt over many, each with its phrases.
    load = routed.filter("kind = 1").groupBy("shard").agg(F.ceil(F.sum("words") / F.lit(stream_words)).cast("int").alias("salts"))
    streams = routed.join(load, "shard").withColumn("salt", F.explode(
        F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("salts") - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("doc_id", "t", "start"), F.col("salts")).cast("int"))))).drop("salts")
    streams = streams.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    streams = streams.select("shard", "salt", "kind", "doc_id", "t", "start", "part")
    located = materialise(_locate(streams, window, phrase), "located")
    remove(spark, late)

    key = ["a", "c"]
    runs = materialise(located.groupBy(*key).agg(F.min("doc_id").alias("first")), "runs")
    unlike = runs.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    packed = located.filter("hashes IS NOT NULL").select(*key, "hashes").join(runs.join(unlike, "a"), key).dropDuplicates(key)
    single = materialise(_opened(packed), "windows")
    least = single.groupBy("a", "h").agg(F.min("first").alias("least"))
    seen = single.join(least, ["a", "h"]).filter("least < first").groupBy(*key).agg(F.collect_list("place").alias("places"))
    # Written first, so that the join with all occurrences is one whose hot side can be split.
    known = materialise(runs.join(seen, key, "left"), "known")
    decided = located.select(*key, "doc_id", "t", "start", "number").join(known, key).filter("doc_id > first OR places IS NOT NULL")
    each = F.when(F.col("doc_id") > F.col("first"), F.array(F.struct("start", "number"))).otherwise(
        F.transform("places", lambda p: F.struct((F.col("start") + p).alias("start"), F.lit(1).alias("number"))))
    return decided.select("doc_id", "t", each.alias("runs")).groupBy("doc_id", "t").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text",
                   shard_phrases: int = SHARD_PHRASES, stream_words: int = STREAM_WORDS) -> DataFrame:
    """Per document ``id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, one space between) and ``spans``
    (removed words as ``(start, end)``).

    Words are what ASCII white space parts. A word goes if it lies in ``window`` consecutive words of its document that
    also start in a document with a smaller id; windows are judged on the input, so the first document keeps them. Rows of one
    id do not remove each other's words; a null id has no smaller one and is none. A null text has no words; texts
    shorter than a window stay whole; ties and repeated rows are treated alike; other columns are not touched.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase has at least one word and fits into a window")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = repeated_windows(docs, window, phrase, shard_phrases, stream_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            size = 0
            at = 0
            for row in range(batch.num_rows):
                words = expand.decompress(batch.column(1)[row].as_py()).split()
                found = batch.column(2)[row]
                spans = []
                kept = words
                if found.is_valid:
                    start, number = (found.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + number + window - 1, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                text = b" ".join(kept)
                for column, value in zip(out, (len(words), len(words) - len(kept), text, spans), strict=True):
                    column.append(value)
                size += len(text)
                if size > 8 << 20 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(at, row + 1 - at), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                        pa.array(out[2], pa.binary()).cast(pa.string()),
                        pa.array(out[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                        ["id", "n_words", "n_removed", "kept", "spans"])
                    out, size, at = [[], [], [], []], 0, row + 1

    return _squeezed(docs).join(runs, ["doc_id", "t"], "left").select("doc_id", "z", "runs").mapInArrow(
        frugal(run), "id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: bigint, end: bigint>>")
