"""Benchmark decontamination: suffix arrays over shards of documents, searched with every benchmark window."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import frugal, text_bytes
from wardlight.llm.files import read_blocks, table_files
from wardlight.session import materialise

WINDOW = 13
HIT_SHARE = 20
SHARD_BYTES = 8 << 20
BLOCK_ITEMS = 5_000
_SEPARATORS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))
_PIECE = 1 << 22
_MATCH = "array<struct<item_id: string, item_start: bigint, doc_start: bigint, words: bigint>>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, letters (A-Z lower-cased) and non-ASCII characters."""
    return text.lower().translate(_SEPARATORS).split()


class _Suffixes:
    """One block of benchmark items: word ids, and their distinct windows in order of their words.

    A window is the first ``window`` words of a suffix; an item with fewer words is one
    window. Id 0 stands for every word that no item of the block has.
    """

    def __init__(self, names: list[str | None], texts: list[bytes], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = names
        items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64) for t in texts]
        self.words = np.concatenate(items) if items else np.zeros(0, np.int64)
        self.ends = np.cumsum([len(i) for i in items], dtype=np.int64)
        lengths = [min(window, len(i)) for i in items]
        self.width = max(lengths, default=0)
        self.shortest = min((n for n in lengths if n), default=0)
        if not self.width:
            return
        starts = np.array([(k, s, n) for k, n in enumerate(lengths) if n for s in range(len(items[k]) - n + 1)], np.int64)
        matrix = np.zeros((len(starts), self.width), ">u4")
        for row, (k, s, n) in enumerate(starts.tolist()):
            matrix[row, :n] = items[k][s:s + n]
        keys = _keys(matrix)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        rows = order[first]
        self.low = keys[rows]
        self.lengths = starts[rows, 2]
        top = matrix[rows]
        top[np.arange(self.width) >= self.lengths[:, None]] = 0xFFFFFFFF
        self.high = _keys(top)
        self.starts = starts[order, :2]
        self.groups = np.append(np.flatnonzero(first), len(order))
        self.opening = min(3, self.shortest)
        self.opens = self._open(matrix[rows, :self.opening].astype(np.int64))
        self.openings = np.unique(self.opens)

    def _open(self, columns: np.ndarray) -> np.ndarray:
        """One number for the first words of each row (up to three of at most 2^21 ids)."""
        out = np.zeros(len(columns), np.int64)
        for c in range(columns.shape[1]):
            out = (out << 21) | (columns[:, c] & 0x1FFFFF)
        return out

    def encode(self, distinct: list[bytes]) -> np.ndarray:
        """Word ids of a shard's distinct words."""
        return np.fromiter(map(self.vocabulary.get, distinct, repeat(0)), np.int64, len(distinct))

    def starts_of(self, window: int) -> list[list[int]]:
        """Items and places in them where a window starts."""
        return self.starts[self.groups[window]:self.groups[window + 1]].tolist()

    def search(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ``(window, position)`` with the window's words at that position of a shard.

        ``ids`` are the shard's words, ``ends`` for each position where its document ends. The suffix array holds
        the positions that can open a window: enough known words follow and the first
        ones open some window. It is ordered by the words a window can compare.
        """
        none = np.zeros(0, np.int64)
        if not self.width or not len(ids):
            return none, none
        places = np.arange(len(ids))
        unknown = np.where(ids == 0, places, len(ids))
        stop = np.minimum(np.minimum.accumulate(unknown[::-1])[::-1], ends)
        at = places[stop - places >= self.shortest]
        opens = self._open(ids[at[:, None] + np.arange(self.opening)])
        known = np.isin(opens, self.openings)
        at, opens = at[known], opens[known]
        if not len(at):
            return none, none
        reach = at[:, None] + np.arange(self.width)
        columns = np.where(reach < stop[at][:, None], ids[np.minimum(reach, len(ids) - 1)], 0)
        keys = _keys(columns.astype(">u4"))
        array = np.argsort(keys, kind="stable")
        keys = keys[array]
        near = np.flatnonzero(np.isin(self.opens, opens))  # no other window opens anywhere in the shard
        left, right = np.searchsorted(keys, self.low[near], "left"), np.searchsorted(keys, self.high[near], "right")
        found = np.flatnonzero(right > left)
        sizes = (right - left)[found]
        offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(near[found], sizes), at[array[np.repeat(left[found], sizes) + offsets]]

    def matches(self, windows: np.ndarray, places: np.ndarray, doc: np.ndarray) -> list[dict]:
        """For each item the longest verbatim match at each place, in ascending order, that reaches beyond those before it."""
        out, covered, k = [], {}, 0
        windows, places = windows.tolist(), places.tolist()
        while k < len(places):
            at, best = places[k], {}
            while k < len(places) and places[k] == at:
                reach = at + int(self.lengths[windows[k]])
                for item, start in self.starts_of(windows[k]):
                    if reach > covered.get(item, 0):
                        n = self._common(item, start, doc, at)
                        if n > best.get(item, (0, 0))[0]:
                            best[item] = (n, start)
                k += 1
            for item, (n, start) in best.items():
                out.append({"item_id": self.names[item], "item_start": start, "doc_start": at, "words": n})
                covered[item] = at + n
        return out

    def _common(self, item: int, start: int, doc: np.ndarray, at: int) -> int:
        """Words that an item and a document share from these places on."""
        a = self.words[start + (self.ends[item - 1] if item else 0):self.ends[item]]
        b = doc[at:at + len(a)]
        other = np.flatnonzero(a[:len(b)] != b)
        return int(other[0]) if len(other) else len(b)


def _keys(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(f"S{matrix.shape[1] * 4}").ravel()


def _build(items: DataFrame, window: int, block_items: int) -> DataFrame:
    """The benchmark in blocks of about ``block_items`` items, their windows sorted once: a written table with one row per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("name", pa.string()), ("bytes", pa.binary())]))
        if rows.num_rows:
            block = _Suffixes(rows.column(0).to_pylist(), rows.column(1).to_pylist(), window)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])

    parts = max(1, -(-items.count() // block_items))
    return materialise(items.repartition(parts).mapInArrow(frugal(run), "block binary"), "benchmark-blocks")


def _blocks(uris: list[str], held: list) -> Iterator[_Suffixes]:
    """The benchmark block by block; a benchmark of a single block stays in memory for the next shard."""
    if held:
        yield from held
        return
    blocks = 0
    for batch in read_blocks(uris, 1):
        blocks += 1
        block = pickle.loads(batch.column(0)[0].as_py())
        yield block
    if blocks == 1:
        held.append(block)


def _parse(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, list[int]]:
    """Distinct words of a shard, the number of the word at each place, words of each text; texts are read in pieces that end between words."""
    numbers: dict[bytes, int] = {}
    parts, counts = [], []
    for text in texts:
        at, count = 0, 0
        while at < len(text):
            end = at + _PIECE
            while end < len(text) and _SEPARATORS[text[end] | 0x20 if 0x41 <= text[end] <= 0x5A else text[end]] != 0x20:
                end += 1
            words = words_of(text[at:end])
            for w in set(words).difference(numbers):
                numbers[w] = len(numbers)
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            at, count = end, count + len(words)
        counts.append(count)
    return list(numbers), np.concatenate(parts) if parts else np.zeros(0, np.int64), counts


def _shard(texts: list[bytes], blocks: Iterator[_Suffixes]) -> tuple[list[int], list[int], list[set], list[list[dict]]]:
    """For each text: words, words inside matches, names of matching items, longest matches."""
    names: list[set] = [set() for _ in texts]
    spans: list[list[dict]] = [[] for _ in texts]
    distinct, words, counts = _parse(texts)
    starts = np.cumsum(counts) - counts
    stops = np.repeat(starts + counts, counts)
    hits = np.zeros(len(words) + 1, np.int64)
    for block in blocks:
        ids = block.encode(distinct)[words]
        window, place = block.search(ids, stops)
        if not len(place):
            continue
        np.add.at(hits, place, 1)
        np.add.at(hits, place + block.lengths[window], -1)
        owner = np.searchsorted(starts, place, "right") - 1
        order = np.lexsort((place, owner))
        window, place, owner = window[order], place[order], owner[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for w, p in zip(np.split(window, cuts), np.split(place, cuts), strict=True):
            d = int(np.searchsorted(starts, p[0], "right") - 1)
            names[d].update(block.names[item] for k in np.unique(w).tolist() for item, _ in block.starts_of(k))
            spans[d] += block.matches(w, p - starts[d], ids[starts[d]:starts[d] + counts[d]])
    inside = np.cumsum(hits)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    ends = np.cumsum(counts)
    return counts, (total[ends] - total[ends - counts]).tolist(), names, spans


def overlaps(docs: DataFrame, items: DataFrame, text_col: str = "text", carry: list[str] | None = None,
             item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, hit_share: int = HIT_SHARE,
             shard_bytes: int = SHARD_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Verbatim matches of benchmark items in documents.

    Per document: ``row`` (the ``carry`` columns, by default all), ``n_words``, ``n_hit`` (words inside an occurrence of
    a window), ``items`` (distinct ids of items with an occurring window, sorted as
    strings), ``matches`` (for each item the longest match at each place where one starts that reaches
    beyond those of the item before it, with item, place in the item, place in the document,
    words) and ``contaminated``: ``n_hit > 0`` and ``hit_share * n_hit >= n_words``.

    Documents are cut into shards of ``shard_bytes`` where they lie; nothing is shuffled.
    Each shard's suffix array holds the places whose first words open a window, in order of ``window`` words, and is searched with
    all distinct windows of the benchmark (of an item with fewer words, the whole item). These are sorted once, in blocks of
    ``block_items``, which tasks read from the shared folder. Matches shorter than that are not looked for. Null texts have no words;
    an item without words has no window; windows of an item with a null id count
    but it is not listed; repeated rows are separate rows.
    """
    carry = docs.columns if carry is None else carry
    written = materialise(items.select(F.col(item_id_col).cast("string").alias("name"),
                                       text_bytes(item_text_col).alias("bytes")).filter("octet_length(bytes) > 0"), "benchmark")
    uris = table_files(_build(written, window, block_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Suffixes] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and (size < shard_bytes or not texts):
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    size += len(texts[-1])
                words, hit, names, spans = _shard(texts, _blocks(uris, held))
                listed = [sorted(n for n in found if n is not None) for found in names]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), pa.array(words, pa.int64()), pa.array(hit, pa.int64()),
                    pa.array(listed, pa.list_(pa.string())), pa.array(spans, _MATCHES)],
                    ["row", "n_words", "n_hit", "items", "matches"])
                at += len(texts)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text_bytes(text_col).alias("bytes"))
    found = rows.mapInArrow(frugal(run), f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint, n_hit bigint, "
                                 f"items array<string>, matches {_MATCH}")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * hit_share >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated by ``items``, all columns as they are."""
    return overlaps(docs, items, **options).filter(~F.col("contaminated")).select("row.*")
