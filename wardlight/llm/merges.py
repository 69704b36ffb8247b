"""Token counts by rank-synchronous merging of ragged arrays of symbols."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import frugal
from wardlight.llm.tokens import Cache, Pieces, slices

LIMIT = 512
LONG = 2048
BAND = 64
# Fixed value: how byte-level tokenizers of this family split text before merging.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Merges:
    """Number of tokens of pre-tokens, from a tokenizer's JSON file."""

    def __init__(self, tokenizer: str):
        model = json.loads(tokenizer)["model"]
        if model.get("type", "BPE") != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("plain byte-level pair merges are needed")
        vocab = model["vocab"]
        self.first = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.pieces = Pieces(tokenizer)
        self.split = regex.compile(PRE_TOKENS)
        self.cache = Cache()

    def counts(self, pre_tokens: list[bytes], long: int = LONG) -> np.ndarray:
        """Symbols that are left of each pre-token.

        Up to ``long`` bytes they are held together, so that a round serves them all; a
        longer one has so many rounds that each must touch its own places only. Both
        merge every place of the lowest rank at once and leave the same symbols.
        """
        out = np.zeros(len(pre_tokens), np.int64)
        short = [k for k, p in enumerate(pre_tokens) if len(p) <= long]
        out[short] = self._together([pre_tokens[k] for k in short])
        for k, p in enumerate(pre_tokens):
            if len(p) > long:
                out[k] = self._alone(p)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[found] == keys, self.ranks[found], self.none)

    def _alone(self, pre_token: bytes) -> int:
        """Symbols that are left of one pre-token, its places kept by rank.

        Symbols form a chain. Places wait in bands of ``BAND`` ranks; the lowest band is
        opened, its places are sorted by rank, and each round takes those of the lowest one. Only the pairs
        next to a merged place get a new rank, and wait under it.
        """
        n = len(pre_token)
        # Place n is the end of the chain and stands before its start, too; it pairs with nothing.
        symbols = np.append(self.first[np.frombuffer(pre_token, np.uint8)], self.base)
        after = np.append(np.arange(1, n + 1), n)
        before = np.append(np.arange(-1, n - 1), n)
        before[0] = n
        rank = np.full(n + 1, self.none)
        rank[:n - 1] = self._ranks(symbols[:n - 1], symbols[1:n])
        bands: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def put(places: np.ndarray) -> None:
            band = rank[places] // BAND
            order = np.argsort(band, kind="stable")
            band, places = band[order], places[order]
            cuts = np.flatnonzero(band[1:] != band[:-1]) + 1
            firsts = [0, *cuts.tolist()]
            for first, end, b in zip(firsts, [*firsts[1:], len(places)], band[firsts].tolist(), strict=True):
                if b not in bands:
                    bands[b] = []
                    heappush(waiting, b)
                bands[b].append(places[first:end])

        known = np.flatnonzero(rank < self.none)
        if len(known):
            put(known)
        while waiting:
            band = heappop(waiting)
            held = np.concatenate(bands.pop(band))
            while len(held):
                here = rank[held]
                held = held[(here // BAND == band) & (here < self.none)]  # the others have merged or wait elsewhere
                if not len(held):
                    break
                here = rank[held]
                least = here.min()
                places = np.unique(held[here == least])
                held = held[here != least]
                # Neighbouring places of one pair overlap: every second one of a run, from its first.
                opens = np.append(True, after[places[:-1]] != places[1:])
                at = np.arange(len(places))
                places = places[(at - np.maximum.accumulate(np.where(opens, at, 0))) % 2 == 0]
                gone = after[places]
                nexts = after[gone]
                symbols[places] = self.merged[least]
                rank[gone] = self.none
                n -= len(places)
                after[places] = nexts
                before[nexts] = places
                before[-1] = after[-1] = len(rank) - 1
                changed = np.concatenate([places, before[places]])
                changed = changed[changed != len(rank) - 1]
                new = self._ranks(symbols[changed], symbols[after[changed]])
                rank[changed] = new
                changed = changed[new < self.none]
                new = rank[changed] // BAND
                lower = bool((new < band).any())
                if len(changed):
                    held = np.concatenate([held, changed[new == band]])
                    if (new != band).any():
                        put(changed[new != band])
                if lower:  # a pair of a lower band first
                    break
            if len(held):
                put(held)
        return n

    def _together(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each pre-token.

        All are held as one flat array of symbols. In each round every sequence looks up
        the ranks of its neighbouring pairs, takes its own lowest rank and merges all
        places of that pair at once, from the left where they overlap. Sequences without a
        pair to merge leave the arrays.
        """
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        out = np.zeros(len(pre_tokens), np.int64)
        owner = np.flatnonzero(sizes)
        sizes = sizes[owner]
        symbols = self.first[np.frombuffer(b"".join(pre_tokens), np.uint8)]
        while len(owner):
            ends = np.cumsum(sizes)
            rank = np.append(self._ranks(symbols[:-1], symbols[1:]), self.none)
            rank[ends - 1] = self.none  # no pair across two sequences
            least = np.minimum.reduceat(rank, ends - sizes)
            chosen = (rank == np.repeat(least, sizes)) & (rank < self.none)
            # Neighbouring places of one pair overlap: every second one of a run, from its first.
            places = np.flatnonzero(chosen)
            opens = np.append(True, np.diff(places) > 1)
            run = np.arange(len(places)) - np.maximum.accumulate(np.where(opens, np.arange(len(places)), 0))
            places = places[run % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            sizes = sizes - np.bincount(np.searchsorted(ends, places, "right"), minlength=len(sizes))
            symbols = symbols[keep]
            done = least == self.none
            out[owner[done]] = sizes[done]
            if done.any():
                symbols = symbols[np.repeat(~done, sizes)]
                owner, sizes = owner[~done], sizes[~done]
        return out

    def _count(self, pieces: list[str]) -> list[int]:
        parts = [[p] if p in self.pieces.special else self.split.findall(p) for p in pieces]
        flat = [t.encode() for p in parts for t in p]
        counts = self.counts(flat)
        whole = np.fromiter((p in self.pieces.special for p in pieces), bool, len(pieces))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        upto = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(sizes)
        return np.where(whole, 1, upto[ends] - upto[ends - sizes]).tolist()

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        distinct, index, ends = self.pieces.cut(texts)
        values = np.array(self.cache.values(distinct, self._count), np.int64)
        upto = np.concatenate([[0], np.cumsum(values[index])]) if len(index) else np.zeros(1, np.int64)
        return np.diff(np.concatenate([[0], upto[ends]]))


_held: dict[str, Merges] = {}


def merges(tokenizer: str) -> Merges:
    """The tables of this process for a tokenizer."""
    if tokenizer not in _held:
        _held.clear()
        _held[tokenizer] = Merges(tokenizer)
    return _held[tokenizer]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row, without added special tokens; nothing is shuffled.

    Special strings inside a text are one token each. A null text is empty and has no
    tokens; null ids and repeated rows stay as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merges(tokenizer)
        for batch in batches:
            texts = batch.column(2)
            found = [count.texts(texts.slice(first, number)) for first, number in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found or [np.zeros(0, np.int64)]))],
                                             ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    found = rows.mapInArrow(frugal(run), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
