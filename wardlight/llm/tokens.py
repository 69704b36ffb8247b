"""Texts to pieces that a byte-level tokenizer treats one by one, and pieces to ids by the tokenizers library.

A byte-level pre-tokenizer never joins what stands before a space or line break that
follows a visible character with what stands after it. Texts are cut there, and each
distinct piece of a batch goes through the tokenizer once. Texts of well-known characters are parted
as the pre-tokenizer does, and each distinct part is merged once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
CACHED = 250_000
ENCODED_BYTES = 16 << 20
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = "\x01"
# Letters that every version of the Unicode tables knows as such. Texts of these, the signs of ASCII and plain white space are parted
# as the byte-level pre-tokenizer parts them. Any other text goes through the whole library.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f"
_OTHER = "[^\\t-\\r -~" + _LETTER.removeprefix("A-Za-z") + "]"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_BREAK = re.compile(r"(?<=[!-~])(?= [!-~])")
_RUN = 1 << 18
_KEPT = 64
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


def public_tokenizer(name: str) -> str:
    """Content of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


_BYTE_SIGNS = _byte_signs()


def _literal(text: str) -> str:
    """A pattern for exactly this text."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


class Pieces:
    """Cuts texts for one tokenizer, given as the content of its JSON file."""

    def __init__(self, tokenizer: str):
        spec = json.loads(tokenizer)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is needed")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        s = "[\\x09-\\x0d \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
        # Runs of white space that a cut would tear apart, the cut mark itself, special strings.
        self._odd = "|".join([s + s + s, s + s + "\\z", _CUT, *(re.escape(t) for t in self.special)])

    def by_pattern(self, text: str) -> list[str]:
        parts = self._split.split(text) if self._split else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            out.extend([part] if k % 2 else _PIECE.findall(part))
        return out

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the piece at each place, and where each text ends among the places."""
        odd = pc.match_substring_regex(texts, self._odd)
        plain = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", _CUT + "\n" + _CUT)
        lists = pc.split_pattern(plain, _CUT)
        if pc.any(odd).as_py():
            flags = odd.to_pylist()
            lists = pa.array([self.by_pattern(t) if o else x for t, o, x in zip(texts.to_pylist(), flags, lists.to_pylist(), strict=True)],
                             pa.list_(pa.string()))
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), ends


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """``(first, number)`` of runs of texts of about ``size`` bytes."""
    out, first, total = [], 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if total and total + n > size:
            out.append((first, k - first))
            first, total = k, 0
        total += n
    return [*out, (first, len(texts) - first)] if len(texts) else out


class Cache:
    """Values of the pieces seen lately, at most two generations of ``limit`` each."""

    def __init__(self, limit: int = CACHED):
        self.limit, self.young, self.old = limit, {}, {}

    def values(self, pieces: list[str], make: Callable[[list[str]], list]) -> list:
        out = list(map(self.young.get, pieces))
        lost = [k for k, v in enumerate(out) if v is None]
        missing = []
        for k in lost:
            out[k] = self.old.get(pieces[k])
            if out[k] is None:
                missing.append(k)
        for k, v in zip(missing, make([pieces[k] for k in missing]), strict=True):
            out[k] = v
        if len(self.young) + len(lost) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update((pieces[k], out[k]) for k in lost)
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all members of the given runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Merged(dict):
    """Ids of single pre-tokens as bytes, by the library's model alone; long ones are not kept."""

    def __init__(self, tokenize: Callable):
        self.tokenize = tokenize

    def __missing__(self, part: str) -> bytes:
        tokens = self.tokenize(part.encode().decode("latin-1").translate(_BYTE_SIGNS))
        value = array("I", [t.id for t in tokens]).tobytes()
        if len(part) <= _KEPT:
            self[part] = value
        return value


class Encoder:
    """Ids by the tokenizers library, special tokens inside texts as it treats them, none added."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.pieces = Pieces(tokenizer)
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def _by_parts(self, text: str, ids: _Merged) -> bytes:
        """Ids of a text of known characters, in runs that end between two pre-tokens."""
        if len(text) <= _RUN:
            return b"".join(map(ids.__getitem__, _PARTS.findall(text)))
        out, at = [], 0
        while at < len(text):
            end = _BREAK.search(text, at + _RUN)
            run = text[at:end.start() if end else len(text)]
            out.append(b"".join(map(ids.__getitem__, _PARTS.findall(run))))
            at += len(run)
        return b"".join(out)

    def _through(self, pieces: list[str]) -> list[bytes]:
        """Ids by the whole library. Pieces that a line break keeps apart go there in one string."""
        out: list = [None] * len(pieces)
        apart = [k for k, p in enumerate(pieces) if self.line is not None and self._alone(p)]
        for at in range(0, len(apart), 10_000):
            some = apart[at:at + 10_000]
            ids = np.array(self.library.encode_batch_fast(["\n".join(pieces[k] for k in some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.line).tolist()
            raw, first = ids.tobytes(), 0
            for k, end in zip(some, [*cuts, len(ids)], strict=True):
                out[k] = raw[4 * first:4 * end]
                first = end + 1
        rest = [k for k, v in enumerate(out) if v is None]
        for k, e in zip(rest, self.library.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32).tobytes()
        return out

    def _alone(self, piece: str) -> bool:
        if not piece or "\n" in piece or piece[-1].isspace() or piece in self.pieces.special:
            return False
        return not piece[0].isspace() or (piece[0] == " " and len(piece) > 1 and not piece[1].isspace())

    def _by_pieces(self, texts: pa.Array) -> list[bytes]:
        distinct, index, ends = self.pieces.cut(texts)
        values = self._through(distinct)
        index, starts = index.tolist(), np.concatenate([[0], ends[:-1]]).tolist()
        return [b"".join([values[k] for k in index[a:b]]) for a, b in zip(starts, ends.tolist(), strict=True)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text."""
        odd = pc.match_substring_regex(texts, "|".join([_OTHER, *map(_literal, self.pieces.special)]))
        merged = _Merged(self.library.model.tokenize)
        out: list = []
        for text, other in zip(texts, odd.to_pylist(), strict=True):
            out.append(None if other else self._by_parts(text.as_py(), merged))
            if len(merged) > CACHED:
                merged.clear()
        if None in out:
            rest = iter(self._by_pieces(texts.filter(odd)))
            out = [next(rest) if v is None else v for v in out]
        lengths = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), np.uint32), lengths


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The encoder of this process for a tokenizer."""
    if tokenizer not in _encoders:
        _encoders.clear()
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]
