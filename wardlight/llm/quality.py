"""Quality scores by positive-unlabelled learning: non-negative unbiased risk with an estimated class prior."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import frugal, text_bytes

THRESHOLD = 0.7
MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
_PIECE = 1 << 20

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "stop": b".,;:", "call": b"!?", "quote": b"'\"()-", "symbol": b"#$%&*+=<>^~@\\/_{}[]`", "bar": b"|", "line": b"\n",
    "control": bytes([*range(9), *range(11, 32), 127]),
}
_SPACE, _LINE = re.compile(rb"\s"), re.compile(rb"\n")
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")
FEATURES = [*_CLASSES, "high", "word_length", "long_words", "distinct", "repeat_next", "repeat_second", "repeat_pair", "repeat_lines",
            "words_a_line", "size", "capital_words", "mixed_words", "bare_words"]


class _Distinct:
    """Number of distinct values over the pieces of a text, by their 64-bit hashes once there is more than one piece."""

    def __init__(self):
        self.first: set | None = None
        self.hashes: list[np.ndarray] = []
        self.merged = 0

    def add(self, values: set) -> None:
        if self.first is None:
            self.first = values
            return
        for part in ([self.first, values] if not self.hashes else [values]):
            self.hashes.append(np.fromiter(map(hash, part), np.int64, len(part)))
        if sum(map(len, self.hashes)) > 2 * self.merged:
            self.hashes = [np.unique(np.concatenate(self.hashes))]
            self.merged = len(self.hashes[0])

    def __len__(self) -> int:
        if not self.hashes:
            return len(self.first or ())
        return len(np.unique(np.concatenate(self.hashes)))


def _pieces(text: bytes, gap: re.Pattern) -> Iterator[bytes]:
    """The text in pieces of about ``_PIECE`` bytes that end before a ``gap``."""
    at = 0
    while at < len(text):
        cut = gap.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def features(text: bytes) -> list[float]:
    """Shares and ratios of a whole UTF-8 text. A very long one is counted in pieces; the features are those of the whole."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(text), _PIECE):
        counts += np.bincount(np.frombuffer(text, np.uint8, min(_PIECE, len(text) - at), at), minlength=256)
    size = max(1, len(text))
    n = letters = long_words = follows = second = pairs = capital = mixed = bare = lines = 0
    words_seen, pairs_seen, lines_seen = _Distinct(), _Distinct(), _Distinct()
    carry: list[bytes] = []
    for piece in _pieces(text, _SPACE):
        words = piece.split()
        joined = carry + words
        pair = list(zip(joined[max(0, len(carry) - 1):], joined[max(1, len(carry)):], strict=False))
        n += len(words)
        letters += sum(map(len, words))
        long_words += sum(len(w) > 25 for w in words)
        words_seen.add(set(words))
        follows += sum(a == b for a, b in pair)
        second += sum(map(eq, joined, joined[2:]))
        pairs += len(pair)
        pairs_seen.add(set(pair))
        capital += sum(map(bytes.isupper, words))
        mixed += sum(not w.isalpha() and w[:-1].isascii() and not w[:-1].isalnum() for w in words)
        bare += sum(not _LETTERS.search(w) for w in words)
        carry = joined[-2:]
    for piece in _pieces(text, _LINE):
        found = [x for x in piece.split(b"\n") if x.strip()]
        lines += len(found)
        lines_seen.add(set(found))
    n = max(1, n)
    shares = [counts[list(c)].sum() / size for c in _CLASSES.values()]
    return [
        *shares, counts[128:].sum() / size, letters / n / 10, long_words / n, len(words_seen) / n ** 0.85, follows / n, second / n,
        1 - len(pairs_seen) / max(1, pairs), 1 - len(lines_seen) / max(1, lines),
        np.log1p(n / max(1, lines)) / 5, np.log1p(n) / 10, capital / n, mixed / n, bare / n,
    ]


def _basis(x: np.ndarray) -> np.ndarray:
    """Each feature as it is and as two curves that saturate, so that a small share already counts."""
    x = np.abs(x)
    return np.concatenate([x, 1 - np.exp(-10 * x), 1 - np.exp(-60 * x)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((_basis(raw) - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Weights of a linear score under the logistic loss, by Adam on all rows.

    With a prior the risk is ``prior * R+(P) + max(0, R-(U) - prior * R-(P))``; while the
    second part is negative only its gradient is climbed back, as non-negative learning does. Without a prior
    positives and unlabelled rows are simply told apart.
    """
    width = positive.shape[1]
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    p1 = np.hstack([positive, np.ones((len(positive), 1))]).astype(np.float32)
    u1 = np.hstack([unlabelled, np.ones((len(unlabelled), 1))]).astype(np.float32)
    for step in range(1, steps + 1):
        now = theta.astype(np.float32)
        sp, su = (1 / (1 + np.exp(-np.clip(x @ now, -15, 15))) for x in (p1, u1))
        up, down, other = p1.T @ (sp - 1) / len(p1), p1.T @ sp / len(p1), u1.T @ su / len(u1)
        if prior is None:
            gradient = up + other
        else:
            negative = -np.log1p(-su).mean() + prior * np.log1p(-sp).mean()
            gradient = prior * up + (other - prior * down) if negative >= 0 else prior * down - other
        gradient[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among unlabelled scores: the least ratio of upper tails, each widened by its sampling error.

    Where scores are high enough, only positives are left in the unlabelled tail, and its share
    over the positives' share is the prior.
    """
    cuts = np.unique(positive)
    tail_p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    tail_u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((tail_u + slack) / np.maximum(tail_p, 1e-9))
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


def fit_model(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 400, decay: float = 1e-3) -> Model:
    """Model from raw features of trusted positives and of unlabelled texts; the prior is estimated if not given.

    Without any positive or unlabelled row every text scores the prior, one half if there is none.
    """
    width = 3 * len(FEATURES)
    if not len(positive) or not len(unlabelled):
        share = 0.5 if prior is None else prior
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(share / (1 - share))), share)
    p, u = _basis(positive), _basis(unlabelled)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    p, u = np.clip((p - mean) / scale, -8, 8), np.clip((u - mean) / scale, -8, 8)
    if prior is None:
        # One half of the rows learns to tell the sets apart, the other half is measured.
        w, b = _descend(p[::2], u[::2], None, steps // 2, decay)
        prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b) if len(p) > 1 and len(u) > 1 else 0.5
    w, b = _descend(p, u, prior, steps, decay)
    return Model(mean, scale, w, b, prior)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample_features(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Features of the documents named by a bounded table ``(id)``, one row for each id, in order of its hash.

    Of an id that several rows share the text with the smallest hash counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["key", "hash", "x"])

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes")).join(F.broadcast(ids), "id")
    rows = rows.select(F.struct("id").alias("key"), F.xxhash64("bytes").alias("hash"), "bytes")
    found = rows.mapInArrow(frugal(run), f"key {rows.schema['key'].dataType.simpleString()}, hash long, x array<double>")
    # Partial aggregates leave at most one row of an id in each task.
    found = found.groupBy("key.id").agg(F.min_by("x", "hash").alias("x")).select(F.xxhash64("id").alias("place"), "x").collect()
    return np.array([r.x for r in sorted(found, key=lambda r: (r.place, r.x))], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
          label_col: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from texts marked good (label 1) and from texts of unknown quality.

    Held-out ids (see ``held_out``) are in neither set. Label 0 is not used. The unlabelled set is
    drawn from all other documents, marked or not, as the risk asks for. Both are
    bounded samples, those with the smallest hash of the id; a label of a repeated id
    is trusted if every label of it is 1, null ids are left out. Rows that share an id are one text of the sample.
    """
    marks = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null")
    good = marks.groupBy("id").agg(F.min(F.coalesce(F.col("label") == 1, F.lit(False))).alias("good")).filter("good")
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull() & ~held_out("id")).distinct()
    trusted = ids.join(good.select("id"), "id").orderBy(F.xxhash64("id"), "id").limit(max_positive)
    drawn = ids.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_unlabelled)
    return fit_model(*(_sample_features(docs, sample, id_col, text_col) for sample in (trusted, drawn)))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``row`` (the ``carry`` columns, by default all) and ``score`` of every whole text; a null text is an empty one."""
    carry = docs.columns if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([features(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(raw), pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text_bytes(text_col).alias("bytes"))
    return rows.mapInArrow(frugal(run), f"row {rows.schema['row'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns as they are."""
    return score(docs, model, text_col=text_col).filter(F.col("score") >= threshold).select("row.*")
