"""Secret scans: candidates in texts, judged by a random forest that was trained on labelled findings."""

from __future__ import annotations

import json
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import frugal, text_bytes
from wardlight.session import scratch_path

THRESHOLD = 0.5
TREES = 60
DEPTH = 9
MARK = "[SECRET]"
AROUND = 48
SHORTEST = 12
LONGEST = 256
LOOK = 96
STEP = 32
_CHUNK = 4096

# A run of key characters that is long and not only letters, or any value that is assigned to something.
_RUN = re.compile(r"[A-Za-z0-9+/=_\-.~]{16,}")
_ASSIGNED = re.compile(r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)"
                       r"[\"']?[ \t]{0,3}(?:[:=]|=>|is)[ \t]{0,3}[\"']?([^\s\"',;<>]{8,})")
_SIGNS = re.compile(r"=+")
_WORD = re.compile(r"[A-Za-z]+")
_SEGMENT = re.compile(r"[A-Za-z0-9_\-]+")
_LEAD = "\"'`([{<"
_TAIL = "\"'`)]}>.,;:!?"

# Fixed groups of words that stand near findings.
_NEAR = {
    "secret": {"secret", "token", "password", "passwd", "passphrase", "pwd", "pass", "key", "apikey", "api", "auth", "bearer", "credential",
               "credentials", "private", "access", "authorization", "login"},
    "digest": {"sha", "md5", "hash", "digest", "checksum", "commit", "revision", "rev", "etag", "integrity", "blob", "fingerprint"},
    "number": {"id", "uuid", "guid", "version", "build", "order", "invoice", "card", "phone", "call", "number", "isbn", "account", "ref", "ticket"},
    "sample": {"example", "sample", "dummy", "test", "fake", "placeholder", "your", "changeme", "todo", "mock", "demo", "template"},
    "place": {"http", "https", "www", "url", "path", "file", "href", "src", "import", "from", "include", "see", "mail", "email"},
}
_PATHS = {
    "test": re.compile(r"(?i)test|spec|mock|fixture|example|sample|demo|docs?/"),
    "config": re.compile(r"(?i)\.(env|ya?ml|toml|ini|cfg|conf|json|properties|tfvars|pem)\b|config|settings"),
    "code": re.compile(r"(?i)\.(py|js|ts|java|go|rb|php|c|cc|rs|sh|scala)\b"),
    "prose": re.compile(r"(?i)\.(md|txt|rst|html?|csv|log|lock|svg)\b|readme|changelog"),
}
_KINDS = 6  # lower, upper, digit, padding, joint, other


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "+/=" else 4 if c in "_-.~" else 5


class Words:
    """A dictionary and its letter transitions; by default the plain words of a public tokenizer's vocabulary."""

    def __init__(self, words: list[str], longest: int = 14):
        self.words = frozenset(w for w in (x.lower() for x in words) if w.isascii() and w.isalpha() and 4 <= len(w) <= longest)
        self.longest = longest
        counts = np.ones((27, 27))
        for w in self.words:
            codes = [ord(c) - 96 for c in w]
            for a, b in zip([0, *codes], [*codes, 0], strict=True):
                counts[a, b] += 1
        self.odds = np.log(27 * counts / counts.sum(axis=1, keepdims=True)).tolist()

    def covered(self, text: str) -> int:
        """Letters of ``text`` inside dictionary words, longest word first from each place."""
        text, at, total = text.lower(), 0, 0
        while at + 4 <= len(text):
            for end in range(min(len(text), at + self.longest), at + 3, -1):
                if text[at:end] in self.words:
                    total, at = total + end - at, end - 1
                    break
            at += 1
        return total

    def likeness(self, text: str) -> float:
        """Mean log odds of the letter transitions in ``text`` against random letters."""
        odds, n = 0.0, 0
        for word in _WORD.findall(text.lower()):
            if word.isascii():
                codes = [0, *(ord(c) - 96 for c in word)]
                for a, b in zip(codes, codes[1:], strict=False):
                    odds, n = odds + self.odds[a][b], n + 1
        return odds / n if n else 0.0


def vocabulary_words(tokenizer: str) -> list[str]:
    """Whole words of a tokenizer's vocabulary, given as the content of its JSON file."""
    vocab = json.loads(tokenizer)["model"]["vocab"]
    return sorted(w[:-4] for w in vocab if w.endswith("</w>"))


FEATURES = ["length", "distinct", "entropy", "changes", *(f"share_{k}" for k in range(_KINDS)), "hex_only", "digits_only", "letters_only",
            "longest_letters", "repeats", "covered", "likeness", "dots", "at_sign", "in_path", "angle", "grouped", "assigned", "quoted",
            *(f"before_{k}" for k in _NEAR), *(f"after_{k}" for k in _NEAR), *(f"path_{k}" for k in _PATHS)]
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_GROUPS = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z|\d+([.\-]\d+)+\Z")


def features(before: str, value: str, after: str, path: str | None, words: Words) -> list[float]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of one candidate."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    shares = [kinds.count(k) / n for k in range(_KINDS)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    entropy = -sum(c / n * log2(c / n) for c in (value.count(x) for x in set(value)))
    letters = max((len(w) for w in _WORD.findall(value)), default=0)
    near_before = {w.lower() for w in _WORD.findall(before)[-5:]}
    near_after = {w.lower() for w in _WORD.findall(after)[:3]}
    own = {w.lower() for w in _WORD.findall(value)}
    tight = before.rstrip(" \t\"'")
    return [
        log(n + 1), len(set(value)) / n, entropy, changes, *shares, float(bool(_HEX.match(value))), float(value.isdigit()),
        float(value.isalpha()), letters / n, sum(a == b for a, b in zip(value, value[1:], strict=False)) / n, words.covered(value) / n,
        words.likeness(value), value.count(".") / n, float("@" in value or after.startswith("@") or before.endswith("@")),
        float("/" in before[-3:] or "://" in value), float(before.endswith(("<", "{", "[", "$"))), float(bool(_GROUPS.match(value))),
        float(tight.endswith(("=", ":", "=>"))), float(before.endswith(("\"", "'", "`"))),
        *(float(bool((near_before | own if k == "sample" else near_before) & near)) for k, near in _NEAR.items()),
        *(float(bool(near_after & near)) for near in _NEAR.values()),
        *(float(bool(p.search(path or ""))) for p in _PATHS.values()),
    ]


def _between_signs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a run between ``=`` signs, so that "name=value" and "key=key" give each side.

    Signs before a joint or at the end are padding of what stands before them. A part of fewer than 8
    characters stays with the one before it; as the first it is a mere name and left out.
    """
    out: list[tuple[int, int]] = []
    at = start
    for m in _SIGNS.finditer(text, start, end):
        pads = m.end() == end or text[m.end()] in ".-_~"
        if m.start() > at:
            out.append((at, m.end() if pads else m.start()))
            at = m.end()
        elif m.start() == start and not pads:
            at = m.end()
    if at < end:
        out.append((at, end))
    joined: list[tuple[int, int]] = []
    for a, b in out:
        if joined and b - a < 8:
            joined[-1] = (joined[-1][0], b)
        elif joined and joined[-1][1] - joined[-1][0] < 8:
            joined[-1] = (a, b)
        else:
            joined.append((a, b))
    return joined


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that might be secrets: long runs that are not only letters, and values assigned to a telling name."""
    spans = set()
    for m in _RUN.finditer(text):
        value = m.group()
        if not value.isalpha():
            for start, end in _between_signs(text, m.start(), m.end()):
                while end > start and text[end - 1] in ".-_":
                    end -= 1
                if end - start >= SHORTEST and not text[start:end].isalpha():
                    spans.add((start, end))
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(1)
        while start < end and text[start] in _LEAD:
            start += 1
        while end > start and text[end - 1] in _TAIL:
            end -= 1
        if end - start >= 8:
            spans.add((start, end))
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def _stretch(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping looks of at most ``LOOK`` characters over a stretch, from and to joints where there are some.

    Looks start at most ``STEP`` apart wherever a segment is longer than that.
    """
    marks = {start, end}
    for m in _SEGMENT.finditer(text, start, end):
        marks.update(range(m.start(), m.end(), STEP))
        marks.add(m.end())
    for a, b in zip(at := sorted(marks), at[1:], strict=False):
        marks.update(range(a + STEP, b, STEP))
    bounds = sorted(marks)
    looks, to, last = [], 0, start - STEP
    for k, a in enumerate(bounds[:-1]):
        while to + 1 < len(bounds) and bounds[to + 1] <= a + LOOK:
            to += 1
        # A start is left out only if the next one is still within a step of the last look.
        if (k and bounds[k + 1] - last <= STEP) or (looks and looks[-1][1] == end):
            continue
        looks.append((a, bounds[to]))
        last = a
    return looks


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The spans that are judged for a candidate: itself, or if it has more than ``LONGEST`` characters its parts.

    Long segments between joints (``/ . = +`` ...) are parts of their own; what lies between them, and a
    segment that is too long itself, is covered by overlapping looks. Every character is in some part.
    """
    if end - start <= LONGEST:
        return [(start, end)]
    out, at = [], start
    for m in _SEGMENT.finditer(text, start, end):
        if SHORTEST <= m.end() - m.start() <= LONGEST and not m.group().isalpha():
            if at < m.start():
                out += _stretch(text, at, m.start())
            out.append(m.span())
            at = m.end()
    return out + _stretch(text, at, end) if at < end else out


def _settled(judged: list[tuple[int, int, float]], threshold: float) -> list[tuple[int, int, float]]:
    """Spans that do not overlap: where judged ones do, each character has the highest probability of those
    over it. Neighbours on the same side of the threshold are one span, and what lies between two
    found ones belongs to them if it is too short to be a candidate."""
    out: list[tuple[int, int, float]] = []
    judged = sorted(judged)
    first = 0
    while first < len(judged):
        last, reach = first + 1, judged[first][1]
        while last < len(judged) and judged[last][0] <= reach:
            reach = max(reach, judged[last][1])
            last += 1
        group, first = judged[first:last], last
        cuts = sorted({x for a, b, _ in group for x in (a, b)})
        cells: list[tuple[int, int, float]] = []
        live, k = [], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            while k < len(group) and group[k][0] <= a:
                live.append(group[k])
                k += 1
            live = [x for x in live if x[1] > a]
            p = max(x[2] for x in live)
            if cells and (cells[-1][2] >= threshold) == (p >= threshold):
                cells[-1] = (cells[-1][0], b, max(cells[-1][2], p))
            else:
                cells.append((a, b, p))
        joined: list[tuple[int, int, float]] = []
        for a, b, p in cells:
            if p >= threshold and len(joined) > 1 and joined[-1][1] - joined[-1][0] < SHORTEST:
                a, p = joined[-2][0], max(p, joined[-2][2])
                del joined[-2:]
            joined.append((a, b, p))
        out += joined
    return out


def described(text: str, span: tuple[int, int], path: str | None, words: Words) -> list[float]:
    start, end = span
    return features(text[max(0, start - AROUND):start], text[start:end], text[end:end + AROUND], path, words)


def labelled_findings(words: Words, number: int = 6000, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings ``(text, start, end, path, label)`` by rules: random keys in assignments and known
    shapes are secrets; digests, ids, numbers, addresses, paths, placeholders and joined words are not."""
    rnd = random.Random(seed)
    vocabulary = sorted(words.words)
    upper, lower, digit = string.ascii_uppercase, string.ascii_lowercase, string.digits
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    word = lambda: rnd.choice(vocabulary)
    some = lambda k: " ".join(word() for _ in range(k))
    alnum = upper + lower + digit
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "private_key", "passwd", "client_secret", "bearer"]
    out = []
    for _ in range(number):
        secret = rnd.random() < 0.5
        quote = rnd.choice(["\"", "\"", "'", ""])
        join = rnd.choice([" = ", "=", ": ", " := "])
        path = rnd.choice(["", "src/app.py", "config/settings.yml", ".env", "deploy/main.tf", "README.md", "lib/auth.js"])
        if secret:
            value = rnd.choice([
                lambda: pick("0123456789abcdef", rnd.choice([32, 40, 64])), lambda: pick(alnum, rnd.randint(16, 48)),
                lambda: pick(alnum + "+/", rnd.randint(24, 64)) + rnd.choice(["", "=", "=="]), lambda: pick(upper + digit, rnd.randint(16, 24)),
                lambda: pick(alnum, 4).lower() + "_" + pick(alnum, rnd.randint(24, 36)), lambda: pick(alnum + "!#%&*+-_", rnd.randint(10, 20)),
                lambda: pick(lower + digit, rnd.randint(20, 40)), lambda: pick("0123456789ABCDEF", rnd.choice([32, 40])),
                lambda: ".".join(pick(alnum + "-_", n) for n in (20, 40, 43))])()
            name = rnd.choice(names)
            name = name.upper() if value.upper() == value or rnd.random() < 0.15 else name
            start = f"{some(rnd.randint(0, 6))} {name}{join}{quote}"
            end = f"{quote}{rnd.choice([' ', chr(10), ';', ',', '!! '])}{some(rnd.randint(0, 4))}"
        else:
            kind = rnd.randrange(12)
            start, end = some(rnd.randint(1, 6)) + " ", rnd.choice([" ", "\n", ". ", ", "]) + some(rnd.randint(0, 4))
            if kind == 0:
                value = pick("0123456789abcdef", rnd.choice([32, 40, 64]))
                start += rnd.choice(["commit ", "sha256: ", "md5 = ", "checksum: ", "digest=", "revision ", "etag: \"", "hash "])
            elif kind == 1:
                value = "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
                start += rnd.choice(["id: ", "uuid = \"", "request ", ""])
            elif kind == 2:
                value = pick(digit, rnd.randint(12, 24))
                start += rnd.choice(["", "card ", "account: ", "call ", "order = ", "phone "])
            elif kind == 3:
                value = rnd.choice([f"{word()}.{rnd.randint(1, 99)}", f"{word()}{rnd.randint(1, 99)}"])
                end = f"@{word()}{rnd.randint(1, 9)}.example.com" + end
                value = value if rnd.random() < 0.5 else value + end.split()[0].rstrip(".,")
            elif kind == 4:
                value = "/".join(word() for _ in range(rnd.randint(2, 5))) + rnd.choice([".py", ".html", "/v2", "-1.0.tgz"])
                start += rnd.choice(["https://", "see ", "from ", "./"])
            elif kind == 5:
                value = rnd.choice(["-", "_", "."]).join(word() for _ in range(rnd.randint(3, 6))) + rnd.choice(["", str(rnd.randint(0, 99))])
                start += rnd.choice(["", f"{word()} = ", "id: "])
            elif kind == 6:
                value = rnd.choice([f"your-{word()}-here", "x" * rnd.randint(8, 32), f"example_{word()}_{word()}", f"<{word()}-token>"[1:-1],
                                    f"changeme{rnd.randint(1, 999)}", "0" * rnd.randint(16, 40), "1234567890abcdef", f"dummy-{word()}-value"])
                start += rnd.choice(names) + join + quote
                end = quote + end
            elif kind == 7:
                value = "".join(w.capitalize() for w in (word(), word(), word())) + rnd.choice(["", str(rnd.randint(1, 999))])
                start += rnd.choice(["", "class ", "call "])
            elif kind == 8:
                value = f"{word()}_{word()}()" if rnd.random() < 0.3 else f"{word()}.{word()}.{word()}"
                start += rnd.choice(names) + join
            elif kind == 9:
                value = ".".join(str(rnd.randint(0, 255)) for _ in range(4)) + rnd.choice(["", ".", f":{rnd.randint(1000, 65000)}"]) + "1" * rnd.randint(0, 4)
            elif kind == 10:
                value = f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}T{rnd.randint(10, 23)}.{rnd.randint(10, 59)}.{pick(digit, 6)}"
            else:
                value = word() + rnd.choice("-_=~.") * rnd.randint(8, 30) + rnd.choice(["", word()])
        out.append((start + value + end, len(start), len(start) + len(value), path, int(secret)))
    return out


@dataclass
class Forest:
    """Trees as arrays: the column and cut of each node, its children, the share of secrets in it."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    depth: int
    words: Words

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the share of secrets in the leaf that each row reaches."""
        trees = np.arange(len(self.column))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.column[trees, node]] <= self.cut[trees, node]
            node = np.where(goes_left, self.left[trees, node], self.right[trees, node])
        return self.share[trees, node].mean(axis=1)


def train(spark: SparkSession, words: Words, findings: list[tuple[str, int, int, str, int]] | None = None, trees: int = TREES,
          depth: int = DEPTH, seed: int = 1) -> Forest:
    """Fit Spark's random forest on labelled findings (a bounded list, by default ``labelled_findings``).

    The fitted nodes are read back from the saved model, so that tasks can judge
    candidates in the pass that finds them.
    """
    findings = labelled_findings(words) if findings is None else findings
    rows = [(described(t, (a, b), p, words), float(y)) for t, a, b, p, y in findings]
    if len({y for _, y in rows}) < 2:
        raise ValueError("findings of both kinds are needed")
    table = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="sqrt").fit(table)
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    size = max(n.id for n in nodes) + 1
    column, cut = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    left, right = np.tile(np.arange(size), (trees, 1)), np.tile(np.arange(size), (trees, 1))
    share = np.zeros((trees, size))
    for n in nodes:
        share[n.treeID, n.id] = n.impurityStats[1] / sum(n.impurityStats)
        if n.leftChild >= 0:
            column[n.treeID, n.id], cut[n.treeID, n.id] = n.split.featureIndex, n.split.leftCategoriesOrThreshold[0]
            left[n.treeID, n.id], right[n.treeID, n.id] = n.leftChild, n.rightChild
    return Forest(column, cut, left, right, share, depth, words)


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("probability", pa.float64())]))


def judge(text: str, path: str | None, forest: Forest, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """``(start, end, probability)`` of every finding of a text with long candidates, a bounded number of looks at a time.

    A part of a long candidate is judged by what stands around it and by what stands around the candidate, and the higher one counts.
    """
    judged: list[tuple[int, int, float]] = []
    spans: list[tuple[int, int]] = []
    rows: list[list[float]] = []

    def flush() -> None:
        if rows:
            judged.extend((*s, p) for s, p in zip(spans, forest.probability(np.array(rows)).tolist(), strict=True))
            spans.clear()
            rows.clear()

    for start, end in candidates(text):
        before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
        for part in parts(text, start, end):
            spans.append(part)
            rows.append(described(text, part, path, forest.words))
            if part != (start, end):
                spans.append(part)
                rows.append(features(before, text[part[0]:part[1]], after, path, forest.words))
            if len(rows) >= _CHUNK:
                flush()
    flush()
    return _settled(judged, threshold)


def scan(docs: DataFrame, forest: Forest, carry: list[str] | None = None, text_col: str = "text", path_col: str | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """Per document ``row`` (the ``carry`` columns, by default all) and ``findings``: every candidate of the whole text.

    A finding has its span in characters, its value and the probability that it is a secret, in
    order of the text; spans do not overlap. A candidate of more than ``LONGEST`` characters is judged in parts
    (see ``parts``), and those that overlap on one side of ``threshold`` are one finding.
    Null and empty texts have none. Nothing is shuffled.
    """
    carry = docs.columns if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, spans, rows = [], [], []
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            paths = batch.column(2).to_pylist()
            for k, raw in enumerate(batch.column(1)):
                text = raw.as_py().decode("utf-8", "replace")
                spots = candidates(text)
                if any(end - start > LONGEST for start, end in spots):
                    found[k] = [{"start": a, "end": b, "value": text[a:b], "probability": p}
                                for a, b, p in judge(text, paths[k], forest, threshold)]
                    continue
                for start, end in spots:
                    owners.append(k)
                    spans.append((start, end, text[start:end]))
                    rows.append(described(text, (start, end), paths[k], forest.words))
            if rows:
                for k, (start, end, value), p in zip(owners, spans, forest.probability(np.array(rows)).tolist(), strict=True):
                    found[k].append({"start": start, "end": end, "value": value, "probability": p})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND)], ["row", "findings"])

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text_bytes(text_col).alias("bytes"), path.alias("path"))
    return rows.mapInArrow(frugal(run), f"row {rows.schema['row'].dataType.simpleString()}, "
                                "findings array<struct<start: bigint, end: bigint, value: string, probability: double>>")


def redact(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text", path_col: str | None = None,
           length_col: str | None = None) -> DataFrame:
    """All rows of ``docs``, secrets replaced by a mark; ``length_col``, if given, is set to the new number of characters.

    Texts without a secret stay as they are, null texts too.
    """
    cols = docs.columns
    found = scan(docs, forest, None, text_col, path_col, threshold)
    secret = F.filter("findings", lambda f: f["probability"] >= threshold)
    text = F.col(f"row.`{text_col}`")
    # Between two secrets the text is kept: pieces end where a secret starts.
    ends = F.array_append(F.transform("secret", lambda f: f["start"]), F.char_length(text).cast("long"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("secret", lambda f: f["end"]))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    marked = F.when(F.size("secret") > 0, F.array_join(pieces, MARK)).otherwise(text)
    out = found.withColumn("secret", secret).withColumn("marked", marked)

    def column(name: str):
        if name == text_col:
            return F.col("marked").alias(name)
        if name == length_col:
            changed = F.char_length("marked").cast(docs.schema[name].dataType)
            return F.when(F.size("secret") > 0, changed).otherwise(F.col(f"row.`{name}`")).alias(name)
        return F.col(f"row.`{name}`")

    return out.select(*[column(c) for c in cols])
