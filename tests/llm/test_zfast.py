import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import zfast
from wardlight.session import materialise

SCHEMA = "conv_id long, turn long, role string, text string, depth int, h string, ends int"


def plain(convs):
    """Nodes by brute force: ``{prefix: [conv_id, n_convs, n_children, n_leaves, saved, ends]}`` of ``{id: [(symbol, words)]}``."""
    members, ends = {}, {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children, nodes = {}, {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        saved = (len(members[k]) - 1) * k[-1][1] if k else 0
        nodes[k] = [min(members[k]), len(members[k]), len(below), sum(nodes[b][3] for b in below) or 1, saved + sum(nodes[b][4] for b in below), sorted(ends.get(k, []))]
    return sorted((v[0], len(k), nodes[k[:-1]][0] if k else None, v[1], v[2], v[3], v[4], hashlib.sha256(",".join(map(str, v[5])).encode()).hexdigest())
                  for k, v in nodes.items())


def found(convs):
    prefixes = materialise(zfast.with_prefixes(convs), "test")
    trie = zfast.prefix_trie(prefixes).join(zfast.end_digests(prefixes), "h", "left")
    rows = trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(zfast.NO_ENDS))).collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[1]))


def table(spark, convs):
    rows = [(c, [(bytearray(b"%d" % s), w) for s, w in seq]) for c, seq in convs.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<symbol: binary, words: int>>")


def words_of(symbol):
    return symbol * 7 % 5


@pytest.mark.parametrize("kind", ["two symbols", "chains", "long and alike", "copies"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    convs = {}
    for c in range(150):
        if kind == "two symbols":
            seq = rng.integers(0, 2, rng.integers(0, 12)).tolist()
        elif kind == "chains":
            seq = [1] * int(rng.integers(0, 40)) + [2] * int(rng.integers(0, 2))
        elif kind == "long and alike":
            seq = list(range(int(rng.integers(0, 70)))) + rng.integers(100, 103, rng.integers(0, 3)).tolist()
        else:
            seq = rng.integers(0, 2, 3).tolist() if c % 3 else [5, 6, 7]
        convs[c * 3 - 50] = [(s, words_of(s)) for s in seq]
    want = sorted(plain(convs), key=lambda r: (r[0], r[1]))
    assert found(table(spark, convs)) == want


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", zfast.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_from_turns(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in [*range(0, 45), 100, 119, 121, -3, -20]:
        for t in range(int(rng.integers(1, 6))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), f"say {rng.integers(3)} \x0b twice", 1, "x", 2))
    rows += [(7, None, None, None, 1, "x", 2), (8, 1, "user", None, 1, "x", 2), (8, 1, "user", "", 1, "x", 2), (9, 2, "", "é ü ", 1, "x", 2), (None, 0, "user", "nobody", 1, "x", 2)]
    rows += [(c, 0, "user", "only turn", 1, "x", 2) for c in range(141, 149)]  # without a base
    rows += [(200, t, "user", "again " * 50, 1, "x", 2) for t in range(300)]
    texts = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            texts.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {}
    for c, turns in texts.items():
        by_hash = sorted(turns, key=lambda x: (*x[:2], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))
        own[c] = [((r, t), len(t.replace("\x0b", " ").split())) for _, _, r, t in by_hash]
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    assert [] in rebuilt.values()
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(zfast.with_shared_openings(zfast.conversations(df)))
    assert got == sorted(plain(rebuilt), key=lambda r: (r[0], r[1]))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(zfast.with_shared_openings(zfast.conversations(df))) == []
