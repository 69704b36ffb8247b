import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from wardlight.llm import queries, simhash
from wardlight.llm.common import components, read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, row int"


def plain(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, near):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in items:
        for b in items:
            if a < b and near(a, b):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {x: find(x) for x in items}


@pytest.mark.parametrize("text", ["", "  \t\x0b ", "One", "one TWO", "Ärger ÄB cd\x1cef gh X", "a b c " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == plain(text)


@pytest.mark.parametrize("max_bits,segments", [(1, 3), (2, 3), (2, 5), (2, 7), (3, 7)])
@pytest.mark.parametrize("bucket_rows", [1, 64])
def test_links_connect_what_brute_force_does(spark, max_bits, segments, bucket_rows):
    rnd = random.Random(max_bits * 10 + segments)
    prints = {0, -1, 1, 1 << 62}
    for _ in range(40):
        base = rnd.getrandbits(64) - 2**63
        prints.add(base)
        for _ in range(4):
            flipped = base
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                flipped ^= simhash._signed(1 << b)
            prints.add(flipped)
    items = sorted(prints)
    bits = lambda a, b: bin((a ^ b) % 2**64).count("1")
    edges = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in items], "fp long"), max_bits, segments, bucket_rows)
    rows = edges.collect()
    assert all(bits(r.a, r.b) <= max_bits for r in rows)
    got = {r.node: r.root for r in components(edges).collect()}
    want = classes(items, lambda a, b: bits(a, b) <= max_bits)
    assert {x: got.get(x, x) for x in items} == want


def test_a_large_bucket_makes_no_pairs(spark):
    prints = spark.range(1 << 11).selectExpr("id << 30 AS fp")
    edges = simhash.link_fingerprints(prints)
    assert edges.count() < 64 * (1 << 11)
    assert components(edges).filter("root = 0").count() == 1 << 11


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(5, "a b c d", "x", 1), (3, "A b  c d", "y", 2), (3, "A b  c d", "z", 3), (None, "a b c d", "n", 4), (7, None, "q", 5),
            (8, "", "r", 6), (None, "only null id here", "s", 7), (9, "x" * 300_000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.id, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (7, 7), (8, 7), (None, None), (9, 9)], key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, 9, None]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_query_agrees_with_brute_force(spark):
    docs = read(spark, SF, "documents").collect()
    prints = {r.doc_id: plain(r.text) for r in docs}
    want = classes(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    df = queries.QUERIES["op7_simhash_near_dedup"](spark, SF)
    assert [f.dataType for f in df.schema] == [T.LongType(), T.StringType(), T.LongType()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()} == \
        {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    assert np.mean([want[d] == d for d in want]) < 1
