import hashlib
import random
import re

import pytest

from wardlight.llm import queries, suffixes
from wardlight.llm.common import read

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, items, window):
    words = WORD.findall((text or "").encode().lower())
    hit, names = set(), set()
    for name, item in items:
        other = WORD.findall((item or "").encode().lower())
        n = min(window, len(other))
        for s in range(len(other) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == other[s:s + n]:
                    hit.update(range(p, p + n))
                    if name is not None:
                        names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("window,block_items,shard_bytes", [(3, 100, 1 << 20), (3, 2, 200), (13, 100, 60)])
def test_agrees_with_brute_force(spark, window, block_items, shard_bytes):
    rnd = random.Random(window)
    text = lambda n: " ".join(rnd.choice(["a", "b", "C", "dé", "e1"]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 2, 5, 20, 30]))) for i in range(12)] + [(None, "q q q"), (3, "z-z"), (5, None), (6, "...")]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (None, "q q q Q q"), (3, "z z"), (3, "z z"),
                                                                (62, items[5][1] or ""), (63, "a " * 2000)]
    got = suffixes.overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(2),
                            spark.createDataFrame(items, "item_id long, text string"),
                            window=window, block_items=block_items, shard_bytes=shard_bytes).collect()
    want = sorted(((d, *plain(t, items, window)) for d, t in docs), key=str)
    assert sorted(((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
    for r in got:
        words = WORD.findall((r.row.text or "").encode().lower())
        covered = set()
        for m in r.matches:
            covered.update(range(m.doc_start, m.doc_start + m.words))
            assert any(WORD.findall((t or "").encode().lower())[m.item_start:m.item_start + m.words]
                       == words[m.doc_start:m.doc_start + m.words] for i, t in items if str(i) == str(m.item_id))
        assert len(covered) == r.n_hit


def test_only_clean_rows_stay_with_their_columns(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "One, two three FOUR", 7, "x"), (2, "clean", 8, "y"), (3, None, None, None)],
                                 "doc_id long, text string, n_words int, row string")
    kept = suffixes.decontaminate(docs, items)
    assert kept.schema == docs.schema and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [2, 3]
    assert suffixes.decontaminate(docs.limit(0), items).count() == 0
    assert suffixes.decontaminate(docs, items.limit(0)).count() == 3


def test_items_that_share_a_passage_are_all_located(spark):
    items = spark.createDataFrame([(1, "x one two three four"), (2, "one two three y"), (3, "two three four z"), (4, "one two three")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "a one two three four b one two three y")], "doc_id long, text string")
    got = suffixes.overlaps(docs, items, window=3).first()
    want = {("1", 1, 1, 4), ("1", 1, 6, 3), ("2", 0, 1, 3), ("2", 0, 6, 4), ("3", 0, 2, 3), ("4", 0, 1, 3), ("4", 0, 6, 3)}
    assert {tuple(m) for m in got.matches} == want and len(got.matches) == 7 and got["items"] == ["1", "2", "3", "4"]


def test_long_texts_are_read_in_pieces():
    text = (b"Alpha beta " * 450_000) + b"one two three " + b"z" * 5_000_000
    block = suffixes._Suffixes(["n"], [b"alpha beta one two three"], 13)
    distinct, words, counts = suffixes._parse([b"", text, b"beta"])
    assert counts == [0, 900_004, 1] and sorted(distinct) == sorted({*suffixes.words_of(text)})
    ids = block.encode(distinct)[words][:-1]
    assert len(ids) == 900_004 and ids[-4:].tolist() == [3, 4, 5, 0]


def test_query(spark):
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    want = {}
    for r in read(spark, SF, "documents").collect():
        words, hit, names = plain_fast(r.text, items)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        want[r.doc_id] = (words, hit, len(names), sha, hit > 0 and 20 * hit >= words)
    df = queries.QUERIES["op9_benchmark_decontamination"](spark, SF)
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == want
    assert any(w[4] for w in want.values())


def plain_fast(text, items):
    windows = {}
    for name, item in items:
        other = WORD.findall(item.encode().lower())
        n = min(13, len(other))
        for s in range(len(other) - n + 1 if n else 0):
            windows.setdefault(tuple(other[s:s + n]), set()).add(str(name))
    words, hit, names = WORD.findall(text.encode().lower()), set(), set()
    for n in {len(w) for w in windows}:
        for p in range(len(words) - n + 1):
            if found := windows.get(tuple(words[p:p + n])):
                hit.update(range(p, p + n))
                names |= found
    return len(words), len(hit), sorted(names)
