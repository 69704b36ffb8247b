import random
import time

from tests.llm.test_tokens import FILE, LIBRARY, ODD, library
from wardlight.llm import merges, queries
from wardlight.llm.common import read

SF = "/root/testdata/sf0.001"


def test_symbols_left_of_pre_tokens():
    rnd = random.Random(1)
    words = ["a" * n for n in range(1, 40)] + ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 30))).strip() or "x" for _ in range(300)]
    words = [w.replace(" ", "") for w in words]
    got = merges.Merges(FILE).counts([w.encode() for w in words] + [b""])
    assert got.tolist() == [len(library(w)) for w in words] + [0]


def test_one_by_one_and_together_leave_the_same_symbols():
    rnd, count = random.Random(3), merges.Merges(FILE)
    for letters in ("ab", "aé日х", "etaoinshr", "abcdefghijklmnopqrstuvwxyz"):
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 200))) for _ in range(60)]
        raw = [w.encode() for w in words]
        assert count.counts(raw, long=0).tolist() == count.counts(raw).tolist() == [len(library(w)) for w in words]


def test_a_long_run_of_many_letters():
    rnd = random.Random(5)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT", "x"):
        word = "".join(rnd.choice(letters) for _ in range(1_000_000))
        start = time.process_time()
        assert merges.Merges(FILE).counts([word.encode()]).tolist() == [len(library(word))]
        assert time.process_time() - start < 15


def test_nulls_long_and_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "a"), (7, None), (7, None), (8, "x" * 20_000), (9, "word " * 100_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    got = merges.count_tokens(docs, FILE).collect()
    want = [(i, len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 512) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert merges.count_tokens(docs.limit(0), FILE).count() == 0


def test_query(spark):
    want = {r.doc_id: len(LIBRARY.encode(r.text, add_special_tokens=False).ids) for r in read(spark, SF, "documents").collect()}
    got = queries.QUERIES["op8_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want
