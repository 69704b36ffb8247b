import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_simhash import classes, plain as simhash_of
from tests.llm.test_suffixes import plain_fast
from tests.llm.test_tokens import library
from wardlight.llm import quality
from wardlight.llm.common import read

SF = "/root/testdata/sf0.01"
KEY = re.compile(r'(?i)(?<=token = ")[0-9a-f]{40}(?=")')


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert len([n for n in entry.queries() if re.match(r"op\d+_", n)]) == 13


def test_run_agrees_with_brute_force(spark):
    docs = read(spark, SF, "documents")
    model = quality.train(docs, read(spark, SF, "labels"))
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = model.score(np.array([quality.features(t.encode()) for t in texts.values()]))
    texts = {d: t for (d, t), s in zip(texts.items(), scores, strict=True) if s >= 0.7}
    prints = {d: simhash_of(t) for d, t in texts.items()}
    root = classes(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    texts = {d: t for d, t in texts.items() if root[d] == d}
    clean = {}
    for d, t in texts.items():
        n, hit, _ = plain_fast(t, items)
        if not (hit and 20 * hit >= n):
            clean[d] = KEY.sub("[SECRET]", t)
    want = {}
    for d, t in clean.items():
        ids = np.array([*library(t), 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[d, s] = (len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in rows} == want
    assert 0 < len(clean) < len(texts) < len(prints) < docs.count() and any("[SECRET]" in t for t in clean.values())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_takes_odd_tables(spark, empty):
    good = read(spark, SF, "documents").filter("doc_id < 40").collect()
    extra = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1.5, "row") for r in good]
    odd = [(None, None, None, None, None, None, None), (None, good[1].text, "en", "s", 1, None, "x"), (900, "", "en", "s", 0, 0.1, ""),
           (900, "", "en", "s", 0, 0.1, ""), (901, "word " * 200_000, None, None, None, None, None), (1, good[1].text, "en", "s", 1, 2.0, "y")]
    docs = spark.createDataFrame([] if empty else [*extra, *odd],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, SF), "test-stage")
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() >= docs.count() and "doc_id" in last.columns
