import zlib

import numpy as np
import pytest

from wardlight.llm import quality, queries
from wardlight.llm.common import read

SF = "/root/testdata/sf0.1"


def test_prior_is_estimated_from_the_upper_tails():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        positive = rng.normal(3, 1, 4000)
        unlabelled = np.where(rng.random(8000) < share, rng.normal(3, 1, 8000), rng.normal(-3, 1, 8000))
        assert abs(quality.estimate_prior(positive, unlabelled) - share) < 0.06


def test_risk_stays_non_negative_and_tells_classes_apart():
    rng = np.random.default_rng(2)
    width = len(quality.FEATURES)
    good = lambda n: np.abs(rng.normal(0.1, 0.03, (n, width)))
    bad = lambda n: np.abs(rng.normal(0.4, 0.03, (n, width)))
    model = quality.fit_model(good(300), np.vstack([good(420), bad(180)]))
    assert abs(model.prior - 0.7) < 0.1
    assert (model.score(good(200)) >= 0.7).all() and (model.score(bad(200)) < 0.3).all()


def test_features_of_any_text():
    for text in (b"", b" ", b"\n\n", b"word", "ä ä ä".encode(), b"a b " * 700_000, b"x" * 3_000_000):
        row = quality.features(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()


def test_features_do_not_depend_on_the_piece(monkeypatch):
    passage = b"".join(b"Word%d, and 12 of them\n" % (k % 700) for k in range(60_000))
    texts = [passage, b"a b " * 400_000, "ä B b b\n\r c. ".encode() * 90_000, b"x" * 1_500_000, b" \n a", b"one", b"\n\nq q q\nq q q"]
    cut = [quality.features(t) for t in texts]
    monkeypatch.setattr(quality, "_PIECE", 1 << 30)
    whole = [quality.features(t) for t in texts]
    assert cut == whole and whole[0][quality.FEATURES.index("size")] == np.log1p(len(passage.split())) / 10
    monkeypatch.setattr(quality, "_PIECE", 7)
    assert [quality.features(t[:4000]) for t in texts[1:]] == [plain_features(t[:4000]) for t in texts[1:]]


def plain_features(text):
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, pairs = max(1, len(words)), list(zip(words, words[1:]))
    return [
        *(counts[list(c)].sum() / len(text) for c in quality._CLASSES.values()), counts[128:].sum() / len(text),
        sum(map(len, words)) / n / 10, sum(len(w) > 25 for w in words) / n, len(set(words)) / n ** 0.85,
        sum(a == b for a, b in pairs) / n, sum(a == b for a, b in zip(words, words[2:])) / n,
        1 - len(set(pairs)) / max(1, len(pairs)), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 5, np.log1p(n) / 10, sum(w.isupper() for w in words) / n,
        sum(not w.isalpha() and w[:-1].isascii() and not w[:-1].isalnum() for w in words) / n,
        sum(not quality._LETTERS.search(w) for w in words) / n]


def test_held_out_accuracy_of_the_query(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op2_quality_classifier"](spark, SF).collect()}
    assert len(rows) == read(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1
               for d, r in rows.items())
    truth = [(rows[r.doc_id], r.quality) for r in read(spark, SF, "labels").collect() if rows[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in truth]) > 0.98
    assert np.mean([r.predicted for r, q in truth if q == 1]) > 0.995


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = quality.train(docs, labels), quality.train(docs, changed)
    assert a.prior == b.prior and np.allclose(a.weights, b.weights)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "a", 1.0), (None, "a b c", "b", 2.0), (3, "", "c", None), (3, "", "c", None)],
                                 "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (1, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == 4
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.schema == docs.schema and kept.count() == 4
    none = quality.train(docs.limit(0), labels.limit(0))
    assert none.score(np.zeros((1, len(quality.FEATURES))))[0] == pytest.approx(0.5)
    assert quality.score(docs.limit(0), none).count() == 0


def test_a_repeated_id_is_one_text_of_the_sample(spark, monkeypatch):
    rows = [(k, f"Some good words, number {k}.") for k in range(20)]
    hot = [(1, rows[1][1])] * 400 + [(2, f"other text {k}") for k in range(200)]
    labels = spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit_model", lambda p, u: sizes.append((len(p), len(u))) or (p, u))
    table = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    plain = quality.train(table(rows), labels)
    repeated = quality.train(table(rows + hot).repartition(4), labels)
    again = quality.train(table(hot[::-1] + rows).repartition(3), labels)
    assert sizes[0] == sizes[1] == sizes[2] and 0 < sizes[0][0] < sizes[0][1] <= 20
    assert (repeated[0] == again[0]).all() and (repeated[1] == again[1]).all()
    assert (plain[0] != repeated[0]).any(axis=1).sum() <= 1
