import random
import re

import numpy as np
import pytest

from wardlight.llm import queries, secret_scan
from wardlight.llm.common import read
from wardlight.llm.tokens import public_tokenizer

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def words():
    return secret_scan.Words(secret_scan.vocabulary_words(public_tokenizer("word_bpe_49k.json")))


@pytest.fixture(scope="module")
def forest(spark, words):
    return secret_scan.train(spark, words)


def test_held_out_accuracy(forest, words):
    found = secret_scan.labelled_findings(words, 2000, seed=99)
    x = np.array([secret_scan.described(t, (a, b), p, words) for t, a, b, p, _ in found])
    assert np.mean((forest.probability(x) >= 0.5) == np.array([y for *_, y in found])) > 0.97


def test_forest_is_that_of_spark(spark, words):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    found = secret_scan.labelled_findings(words, 400)
    rows = [(secret_scan.described(t, (a, b), p, words), float(y)) for t, a, b, p, y in found]
    table = spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1, maxBins=64, featureSubsetStrategy="sqrt").fit(table)
    scored = model.transform(table).select("x", vector_to_array("probability")[1].alias("p")).collect()
    own = secret_scan.train(spark, words, found, trees=5, depth=4)
    assert np.allclose(own.probability(np.array([r.x for r in scored])), [r.p for r in scored])


def test_candidates():
    text = 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and password: hunter2hunter2, mail a.b@c.example, averyveryverylongword'
    got = [text[a:b] for a, b in secret_scan.candidates(text)]
    assert got == ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "hunter2hunter2"]
    assert secret_scan.candidates("") == []


def test_query_finds_the_planted_keys_and_nothing_else(spark):
    planted = set()
    for r in read(spark, SF, "documents").collect():
        planted.update((r.doc_id, *m.span(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text))
    rows = queries.QUERIES["op1_secret_scan"](spark, SF).collect()
    got = {(r.doc_id, r.start, r.end) for r in rows if r.is_secret}
    assert len(planted) > 100 and got == planted
    assert any(not r.is_secret for r in rows)


def test_redaction_nulls_long_texts_and_clashing_names(spark, forest):
    key, other = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "Zk3x9Qw7Lm2Vt8Rb5Yp1Nc6H"
    rows = [(1, f'é token = "{key}" then secret = "{other}"!', 9, "x"), (2, None, None, None), (None, "", 0, "y"), (None, "", 0, "y"),
            (3, "plain word " * 100_000, 1, "z"), (4, f'token = "{key}"', 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, findings string")
    out = secret_scan.redact(docs, forest, length_col="n_chars")
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = sorted(map(tuple, out.collect()), key=str)
    text = 'é token = "[SECRET]" then secret = "[SECRET]"!'
    want = [(1, text, len(text), "x"), *rows[1:5], (4, 'token = "[SECRET]"', 18, None)]
    assert got == sorted(want, key=str)
    assert secret_scan.scan(docs.limit(0), forest).count() == 0


def test_long_runs_are_judged_in_all_their_parts(spark, forest, words):
    rnd = random.Random(3)
    chain = lambda joint: joint.join(rnd.choice(sorted(words.words)) for _ in range(60))
    path, dots, key = chain("/"), chain("."), "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    blob = "".join(rnd.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(5000))
    texts = [f"see {path}/v2/token={key} end", f"see {path}/token={key}/{dots}/9 end", f"{dots}.7.secret={key}", f"token={key}/{path}/9 end",
             f"see {path}/v2 and {dots}.9 end", f'token = "{blob}" end', "-" * 400 + " " + "=" * 400]
    want = [t.replace(key, "[SECRET]") for t in texts[:5]] + ['token = "[SECRET]" end', texts[6]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in secret_scan.redact(docs, forest).orderBy("doc_id").collect()] == want
    for row in secret_scan.scan(docs, forest).collect():
        spans = [(f.start, f.end) for f in row.findings]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_features_see_the_end_of_a_long_value(words):
    ordinary, key = "ordinary/" * 40, "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    a, b = (secret_scan.features("", ordinary + end, "", None, words) for end in (key, "-" * len(key)))
    assert all(a[secret_scan.FEATURES.index(k)] != b[secret_scan.FEATURES.index(k)] for k in ("distinct", "entropy", "changes", "share_2", "repeats"))


def test_parts_cover_long_candidates():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choice(["/", ".", "=", "a" * rnd.randint(1, 40), "b1" * rnd.randint(1, 150), "é" * rnd.randint(1, 40)]) for _ in range(60))
        parts = secret_scan.parts(text, 0, len(text))
        assert {x for a, b in parts for x in range(a, b)} == set(range(len(text)))
        assert all(b - a <= secret_scan.LONGEST for a, b in parts)
    parts = secret_scan.parts("a1" * 1000, 0, 2000)
    assert all(any(a <= x and x + 64 <= b for a, b in parts) for x in range(1937))


def test_every_part_between_signs_is_a_candidate():
    one, two = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "Zk3x9Qw7Lm2Vt8Rb5Yp1Nc6H"
    for text, want in [(f"{one}={two}", [one, two]), (f"{two}==.{one}", [f"{two}==", f".{one}"]), (f"id={one}={two}=", [one, f"{two}="]),
                       (f"a={one}=b1={two}", [f"{one}=b1", two]), (f"{one}=ab", [f"{one}=ab"]), (f"x=y={one}", [one]),
                       (f"first_name_1={one}", ["first_name_1", one]), (f"={one}==", [f"{one}=="]), ("=" * 20, ["=" * 20])]:
        assert [f"see {text} end"[a:b] for a, b in secret_scan.candidates(f"see {text} end")] == want


def test_both_keys_of_a_run_are_replaced(spark, forest):
    one, two = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "Zk3x9Qw7Lm2Vt8Rb5Yp1Nc6H"
    docs = spark.createDataFrame([(1, f"login access credential {two}={one} end")], "doc_id long, text string")
    found = secret_scan.scan(docs, forest).first().findings
    assert [f.value for f in found] == [two, one]
    marked = secret_scan.redact(docs, forest, threshold=min(f.probability for f in found)).first().text
    assert two not in marked and one not in marked
