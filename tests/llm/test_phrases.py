import numpy as np
import pytest

from wardlight.llm import phrases

SCHEMA = "doc_id long, text string, n_words int, kept string, t int"


def plain(rows, window):
    """Words kept of each document, window by window."""
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, words in docs:
        for s in range(len(words) - window + 1):
            if i is not None:
                w = tuple(words[s:s + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in docs:
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - window + 1):
            if i is not None and first[tuple(words[s:s + window])] < i:
                gone[s:s + window] = True
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i, len(words), int(gone.sum()), b" ".join(kept).decode()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    found = phrases.remove_repeats(df, **how).collect()
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted([(r.id, r.n_words, r.n_removed, r.kept) for r in found], key=str)


@pytest.mark.parametrize("window,phrase,how", [
    (10, 4, {}), (10, 4, {"shard_phrases": 5, "stream_words": 40}), (7, 7, {}), (6, 1, {"shard_phrases": 3}), (50, 12, {"stream_words": 500})])
def test_equals_brute_force(spark, window, phrase, how):
    rng = np.random.default_rng(window)
    passages = [" ".join(f"w{k}" for k in rng.integers(0, 400, rng.integers(window - 2, 4 * window))) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.integers(0, 5)):
            words = passages[rng.integers(len(passages))].split() if rng.random() < 0.5 else [f"u{k}" for k in rng.integers(0, 300, rng.integers(1, 60))]
            if rng.random() < 0.3 and len(words) > 3:
                words[rng.integers(len(words))] = "other"
            parts.append((" " if rng.random() < 0.5 else "\n\t").join(words[rng.integers(0, 3):]))
        rows.append((int(rng.integers(0, 140)), " ".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(20)] + [(500 + k, passages[3]) for k in range(60)]
    rows += [(300, "same " * 300), (301, "same " * 90 + "end"), (302, "ab ab ba " * 60), (303, "ba ab ab " * 70)]
    rows += [(None, passages[0]), (None, None), (1, passages[1]), (1, passages[1]), (0, None), (999, ""), (-5, passages[2]), (998, " \x0b\x0c\r\n"), (997, "é ü " * 80)]
    want = plain(rows, window)
    assert sum(n for _, _, n, _ in want) > 500
    assert got(spark, rows, window=window, phrase=phrase, **how) == want


def test_empty_and_short(spark):
    assert got(spark, []) == []
    assert got(spark, [(2, "a b c"), (1, "a b c"), (3, None)]) == [(1, 3, 0, "a b c"), (2, 3, 0, "a b c"), (3, 0, 0, "")]


def test_one_long_text(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 5000, 300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:200_000])), (3, " ".join(words[250_000:250_049]))]
    found = got(spark, rows)
    assert [(i, n, gone) for i, n, gone, _ in found] == [(1, 300_000, 0), (2, 199_000, 199_000), (3, 49, 0)]


def test_every_window_has_a_sampled_phrase():
    rng = np.random.default_rng(0)
    for words in (rng.integers(0, 2**63, 500), rng.integers(0, 3, 400), np.zeros(300, np.int64)):
        hashes = phrases._mixed(words.astype(np.uint64))
        ends = np.array([120, 130, len(words)])
        starts = np.array([0, 120, 130])
        at = phrases.sampled(hashes, starts, ends, 20, 1)
        for a, b in zip(starts, ends, strict=True):
            for s in range(a, b - 20 + 1):
                assert ((at >= s) & (at < s + 20)).any()
