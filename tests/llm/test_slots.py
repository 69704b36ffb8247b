import math

import numpy as np
import pytest

from wardlight.llm import slots

SCHEMA = "vec_id long, label int, embedding array<float>, id string, slot int"


def plain(rows, every, positives, negatives):
    """All windows by brute force."""
    sound = {}
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound[i] = min(sound.get(i, (label, v)), (label, v))
    rows = [(i, label, [math.floor(256 * x) for x in np.array(v, np.float32).tolist()]) for i, (label, v) in sound.items()]
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in rows if i != a and len(v) == len(va)]
        for p, pid, _ in sorted(s for s in scored if s[2] == la)[:positives]:
            hits = sorted(s for s in scored if s[2] != la and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(hits)]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, slots.mine(df, anchors=f"vec_id % {how.pop('every', 10)} = 0", **how).collect()))


def vectors(rng, n, width, spread):
    centres = rng.normal(size=(8, width))
    return [(i, int(rng.integers(3)), (centres[rng.integers(8)] * 0.3 + spread * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"block_rows": 50, "anchor_rows": 3}, {"positives": 2, "negatives": 1}, {"positives": 60, "negatives": 90, "block_rows": 70}])
def test_equals_brute_force(spark, how):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 400, 12, 0.1)
    rows += [(1000 + k, rows[k % 3][1], rows[k % 3][2]) for k in range(60)]  # ties
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2010, 1, None), (2020, 1, [1.0, None] * 6), (2030, 1, [float("nan")] * 12),
             (2040, 2, [float("inf")] * 12), (2050, 2, [1.0, 0.5]), (2051, 2, [1.0, 0.4]), (2052, 1, [0.5, 0.3]), (2060, 1, []), (2070, 0, [0.0] * 12),
             (0, 0, rows[5][2]), rows[10], rows[10], (-20, 1, rows[7][2]), (3000, 7, rows[8][2])]
    want = plain(rows, 10, how.get("positives", 5), how.get("negatives", 10))
    assert len(want) > 90
    assert got(spark, rows, **how) == want


def test_overlapping_and_negative_windows(spark):
    rows = [(0, 0, [1.0, 0.0])]
    rows += [(k, 0, [x, 0.0]) for k, x in ((1, 4.0), (2, 4.0), (3, 3.9), (4, 0.0), (5, -1.0))]
    rows += [(100 + k, 1, [k / 8, 1.0]) for k in range(-20, 40)]
    assert got(spark, rows, every=1000) == plain(rows, 1000, 5, 10)
    assert got(spark, []) == [] and got(spark, rows[:1]) == []


def test_large_components(spark):
    rows = [(k, k % 2, [float(1 << 18) + 64 * k, float(k)]) for k in range(40)]
    assert got(spark, rows) == plain(rows, 10, 5, 10)
    with pytest.raises(Exception, match="2\\^56"):
        got(spark, [*rows, (100, 1, [1e30, 0.0])])


def test_best_keeps_ties_by_id():
    scores, ids = np.array([3, 5, 5, 1, 5]), np.array([9, 8, 2, 1, 4])
    assert slots.best(scores, ids, 2).tolist() == [2, 4]
    assert slots.best(scores, ids, 9).tolist() == [2, 4, 1, 0, 3]
