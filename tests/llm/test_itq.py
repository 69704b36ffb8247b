import numpy as np
import pytest

from wardlight.llm import itq, queries
from wardlight.llm.common import read

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, rows int"


def plain(rows, threshold):
    """(links, component) by brute force."""
    ok = []
    for i, v, label, *_ in rows:
        good = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append((np.array(v, np.float32).astype(float), label) if good else None)
    n = len(rows)
    links = [[] for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]):
                x, y = ok[a][0], ok[b][0]
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a].append(b)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], len(links[a]), min(ids) if ids else None))
    return out


def clustered(rng, n, width, labels=2, spread=0.03):
    centres = rng.normal(size=(n // 6 + 1, width))
    return [(i, (centres[rng.integers(len(centres))] + spread * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(labels)), "x", 1)
            for i in range(n)]


@pytest.mark.parametrize("width,threshold,listing_limit,block", [(64, 0.98, 2048, 128), (12, 0.98, 2048, 3), (20, 0.9, 4, 128)])
def test_finds_every_link(spark, width, threshold, listing_limit, block):
    rng = np.random.default_rng(width)
    rows = clustered(rng, 240, width, spread=0.12 if threshold < 0.95 else 0.08)
    rows += [(1000 + k, *rows[k][1:]) for k in range(20)]  # copies
    got = itq.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold=threshold, listing_limit=listing_limit, block=block).collect()
    want = plain(rows, threshold)
    assert sum(n for _, n, _ in want) > 100
    assert sorted(map(tuple, got)) == sorted(want)


def test_flat_data_and_unseen_widths(spark):
    rng = np.random.default_rng(5)
    flat = [(i, [float(x) for x in rng.normal(size=3)] + [0.0] * 29, 1, "x", 1) for i in range(60)]
    tight = [(100 + i, [1.0, 1.0, 1.0 + 0.001 * i] + [0.0] * 29, 1, "x", 1) for i in range(40)]
    other = [(200, [1.0, 2.0], 1, "x", 1), (201, [2.0, 4.0], 1, "x", 1), (202, [1.0, 2.0, 3.0], 1, "x", 1)]
    rows = flat + tight + other
    got = itq.near_duplicates(spark.createDataFrame(rows, SCHEMA), sample=50, listing_limit=8).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, 0.98))


def test_nulls_zeros_and_repeats(spark):
    nan = float("nan")
    rows = [(1, None, 1, "x", 1), (2, [0.0, 0.0], 1, "x", 1), (3, [1.0, None], 1, "x", 1), (4, [nan, 1.0], 1, "x", 1), (5, [1.0, 2.0], None, "x", 1),
            (6, [1.0, 2.0], 1, "x", 1), (6, [1.0, 2.0], 1, "x", 1), (None, [1.0, 2.0], 1, "x", 1), (7, [], 1, "x", 1), (8, [float("inf"), 1.0], 1, "x", 1),
            (None, [-1.0, 5.0], 2, None, None), (9, [-0.0, 3.0], 3, "x", 1), (10, [0.0, 3.0], 3, "x", 1)]
    got = itq.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, 0.98), key=str)
    assert itq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_are_balanced_and_the_rotation_keeps_distances():
    rng = np.random.default_rng(1)
    unit = itq.unit_rows(rng.normal(size=(3000, 16)) * np.linspace(3, 0.5, 16))
    codes = itq.fit(unit, 3000)
    z = codes.project(unit)
    assert np.allclose(np.linalg.norm(z[:50, None] - z[None, :50], axis=2), np.linalg.norm(unit[:50, None] - unit[None, :50], axis=2), atol=1e-6)
    start = itq.fit(unit, 3000, iterations=0).project(unit)
    loss = lambda z: ((z - np.sign(z) * np.abs(z).mean()) ** 2).mean()
    assert loss(z) < loss(start) and (np.abs((z >= 0).mean(axis=0) - 0.5) < 0.1).all()


def test_query_finds_every_link(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in read(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    got = queries.QUERIES["op5_embedding_near_dedup"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == sorted(plain(rows, 0.98))
