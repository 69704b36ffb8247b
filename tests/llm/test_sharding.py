import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from wardlight.llm import queries, sharding
from wardlight.llm.common import read

SF = "/root/testdata/sf0.001"


def by_shard(rows):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    last = None
    for s in sorted(shards):
        for r in sorted(shards[s], key=lambda r: r.slot):
            key = (r.text_key, r.id_key, -2**63 if r.id is None else r.id)
            assert last is None or last <= key
            last = key
    return shards


@pytest.mark.parametrize("probe_bits", [1, 3, 10])
def test_order_sizes_and_slots(spark, probe_bits):
    docs = read(spark, SF, "documents")
    want = {r.doc_id: r.text.encode() for r in docs.collect()}
    rows = sharding.shard_rows(docs, shards=4, probe_bits=probe_bits, piece_rows=7).collect()
    assert {r.id: (r["size"], r.text_crc32) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in want.items()}
    shards = by_shard(rows)
    total, largest = sum(len(t) + 1 for t in want.values()), max(map(len, want.values())) + 1
    for members in shards.values():
        assert abs(sum(r["size"] for r in members) - total / 4) <= largest + 2 * sharding.TOLERANCE * total / 4


def test_one_text_with_most_rows_is_cut(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    shards = by_shard(sharding.shard_rows(docs).collect())
    sizes = [sum(r["size"] for r in shards[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 16 + 40


def test_equal_texts_stay_together_where_the_sizes_allow(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 4000).alias("text"))
    rows = sharding.shard_rows(docs, shards=4, tolerance=0.01).collect()
    assert len({(r.text_key, r.shard) for r in rows}) == len({r.text_key for r in rows})


def test_nulls_repeats_long_and_empty(spark):
    schema = "doc_id long, text string, id string, size int, shard int"
    rows = [(1, None, "a", 1, 1), (1, "", "b", 2, 2), (None, "x", None, 3, 3), (None, "x", None, 3, 3), (5, "y" * 500_000, "c", 4, 4)]
    got = sharding.shard_rows(spark.createDataFrame(rows, schema)).collect()
    assert len(by_shard(got)) >= 1
    assert sorted((str(r.id), r["size"], r.text_crc32) for r in got) == sorted(
        (str(i), len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.shard_rows(spark.createDataFrame([], schema)).count() == 0


def test_query_is_native(spark):
    df = queries.QUERIES["op4_sharding"](spark, SF)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df) and "Cartesian" not in plan_of(df)
    assert df.count() == 200 and df.filter("grown_shard is not null or law <> 'bytes'").count() == 0


def test_whole_rows_are_written_in_slot_order(spark):
    docs = read(spark, SF, "documents").withColumn("slot", F.lit("own"))
    tables = sharding.write_shards(docs, shards=4, part_bytes=20_000)
    got = [sharding.read_shard(tables, s).collect() for s in range(4)]
    assert sharding.read_shard(tables, 0).schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, sum(got, []))) == sorted(map(tuple, docs.collect()))
    label = {r.id: (r.shard, r.slot) for r in sharding.shard_rows(docs, shards=4).collect()}
    assert all(label[r.doc_id] == (s, k) for s, rows in enumerate(got) for k, r in enumerate(rows))
    files = sorted(tables.inputFiles())
    assert len(files) > 8
    at = {}
    for f in files:
        slots = [r.slot for r in spark.read.parquet(f).collect()]
        first = at.get(f.split("/")[-2], 0)
        assert slots == list(range(first, first + len(slots)))
        at[f.split("/")[-2]] = first + len(slots)
