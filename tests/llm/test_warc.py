import gzip
import hashlib

import pytest

from wardlight.llm import queries, warc
from wardlight.llm.common import read
from wardlight.llm.files import locate

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("url,key", [
    ("https://Blog.tionble.example.com:443/en/7198?b=1#top", "com,example,tionble,blog)/en/7198?b=1"), ("http://www2.a.org", "org,a)/"),
    ("http://a.org:8080/x y", "org,a:8080)/x%20y"), ("mailto:x@y", "mailto:x@y"), (None, ""), ("http://[bad", "http://[bad")])
def test_keys(url, key):
    assert warc.url_key(url) == key


def want(rows):
    payloads = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    out = []
    for i, p in payloads:
        ids = [j for j, q in payloads if q == p and j is not None]
        first = min(ids, default=None) if len(p) >= 100 else i
        again = first is not None and first != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_through_the_index(spark):
    long = "<p>é</p>" * 20
    rows = [(5, "http://b.example/x", long, "c"), (2, "http://b.example/x", long, "c"), (9, None, "short", "c"), (8, "http://b.example/x\r\nA: b", None, "c"),
            (7, "", "", "c"), (7, "", "", "c"), (None, "http://z.example/", long, "c"), (3, "http://a.example/", "y" * 2_000_000, None)]
    rows += [(100 + k, f"http://s{k % 5}.example.org/p/{k}", f"page {k % 40} " * 12, "c") for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3)
    archive = warc.write_archive(pages, block_lines=4, index_lines=30, file_bytes=4000)
    found = warc.look_up(spark, archive.directory, warc.keys_of(pages))
    got = warc.read_records(found).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    missing = spark.createDataFrame([("org,none)/\t1",), ("",), ("zzz",)], "sort_key string")
    assert warc.look_up(spark, archive.directory, missing).count() == 0
    # The files are plain gzip members of WARC records.
    total = 0
    for r in archive.captures.select("file").distinct().collect():
        system, path = locate(r.file)
        with system.open_input_file(path) as f:
            total += gzip.decompress(f.read()).count(b"WARC/1.1\r\n")
    assert total == len(rows)
    blocks = archive.directory.collect()
    assert [b.first_key for b in blocks] == sorted(b.first_key for b in blocks) and len(blocks) >= len(rows) / 4


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    assert archive.captures.count() == 0
    assert warc.look_up(spark, archive.directory, warc.keys_of(pages)).count() == 0
    assert warc.read_records(archive.captures).count() == 0


def test_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in read(spark, SF, "pages").collect()]
    got = queries.QUERIES["op6_warc"](spark, SF)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)
