"""WARC archives with a two-level capture index: compressed blocks of sorted keys and a sparse directory of the blocks."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import text_bytes
from wardlight.llm.files import locate, qualified, table_files
from wardlight.session import materialise, scratch_path

MIN_REVISIT = 100
FILE_BYTES = 256 << 20
BLOCK_LINES = 3000
INDEX_LINES = 300_000
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
_HOST_PREFIX = re.compile(r"^www\d*\.")


def _plain(text: str) -> str:
    """White space and control characters percent-encoded, so that a value stays on its line."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: quote(m.group()), text)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: pages of a site sort together.

    Scheme, default port, user, a leading ``www`` and the fragment are dropped; an address without a host is its own
    key; null has the empty key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return _plain(url)
    if not host:
        return _plain(url)
    host = _HOST_PREFIX.sub("", host)
    ports = {"http": 80, "https": 443}
    named = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != ports.get(parts.scheme) else "")
    return _plain(f"{named}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""))


def sort_key(url: str | None, page_id: int | None) -> str:
    """Key of one capture: the address's key, then the id so written that text order is its order."""
    return url_key(url) + "\t" + ("" if page_id is None else f"{page_id + (1 << 63):020d}")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, a gzip member of its own: an HTTP response, or a revisit that keeps only the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_plain(url) if url else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one gzip member; field names in lower case."""
    text = zlib.decompress(raw, 31)

    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode().split("\r\n")[1:]
        return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}

    if not text.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head, _, rest = text.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[:int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


@dataclass
class Archive:
    """What was written: ``captures`` (a table, one row per record), the files of the block directory."""

    captures: DataFrame
    directory: DataFrame


_CAPTURE = "page_id bigint, sort_key string, file string, at bigint, size bigint, kind string"
_BLOCK = "first_key string, last_key string, file string, at bigint, size bigint"


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def marked_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages with payload, its SHA-256 and, for revisits, the id of the response with the same payload.

    Of pages with equal payloads of at least ``min_revisit`` bytes the smallest id is the
    response. Rows that repeat that id are responses too; a null id is never the
    smallest unless there is no other, and then all are responses.

    Only ids and digests are grouped. What comes back to the pages is one narrow row for each revisit, by
    id and digest, so the pages of one payload share no key, and where revisits are few Spark broadcasts
    them by its own size check and no payload moves.
    """
    payload = text_bytes(html_col)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    long = rows.filter(F.octet_length("payload") >= min_revisit).select("page_id", F.unhex("digest").alias("hash"))
    ids = materialise(long.groupBy("hash", "page_id").agg(F.count("*").alias("rows")), "payload-ids")
    first = ids.groupBy("hash").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("hash", "refers_to")
    again = ids.join(first, "hash").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = materialise(again.select(F.col("page_id").alias("again_id"), "hash", "refers_to"), "revisits")
    return rows.join(again, (F.unhex("digest") == F.col("hash")) & F.col("page_id").eqNullSafe(F.col("again_id")), "left").drop("hash", "again_id")


def write_archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES, block_lines: int = BLOCK_LINES,
                  index_lines: int = INDEX_LINES, date: str = DATE) -> Archive:
    """Write one record per page and the capture index, all under ``folder`` in the shared file system.

    Records go to the files of the task that holds the page. The index is sorted by key over all
    pages, in files of about ``index_lines``; every ``block_lines`` lines are one gzip block, and
    the directory keeps the first and last key of each block and where it lies. Files have names of their
    own for each attempt of a task, and only files named by the tables count.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "warc")).rstrip("/")
    capture = [("page_id", pa.int64()), ("sort_key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("kind", pa.string())]
    block = [("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]

    def create(kind: str, suffix: str):
        name = f"{folder}/{kind}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"
        system, path = locate(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return name, system.open_output_stream(path, compression=None)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = None, None
        for batch in batches:
            rows = []
            ids, urls, digests, firsts = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for k, page_id in enumerate(ids):
                if out is None or out.tell() >= file_bytes:
                    if out is not None:
                        out.close()
                    name, out = create("archive", ".warc.gz")
                revisit = firsts[k] is not None
                raw = make_record(page_id, urls[k], batch.column(2)[k].as_py(), digests[k], firsts[k], revisit, date)
                rows.append((page_id, sort_key(urls[k], page_id), name, out.tell(), len(raw), "revisit" if revisit else "response"))
                out.write(raw)
            yield _table(rows, capture)
        if out is not None:
            out.close()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, held = None, None, []
        rows: list[tuple] = []

        def flush():
            nonlocal name, out, held
            if out is None:
                name, out = create("index", ".cdx.gz")
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = squeeze.compress("\n".join(line for _, line in held).encode()) + squeeze.flush()
            rows.append((held[0][0], held[-1][0], name, out.tell(), len(raw)))
            out.write(raw)
            held = []

        for batch in batches:
            for row in batch.to_pylist():
                key = row.pop("sort_key")
                held.append((key, f"{key}\t{json.dumps(row)}"))
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        yield _table(rows, block)

    marked = marked_pages(pages, id_col, url_col, html_col, min_revisit).select("page_id", "url", "payload", "digest", "refers_to")
    captures = materialise(marked.mapInArrow(records, _CAPTURE), "captures")
    parts = max(1, -(-captures.count() // index_lines))
    ordered = captures.repartitionByRange(parts, "sort_key").sortWithinPartitions("sort_key")
    directory = materialise(ordered.mapInArrow(blocks, _BLOCK), "block-directory")
    return Archive(captures, materialise(directory.orderBy("first_key"), "directory"))


def look_up(spark: SparkSession, directory: DataFrame, keys: DataFrame) -> DataFrame:
    """Captures with the given keys (column ``sort_key``): ``(page_id, sort_key, file, at, size, kind)``.

    Keys are sorted across tasks. Each batch reads the part of the directory that its range
    needs, finds a key's blocks by binary search, reads their byte ranges, and finds the
    lines by binary search again. Keys that are not there give nothing, repeated keys are looked up once.
    """
    uris = table_files(directory)
    capture = [("page_id", pa.int64()), ("sort_key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("kind", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sorted(batch.column(0).to_pylist())
            rows: list[tuple] = []
            if keys and uris:
                rows = _find(keys, uris)
            yield _table(rows, capture)

    ordered = keys.select("sort_key").distinct().repartitionByRange("sort_key").sortWithinPartitions("sort_key")
    return ordered.mapInArrow(run, _CAPTURE)


def _find(keys: list[str], uris: list[str]) -> list[tuple]:
    system, _ = locate(uris[0])
    needed = (ds.field("last_key") >= keys[0]) & (ds.field("first_key") <= keys[-1])
    blocks = ds.dataset([locate(u)[1] for u in uris], format="parquet", filesystem=system).to_table(filter=needed)
    blocks = sorted(blocks.to_pylist(), key=lambda b: b["first_key"])
    first = [b["first_key"] for b in blocks]
    held: dict[int, tuple[list[str], list[str]]] = {}
    rows = []
    for key in keys:
        # The key may start at the end of the block before the first one that opens with it.
        for k in range(max(0, bisect_left(first, key) - 1), bisect_right(first, key)):
            if blocks[k]["last_key"] < key:
                continue
            if k not in held:
                held = {j: v for j, v in held.items() if j >= k - 1}
                at, path = locate(blocks[k]["file"])
                with at.open_input_file(path) as f:
                    f.seek(blocks[k]["at"])
                    lines = zlib.decompress(f.read(blocks[k]["size"]), 31).decode().split("\n")
                held[k] = [line[:line.rindex("\t")] for line in lines], lines
            names, lines = held[k]
            for line in lines[bisect_left(names, key):bisect_right(names, key)]:
                row = json.loads(line[len(key) + 1:])
                rows.append((row["page_id"], key, row["file"], row["at"], row["size"], row["kind"]))
    return rows


def read_records(captures: DataFrame) -> DataFrame:
    """Records of captures by range reads, in order of files and places:
    ``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)``; a revisit has no payload of its own.

    Digests of responses are computed anew; one that is not that of the record is an error.
    """
    schema = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, name, f = [], None, None
            for file, at, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    system, path = locate(file)
                    name, f = file, system.open_input_file(path)
                f.seek(at)
                warc, http, payload = parse_record(f.read(size))
                kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"record at {at} of {file} does not match its digest")
                number = lambda k, w=warc: int(w[k]) if k in w else None
                rows.append((number("x-page-id"), warc["warc-target-uri"], payload if kind == "response" else None,
                             len(payload) if kind == "response" else int(http["content-length"]), digest, kind, number("x-refers-to-page-id")))
            if f is not None:
                f.close()
            yield _table(rows, schema)

    ordered = captures.select("file", "at", "size").repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return ordered.mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
                                   "record_type string, refers_to bigint")


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The index key of each page, column ``sort_key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sort_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["sort_key"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, "sort_key string")
