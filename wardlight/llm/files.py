"""Files in the shared folder that tasks read and write themselves, by any file system pyarrow knows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of a path as Spark resolves it: a bare one lies in the cluster's default file system, not on each machine."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return target.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a ``file:``, ``hdfs:``, ``s3:`` ... address; tasks get addresses that are ``qualified``."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + uri[len("file:"):].lstrip("/"))
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def table_files(written: DataFrame) -> list[str]:
    """The Parquet files of a table that was written to the shared folder."""
    return sorted(written.inputFiles())


def read_blocks(uris: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """All rows of a written table, block by block."""
    for uri in uris:
        system, path = locate(uri)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows)
