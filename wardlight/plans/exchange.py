"""What tasks that run side by side hand each other: files in the shared folder.

A barrier stage starts all its tasks at once, so each may wait for the others. Spark's own messages between them take a
second each; a file is seen after milliseconds.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession


def side_by_side(spark: SparkSession) -> int:
    """How many tasks run at once; 0 where Spark does not promise to start all tasks of a stage together."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    return context._jsc.sc().maxNumConcurrentTasks(context._jsc.sc().resourceProfileManager().defaultResourceProfile())


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a ``file:``, ``hdfs:``, ``s3:`` ... address."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + uri[len("file:"):].lstrip("/"))
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def opened(spark: SparkSession, path: str) -> str | None:
    """Make a folder for messages and return its full address; None where only Spark knows its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = target.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    try:
        where, folder = locate(uri)
        where.create_dir(folder, recursive=True)
    except (pa.ArrowException, OSError, ImportError):
        return None
    return uri


def rows_of(uris: Sequence[str], columns: Sequence[str]) -> Iterator[dict]:
    """The rows of Parquet files one by one, for rows that are large."""
    for uri in uris:
        system, path = locate(uri)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(1, columns=list(columns)):
                yield from batch.to_pylist()


class Exchange:
    """One task's end. In every step each task puts one message and reads of those of all, so a message can go two steps later."""

    def __init__(self, uri: str, me: int, tasks: int) -> None:
        self.system, self.folder = locate(uri)
        self.system.create_dir(self.folder, recursive=True)
        self.me, self.tasks, self.step = me, tasks, 0

    def _name(self, step: int, task: int) -> str:
        return f"{self.folder}/{step}-{task}"

    def put(self, message: bytes) -> None:
        """The next step's message; others see it whole or not at all."""
        self.step += 1
        name = self._name(self.step, self.me)
        with self.system.open_output_stream(f"{name}.part") as out:
            out.write(message)
        self.system.move(f"{name}.part", name)
        if self.step > 2:
            self.system.delete_file(self._name(self.step - 2, self.me))

    def parts(self, *ranges: tuple[int, int]) -> Iterator[list[bytes]]:
        """Of each task's message in this step the bytes in ``(start, length)`` ranges, in order of the tasks; all of it without ranges."""
        for task in range(self.tasks):
            name, began = self._name(self.step, task), time.monotonic()
            while self.system.get_file_info(name).type == fs.FileType.NotFound:
                time.sleep(min(0.2, max(0.0005, (time.monotonic() - began) / 20)))
            with self.system.open_input_file(name) as f:
                yield [f.read_at(length, start) for start, length in ranges] if ranges else [f.read()]
