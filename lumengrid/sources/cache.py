"""A cache of files that are named by their content's key, written and cleared by all tasks.

A file lies in a folder named by the first two letters of its key. It is written aside and renamed when it is whole, and
one that is there already is never touched, so a task that is tried again, two tasks with the same key
and a run that breaks off all leave whole files only. The root must be mounted where the tasks run.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Where files are while they are being written, under the root.
ASIDE = ".aside"


def file_of(root: str, key: str, ending: str) -> str:
    """The path of a key; one of less than two letters lies in the folder 00."""
    return os.path.join(root, key[:2] if len(key) >= 2 else "00", f"{key}.{ending}")


@dataclass
class Stored(WriterCommitMessage):
    new: int
    present: int


class CacheWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        self.ending = options.get("ending", "jpg")
        self.aside = os.path.join(self.root, ASIDE, uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Stored:
        """A task's rows. Where it breaks off, what it has renamed by then is whole and stays."""
        new = present = 0
        os.makedirs(self.aside, exist_ok=True)
        part = os.path.join(self.aside, uuid.uuid4().hex)
        for row in iterator:
            key, content = row["key"], row["content"]
            if key is None or content is None:
                continue
            if not key or "/" in key or "\0" in key or key.startswith("."):
                raise ValueError(f"{key!r} can't name a file")
            target = file_of(self.root, key, self.ending)
            if os.path.isfile(target):
                present += 1
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(part, "wb") as f:
                f.write(content)
            os.replace(part, target)
            new += 1
        return Stored(new, present)

    def _sweep(self) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)

    def commit(self, messages: list[Stored | None]) -> None:
        self._sweep()

    def abort(self, messages: list[Stored | None]) -> None:
        self._sweep()


class FileCache(DataSource):
    """``df.write.format("filecache").mode("append")`` of rows (key, content), with path and ending."""

    @classmethod
    def name(cls) -> str:
        return "filecache"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a cache is added to; clear it first")
        return CacheWriter(dict(self.options))


def store(rows: DataFrame, root: str, ending: str = "jpg") -> None:
    """Put (key, content) into the cache under ``root``. Keys that are there stay as they are; of a key's several rows one
    counts; rows without key or content are left out."""
    rows.sparkSession.dataSource.register(FileCache)
    rows.select("key", F.col("content").cast("binary").alias("content")).write.format("filecache").mode("append").option("ending", ending).save(root)


def _folders(spark: SparkSession, root: str) -> DataFrame:
    """The cache's folders, a few hundred whatever it holds, each for a task's row."""
    root = root.removeprefix("file://")
    names = sorted(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False)) if os.path.isdir(root) else []
    return spark.createDataFrame([(os.path.join(root, n),) for n in names], "folder string").repartition(max(1, min(256, len(names))))


def _go_through(batches: Iterator[pa.RecordBatch], remove: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = size = 0
        for folder in batch.column("folder").to_pylist():
            for at, _, names in os.walk(folder):
                for name in names:
                    path = os.path.join(at, name)
                    try:
                        held = os.lstat(path).st_size
                        if remove:
                            os.remove(path)
                    except OSError:
                        continue
                    files, size = files + 1, size + held
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64()), pa.array([size], pa.int64())], names=["files", "bytes"])


def _counted(spark: SparkSession, root: str, remove: bool) -> DataFrame:
    found = _folders(spark, root).mapInArrow(partial(_go_through, remove=remove), "files long, bytes long")
    return found.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def cache_size(spark: SparkSession, root: str) -> DataFrame:
    """(files, bytes) of what the cache holds."""
    return _counted(spark, root, remove=False)


def clear(spark: SparkSession, root: str) -> int:
    """Remove all files of the cache and return how many there were; one that can't be removed stays and isn't counted."""
    return _counted(spark, root, remove=True).first()["files"]
