"""A walk through folders as a Spark data source.

Spark's own file listing leaves out names that begin with _ or a stop and follows links
without being asked, so the walk is a reader of its own. The driver goes down until there are enough
folders for the tasks; each task walks its folders to the end. Folders must be mounted where the tasks run.
"""

from __future__ import annotations

import datetime
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import IGNORED_FOLDERS, media_kind

SCHEMA = "path string, relative string, length long, modificationTime timestamp, status string"
#: What a row tells of: a file, something that can't be read, a link back to a folder above, a walk called off.
FILE, UNREADABLE, LOOP, CANCELLED = "file", "unreadable", "loop", "cancelled"
#: Folders that the driver hands out at least, if there are so many.
FRONTIER = 256

Row = tuple[str, str, int | None, datetime.datetime | None, str]


@dataclass
class Folders(InputPartition):
    """Folders to walk, each with its depth and the folders above it as (device, inode), and rows found on the way to them."""

    folders: list[tuple[str, int, tuple[tuple[int, int], ...]]] = field(default_factory=list)
    rows: list[Row] = field(default_factory=list)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.follow = options.get("follow_links", "false").lower() == "true"
        self.deepest = int(options.get("max_depth", 32)) if options.get("recursive", "true").lower() == "true" else 1
        self.cancel = options.get("cancel_file")

    def _folder(self, path: str, depth: int, above: tuple) -> tuple[list[Row], list[tuple]]:
        """Rows of one folder's own entries, and the folders in it that are to be entered."""
        row = lambda p, status, length=None, when=None: (p, os.path.relpath(p, self.root), length, when, status)
        if self.cancel and os.path.exists(self.cancel):
            return [row(path, CANCELLED)], []
        rows, inner = [], []
        try:
            here = os.stat(path)
            entries = sorted(os.scandir(path), key=lambda e: e.name)
        except OSError:
            return [row(path, UNREADABLE)], []
        above = (*above, (here.st_dev, here.st_ino))
        for e in entries:
            try:
                if e.is_symlink() and not self.follow:
                    continue
                found = e.stat(follow_symlinks=True)
                if e.is_dir(follow_symlinks=True):
                    if e.name.lower() in IGNORED_FOLDERS:
                        continue
                    if (found.st_dev, found.st_ino) in above:
                        rows.append(row(e.path, LOOP))
                    elif depth < self.deepest:
                        inner.append((e.path, depth + 1, above))
                elif e.is_file(follow_symlinks=True):
                    rows.append(row(e.path, FILE, found.st_size, datetime.datetime.fromtimestamp(found.st_mtime)))
            except OSError:
                rows.append(row(e.path, UNREADABLE))
        return rows, inner

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {self.root}")
        if os.path.basename(self.root).lower() in IGNORED_FOLDERS:
            return [Folders()]
        todo, found = deque([(self.root, 1, ())]), Folders()
        while todo and len(todo) < FRONTIER:
            rows, inner = self._folder(*todo.popleft())
            found.rows += rows
            todo.extend(inner)
            if rows and rows[0][4] == CANCELLED:
                return [found]
        return [found, *(Folders([one]) for one in todo)]

    def read(self, partition: Folders) -> Iterator[Row]:
        yield from partition.rows
        todo = list(partition.folders)
        while todo:
            rows, inner = self._folder(*todo.pop())
            yield from rows
            if rows and rows[0][4] == CANCELLED:
                return
            todo += reversed(inner)


class FolderWalk(DataSource):
    """``spark.read.format("folders")`` with path, recursive, max_depth, follow_links and cancel_file."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


def walk(spark: SparkSession, root: str, recursive: bool = True, max_depth: int = 32, follow_links: bool = False, cancel_file: str | None = None) -> DataFrame:
    """(path, relative, length, modificationTime, status) of all that a walk from ``root`` meets.

    Folders that never hold originals aren't entered, in any case of their names, and the root itself neither if it is
    one. Links are followed only on request; one that leads to a folder above it is told as a loop, and what can't be read
    as unreadable, and the walk goes on. Where a file ``cancel_file`` appears, tasks stop at their next folder.
    """
    spark.dataSource.register(FolderWalk)
    reader = spark.read.format("folders").option("recursive", str(recursive).lower()).option("max_depth", max_depth).option("follow_links", str(follow_links).lower())
    return (reader.option("cancel_file", cancel_file) if cancel_file else reader).load(root)


def walk_report(walked: DataFrame) -> DataFrame:
    """(photos, videos, skipped, cancelled): skipped are files of other kinds, and what couldn't be read or led back."""
    kind = F.when(F.col("status") == FILE, media_kind(F.col("path")))
    skipped = kind.isNull() & (F.col("status") != CANCELLED)
    return walked.agg(F.count_if(kind == "photo").alias("photos"), F.count_if(kind == "video").alias("videos"), F.count_if(skipped).alias("skipped"), (F.count_if(F.col("status") == CANCELLED) > 0).alias("cancelled"))
