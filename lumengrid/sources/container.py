"""Times, sizes and rotation of MP4 and MOV files, from their boxes.

A file is read box by box: of the media data only the header, of the movie box what is asked for. Files
must be mounted where the tasks run.
"""

from __future__ import annotations

import datetime
import math
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: container times count seconds from here.
EPOCH = datetime.datetime(1904, 1, 1, tzinfo=datetime.timezone.utc)
#: A movie box that claims more than this isn't read.
MOST = 64 << 20

DDL = "path string, width long, height long, duration double, rotation long, created string"
_SCHEMA = pa.schema([("path", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("duration", pa.float64()), ("rotation", pa.int64()), ("created", pa.string())])


def boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of the boxes in a box; one that claims more than there is ends it."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            return
        yield kind, data[at + head : at + size]
        at += size


def movie_box(file: BinaryIO, length: int) -> bytes | None:
    """The body of the movie box, by jumps over the boxes before it."""
    at = 0
    while at + 8 <= length:
        file.seek(at)
        size, kind = struct.unpack(">I4s", file.read(8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", file.read(8))[0], 16
        size = size or length - at
        if size < head or at + size > length:
            return None
        if kind == b"moov":
            return file.read(size - head) if size <= MOST else None
        at += size
    return None


def _inner(data: bytes, *path: bytes) -> bytes | None:
    for kind in path:
        data = next((body for k, body in boxes(data) if k == kind), None)
        if data is None:
            return None
    return data


def movie_facts(moov: bytes) -> dict[str, object]:
    """width, height, duration, rotation and created of a movie: those that are there and can be read.

    Sizes and rotation are those of the first video track. The rotation is counted as the common tools
    do, against the clock, in whole degrees.
    """
    found: dict[str, object] = {}
    head = _inner(moov, b"mvhd")
    if head and len(head) >= (32 if head[0] == 1 else 20):
        made, _, scale, ticks = struct.unpack_from(">QQIQ" if head[0] == 1 else ">IIII", head, 4)
        unknown = (1 << 64) - 1 if head[0] == 1 else (1 << 32) - 1
        if scale and ticks != unknown:
            found["duration"] = ticks / scale
        if made and made < 1 << 40:
            found["created"] = (EPOCH + datetime.timedelta(seconds=made)).strftime("%Y-%m-%dT%H:%M:%SZ")
    for kind, trak in boxes(moov):
        handler = _inner(trak, b"mdia", b"hdlr") if kind == b"trak" else None
        if not handler or handler[8:12] != b"vide":
            continue
        track, sample = _inner(trak, b"tkhd"), _inner(trak, b"mdia", b"minf", b"stbl", b"stsd")
        at = 52 if track and track[0] == 1 else 40
        if track and len(track) >= at + 44:
            a, b = struct.unpack_from(">ii", track, at)
            found["rotation"] = -round(math.degrees(math.atan2(b, a)))
            found["width"], found["height"] = (x >> 16 for x in struct.unpack_from(">II", track, at + 36))
        if sample and len(sample) >= 44:
            # what is stored, where the track says what is shown
            found["width"], found["height"] = struct.unpack_from(">HH", sample, 40)
        break
    return found


def _read(path: str) -> dict[str, object]:
    try:
        with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
            moov = movie_box(f, os.fstat(f.fileno()).st_size)
        return movie_facts(moov) if moov else {}
    except (OSError, struct.error, OverflowError):
        return {}


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        rows = [_read(p) if p else {} for p in paths]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array([r.get(f.name) for r in rows], f.type) for f in list(_SCHEMA)[1:])], schema=_SCHEMA)


def orientation_of(rotation: Column) -> Column:
    """The code of a picture that is turned like this: quarter turns have one, all else is upright."""
    turn = F.pmod(rotation, F.lit(360))
    return F.when(turn == 90, 6).when(turn == 180, 3).when(turn == 270, 8).otherwise(1).cast("long")


def video_metadata(files: DataFrame) -> DataFrame:
    """(path, width, height, duration, orientation, captured_at) of videos (path, modified_at): when they were taken is
    what the container says, else when the file was changed. What a broken file doesn't tell is null, its orientation 1."""
    found = files.select("path").mapInArrow(_facts, DDL)
    rows = found.join(files.select("path", "modified_at").distinct(), "path")
    return rows.select("path", "width", "height", "duration", orientation_of(F.coalesce("rotation", F.lit(0))).alias("orientation"), F.coalesce("created", "modified_at").alias("captured_at"))
