"""Files as tables: the listing of a shoot's folder, content keys, metadata, model files, cache sizes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_key, decoder, extension, in_ignored_folder, media_kind, model_role, nocase, rfc3339


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of all files; their contents are not read. Spark lists no files or
    folders whose names begin with _ or a stop."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", "length", "modificationTime")


def scan(files: DataFrame, root: str, max_depth: int = 32) -> DataFrame:
    """Photos and videos of a listing under ``root``: (path, relative, filename, extension, media_type,
    decoder, file_size, modified_at, content_key). Folders that are never entered, and what lies
    deeper than ``max_depth`` folders, are left out."""
    prefix = root.rstrip("/") + "/"
    start = F.expr(f"instr(path, '{prefix}')") if "'" not in prefix else F.locate(prefix, "path")
    relative = F.expr("substring(path, _at)")
    rows = files.withColumn("_at", start + len(prefix)).withColumn("relative", relative)
    rows = rows.where(~in_ignored_folder(F.col("relative")) & (F.size(F.split("relative", "/")) <= max_depth))
    kind = media_kind(F.col("path"))
    return rows.where(kind.isNotNull()).select(
        "path", "relative", F.element_at(F.split("relative", "/"), -1).alias("filename"), extension(F.col("path")).alias("extension"), kind.alias("media_type"), decoder(F.col("path")).alias("decoder"),
        F.col("length").alias("file_size"), rfc3339(F.col("modificationTime")).alias("modified_at"), content_key(F.col("path"), F.col("length"), F.unix_timestamp("modificationTime")).alias("content_key"),
    )


def scan_report(files: DataFrame) -> DataFrame:
    """Photos, videos and files of other kinds."""
    kind = media_kind(F.col("path"))
    return files.agg(F.count_if(kind == "photo").alias("photos"), F.count_if(kind == "video").alias("videos"), F.count_if(kind.isNull()).alias("skipped"))


def new_or_changed(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned files whose (path, content_key) the index doesn't have."""
    return scanned.join(known.select("path", "content_key"), ["path", "content_key"], "left_anti")


def folder_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


# ---------------------------------------------------------------- EXIF

# TIFF tags that are read, and what they are called.
_TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation", 0x0132: "modified", 0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x9003: "original", 0x9004: "digitised", 0x920A: "focal_length", 0xA434: "lens", 0xA002: "width", 0xA003: "height"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
EXIF_DDL = "path string, camera_make string, camera_model string, lens string, orientation long, iso long, aperture double, focal_length double, shutter string, original string, digitised string, modified string, width long, height long"
_EXIF = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (x.split() for x in EXIF_DDL.split(", "))])


def read_tiff(data: bytes) -> dict[str, object]:
    """The known tags of a TIFF block; what can't be read is left out."""
    found: dict[str, object] = {}
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return found
    todo, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
            size = _SIZES.get(kind, 0) * n
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if tag == 0x8769:
                todo.append(struct.unpack_from(order + "I", data, entry + 8)[0])
            if tag not in _TAGS or not size or place + size > len(data):
                continue
            if kind == 2:
                text = data[place : place + n].split(b"\0")[0].decode("utf-8", "replace").strip().strip('"').strip()
                if text:
                    found[_TAGS[tag]] = text
            elif kind in (3, 4, 9):
                found[_TAGS[tag]] = struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}[kind], data, place)[0]
            elif kind in (5, 10):
                a, b = struct.unpack_from(order + ("II" if kind == 5 else "ii"), data, place)
                if b:
                    found[_TAGS[tag]] = (a, b)
    return found


def exif_block(data: bytes) -> bytes:
    """The TIFF block of a JPEG file, or the file itself if it is one; empty if there is none."""
    if data[:2] in (b"II", b"MM"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return b""


def _exif(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            tags = read_tiff(exif_block(data or b""))
            number = lambda k: tags[k][0] / tags[k][1] if isinstance(tags.get(k), tuple) else None  # noqa: B023, E731
            time = lambda k: f"{tags[k][:10].replace(':', '-')}T{tags[k][11:19]}Z" if isinstance(tags.get(k), str) and len(tags[k]) >= 19 else None  # noqa: B023, E731
            whole = lambda k: tags[k] if isinstance(tags.get(k), int) else None  # noqa: B023, E731
            speed = tags.get("exposure")
            shutter = None if not isinstance(speed, tuple) or not speed[0] else f"1/{round(speed[1] / speed[0])}" if speed[0] < speed[1] else f"{speed[0] / speed[1]:g}"
            rows.append((path, tags.get("camera_make"), tags.get("camera_model"), tags.get("lens"), whole("orientation") or 1, whole("iso"), number("aperture"), number("focal_length"), shutter, time("original"), time("digitised"), time("modified"), whole("width"), whole("height")))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_EXIF)], schema=_EXIF)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """EXIF of photos; a file that can't be read gives nulls and orientation 1."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_exif, EXIF_DDL)


# ---------------------------------------------------------------- model files


def model_files(files: DataFrame) -> DataFrame:
    """(name, role, size_bytes) of .onnx files, by name."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(extension(F.col("path")) == "onnx").select(name.alias("name"), model_role(name).alias("role"), F.col("length").alias("size_bytes")).orderBy("name")


def resolve_model(models: DataFrame, role: str, chosen: str | None = None) -> DataFrame:
    """The model of this name, in any case, else the largest of the role; of equals the last by name."""
    own = models.where(F.col("role") == role)
    named = own.where(nocase(F.col("name")) == nocase(F.lit(chosen or ""))).select("name", F.lit(1).alias("rank"), "size_bytes")
    return named.unionByName(own.select("name", F.lit(2).alias("rank"), "size_bytes")).orderBy("rank", F.desc("size_bytes"), F.desc("name")).limit(1).select("name")


def model_status(models: DataFrame) -> DataFrame:
    """Whether recognition can run, and what is missing."""
    counts = models.agg(F.count_if(F.col("role") == "detector").alias("d"), F.count_if(F.col("role") == "embedder").alias("e"))
    ready = (F.col("d") > 0) & (F.col("e") > 0)
    message = F.when(ready, "ready").when((F.col("d") == 0) & (F.col("e") == 0), "no models found").when(F.col("d") == 0, "no face detector found").otherwise("no face embedder found")
    return counts.select(ready.alias("ready"), message.alias("message"))


