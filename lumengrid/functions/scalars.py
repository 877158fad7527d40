"""Scalar expressions: names, times, numbers, labels. All are Columns; no Python runs on rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\p{IsWhite_Space}]+"

# File extensions by kind and reader.
NATIVE_PHOTO = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp")
CONVERTED_PHOTO = ("heic", "heif", "avif", "cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2")
VIDEO = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg", "mpeg", "wmv", "mts", "m2ts")
# Folders that are never entered, and this library's own export folder.
IGNORED_FOLDERS = (".git", "node_modules", "__macosx", ".trash", "$recycle.bin", "lightroom catalog previews.lrdata", ".thumbnails", "_lumengrid_export")
# Device names that no file may have.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
# What the file name of a model says about its use.
DETECTOR_HINTS = ("scrfd", "retinaface", "det_", "detection", "yunet", "_det")
EMBEDDER_HINTS = ("arcface", "w600k", "glint", "recognition", "_rec", "mobileface", "r50", "r100", "webface")


def nocase(c: Column) -> Column:
    """A key for comparing and ordering text without regard to the case of A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def matches_search(c: Column, term: str | None) -> Column | None:
    """Contains the trimmed term, A-Z in any case; % and _ in it stay wildcards. None for a blank term."""
    term = (term or "").strip()
    if not term:
        return None
    return nocase(c).like("%" + term.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}|{BLANK}$", "")


def safe_component(c: Column) -> Column:
    """Text as a file or folder name: forbidden characters to _, no blank or stop at the ends, at
    most 80 characters, no device name, never empty."""
    text = trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"))
    text = trimmed(F.regexp_replace(text, r"[. ]+$", ""))
    text = F.when(F.char_length(text) > 80, F.regexp_replace(F.substring(text, 1, 80), BLANK + "$", "")).otherwise(text)
    stem = F.lower(F.element_at(F.split(text, r"\."), 1))
    return F.when(text == "", F.lit("Unnamed")).when(stem.isin(*RESERVED), F.concat(text, F.lit("_"))).otherwise(text)


def extension(path: Column) -> Column:
    """Lower-case extension of a path; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def media_kind(path: Column) -> Column:
    """photo, video, or null for a file that isn't indexed."""
    ext = extension(path)
    return F.when(ext.isin(*NATIVE_PHOTO, *CONVERTED_PHOTO), "photo").when(ext.isin(*VIDEO), "video")


def decoder(path: Column) -> Column:
    """native or ffmpeg, or null."""
    ext = extension(path)
    return F.when(ext.isin(*NATIVE_PHOTO), "native").when(ext.isin(*CONVERTED_PHOTO, *VIDEO), "ffmpeg")


def in_ignored_folder(path: Column) -> Column:
    """Some folder of the path is never entered."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: nocase(d).isin(*IGNORED_FOLDERS))


def content_key(path: Column, size: Column, modified_s: Column) -> Column:
    """32 hex digits that change when path, size or time of change do."""
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string"), modified_s.cast("string")), 256), 1, 32)


def normal_timestamp(c: Column) -> Column:
    """RFC 3339, ``Y-m-d H:M:S`` or ``Y-m-dTH:M:S[.f]`` as RFC 3339 to the second; null if none fits.
    An offset that is given is kept as given, Z otherwise."""
    day, time = r"(\d{4}-\d{2}-\d{2})", r"(\d{2}:\d{2}:\d{2})"
    zoned = rf"^{day}[Tt ]{time}(?:\.\d+)?([Zz]|[+-]\d{{2}}:\d{{2}})$"
    plain = rf"^{day}[T ]{time}(?:\.\d+)?$"
    both = lambda p: F.concat(F.regexp_extract(c, p, 1), F.lit("T"), F.regexp_extract(c, p, 2))
    real = lambda p: F.try_to_timestamp(both(p), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    offset = F.regexp_extract(c, zoned, 3)
    offset = F.when(F.upper(offset).isin("Z", "+00:00"), F.lit("Z")).otherwise(offset)
    return F.when(c.rlike(zoned) & real(zoned), F.concat(both(zoned), offset)).when(c.rlike(plain) & real(plain), F.concat(both(plain), F.lit("Z")))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capture_time(original: Column, digitised: Column, modified: Column, container: Column, file_time: Column) -> Column:
    """The first of the times that there is."""
    return F.coalesce(original, digitised, modified, container, file_time)


def rational(c: Column) -> Column:
    """'30000/1001' as a number; null if it isn't one or divides by zero."""
    part = lambda i: F.try_element_at(F.split(c, "/"), F.lit(i)).try_cast("double")
    return F.when(c.contains("/"), F.try_divide(part(1), part(2))).otherwise(c.try_cast("double"))


def clean_exif(c: Column) -> Column:
    """Without blanks and quotation marks around it; null if nothing is left."""
    text = trimmed(F.regexp_replace(trimmed(c), r'^"+|"+$', ""))
    return F.when(text != "", text)


def rotation_orientation(degrees: Column) -> Column:
    """Container rotation as an EXIF orientation."""
    turn = F.pmod(degrees, F.lit(360))
    return F.when(turn == 90, 6).when(turn == 180, 3).when(turn == 270, 8).otherwise(1)


def swaps_axes(orientation: Column) -> Column:
    return orientation.between(5, 8)


def orientation_transform(orientation: Column) -> Column:
    """What turns a stored image upright; normal for values that don't exist."""
    # The transforms of orientations 1 to 8.
    names = ("normal", "flip_horizontal", "rotate180", "flip_vertical", "transpose", "rotate90", "transverse", "rotate270")
    place = F.when(orientation.between(1, 8), orientation).otherwise(1).cast("int")
    return F.element_at(F.array(*map(F.lit, names)), place)


def thumbnail_path(root: str, key: Column) -> Column:
    return F.concat_ws("/", F.lit(root), F.substring(key, 1, 2), F.concat(key, F.lit(".jpg")))


def crop_folder(face_id: Column) -> Column:
    return F.lpad((F.abs(face_id) % 100).cast("string"), 2, "0")


def poster_time(duration: Column) -> Column:
    """A tenth into the video, not before its start nor within 0.1 s of its end; 0 if unknown."""
    return F.when(duration > 0, F.greatest(F.lit(0.0), F.least(duration * 0.1, duration - 0.1))).otherwise(F.lit(0.0))


def thumbnail_size(width: Column, height: Column, longest: int = 512) -> Column:
    """(width, height) that fit into a square, never larger than the image."""
    big = F.greatest(width, height)
    fit = lambda x: F.when(big <= longest, x).otherwise(F.greatest(F.floor(x * longest / big).cast("long"), F.lit(1).cast("long")))
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def byte_range(header: Column, total: Column, chunk: int = 2 << 20) -> Column:
    """(first, last) of a 'bytes=a-b' header, the first range of it, clamped to the file. An open end
    gets ``chunk`` bytes, 'bytes=-n' is the last n; null if it can't be met."""
    spec = trimmed(F.regexp_extract(header, r"^bytes=([^,]*)", 1))
    shape = r"^(\d*)-(\d*)$"
    first, last = F.regexp_extract(spec, shape, 1), F.regexp_extract(spec, shape, 2)
    start, end = first.try_cast("long"), last.try_cast("long")
    suffix = F.struct(F.greatest(total - end, F.lit(0).cast("long")).alias("first"), (total - 1).alias("last"))
    until = F.least(F.when(last == "", start + (chunk - 1)).otherwise(end), total - 1)
    return F.when((total > 0) & (first == "") & (end > 0), suffix).when((total > 0) & (start < total) & (start <= until), F.struct(start.alias("first"), until.alias("last")))


def video_mime(ext: Column) -> Column:
    names = {"mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("application/octet-stream"))


def model_role(filename: Column) -> Column:
    """detector, embedder or unknown, by what the name of a model file says; detectors first."""
    name = nocase(filename)
    has = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(name, h))
    return F.when(has(DETECTOR_HINTS), "detector").when(has(EMBEDDER_HINTS), "embedder").otherwise("unknown")


def blob_floats(blob: Column) -> Column:
    """Little-endian 32-bit floats of a blob; null if its length isn't a multiple of four."""
    h = F.hex(blob)
    n = F.octet_length(blob) / 4
    at = F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0)))

    def number(i: Column) -> Column:
        byte = lambda k: F.substring(h, i * 8 + 1 + 2 * k, F.lit(2))
        bits = F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")
        sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
        power = F.shiftright(bits, 23).bitwiseAND(255)
        part = bits.bitwiseAND(0x7FFFFF)
        value = F.when(power == 0, part * F.pow(F.lit(2.0), F.lit(-149))).otherwise((1 + part / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), power - 127))
        return (sign * value).cast("float")

    some = F.transform(at, number)
    return F.when(F.octet_length(blob) % 4 == 0, F.when(F.octet_length(blob) == 0, F.slice(some, 1, 0)).otherwise(some))


@F.arrow_udf(BinaryType())
def _packed(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None or x.null_count else x.to_numpy().astype("<f4").tobytes() for x in (s.values for s in v)], pa.binary())


def float_blob(v: Column) -> Column:
    """Numbers as little-endian 32-bit floats, end to end; null for null and for an array with a null in it."""
    return _packed(v.cast("array<float>"))


def id_list_text(ids: Column) -> Column:
    """Ids as a JSON list; ``[]`` for null."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(ids, ","), F.lit("")), F.lit("]"))


def id_list(c: Column) -> Column:
    """The ids of a JSON list of whole numbers; an empty array for null and for whatever else the text may be,
    a list with one number beyond 64 bits or one fraction in it included."""
    number, gap = r"(?:0|-?[1-9]\d*)", r"[ \t\r\n]*"
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(-?\d+)"), 1), lambda n: n.try_cast("long"))
    whole = c.rlike(rf"\A{gap}\[{gap}(?:{number}{gap}(?:,{gap}{number}{gap})*)?\]{gap}\z")
    return F.when(whole & ~F.exists(found, lambda n: n.isNull()), found).otherwise(F.array().cast("array<bigint>"))


def clean_path(c: Column) -> Column:
    """An absolute or relative path without ``.``, ``..`` and doubled strokes; ``.`` if nothing is left."""
    absolute = F.startswith(c, F.lit("/"))
    parts = F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    up = lambda kept: (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != "..")
    step = lambda kept, p: F.when((p == "..") & up(kept), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when((p == "..") & absolute, kept).otherwise(F.array_append(kept, p))
    text = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(text == "", ".").otherwise(text)


# ---------------------------------------------------------------- labels for people to read


def bytes_label(n: Column, largest: str = "TB") -> Column:
    """B, KB, MB, GB or TB, up to ``largest``, one decimal below 100; a dash for what isn't a size."""
    units = ("KB", "MB", "GB", "TB")
    units = units[: units.index(largest) + 1]
    power = F.lit(len(units))
    for i in range(len(units) - 1, 0, -1):
        power = F.when(n < 1024.0 ** (i + 1), i).otherwise(power)
    value = n / F.pow(F.lit(1024.0), power)
    unit = F.element_at(F.array(*map(F.lit, units)), power)
    number = F.when(value >= 100, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    return F.when(n.isNull() | (n < 0), "—").when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(F.concat(number, F.lit(" "), unit))


def time_label(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; 0:00 for what isn't a time."""
    s = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    label = F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))
    return F.when(seconds >= 0, label).otherwise("0:00")


def count_label(n: Column) -> Column:
    """With a comma between thousands."""
    return F.format_number(n, 0)


def confidence_label(c: Column) -> Column:
    """98.4% of 0.984; a dash where there is none."""
    return F.when(c.isNull() | F.isnan(c), "—").otherwise(F.format_string("%.1f%%", c * 100))


def date_label(c: Column) -> Column:
    """09 Aug 2026 of an RFC 3339 time; a dash where there is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), "dd MMM yyyy"), F.lit("—"))
