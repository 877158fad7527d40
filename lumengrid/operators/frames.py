"""Which frames of a video to look at, and what detectors say about them: folds over arrays, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou, rect

FRAME = "struct<at:double,scene:boolean>"


def _frame(at: Column, scene: bool) -> Column:
    return F.struct(at.cast("double").alias("at"), F.lit(scene).alias("scene"))


def with_frame_plan(videos: DataFrame, duration: str, scenes: str, interval: float = 5.0, gap: float = 1.0, settle: float = 0.2, most: int = 60) -> DataFrame:
    """``videos`` with ``frames`` (times at which to look, and whether they are cut from scene changes)
    and ``truncated``.

    The opening, each scene change (a little after it), and every ``interval`` seconds; of frames
    closer than ``gap`` the later goes, but a scene change replaces what isn't one. More than
    ``most``: scene changes first, others evenly. A duration that is unknown or 0 gives the
    opening. Each step is a column of its own, so that none is worked out twice.
    """
    d = F.col(duration)
    empty = F.array().cast(f"array<{FRAME}>")
    cuts = F.transform(F.filter(F.coalesce(F.col(scenes), F.array().cast("array<double>")), lambda s: (s > 0) & (s < d)), lambda s: _frame(F.least(s + settle, d - 0.05), True))
    ticks = empty
    if interval > 0:
        steps = F.sequence(F.lit(1), F.greatest(F.ceil(d / interval).cast("int"), F.lit(1)))
        ticks = F.filter(F.transform(steps, lambda i: _frame(i * interval, False)), lambda f: f["at"] < d)
    every = F.transform(F.concat(F.array(_frame(F.lit(0.0), False)), cuts, ticks), lambda f, i: F.struct(f["at"].alias("at"), i.alias("i"), f["scene"].alias("scene")))

    def thin(acc: Column, f: Column) -> Column:
        """(kept, last): the last frame is held apart, so that a scene change can take its place."""
        this = F.struct(f["at"].alias("at"), f["scene"].alias("scene"))
        near = F.abs(f["at"] - acc["last"]["at"]) < gap
        first = acc["last"].isNull()
        kept = F.when(first | near, acc["kept"]).otherwise(F.array_append(acc["kept"], acc["last"]))
        last = F.when(~first & near & ~(f["scene"] & ~acc["last"]["scene"]), acc["last"]).otherwise(this)
        return F.struct(kept.alias("kept"), last.alias("last"))

    def spread(frames: Column, n: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(frames, (F.floor((i - 1) * F.size(frames) / n) + 1).cast("int")))
        return F.when(n <= 0, empty).when(F.size(frames) <= n, frames).otherwise(some)

    start = F.struct(empty.alias("kept"), F.lit(None).cast(FRAME).alias("last"))
    rest = F.lit(most) - F.least(F.size("_cuts"), F.lit(most))
    # without scene changes the frames are in order and none is near another: nothing to sort, to thin or to tell apart
    plain = (F.size(F.coalesce(F.col(scenes), F.array().cast("array<double>"))) == 0) & F.lit(interval <= 0 or interval >= gap)
    return (
        videos.withColumn("_plain", plain)
        .withColumn("_sorted", F.when((d > 0) & ~F.col("_plain"), F.array_sort(every)))
        .withColumn("_acc", F.aggregate("_sorted", start, thin))
        .withColumn("_kept", F.when((d > 0) & F.col("_plain"), F.concat(F.array(_frame(F.lit(0.0), False)), ticks)).otherwise(F.array_append(F.col("_acc")["kept"], F.col("_acc")["last"])))
        .withColumn("_cuts", F.when(F.col("_plain"), empty).otherwise(F.filter("_kept", lambda f: f["scene"])))
        .withColumn("_ticks", F.when(F.col("_plain"), F.col("_kept")).otherwise(F.filter("_kept", lambda f: ~f["scene"])))
        .withColumn("truncated", F.coalesce(F.size("_kept") > most, F.lit(False)))
        .withColumn("frames", F.when(F.col("_kept").isNull(), F.array(_frame(F.lit(0.0), False))).when(F.col("truncated"), F.array_sort(F.concat(spread(F.col("_cuts"), F.lit(most)), spread(F.col("_ticks"), rest)))).otherwise(F.col("_kept")))
        .drop("_plain", "_sorted", "_acc", "_kept", "_cuts", "_ticks")
    )


def scene_times(log: Column) -> Column:
    """The times of a scene filter's output, in order, less those within 0.05 s of the one before."""
    found = F.array_sort(F.filter(F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:(\S+)"), 1), lambda t: t.try_cast("double")), lambda t: t.isNotNull()))
    keep = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) >= 0.05), F.array_append(kept, t)).otherwise(kept)
    return F.aggregate(found, F.array().cast("array<double>"), keep)


def video_info(probe: Column) -> Column:
    """(duration, width, height, rotation, creation_time) of key=value lines: the first duration counts,
    of the others the last; N/A and empty values don't."""
    pairs = F.filter(F.transform(F.split(probe, r"\r?\n"), lambda x: F.split(x, "=", 2)), lambda kv: (F.size(kv) == 2) & ~F.trim(F.element_at(kv, 2)).isin("", "N/A"))

    def value(keys: tuple[str, ...], first: bool) -> Column:
        own = F.filter(pairs, lambda kv: F.trim(F.element_at(kv, 1)).isin(*keys))
        return F.trim(F.try_element_at(F.try_element_at(own, F.lit(1 if first else -1)), F.lit(2)))

    return F.struct(
        value(("duration",), True).try_cast("double").alias("duration"), value(("width",), False).try_cast("long").alias("width"), value(("height",), False).try_cast("long").alias("height"),
        value(("rotation", "TAG:rotate"), False).try_cast("double").try_cast("long").alias("rotation"), value(("creation_time", "TAG:creation_time"), False).alias("creation_time"),
    )


def suppress(boxes: Column, threshold: float = 0.4, most: int = 64) -> Column:
    """Of boxes (x1, y1, x2, y2, score) the best by score that no better kept one overlaps by more
    than ``threshold``; ties in their own order."""
    ranked = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("minus"), i.alias("i"), b.alias("b"))))
    kind = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double>>"
    plain = lambda b: F.struct(*[b[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "score")])
    clear = lambda kept, b: ~F.exists(kept, lambda k: iou(k, b) > threshold)
    fold = lambda kept, r: F.when((F.size(kept) < most) & clear(kept, r["b"]), F.array_append(kept, plain(r["b"]))).otherwise(kept)
    return F.aggregate(ranked, F.array().cast(kind), fold)


def anchor_box(index: Column, level: Column, size: Column, distances: Column, scale: Column, anchors: int = 2) -> Column:
    """The box of a detector's output row: ``index`` counts anchors of a level's grid in rows, the level's
    stride is 8 * 2**level, ``distances`` are left, top, right, bottom in strides, ``scale`` shrank the image."""
    stride = F.pow(F.lit(2.0), level + 3)
    grid = F.floor(size / stride)
    cell = F.floor(index / anchors)
    x, y = (cell % grid) * stride, F.floor(cell / grid) * stride
    d = lambda i: F.element_at(distances, i) * stride
    return rect((x - d(1)) / scale, (y - d(2)) / scale, (x + d(3)) / scale, (y + d(4)) / scale)


def scrfd_faces(outputs: DataFrame, key: str, size: float, threshold: float, anchors: int = 2) -> DataFrame:
    """(key, level, index, score, box, landmarks) of a detector's raw outputs.

    ``outputs`` has (key, rows, channels, values, scale): an array of rows * channels numbers for each
    output, 1 channel for scores, 4 for distances of a box, 10 for five points, ``scale`` as in
    ``anchor_box``. Of each kind the output with most rows is level 0, stride 8, the next level 1 and
    so on. Rows below ``threshold`` go; a level whose rows don't fill its grid is skipped; scores and boxes that
    differ in number are an error. Without points, ``landmarks`` is null.
    """
    # all of a key in one shuffle, levels told and outputs of a level brought together in place; a join would broadcast a side, whose arrays are guessed too small
    level = (F.row_number().over(Window.partitionBy(key, "channels").orderBy(F.desc("rows"))) - 1).alias("level")
    leveled = outputs.where(F.col("channels").isin(1, 4, 10)).repartition(key).select(key, "channels", "rows", "values", "scale", level)
    of = lambda n: F.any_value(F.when(F.col("channels") == n, F.struct("rows", "scale", "values")), F.lit(True))
    levels = leveled.groupBy(key, "level").agg(of(1).alias("s"), of(4).alias("b"), of(10).alias("p")).where("s is not null")
    joined = levels.select(key, "level", "s.rows", "s.scale", F.col("s.values").alias("scores"), F.col("b.rows").alias("boxes_rows"), F.col("b.values").alias("boxes"), F.col("p.values").alias("points"))
    stride = F.pow(F.lit(2.0), F.col("level") + 3)
    cells = F.pow(F.floor(F.lit(size) / stride), F.lit(2.0))
    fits = joined.where((cells > 0) & (F.col("rows") % cells == 0))
    same = F.when(F.col("rows").eqNullSafe(F.col("boxes_rows")), F.lit(True)).otherwise(F.raise_error(F.lit("scores and boxes differ in number")).cast("boolean"))
    rows = fits.where(same).select("*", F.posexplode("scores").alias("index", "score")).where(F.col("score") >= threshold)
    distances = F.slice("boxes", F.col("index") * 4 + 1, F.lit(4))
    per_cell = F.col("rows") / cells
    cell = F.floor(F.col("index") / per_cell)
    grid = F.floor(F.lit(size) / stride)
    x, y = (cell % grid) * stride, F.floor(cell / grid) * stride
    d = lambda i: F.element_at(distances, i) * stride
    box = rect((x - d(1)) / F.col("scale"), (y - d(2)) / F.col("scale"), (x + d(3)) / F.col("scale"), (y + d(4)) / F.col("scale"))
    own = F.slice("points", F.col("index") * 10 + 1, F.lit(10))
    landmarks = F.transform(own, lambda v, i: (v * stride + F.when(i % 2 == 0, x).otherwise(y)) / F.col("scale"))
    return rows.select(key, "level", "index", "score", box.alias("box"), F.when(F.col("points").isNotNull(), landmarks).alias("landmarks"))
