"""Planning an export: groups, folders, file names, and copying the files."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import discard, written
from ..functions.scalars import clean_path, nocase, safe_component
from ..schema import State
from . import changes
from .albums import kind_order


@dataclass(frozen=True)
class ExportOptions:
    person_ids: tuple[int, ...] | None = None
    split_photos_videos: bool = True
    include_unidentified: bool = True
    include_multi_player: bool = False
    preserve_times: bool = True
    on_conflict: str = "skip"  # skip, rename or overwrite


OPTIONS_DDL = "person_ids array<bigint>, split_photos_videos boolean, include_unidentified boolean, include_multi_player boolean, preserve_times boolean, on_conflict string"


def export_groups(state: State, shoot_id: int, options: ExportOptions, present: DataFrame | None = None) -> DataFrame:
    """(group, name, media_id, source, filename, media_type, file_size, position) of what is exported:
    players' albums (all, or those with one of ``person_ids``), pairs and the unidentified as asked,
    teams never. ``present`` (path) limits it to files that exist."""
    kind = F.col("album_type")
    players = kind == "player"
    if options.person_ids is not None:
        players &= F.arrays_overlap("person_ids", F.array(*[F.lit(i).cast("long") for i in options.person_ids]).cast("array<bigint>"))
    wanted = players | ((kind == "multiPlayer") & F.lit(options.include_multi_player)) | ((kind == "unidentified") & F.lit(options.include_unidentified))
    albums = state["albums"].where((F.col("shoot_id") == shoot_id) & wanted).select(F.col("id").alias("album_id"), "name", "album_type", "media_count")
    media = state["media"].select(F.col("id").alias("media_id"), F.col("path").alias("source"), "filename", "media_type", "file_size", "captured_at")
    if present is not None:
        media = media.join(present.select(F.col("path").alias("source")), "source", "left_semi")
    return albums.join(state["album_media"], "album_id").join(media, "media_id").withColumnRenamed("album_id", "group")


def _deduplicated(table: pa.Table, order: list[str]) -> pa.Table:
    """(_row, target) of a scope where a file is named like a copy: gone through in order."""
    rows = sorted(table.to_pylist(), key=lambda r: tuple((r[c] is None, r[c]) for c in order))
    taken: set[str] = set()
    return pa.table({"_row": pa.array([r["_row"] for r in rows], pa.int64()), "target": pa.array([free_name(r["filename"], taken) for r in rows], pa.string())})


def free_name(name: str, taken: set[str]) -> str:
    """The name, or the first of 'name (2).ext', 'name (3).ext' that isn't taken in any case; it is taken then."""
    stem, dot, ext = name.rpartition(".")
    if not stem:
        stem, dot, ext = name, "", ""
    candidate, n = name, 1
    while candidate.lower() in taken:
        n += 1
        candidate = f"{stem} ({n}){dot}{ext}"
    taken.add(candidate.lower())
    return candidate


def deduplicated(files: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """``files`` with ``target``: file names of one scope (a folder of a group) made distinct, in order.

    The second of a name gets ' (2)' before the last stop, and so on. Where a file's own name looks like
    that, 'a (2).jpg' that is there already keeps its place; only names of that stem are gone through in order.
    """
    stem, ext = F.regexp_extract("filename", r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"(?s)^(.+?)(\.[^.]*)?$", 2)
    # names that can collide with each other have one root: the stem without any ' (n)' at its end
    root = F.lower(F.concat(F.regexp_replace(stem, r"( \(\d+\))+$", ""), ext))
    rows = written(files.withColumn("_row", F.monotonically_increasing_id()).withColumn("_root", root), "export-names")
    by = [*scope, "_root"]
    literal = rows.where(F.lower("filename") != F.col("_root")).select(*[F.col(c).alias(f"_by_{c}") for c in by]).distinct().withColumn("_literal", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    marked = rows.join(literal, same, "left").select(*rows.columns, "_literal")
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.asc_nulls_last(c) for c in order], "_row"))
    copy = F.when(n == 1, F.col("filename")).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext))
    plain = marked.where("_literal is null").withColumn("target", copy).select(*files.columns, "target")
    needed = list(dict.fromkeys([*by, *order, "filename", "_row"]))

    def run(table: pa.Table) -> pa.Table:
        return _deduplicated(table, [*order, "_row"])

    walked = marked.where("_literal").select(*needed).groupBy(*by).applyInArrow(run, "_row long, target string")
    return plain.unionByName(rows.join(walked, "_row").select(*files.columns, "target"))


def export_plan(groups: DataFrame, options: ExportOptions) -> DataFrame:
    """``groups`` with the folder, the sub-folder and the relative path of each file."""
    sub = F.when(F.col("media_type") == "video", "Videos").otherwise("Photos") if options.split_photos_videos else F.lit("")
    rows = groups.withColumn("folder", safe_component(F.col("name"))).withColumn("subfolder", sub)
    named = deduplicated(rows, ["group", "subfolder"], ["captured_at", "filename", "media_id"])
    parts = F.filter(F.array("folder", "subfolder", "target"), lambda p: p != "")
    return named.withColumn("relative_path", F.concat_ws("/", parts))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("files_total"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes_total"), F.count_distinct("folder").alias("folders"))


def colliding_folders(plan: DataFrame) -> DataFrame:
    """Folders that several groups share: their files may be skipped as already there."""
    return plan.groupBy("folder").agg(F.count_distinct("group").alias("groups")).where("groups > 1")


def destination_allowed(destination: str, sources: list[str]) -> bool:
    """A destination must not be a source folder nor lie in one."""
    there = PurePath(os.path.normpath(destination)).parts
    return not any(there[: len(own)] == own for s in sources if (own := PurePath(os.path.normpath(s)).parts))


def plan_folders(plan: DataFrame) -> DataFrame:
    """(folder, position) of the folders that files go to, in the order in which an export meets them: albums in
    their order, the files of each by time, name and id. The window holds a row a folder of one export."""
    folder = F.concat_ws("/", F.filter(F.array("folder", "subfolder"), lambda p: p != ""))
    file = (F.col("captured_at").isNull(), F.col("captured_at"), F.col("filename"), F.col("media_id"))
    place = F.struct(*[c.alias(f"c{i}") for i, c in enumerate((kind_order(), -F.col("media_count"), nocase(F.col("name")), F.col("group"), *file))])
    first = plan.groupBy(folder.alias("folder")).agg(F.min(place).alias("_first"))
    return first.select("folder", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("position"))


def refused_destinations(destinations: DataFrame, sources: DataFrame) -> DataFrame:
    """Of ``destinations`` (path and any other columns) the rows whose folder is one of ``sources`` (path) or lies in
    one, the file system not asked. Each destination meets the sources by its own ancestors, an equality join."""
    roots = sources.select(clean_path(F.col("path")).alias("_root")).where("_root is not null").distinct()
    parts = F.split(clean_path(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.transform(above, lambda p: F.when(p == "", "/").otherwise(p))
    asked = destinations.where("path is not null").select("path").distinct()
    inside = asked.select("path", F.explode(F.array_distinct(above)).alias("_root")).join(roots, "_root", "left_semi").select("path").distinct()
    return destinations.join(inside, "path", "left_semi").select(*destinations.columns)


def options_text(options: ExportOptions) -> str:
    return json.dumps(asdict(options), sort_keys=True)


def options_of(c: Column) -> Column:
    """The options that ``options_text`` wrote, as a struct; what is missing, unknown or of a wrong kind has its default."""
    found, plain = F.from_json(c, OPTIONS_DDL), ExportOptions()
    value = lambda k: F.coalesce(found[k], F.lit(getattr(plain, k)))
    conflict = F.when(found["on_conflict"].isin("skip", "rename", "overwrite"), found["on_conflict"]).otherwise(plain.on_conflict)
    switches = ("split_photos_videos", "include_unidentified", "include_multi_player", "preserve_times")
    return F.struct(found["person_ids"].alias("person_ids"), *[value(k).alias(k) for k in switches], conflict.alias("on_conflict"))


def _copied(source: str, target: str, options: ExportOptions) -> tuple[str, str | None]:
    """(outcome, error) of one file."""
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if os.path.exists(target) and options.on_conflict == "skip":
            return "skipped", None
        if options.on_conflict == "rename":
            (stem, ext), n = os.path.splitext(target), 1
            while os.path.exists(target):
                n += 1
                target = f"{stem} ({n}){ext}"
        # a copy that is broken off leaves no half file under the final name
        part = f"{target}.part"
        (shutil.copy2 if options.preserve_times else shutil.copy)(source, part)
        os.replace(part, target)
        return "copied", None
    except OSError as e:
        return "failed", str(e)


def _copy(batches: Iterator[pa.RecordBatch], destination: str, options: ExportOptions, run: ExportRun | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for source, relative, size in zip(*(batch.column(c).to_pylist() for c in ("source", "relative_path", "file_size")), strict=True):
            outcome, error = _copied(source, os.path.join(destination, relative), options)
            size = (size or 0) if outcome == "copied" else 0
            rows.append((source, relative, outcome, size, error))
            if run:
                run.tell(outcome, size)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["source", "relative_path", "outcome", "bytes", "error"])


def execute_export(plan: DataFrame, destination: str, options: ExportOptions, run: ExportRun | None = None) -> DataFrame:
    """(source, relative_path, outcome, bytes, error) of copying each file to a folder that all tasks see."""
    rows = plan.select("source", "relative_path", F.col("file_size").cast("long").alias("file_size"))
    return rows.mapInArrow(partial(_copy, destination=destination, options=options, run=run), "source string, relative_path string, outcome string, bytes long, error string")


# ---------------------------------------------------------------- runs


class ExportRun:
    """What goes on in an export: counts that tasks add to, and a way to call it off.

    Counts grow as tasks end; a task that is tried again counts again, so they are for watching. The final
    figures come from the outcomes.
    """

    def __init__(self, spark: SparkSession):
        self._sc = spark.sparkContext
        self.tag = f"export-{uuid.uuid4().hex}"
        self.cancelled = False
        self._counts = {k: self._sc.accumulator(0) for k in ("copied", "skipped", "failed", "bytes")}

    def __getstate__(self) -> dict:
        # tasks only add
        return {"_counts": self._counts}

    def tell(self, outcome: str, size: int) -> None:
        self._counts[outcome].add(1)
        self._counts["bytes"].add(size)

    def progress(self) -> dict[str, int]:
        return {k: a.value for k, a in self._counts.items()}

    def cancel(self) -> None:
        """End the run's tasks, from any thread; files that are done stay, half ones have no name."""
        self.cancelled = True
        self._sc.cancelJobsWithTag(self.tag)


class ExportError(ValueError):
    """An export that can't begin."""


def run_export(state: State, shoot_id: int, destination: str, options: ExportOptions, now: str, run: ExportRun | None = None, present: DataFrame | None = None) -> State:
    """Plan and copy, and return the state with a row of ``exports`` and one in the log.

    Nothing to export, a shoot that isn't there or a destination in the shoot's own folder is an error,
    and nothing is written. Otherwise the run ends as completed, as cancelled if ``run.cancel`` was called, or
    as failed, if it broke off or some file couldn't be copied; the others are there then all the same.
    """
    spark = state["shoots"].sparkSession
    run = run or ExportRun(spark)
    shoot = state["shoots"].where(F.col("id") == shoot_id).first()
    if not shoot:
        raise ExportError(f"there is no shoot {shoot_id}")
    source = shoot.asDict().get("source_path")
    if source and not destination_allowed(destination, [source]):
        raise ExportError("the destination lies in the shoot's own folder")
    plan = written(export_plan(export_groups(state, shoot_id, options, present), options), "export-plan")
    total = plan_totals(plan).first()["files_total"]
    if not total:
        raise ExportError("nothing to export: no albums match the options")
    seen, status, error, done, size = Observation("outcomes"), "completed", None, 0, 0
    spark.sparkContext.addJobTag(run.tag)
    try:
        outcome = F.col("outcome")
        counted = execute_export(plan, destination, options, run).observe(
            seen, F.count_if(outcome == "copied").alias("done"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min(F.when(outcome == "failed", F.concat_ws(": ", "source", "error"))).alias("error")
        )
        discard(written(counted, "export-outcomes"))
        done, size, error = (seen.get[k] for k in ("done", "bytes", "error"))
        status = "failed" if error else "completed"
    except Exception as e:  # the job was ended, or something broke that isn't a file's own fault
        status, error = ("cancelled", None) if run.cancelled else ("failed", str(e).splitlines()[0])
        done, size = run.progress()["copied"], run.progress()["bytes"]
    finally:
        spark.sparkContext.removeJobTag(run.tag)
        discard(plan)
    row = (shoot_id, destination, options_text(options), status, int(total), int(done), int(size), error, now, now)
    ddl = "shoot_id long, destination string, options string, status string, files_total long, files_done long, bytes_done long, error string, started_at string, finished_at string"
    out = changes.inserted(state, "exports", spark.createDataFrame([row], ddl), ["shoot_id"])
    return changes.record(out, "export", now, shoot_id=shoot_id, detail=f"{status} → {destination}")
