"""Changes to the index as functions from a state to a new one.

Lists of ids are joined as tables, so they may be long. ``now`` is given by the caller, so a
change can be repeated with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nocase, trimmed
from ..schema import REFERENCES, State, conform
from ..scratch import discard, numbered, written
from .summaries import cluster_covers

MOST_ATTEMPTS = 3
#: So many ids of deleted rows are looked for by a condition.
FEW = 32
# Priorities of jobs, low numbers first.
PRIORITY = {"scan": 10, "thumbnail": 50, "analysePhoto": 100, "analyseVideo": 120, "recognise": 300, "cluster": 400, "albums": 500}


class ChangeError(ValueError):
    """A change that isn't allowed."""


# ---------------------------------------------------------------- building blocks


def changed(state: State, table: str, where: Column, /, **values) -> State:
    """Rows for which ``where`` is true get new values; columns or plain values."""
    hit = F.coalesce(where, F.lit(False))
    df = state[table]
    new = {c: F.when(hit, v if isinstance(v, Column) else F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    return {**state, table: df.withColumns(new)}


def _id_table(spark: SparkSession, ids: DataFrame | Iterable[int]) -> DataFrame:
    return ids.select("id") if isinstance(ids, DataFrame) else spark.createDataFrame([(int(i),) for i in ids], "id long")


def marked(state: State, table: str, ids: DataFrame | Iterable[int]) -> State:
    """The table with a column ``_hit`` that is true for these ids."""
    df = state[table]
    wanted = _id_table(df.sparkSession, ids).distinct().withColumn("_hit", F.lit(True))
    return {**state, table: df.join(wanted, "id", "left")}


def _unmarked(state: State, table: str) -> State:
    return {**state, table: state[table].drop("_hit")}


def _many(state: State, ids, guard: Column | None = None, /, **values) -> State:
    out = marked(state, "faces", ids)
    return _unmarked(changed(out, "faces", F.col("_hit") if guard is None else F.col("_hit") & guard, **values), "faces")


def inserted(state: State, table: str, rows: DataFrame, order: list[str]) -> State:
    """Rows appended with the ids that follow the largest, in ``order``; defaults fill what is missing."""
    base = state[table].agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    fresh = numbered(rows, order, "_n").join(F.broadcast(base)).withColumn("id", F.col("_base") + F.col("_n"))
    return {**state, table: state[table].unionByName(conform(fresh, table), allowMissingColumns=True)}


def deleted(state: State, table: str, gone: DataFrame | Column) -> State:
    """Rows whose id is in ``gone``, or for which ``gone`` is true, go; rows that point at them go or lose the
    pointer, all the way down."""
    if isinstance(gone, Column):
        hit = F.coalesce(gone, F.lit(False))
        return _let_go({**state, table: state[table].where(~hit)}, table, state[table].where(hit))
    return _let_go({**state, table: state[table].join(gone.select("id").distinct(), "id", "left_anti")}, table, gone)


def _let_go(state: State, table: str, gone: DataFrame) -> State:
    """What points at rows of ``table`` that are gone, by their id.

    The ids are written, so that their number is known: few are a condition that filters push down, more are a
    table of known size, which a join broadcasts or shuffles.
    """
    children = [(child, column, action) for child, column, parent, action in REFERENCES if parent == table and child in state]
    if not children:
        return state
    ids = written(gone.where("id is not null").select(F.col("id").alias("_gone")).distinct(), "gone")
    few = [r["_gone"] for r in ids.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        discard(ids)
    if not few:
        return state
    out = dict(state)
    for child, column, action in children:
        df = out[child]
        if len(few) <= FEW:
            hit = F.coalesce(F.col(column).isin(few), F.lit(False))
            kept, lost = df.where(~hit), df.where(hit)
            freed = df.withColumn(column, F.when(~hit, F.col(column)))
        else:
            same = df[column] == ids["_gone"]
            kept, lost = df.join(ids, same, "left_anti"), df.join(ids, same, "left_semi")
            freed = df.join(ids, same, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
        out[child] = kept if action == "cascade" else freed
        if action == "cascade" and "id" in df.columns:
            out = _let_go(out, child, lost)
    return out


# ---------------------------------------------------------------- media


def upsert_media(state: State, scanned: DataFrame) -> State:
    """Scanned files merged on (shoot_id, path). A known file keeps its id and time, gets the new
    size and key, and starts again, without thumbnail, if its key changed; faces, file name, type
    and error stay until it is analysed."""
    key = ["shoot_id", "path"]
    new = scanned.select(*key, *[F.col(c).alias(f"_{c}") for c in ("file_size", "captured_at", "content_key")]).dropDuplicates(key).withColumn("_seen", F.lit(True))
    differs = F.col("_seen") & ~F.col("content_key").eqNullSafe(F.col("_content_key"))
    known = state["media"].join(new, key, "left")
    known = known.withColumns({
        "processing_status": F.when(differs, "pending").otherwise(F.col("processing_status")), "thumbnail_path": F.when(F.coalesce(~differs, F.lit(True)), F.col("thumbnail_path")),
        "file_size": F.coalesce("_file_size", "file_size"), "captured_at": F.coalesce("captured_at", "_captured_at"), "content_key": F.coalesce("_content_key", "content_key"),
    }).select(*state["media"].columns)
    fresh = scanned.dropDuplicates(key).join(state["media"].select(*key), key, "left_anti")
    return inserted({**state, "media": known}, "media", fresh, key)


def set_metadata(state: State, found: DataFrame) -> State:
    """What reading files found, by media id: a time that was found wins, all else is overwritten, nulls too."""
    columns = [c for c in found.columns if c not in ("id", "captured_at")]
    new = found.select("id", F.col("captured_at").alias("_captured_at"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_seen"))
    df = state["media"].join(new, "id", "left").withColumns({c: F.when(F.col("_seen"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {"captured_at": F.coalesce("_captured_at", "captured_at")})
    return {**state, "media": df.select(*state["media"].columns)}


def set_thumbnail(state: State, media_id: int, path: str | None) -> State:
    return changed(state, "media", F.col("id") == media_id, thumbnail_path=path)


def set_media_status(state: State, media_id: int, status: str, error: str | None = None) -> State:
    return changed(state, "media", F.col("id") == media_id, processing_status=status, error=error)


def refresh_face_counts(state: State) -> State:
    counts = state["faces"].where(F.col("assignment") != "ignored").groupBy(F.col("media_id").alias("id")).agg(F.count("*").alias("_n"))
    df = state["media"].join(counts, "id", "left").withColumn("face_count", F.coalesce("_n", F.lit(0).cast("long")))
    return {**state, "media": df.select(*state["media"].columns)}


def reset_analysis(state: State, shoot_id: int, now: str = "") -> State:
    """Forgets what was found in a shoot: faces, detections, clusters (named ones too) and albums; its
    media are to be analysed again. Its open jobs are cancelled, cancelled and done ones cleared; failed
    ones stay."""
    own = F.col("shoot_id") == shoot_id
    out = state
    for table in ("faces", "clusters", "albums"):
        out = deleted(out, table, own)
    media = out["media"].where(own).select(F.col("id").alias("media_id"))
    out = {**out, "video_detections": out["video_detections"].join(media, "media_id", "left_anti").select(*state["video_detections"].columns)}
    out = changed(out, "media", own, processing_status="indexed", face_count=0, error=None)
    return clear_finished(cancel_jobs(out, shoot_id, now), shoot_id)


def remove_faces_of_media(state: State, media_id: int) -> State:
    """Before a medium is analysed again."""
    out = deleted(state, "faces", F.col("media_id") == media_id)
    return {**out, "video_detections": out["video_detections"].where(F.col("media_id") != media_id)}


# ---------------------------------------------------------------- faces


def set_suggestions(state: State, suggestions: DataFrame) -> State:
    """(face_id, person_id, confidence): faces that nobody has decided on get a suggestion."""
    new = suggestions.select(F.col("face_id").alias("id"), F.col("person_id").alias("_person"), F.col("confidence").alias("_sure"))
    df = state["faces"].join(new, "id", "left")
    open_ = F.col("_person").isNotNull() & F.col("assignment").isin("unassigned", "suggested")
    df = df.withColumns({"person_id": F.when(open_, F.col("_person")).otherwise(F.col("person_id")), "recognition_confidence": F.when(open_, F.col("_sure")).otherwise(F.col("recognition_confidence")), "assignment": F.when(open_, "suggested").otherwise(F.col("assignment"))})
    return {**state, "faces": df.select(*state["faces"].columns)}


def assign_face(state: State, face_id: int, person_id: int, confidence: float | None) -> State:
    return changed(state, "faces", F.col("id") == face_id, person_id=person_id, recognition_confidence=confidence, assignment="confirmed")


def assign_faces(state: State, ids, person_id: int) -> State:
    """Confidence stays."""
    return _many(state, ids, person_id=person_id, assignment="confirmed")


def confirm_faces(state: State, ids) -> State:
    """Faces without a person stay as they are."""
    return _many(state, ids, F.col("person_id").isNotNull(), assignment="confirmed")


def reject_faces(state: State, ids) -> State:
    return _many(state, ids, person_id=None, recognition_confidence=None, cluster_id=None, assignment="unassigned")


def ignore_faces(state: State, ids) -> State:
    """Confidence stays."""
    return _many(state, ids, person_id=None, cluster_id=None, assignment="ignored")


def set_assignment(state: State, face_id: int, assignment: str) -> State:
    return changed(state, "faces", F.col("id") == face_id, assignment=assignment)


def set_cluster(state: State, face_id: int, cluster_id: int | None) -> State:
    return changed(state, "faces", F.col("id") == face_id, cluster_id=cluster_id)


def clear_clusters(state: State, shoot_id: int) -> State:
    return changed(state, "faces", F.col("shoot_id") == shoot_id, cluster_id=None)


def clear_embeddings(state: State) -> State:
    return changed(state, "faces", F.lit(True), embedding=None, embedding_dim=None)


def clear_recognition(state: State) -> State:
    """All recognition data of all persons: faces open, clusters and detections gone, vectors too."""
    out = changed(clear_embeddings(state), "faces", F.lit(True), person_id=None, cluster_id=None, recognition_confidence=None, assignment="unassigned")
    return {**out, "clusters": out["clusters"].limit(0), "video_detections": out["video_detections"].limit(0), "albums": out["albums"].limit(0), "album_media": out["album_media"].limit(0)}


# ---------------------------------------------------------------- people


def get_or_create_person(state: State, name: str, team: str | None, now: str) -> State:
    """A person of this name, the case of A-Z and blanks around it aside, is kept as it is."""
    name = name.strip()
    if not name:
        raise ChangeError("a person needs a name")
    people = state["people"]
    new = people.sparkSession.createDataFrame([(name, team, now, now)], "name string, team string, created_at string, updated_at string")
    fresh = new.join(people.select(nocase(F.col("name")).alias("_key")), nocase(new["name"]) == F.col("_key"), "left_anti")
    return inserted(state, "people", fresh, ["name"])


def rename_person(state: State, person_id: int, name: str, now: str) -> State:
    name = name.strip()
    if not name:
        raise ChangeError("a person needs a name")
    same = state["people"].where((nocase(F.col("name")) == nocase(trimmed(F.lit(name)))) & (F.col("id") != person_id))
    if not same.isEmpty():
        raise ChangeError(f"there is a person named {name}")
    return changed(state, "people", F.col("id") == person_id, name=name, updated_at=now)


def update_person(state: State, person_id: int, team: str | None, notes: str | None, now: str) -> State:
    return changed(state, "people", F.col("id") == person_id, team=team, notes=notes, updated_at=now)


def set_person_cover(state: State, person_id: int, face_id: int | None) -> State:
    return changed(state, "people", F.col("id") == person_id, cover_face_id=face_id)


def merge_people(state: State, target: int, source: int, now: str) -> State:
    """All that points at ``source`` points at ``target``; ``source`` goes."""
    if target == source:
        raise ChangeError("a person can't be merged into itself")
    out = state
    for table in ("faces", "clusters", "video_detections"):
        out = changed(out, table, F.col("person_id") == source, person_id=target)
    out = {**out, "people": out["people"].where(F.col("id") != source)}
    return changed(out, "people", F.col("id") == target, updated_at=now)


def forget_person(state: State, person_id: int, now: str) -> State:
    """Recognition data of a person goes; the profile and the vectors stay."""
    out = changed(state, "faces", F.col("person_id") == person_id, person_id=None, recognition_confidence=None, assignment="unassigned")
    out = changed(out, "clusters", F.col("person_id") == person_id, status="unnamed", person_id=None)
    return changed(out, "people", F.col("id") == person_id, cover_face_id=None, updated_at=now)


def delete_person(state: State, person_id: int) -> State:
    """Faces lose the person but keep their assignment; detections of the person go."""
    return deleted(state, "people", F.col("id") == person_id)


# ---------------------------------------------------------------- clusters


def refresh_clusters(state: State, shoot_id: int | None = None) -> State:
    """Counts and covers from the faces; unnamed clusters without faces go."""
    own = F.lit(True) if shoot_id is None else F.col("shoot_id") == shoot_id
    new = cluster_covers(state).select(F.col("cluster_id").alias("id"), F.col("face_count").alias("_n"), F.col("cover_face_id").alias("_cover"))
    df = state["clusters"].join(new, "id", "left")
    df = df.withColumns({"face_count": F.when(own, F.coalesce("_n", F.lit(0).cast("long"))).otherwise(F.col("face_count")), "cover_face_id": F.when(own, F.col("_cover")).otherwise(F.col("cover_face_id"))})
    return {**state, "clusters": df.where(~(own & (F.col("face_count") == 0) & (F.col("status") == "unnamed"))).select(*state["clusters"].columns)}


def clear_unnamed(state: State, shoot_id: int) -> State:
    return deleted(state, "clusters", (F.col("shoot_id") == shoot_id) & (F.col("status") == "unnamed"))


def name_cluster(state: State, cluster_id: int, person_id: int) -> State:
    out = changed(state, "clusters", F.col("id") == cluster_id, person_id=person_id, status="named")
    return changed(out, "faces", (F.col("cluster_id") == cluster_id) & (F.col("assignment") != "ignored"), person_id=person_id, assignment="confirmed")


def split_cluster(state: State, cluster_id: int, ids, label: str, now: str) -> State:
    """Faces that are in the cluster now move to a new one and are open again. Counts and covers follow in
    the cluster's shoot; other shoots stay as they are."""
    own = state["clusters"].where(F.col("id") == cluster_id).select("shoot_id").withColumn("label", F.lit(label)).withColumn("created_at", F.lit(now))
    found = own.first()
    if not found:
        raise ChangeError(f"there is no cluster {cluster_id}")
    out = inserted(state, "clusters", own, ["shoot_id"])
    new_id = out["clusters"].agg(F.max("id")).first()[0]
    # faces of one cluster, of known size when ids meet them: no long list of ids is shuffled for them
    inside = written(state["faces"].where(F.col("cluster_id") == cluster_id).select("id"), "cluster-faces")
    moved = written(_id_table(state["faces"].sparkSession, ids).join(inside, "id", "left_semi"), "cluster-moved")
    out = _many(out, moved, person_id=None, recognition_confidence=None, assignment="unassigned", cluster_id=new_id)
    return refresh_clusters(out, found["shoot_id"])


def merge_clusters(state: State, target: int, source: int) -> State:
    """Faces move to ``target``; if that has a person, all its faces that aren't ignored are confirmed."""
    if target == source:
        raise ChangeError("a cluster can't be merged into itself")
    found = {r["id"]: r for r in state["clusters"].where(F.col("id").isin(target, source)).select("id", "shoot_id", "person_id").collect()}
    if len(found) < 2:
        raise ChangeError("there is no such cluster")
    if found[target]["shoot_id"] != found[source]["shoot_id"]:
        raise ChangeError("the clusters are of different shoots")
    out = changed(state, "faces", F.col("cluster_id") == source, cluster_id=target)
    if found[target]["person_id"] is not None:
        out = changed(out, "faces", (F.col("cluster_id") == target) & (F.col("assignment") != "ignored"), person_id=found[target]["person_id"], assignment="confirmed")
    return refresh_clusters({**out, "clusters": out["clusters"].where(F.col("id") != source)}, found[target]["shoot_id"])


def set_cluster_status(state: State, cluster_id: int, status: str) -> State:
    return changed(state, "clusters", F.col("id") == cluster_id, status=status)


def rename_cluster(state: State, cluster_id: int, label: str) -> State:
    return changed(state, "clusters", F.col("id") == cluster_id, label=label)


def delete_cluster(state: State, cluster_id: int) -> State:
    return deleted(state, "clusters", F.col("id") == cluster_id)


# ---------------------------------------------------------------- shoots, exports, settings, log


def create_shoot(state: State, name: str, source_path: str, now: str) -> State:
    new = state["shoots"].sparkSession.createDataFrame([(name, source_path, now, now)], "name string, source_path string, created_at string, updated_at string")
    return inserted(state, "shoots", new, ["name"])


def update_shoot(state: State, shoot_id: int, now: str, **values) -> State:
    """name, notes or status."""
    return changed(state, "shoots", F.col("id") == shoot_id, updated_at=now, **values)


def delete_shoot(state: State, shoot_id: int) -> State:
    return deleted(state, "shoots", F.col("id") == shoot_id)


def start_export(state: State, shoot_id: int, destination: str, options: str, now: str) -> State:
    new = state["exports"].sparkSession.createDataFrame([(shoot_id, destination, options, "running", now)], "shoot_id long, destination string, options string, status string, started_at string")
    return inserted(state, "exports", new, ["shoot_id"])


def update_export(state: State, export_id: int, **values) -> State:
    """files_total, files_done, bytes_done, status, error or finished_at."""
    return changed(state, "exports", F.col("id") == export_id, **values)


def put_setting(state: State, key: str, value: str) -> State:
    new = state["settings"].sparkSession.createDataFrame([(key, value)], "key string, value string")
    return {**state, "settings": state["settings"].join(new.select("key"), "key", "left_anti").unionByName(new)}


def record(state: State, event: str, now: str, shoot_id: int | None = None, media_id: int | None = None, person_id: int | None = None, detail: str | None = None) -> State:
    """A line of the log: ids alone, never names or vectors."""
    new = state["app_log"].sparkSession.createDataFrame([(now, event, shoot_id, media_id, person_id, detail)], "timestamp string, event string, shoot_id long, media_id long, person_id long, detail string")
    return inserted(state, "app_log", new, ["timestamp"])


def record_quietly(state: State, *args, **kwargs) -> State:
    """As ``record``; a log that can't be written doesn't stop what is logged."""
    try:
        return record(state, *args, **kwargs)
    except Exception:  # noqa: BLE001
        return state


def trim_log(state: State, keep: int) -> State:
    """The newest lines, 100 at least."""
    newest = state["app_log"].select("id").orderBy(F.desc("id")).limit(max(keep, 100))
    return {**state, "app_log": state["app_log"].join(newest, "id", "left_semi")}


# ---------------------------------------------------------------- jobs


def enqueue(state: State, jobs: DataFrame, unique: bool = False) -> State:
    """Jobs (shoot_id, kind, media_id, priority); with ``unique`` those that wait or run already are left out."""
    if unique:
        busy = state["jobs"].where(F.col("state").isin("queued", "running")).select(F.col("shoot_id").alias("_s"), F.col("kind").alias("_k"), F.col("media_id").alias("_m"))
        jobs = jobs.dropDuplicates(["shoot_id", "kind", "media_id"]).join(busy, (F.col("shoot_id") == F.col("_s")) & (F.col("kind") == F.col("_k")) & F.col("media_id").eqNullSafe(F.col("_m")), "left_anti")
    return inserted(state, "jobs", jobs, ["priority", "shoot_id", "kind", "media_id"])


def claim_next(state: State, now: str, shoot_id: int | None = None) -> tuple[State, DataFrame]:
    """The first queued job by priority and id starts."""
    own = F.lit(True) if shoot_id is None else F.col("shoot_id") == shoot_id
    first = state["jobs"].where((F.col("state") == "queued") & own).orderBy("priority", "id").limit(1)
    out = marked(state, "jobs", first)
    out = _unmarked(changed(out, "jobs", F.col("_hit"), state="running", started_at=now, attempts=F.col("attempts") + 1), "jobs")
    return out, out["jobs"].join(first.select("id"), "id", "left_semi")


def complete_job(state: State, job_id: int, now: str) -> State:
    return changed(state, "jobs", F.col("id") == job_id, state="done", finished_at=now, error=None)


def fail_jobs(state: State, where: Column, error: str, now: str) -> State:
    """Back to the queue, or failed after three attempts."""
    return changed(state, "jobs", where, state=F.when(F.col("attempts") < MOST_ATTEMPTS, "queued").otherwise("failed"), error=error, finished_at=now)


def requeue_stale(state: State) -> State:
    """After a stop: what was running waits again, unless it had its three attempts."""
    return changed(state, "jobs", (F.col("state") == "running") & (F.col("attempts") < MOST_ATTEMPTS), state="queued", started_at=None)


def requeue_without_attempt(state: State, job_id: int) -> State:
    return changed(state, "jobs", F.col("id") == job_id, state="queued", started_at=None, attempts=F.greatest(F.col("attempts") - 1, F.lit(0)))


def retry_failed(state: State, shoot_id: int) -> State:
    return changed(state, "jobs", (F.col("shoot_id") == shoot_id) & (F.col("state") == "failed"), state="queued", attempts=0, error=None, started_at=None, finished_at=None)


def cancel_jobs(state: State, shoot_id: int, now: str) -> State:
    return changed(state, "jobs", (F.col("shoot_id") == shoot_id) & F.col("state").isin("queued", "running"), state="cancelled", finished_at=now)


def clear_finished(state: State, shoot_id: int) -> State:
    return {**state, "jobs": state["jobs"].where(~((F.col("shoot_id") == shoot_id) & F.col("state").isin("done", "cancelled")))}


def analysis_jobs(media: DataFrame, thumbnails: bool = True) -> DataFrame:
    """Two jobs for each medium that is still to be analysed: its thumbnail and its analysis."""
    waiting = media.where(F.col("processing_status").isin("pending", "indexed", "thumbnailed"))
    analyse = F.when(F.col("media_type") == "video", "analyseVideo").otherwise("analysePhoto")
    thumb = F.when((F.col("processing_status") == "pending") | F.col("thumbnail_path").isNull(), "thumbnail") if thumbnails else F.lit(None).cast("string")
    rows = waiting.select("shoot_id", F.col("id").alias("media_id"), F.explode(F.array_compact(F.array(thumb, analyse))).alias("kind"))
    table = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return rows.withColumn("priority", F.element_at(table, F.col("kind")).cast("long"))


def finishing_jobs(shoots: DataFrame) -> DataFrame:
    """Recognise, cluster and albums for each (shoot_id)."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(PRIORITY[k]).cast("long").alias("priority")) for k in ("recognise", "cluster", "albums")]
    return shoots.select("shoot_id", F.explode(F.array(*kinds)).alias("j")).select("shoot_id", F.lit(None).cast("long").alias("media_id"), "j.kind", "j.priority")


