"""A query for each operator on the star schema in its roles, and DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import albums, changes, clustering, export, frames, grid, summaries, vectors
from . import roles
from .roles import ROLES_SQL, state, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Registers a query under its function's name, with SQL that may use the role tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {ROLES_SQL.strip()}\n{sql.strip()}"
        return f

    return add


_MEDIA = ("id", "shoot_id", "filename", "media_type", "captured_at", "processing_status")
_MEDIA_SQL = "id, shoot_id, filename, media_type, captured_at, processing_status"


# ---------------------------------------------------------------- albums


@_query("SELECT p.shoot_id, a_id, b_id, a.name AS a_name, b.name AS b_name, shared, sort_order FROM pairs p JOIN people a ON a.id = a_id JOIN people b ON b.id = b_id")
def album_pairs(spark, sf):
    """Flagship: the pairs of persons that share most media, in each shoot."""
    return albums.album_pairs(state(spark, sf, "faces", "people"))


_COUNTS = ["shoot_id", "name", "sort_order"]
_COUNTS_SQL = "count(*) AS media_count, count(*) FILTER (media_type = 'photo') AS photo_count, count(*) FILTER (media_type = 'video') AS video_count, min(CASE WHEN thumbnail_path IS NOT NULL THEN media_id END) AS cover_media_id"


@_query(f"""SELECT s.shoot_id, p.name, d.sort_order, {_COUNTS_SQL} FROM seen s JOIN people p ON p.id = s.person_id
  JOIN (SELECT shoot_id, person_id, row_number() OVER (PARTITION BY shoot_id ORDER BY lower(name), person_id) - 1 AS sort_order FROM (SELECT DISTINCT shoot_id, person_id, name FROM seen JOIN people ON people.id = person_id)) d
    ON d.shoot_id = s.shoot_id AND d.person_id = s.person_id JOIN media m ON m.id = s.media_id GROUP BY ALL""")
def album_player(spark, sf):
    s = state(spark, sf, "faces", "people", "media")
    return albums.album_counts(albums.player_albums(s), s["media"], _COUNTS)


@_query(f"""SELECT p.shoot_id, a.name || ' + ' || b.name AS name, p.sort_order, {_COUNTS_SQL} FROM pairs p JOIN people a ON a.id = a_id JOIN people b ON b.id = b_id
  JOIN seen x ON x.shoot_id = p.shoot_id AND x.person_id = a_id JOIN seen y ON y.media_id = x.media_id AND y.person_id = b_id JOIN media m ON m.id = x.media_id GROUP BY ALL""".replace("min(CASE WHEN thumbnail_path IS NOT NULL THEN media_id END)", "min(CASE WHEN thumbnail_path IS NOT NULL THEN m.id END)"))
def album_pair_media(spark, sf):
    s = state(spark, sf, "faces", "people", "media")
    return albums.album_counts(albums.pair_albums(s), s["media"], _COUNTS)


@_query(f"""SELECT t.shoot_id, t.team AS name, d.sort_order, {_COUNTS_SQL} FROM (SELECT DISTINCT shoot_id, media_id, team FROM seen JOIN people ON people.id = person_id WHERE trim(team) <> '') t
  JOIN (SELECT shoot_id, team, row_number() OVER (PARTITION BY shoot_id ORDER BY lower(team), team) - 1 AS sort_order FROM (SELECT DISTINCT shoot_id, team FROM seen JOIN people ON people.id = person_id)) d ON d.shoot_id = t.shoot_id AND d.team = t.team
  JOIN media m ON m.id = t.media_id GROUP BY ALL""")
def album_team(spark, sf):
    s = state(spark, sf, "faces", "people", "media")
    return albums.album_counts(albums.team_albums(s), s["media"], _COUNTS)


@_query(f"""SELECT t.shoot_id, 'Unidentified' AS name, CAST(0 AS BIGINT) AS sort_order, {_COUNTS_SQL} FROM (SELECT DISTINCT shoot_id, media_id FROM faces WHERE person_id IS NULL AND assignment <> 'ignored') t JOIN media m ON m.id = t.media_id GROUP BY ALL""")
def album_unidentified(spark, sf):
    s = state(spark, sf, "faces", "people", "media")
    return albums.album_counts(albums.unidentified_albums(s), s["media"], _COUNTS)


@_query("""SELECT shoot_id, album_type, name, count(DISTINCT media_id) AS media_count, min(CASE WHEN thumbnail_path IS NOT NULL THEN media_id END) AS cover_media_id FROM (
  SELECT s.shoot_id, 'player' AS album_type, p.name, s.media_id, s.person_id AS k FROM seen s JOIN people p ON p.id = s.person_id
  UNION ALL SELECT p.shoot_id, 'multiPlayer', a.name || ' + ' || b.name, x.media_id, p.sort_order FROM pairs p JOIN people a ON a.id = a_id JOIN people b ON b.id = b_id JOIN seen x ON x.shoot_id = p.shoot_id AND x.person_id = a_id JOIN seen y ON y.media_id = x.media_id AND y.person_id = b_id
  UNION ALL SELECT DISTINCT s.shoot_id, 'team', team, s.media_id, 0 FROM seen s JOIN people p ON p.id = s.person_id
  UNION ALL SELECT DISTINCT shoot_id, 'unidentified', 'Unidentified', media_id, 0 FROM faces WHERE person_id IS NULL AND assignment <> 'ignored') r JOIN (SELECT id, thumbnail_path FROM media) m ON m.id = r.media_id GROUP BY shoot_id, album_type, name, k""")
def album_list(spark, sf):
    """All albums derived anew, listed."""
    s = state(spark, sf, "faces", "people", "media")
    none = spark.createDataFrame([], "id long, shoot_id long, name string, album_type string, person_ids array<bigint>, cluster_id long, cover_media_id long, media_count long, photo_count long, video_count long, sort_order long, generated_at string")
    s |= {"albums": none, "album_media": spark.createDataFrame([], "album_id long, media_id long")}
    return albums.album_list(albums.regenerate(s)).select("shoot_id", "album_type", "name", "media_count", "cover_media_id")


# ---------------------------------------------------------------- grid and review


@_query(f"SELECT {_MEDIA_SQL} FROM media WHERE shoot_id = 1996 AND media_type = 'photo' ORDER BY captured_at ASC NULLS LAST, filename, id LIMIT 500 OFFSET 20")
def media_grid(spark, sf):
    return grid.media_grid(state(spark, sf, "media"), grid.MediaQuery(shoot_id=1996, media_type="photo", offset=20)).select(*_MEDIA)


@_query(f"SELECT {_MEDIA_SQL} FROM media WHERE id IN (SELECT media_id FROM faces WHERE person_id = 5 AND assignment IN ('suggested', 'confirmed')) ORDER BY captured_at ASC NULLS LAST, filename, id LIMIT 500")
def media_grid_by_person(spark, sf):
    return grid.media_grid(state(spark, sf, "media", "faces"), grid.MediaQuery(person_id=5)).select(*_MEDIA)


@_query(f"SELECT {_MEDIA_SQL} FROM media WHERE shoot_id = 1997 AND id IN (SELECT media_id FROM faces WHERE person_id IS NULL AND assignment <> 'ignored') ORDER BY captured_at ASC NULLS LAST, filename, id LIMIT 5000")
def media_only_unidentified(spark, sf):
    return grid.media_grid(state(spark, sf, "media", "faces"), grid.MediaQuery(shoot_id=1997, only_unidentified=True, limit=9999)).select(*_MEDIA)


@_query(f"SELECT {_MEDIA_SQL} FROM media WHERE lower(filename) LIKE '%mg_1%7.jp%' ORDER BY captured_at ASC NULLS LAST, filename, id LIMIT 500")
def media_search(spark, sf):
    return grid.media_grid(state(spark, sf, "media"), grid.MediaQuery(search=" Mg_1%7.jP ")).select(*_MEDIA)


@_query(f"SELECT {_MEDIA_SQL} FROM media WHERE id IN (SELECT media_id FROM faces WHERE cluster_id = 199607) ORDER BY captured_at ASC NULLS LAST, filename, id LIMIT 500")
def media_grid_by_cluster(spark, sf):
    return grid.media_grid(state(spark, sf, "media", "faces"), grid.MediaQuery(cluster_id=199607)).select(*_MEDIA)


@_query("""SELECT f.id, f.media_id, f.recognition_confidence, m.filename AS media_filename, p.name AS person_name, c.label AS cluster_label
  FROM faces f JOIN media m ON m.id = f.media_id LEFT JOIN people p ON p.id = f.person_id LEFT JOIN clusters c ON c.id = f.cluster_id
  WHERE f.shoot_id = 1996 AND f.assignment = 'suggested' AND coalesce(f.recognition_confidence, 0) <= 0.5 ORDER BY coalesce(f.recognition_confidence, 0), f.id LIMIT 300""")
def face_review_queue(spark, sf):
    q = grid.FaceQuery(shoot_id=1996, assignment="suggested", max_confidence=0.5)
    return grid.face_queue(state(spark, sf, "media", "faces", "people", "clusters"), q).select("id", "media_id", "recognition_confidence", "media_filename", "person_name", "cluster_label")


@_query(f"SELECT {_MEDIA_SQL} FROM media WHERE shoot_id = 1998 AND processing_status IN ('pending', 'indexed', 'thumbnailed') ORDER BY id LIMIT 100")
def pending_media(spark, sf):
    return grid.pending_media(state(spark, sf, "media"), 1998, 100).select(*_MEDIA)


@_query("SELECT id, finished_at, priority FROM jobs WHERE shoot_id = 1996 AND state = 'failed' ORDER BY finished_at DESC NULLS LAST, id DESC LIMIT 50")
def failed_jobs(spark, sf):
    return grid.failed_jobs(state(spark, sf, "jobs"), 1996, 50).select("id", "finished_at", "priority")


@_query("SELECT id, timestamp, event FROM app_log ORDER BY id DESC LIMIT 2000")
def log_recent(spark, sf):
    return grid.recent_log(state(spark, sf, "app_log"), 99_999).select("id", "timestamp", "event")


@_query("SELECT DISTINCT shoot_id FROM jobs WHERE state IN ('queued', 'running')")
def active_shoots(spark, sf):
    return grid.active_shoots(state(spark, sf, "jobs"))


@_query("SELECT count(*) > 0 AS outstanding FROM jobs WHERE shoot_id = 1996 AND kind IN ('scan', 'thumbnail', 'analysePhoto', 'analyseVideo') AND state IN ('queued', 'running')")
def analysis_outstanding(spark, sf):
    return grid.analysis_outstanding(state(spark, sf, "jobs"), 1996)


# ---------------------------------------------------------------- summaries


@_query("""SELECT s.id, s.name, coalesce(photo_count, 0) AS photo_count, coalesce(video_count, 0) AS video_count, coalesce(face_count, 0) AS face_count, coalesce(person_count, 0) AS person_count,
    coalesce(unknown_cluster_count, 0) AS unknown_cluster_count, coalesce(pending_jobs, 0) AS pending_jobs, coalesce(failed_jobs, 0) AS failed_jobs
  FROM shoots s LEFT JOIN (SELECT shoot_id, count(*) FILTER (media_type = 'photo') AS photo_count, count(*) FILTER (media_type = 'video') AS video_count FROM media GROUP BY 1) m ON m.shoot_id = s.id
  LEFT JOIN (SELECT shoot_id, count(*) AS face_count, count(DISTINCT CASE WHEN assignment IN ('suggested', 'confirmed') THEN person_id END) AS person_count FROM faces GROUP BY 1) f ON f.shoot_id = s.id
  LEFT JOIN (SELECT shoot_id, count(*) FILTER (status = 'unnamed') AS unknown_cluster_count FROM clusters GROUP BY 1) c ON c.shoot_id = s.id
  LEFT JOIN (SELECT shoot_id, count(*) FILTER (state IN ('queued', 'running')) AS pending_jobs, count(*) FILTER (state = 'failed') AS failed_jobs FROM jobs GROUP BY 1) j ON j.shoot_id = s.id""")
def shoot_summaries(spark, sf):
    return summaries.shoot_summaries(state(spark, sf)).select("id", "name", "photo_count", "video_count", "face_count", "person_count", "unknown_cluster_count", "pending_jobs", "failed_jobs")


@_query("""SELECT p.id, p.name, p.team, coalesce(a, 0) AS face_sample_count, coalesce(b, 0) AS media_count, coalesce(c, 0) AS shoot_count FROM people p LEFT JOIN (
  SELECT person_id, count(*) FILTER (assignment = 'confirmed' AND shoot_id = 1996) AS a, count(DISTINCT CASE WHEN assignment IN ('suggested', 'confirmed') AND shoot_id = 1996 THEN media_id END) AS b,
         count(DISTINCT CASE WHEN assignment IN ('suggested', 'confirmed') THEN shoot_id END) AS c FROM faces WHERE person_id IS NOT NULL GROUP BY 1) f ON f.person_id = p.id""")
def person_summaries(spark, sf):
    return summaries.person_summaries(state(spark, sf, "people", "faces"), 1996).select("id", "name", "team", "face_sample_count", "media_count", "shoot_count")


@_query("""SELECT c.id, c.label, c.status, c.face_count, p.name AS person_name, x.media_id AS cover_media_id, m.thumbnail_path AS cover_thumbnail, coalesce(n, 0) AS media_count
  FROM clusters c LEFT JOIN people p ON p.id = c.person_id LEFT JOIN faces x ON x.id = c.cover_face_id LEFT JOIN media m ON m.id = x.media_id
  LEFT JOIN (SELECT cluster_id, count(DISTINCT media_id) AS n FROM faces GROUP BY 1) k ON k.cluster_id = c.id WHERE c.shoot_id = 1996""")
def cluster_summaries(spark, sf):
    return summaries.cluster_summaries(state(spark, sf, "clusters", "people", "faces", "media"), 1996, include_named=True).select("id", "label", "status", "face_count", "person_name", "cover_media_id", "cover_thumbnail", "media_count")


@_query("""SELECT *, CASE WHEN media_total > 0 THEN (media_analysed + media_failed) / media_total * 100.0 ELSE 0.0 END AS percent,
    CASE WHEN jobs_queued + jobs_running = 0 THEN CASE WHEN media_total = 0 THEN 'idle' ELSE 'complete' END WHEN media_scanned < media_total THEN 'scanning' WHEN media_analysed < media_total THEN 'analysing' ELSE 'finishing' END AS stage
  FROM (SELECT s.id AS shoot_id, (SELECT count(*) FROM media m WHERE m.shoot_id = s.id) AS media_total, (SELECT count(*) FROM media m WHERE m.shoot_id = s.id AND processing_status <> 'pending') AS media_scanned,
    (SELECT count(*) FROM media m WHERE m.shoot_id = s.id AND processing_status = 'analysed') AS media_analysed, (SELECT count(*) FROM media m WHERE m.shoot_id = s.id AND processing_status = 'failed') AS media_failed,
    (SELECT count(*) FROM faces f WHERE f.shoot_id = s.id) AS faces_detected, (SELECT count(*) FROM faces f WHERE f.shoot_id = s.id AND person_id IS NOT NULL) AS faces_recognised,
    (SELECT count(*) FROM faces f WHERE f.shoot_id = s.id AND person_id IS NULL AND assignment <> 'ignored') AS faces_unknown, (SELECT count(*) FROM jobs j WHERE j.shoot_id = s.id AND state = 'queued') AS jobs_queued,
    (SELECT count(*) FROM jobs j WHERE j.shoot_id = s.id AND state = 'running') AS jobs_running, (SELECT count(*) FROM jobs j WHERE j.shoot_id = s.id AND state = 'failed') AS jobs_failed FROM shoots s)""")
def processing_progress(spark, sf):
    return summaries.progress(state(spark, sf, "shoots", "media", "faces", "jobs"))


@_query("""SELECT cluster_id, count(*) AS face_count, arg_max(id, (coalesce(quality, 0), detection_confidence, -id)) AS cover_face_id FROM faces WHERE cluster_id IS NOT NULL GROUP BY 1""")
def cluster_cover(spark, sf):
    return summaries.cluster_covers(state(spark, sf, "faces"))


@_query("SELECT media_id, count(*) AS face_count FROM faces WHERE assignment <> 'ignored' GROUP BY 1")
def media_face_counts(spark, sf):
    return summaries.media_face_counts(state(spark, sf, "faces"))


@_query("SELECT count(DISTINCT person_id) AS player_count, count(*) AS total_samples FROM faces WHERE person_id IS NOT NULL AND assignment = 'confirmed'")
def library_stats(spark, sf):
    return summaries.library_stats(state(spark, sf, "faces"))


@_query("""SELECT event_type, person_id, id, face_id, CAST(start_time AS DOUBLE) AS start_time, CAST(end_time AS DOUBLE) AS end_time, confidence, p.name AS person_name FROM (
    SELECT event_type, person_id, stretch, arg_min(id, (second, id)) AS id, arg_min(face_id, (second, id)) AS face_id, min(second) AS start_time, CASE WHEN count(*) > 1 THEN max(second) END AS end_time, max(confidence) AS confidence FROM (
      SELECT *, sum(apart) OVER (PARTITION BY event_type, person_id ORDER BY second, id) AS stretch FROM (
        SELECT *, CASE WHEN second - lag(second) OVER (PARTITION BY event_type, person_id ORDER BY second, id) > 7200 THEN 1 ELSE 0 END AS apart FROM detections)) GROUP BY 1, 2, 3) t
  LEFT JOIN (SELECT id AS pid, name FROM people) p ON p.pid = t.person_id""")
def video_timelines(spark, sf):
    s = state(spark, sf, "video_detections", "people")
    kinds = table(spark, sf, "events").select("event_type").distinct().withColumn("media_id", F.crc32(F.col("event_type").cast("binary")).cast("long"))
    lines = summaries.video_timelines(s, gap=7200.0).join(kinds, "media_id")
    return lines.select("event_type", "person_id", "id", "face_id", "start_time", "end_time", "confidence", "person_name")


# ---------------------------------------------------------------- changes


@_query("""SELECT m.shoot_id, m.path, CASE WHEN m.id % 3 = 0 THEN m.file_size + 1 ELSE m.file_size END AS file_size, m.captured_at, CASE WHEN m.id % 6 = 0 THEN 'new' ELSE m.content_key END AS content_key,
    CASE WHEN m.id % 6 = 0 THEN 'pending' ELSE processing_status END AS processing_status, CASE WHEN m.id % 6 <> 0 THEN thumbnail_path END AS thumbnail_path FROM media m
  UNION ALL SELECT shoot_id, path || '.new', file_size + 1, NULL, 'fresh', 'pending', NULL FROM media WHERE id % 100 = 0""")
def media_upsert(spark, sf):
    """A third of the files again, every sixth changed, and a few new ones."""
    s = state(spark, sf, "media")
    m = s["media"]
    again = m.where("id % 3 = 0").select("shoot_id", "path", "filename", "media_type", (F.col("file_size") + 1).alias("file_size"), F.lit(None).cast("string").alias("captured_at"), F.when(F.col("id") % 6 == 0, "new").otherwise(F.col("content_key")).alias("content_key"))
    new = m.where("id % 100 = 0").select("shoot_id", F.concat("path", F.lit(".new")).alias("path"), "filename", "media_type", (F.col("file_size") + 1).alias("file_size"), F.lit(None).cast("string").alias("captured_at"), F.lit("fresh").alias("content_key"))
    return changes.upsert_media(s, again.unionByName(new))["media"].select("shoot_id", "path", "file_size", "captured_at", "content_key", "processing_status", "thumbnail_path")


@_query("""SELECT id, CASE WHEN id % 5 IN (0, 1) THEN NULL WHEN id % 5 = 2 THEN 77 ELSE person_id END AS person_id, CASE WHEN id % 5 IN (0, 1) THEN NULL ELSE cluster_id END AS cluster_id,
    CASE WHEN id % 5 = 0 THEN NULL ELSE recognition_confidence END AS recognition_confidence,
    CASE WHEN id % 5 = 0 THEN 'unassigned' WHEN id % 5 = 1 THEN 'ignored' WHEN id % 5 = 2 THEN 'confirmed' WHEN id % 5 = 3 AND person_id IS NOT NULL THEN 'confirmed' ELSE assignment END AS assignment FROM faces""")
def face_transitions(spark, sf):
    """Faces rejected, ignored, assigned and confirmed, by their id."""
    s = state(spark, sf, "faces")
    pick = lambda k: s["faces"].where(F.col("id") % 5 == k).select("id")
    ids = [pick(k) for k in range(4)]
    s = changes.confirm_faces(changes.assign_faces(changes.ignore_faces(changes.reject_faces(s, ids[0]), ids[1]), ids[2], 77), ids[3])
    return s["faces"].select("id", "person_id", "cluster_id", "recognition_confidence", "assignment")


@_query("SELECT id, CASE WHEN person_id = 2 THEN 1 ELSE person_id END AS person_id, assignment FROM faces")
def person_merge(spark, sf):
    s = changes.merge_people(state(spark, sf, "faces", "clusters", "video_detections", "people"), 1, 2, "2026-01-01T00:00:00Z")
    return s["faces"].select("id", "person_id", "assignment")


@_query("""SELECT 'face' AS kind, id, CASE WHEN person_id <> 3 THEN person_id END AS person_id, assignment AS what FROM faces UNION ALL SELECT 'cluster', id, CASE WHEN person_id <> 3 THEN person_id END, status FROM clusters
  UNION ALL SELECT 'detection', id, person_id, NULL FROM detections WHERE coalesce(person_id, 0) <> 3 UNION ALL SELECT 'person', id, id, name FROM people WHERE id <> 3""")
def person_delete(spark, sf):
    """All rows that can point at a person after one is deleted."""
    s = changes.delete_person(state(spark, sf, "faces", "clusters", "video_detections", "people"), 3)
    rows = lambda t, kind, person, what: s[t].select(F.lit(kind).alias("kind"), "id", person.alias("person_id"), what.alias("what"))
    p = F.col("person_id")
    out = rows("faces", "face", p, F.col("assignment")).unionByName(rows("clusters", "cluster", p, F.col("status")))
    return out.unionByName(rows("video_detections", "detection", p, F.lit(None).cast("string"))).unionByName(rows("people", "person", F.col("id"), F.col("name")))


@_query("""SELECT 'media' AS kind, id FROM media WHERE shoot_id <> 1996 UNION ALL SELECT 'faces', id FROM faces WHERE shoot_id <> 1996 UNION ALL SELECT 'jobs', id FROM jobs WHERE shoot_id <> 1996
  UNION ALL SELECT 'clusters', id FROM clusters WHERE shoot_id <> 1996 UNION ALL SELECT 'shoots', id FROM shoots WHERE id <> 1996""")
def cascade_delete(spark, sf):
    """What is left of all tables after a shoot is deleted."""
    s = changes.delete_shoot(state(spark, sf, "shoots", "media", "faces", "jobs", "clusters"), 1996)
    parts = [s[t].select(F.lit(t).alias("kind"), "id") for t in ("media", "faces", "jobs", "clusters", "shoots")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query("""SELECT c.id, c.status, CASE WHEN c.id = 199605 THEN 7 ELSE c.person_id END AS person_id, count(*) FILTER (f.assignment <> 'ignored') AS open_faces FROM (SELECT id, person_id, CASE WHEN id = 199605 THEN 'named' ELSE status END AS status FROM clusters WHERE shoot_id = 1996) c
  JOIN faces f ON f.cluster_id = c.id GROUP BY ALL""")
def cluster_naming(spark, sf):
    s = changes.name_cluster(state(spark, sf, "clusters", "faces"), 199605, 7)
    open_ = s["faces"].groupBy(F.col("cluster_id").alias("id")).agg(F.count_if(F.col("assignment") != "ignored").alias("open_faces"))
    return s["clusters"].where("shoot_id = 1996").join(open_, "id").select("id", "status", "person_id", "open_faces")


@_query("""SELECT c.id, c.face_count + CASE WHEN c.id = 199611 THEN (SELECT count(*) FROM faces WHERE cluster_id = 199612) ELSE 0 END AS face_count,
    (SELECT arg_max(f.id, (coalesce(quality, 0), detection_confidence, -f.id)) FROM faces f WHERE CASE WHEN f.cluster_id = 199612 THEN 199611 ELSE f.cluster_id END = c.id) AS cover_face_id FROM clusters c WHERE c.shoot_id = 1996 AND c.id <> 199612""")
def cluster_merge(spark, sf):
    return changes.merge_clusters(state(spark, sf, "clusters", "faces"), 199611, 199612)["clusters"].where("shoot_id = 1996").select("id", "face_count", "cover_face_id")


@_query("SELECT id, priority, 'running' AS state, attempts + 1 AS attempts FROM jobs WHERE state = 'queued' AND shoot_id = 1996 ORDER BY priority, id LIMIT 1")
def job_claim_order(spark, sf):
    _, job = changes.claim_next(state(spark, sf, "jobs"), "2026-01-01T00:00:00Z", 1996)
    return job.select("id", "priority", "state", "attempts")


@_query("SELECT id, CASE WHEN state <> 'running' THEN state WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS state, attempts, CASE WHEN state = 'running' THEN 'lost' END AS error FROM jobs")
def job_fail(spark, sf):
    s = changes.fail_jobs(state(spark, sf, "jobs"), F.col("state") == "running", "lost", "2026-01-01T00:00:00Z")
    return s["jobs"].select("id", "state", "attempts", "error")


@_query("SELECT id, CASE WHEN state = 'running' AND attempts < 3 THEN 'queued' ELSE state END AS state, attempts FROM jobs")
def job_requeue_stale(spark, sf):
    return changes.requeue_stale(state(spark, sf, "jobs"))["jobs"].select("id", "state", "attempts")


@_query("""SELECT (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY priority, shoot_id, kind, media_id) AS id, shoot_id, kind, media_id, priority FROM (
    SELECT m.shoot_id, m.id AS media_id, unnest(['thumbnail', CASE WHEN media_type = 'video' THEN 'analyseVideo' ELSE 'analysePhoto' END]) AS kind, unnest([50, CASE WHEN media_type = 'video' THEN 120 ELSE 100 END])::BIGINT AS priority FROM media m WHERE processing_status = 'pending') w
  WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.state IN ('queued', 'running') AND j.shoot_id = w.shoot_id AND j.kind = w.kind AND j.media_id = w.media_id)""")
def enqueue_unique(spark, sf):
    """Work for media that wait, where no job for it waits or runs yet."""
    s = state(spark, sf, "jobs", "media")
    after = changes.enqueue(s, changes.analysis_jobs(s["media"]), unique=True)
    return after["jobs"].join(s["jobs"].select("id"), "id", "left_anti").select("id", "shoot_id", "kind", "media_id", "priority")


@_query("SELECT id, event FROM app_log ORDER BY id DESC LIMIT 150")
def log_trim(spark, sf):
    return changes.trim_log(state(spark, sf, "app_log"), 150)["app_log"].select("id", "event")


# ---------------------------------------------------------------- vectors


def _library(spark, sf):
    v = roles.vectors(spark, sf)
    return v.where("person_id is null"), v.where("person_id is not null").select("person_id", "embedding")


@_query("SELECT id, rank, person_id, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 3")
def vector_rank_top3(spark, sf):
    queries, library = _library(spark, sf)
    return vectors.ranked(queries, library).select("id", F.col("rank").cast("long").alias("rank"), "person_id", F.round("similarity", 6).alias("similarity"))


@_query("""SELECT a.id, a.person_id, round(a.similarity, 6) AS similarity, round(b.similarity, 6) AS runner_up FROM ranked a LEFT JOIN ranked b ON b.id = a.id AND b.rank = 2 WHERE a.rank = 1 AND a.similarity >= 0.25 AND (b.similarity IS NULL OR a.similarity - b.similarity >= 0.02)""")
def vector_match_one(spark, sf):
    queries, library = _library(spark, sf)
    return vectors.matches(queries, library, 0.25, 0.02).select("id", "person_id", F.round("similarity", 6).alias("similarity"), F.round("runner_up", 6).alias("runner_up"))


@_query("""SELECT src, dst, round(max(similarity), 6) AS similarity FROM (SELECT src, dst, similarity FROM k WHERE rank <= 3 UNION ALL SELECT dst, src, similarity FROM k WHERE rank <= 3) GROUP BY 1, 2""".replace("FROM k", "FROM (SELECT a.id AS src, b.id AS dst, greatest(-1, least(1, list_dot_product(a.v, b.v))) AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS rank FROM vectors a JOIN vectors b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) >= 0.3) k"))
def knn_graph(spark, sf):
    v = roles.vectors(spark, sf)
    return vectors.neighbours(v, k=3, least=0.3).select("src", "dst", F.round("similarity", 6).alias("similarity"))


@_query("""SELECT label, size, round(avg(list_dot_product(v, c)), 6) AS cohesion FROM (SELECT CAST(e.label AS BIGINT) AS label, CAST(e.embedding AS DOUBLE[]) AS v, c, size FROM embeddings e JOIN (
  SELECT label, list(s / norm ORDER BY i) AS c, any_value(size) AS size FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY label)) AS norm FROM (
    SELECT label, i, sum(x) AS s, count(*) AS size FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2)) GROUP BY 1) k ON k.label = e.label) GROUP BY 1, 2""")
def centroid_cohesion(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("id"), "embedding")
    sizes = vectors.centroids(e, "label").select("label", "size")
    return vectors.cohesion(e, "label").join(sizes, "label").select("label", "size", F.round("cohesion", 6).alias("cohesion"))


@_query()
def match_frame(spark, sf):
    """No person twice in a medium: a greedy choice in order; tests/test_vectors.py holds it against plain Python."""
    queries, library = _library(spark, sf)
    return clustering.match_frames(queries, library, clustering.MatchSettings(0.25, 0.02))


@_query()
def cluster_faces(spark, sf):
    """Labels spread in a fixed shuffled order, shoot by shoot; tests/test_vectors.py holds it against plain Python."""
    v = roles.vectors(spark, sf).withColumn("shoot_id", F.pmod(F.col("media_id"), F.lit(4)))
    return clustering.cluster_faces(v, clustering.ClusterSettings(edge=0.30))


# ---------------------------------------------------------------- frames and detections


@_query("""SELECT o_orderkey AS id, CASE WHEN d <= 0 THEN 1 ELSE CAST(ceil(d / 5.0) AS BIGINT) END AS n FROM (SELECT o_orderkey, floor(o_totalprice / 1000) AS d FROM orders)""")
def frame_plan_intervals(spark, sf):
    """Frames of videos without scene changes."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("d"))
    plan = frames.with_frame_plan(o.withColumn("cuts", F.array().cast("array<double>")), "d", "cuts", most=1000)
    return plan.select("id", F.size("frames").cast("long").alias("n"))


@_query()
def frame_plan(spark, sf):
    """Frames with scene changes and the cap: a fold; tests/test_scalars.py holds it against plain Python."""
    e = table(spark, sf, "events")
    scenes = e.groupBy("user_id").agg(F.sort_array(F.collect_set(F.round(F.col("value") * 3, 1))).alias("scenes"), (F.max("value") * 3 + 10).alias("duration"))
    plan = frames.with_frame_plan(scenes, "duration", "scenes", most=45)
    return plan.select("user_id", F.size("frames").alias("frames"), F.size(F.filter("frames", lambda f: f["scene"])).alias("cuts"), "truncated")


def _boxes(spark, sf):
    item = table(spark, sf, "lineitem")
    x, y = F.col("l_quantity") * 2, F.col("l_discount") * 400
    return item.select("l_orderkey", F.struct(x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 30).alias("y2"), (F.col("l_extendedprice") / 1e5).alias("score")).alias("box"))


@_query()
def nms(spark, sf):
    """Greedy suppression of overlapping boxes in each frame: a fold; tests/test_whole.py holds it against plain Python."""
    kept = frames.suppress(F.sort_array(F.collect_list("box")), 0.4)
    return _boxes(spark, sf).groupBy("l_orderkey").agg(kept.alias("kept")).select("l_orderkey", F.inline("kept"))


@_query("""SELECT l_orderkey, count(*) AS pairs, round(sum(iou), 6) AS total_iou FROM (SELECT a.l_orderkey, i / (1800 - i) AS iou FROM (
  SELECT a.l_orderkey, greatest(least(a.x, b.x) + 30 - greatest(a.x, b.x), 0) * greatest(least(a.y, b.y) + 30 - greatest(a.y, b.y), 0) AS i
  FROM (SELECT l_orderkey, l_partkey, l_quantity * 2 AS x, l_discount * 400 AS y FROM lineitem) a JOIN (SELECT l_orderkey, l_partkey, l_quantity * 2 AS x, l_discount * 400 AS y FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey) a) GROUP BY 1""")
def box_overlaps(spark, sf):
    b = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", geometry.rect(F.col("l_quantity") * 2, F.col("l_discount") * 400, F.col("l_quantity") * 2 + 30, F.col("l_discount") * 400 + 30).alias("r"))
    c = b.select("l_orderkey", F.col("l_partkey").alias("other"), F.col("r").alias("s"))
    pairs = b.join(c, "l_orderkey").where("l_partkey < other").withColumn("iou", geometry.iou(F.col("r"), F.col("s")))
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.round(F.sum("iou"), 6).alias("total_iou"))


@_query("""SELECT o_orderkey AS id, greatest(CAST(round(w * s) AS BIGINT), 1) AS width, greatest(CAST(round(h * s) AS BIGINT), 1) AS height FROM (SELECT *, least(640.0 / w, 640.0 / h) AS s FROM (SELECT o_orderkey, CAST(100 + o_custkey % 4000 AS DOUBLE) AS w, CAST(100 + o_orderkey % 3000 AS DOUBLE) AS h FROM orders))""")
def letterbox(spark, sf):
    o = table(spark, sf, "orders")
    box = geometry.letterbox((F.col("o_custkey") % 4000 + 100).cast("double"), (F.col("o_orderkey") % 3000 + 100).cast("double"), F.lit(640.0))
    return o.select(F.col("o_orderkey").alias("id"), box["width"].alias("width"), box["height"].alias("height"))


@_query("""SELECT p_partkey AS id, round(greatest(least(s, 1), 0) * 0.6 + greatest(least(a / 640000 / 0.05, 1), 0) * 0.4, 9) AS quality FROM (SELECT p_partkey, p_retailprice / 1500 AS s, CAST(p_size * p_size * 30 AS DOUBLE) AS a FROM part)""")
def detection_quality(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(geometry.detection_quality(F.col("p_retailprice") / 1500, (F.col("p_size") * F.col("p_size") * 30).cast("double"), F.lit(640000.0)), 9).alias("quality"))


@_query("""SELECT id, (x - d * stride) / 0.5 AS x1, (y - d * stride) / 0.5 AS y1, (x + d * stride) / 0.5 AS x2, (y + d * stride) / 0.5 AS y2 FROM (SELECT id, d, stride, (cell % grid) * stride AS x, floor(cell / grid) * stride AS y FROM (
  SELECT event_id AS id, CAST(event_id % 4 AS DOUBLE) AS d, CAST(8 * (1 << CAST(event_id % 3 AS INTEGER)) AS DOUBLE) AS stride, floor((event_id % 700) / 2) AS cell, floor(640 / (8 * (1 << CAST(event_id % 3 AS INTEGER)))) AS grid FROM events))""")
def scrfd_decode(spark, sf):
    e = table(spark, sf, "events")
    d = (F.col("event_id") % 4).cast("double")
    box = frames.anchor_box(F.col("event_id") % 700, F.col("event_id") % 3, F.lit(640.0), F.array(d, d, d, d), F.lit(0.5))
    return e.select(F.col("event_id").alias("id"), *[box[c].alias(c) for c in ("x1", "y1", "x2", "y2")])


# ---------------------------------------------------------------- scalars and export


@_query(r"""SELECT page_id, CASE WHEN t = '' THEN 'Unnamed' ELSE t END AS name FROM (SELECT page_id, rtrim(substr(rtrim(trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '. '), 1, 80)) AS t FROM pages)""")
def sanitise_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.safe_component(F.col("url")).alias("name"))


@_query("""SELECT p_partkey AS id, CASE WHEN n = 1 THEN p_name || '.jpg' ELSE p_name || ' (' || n || ').jpg' END AS target FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS n FROM part)""")
def dedup_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.concat("p_name", F.lit(".jpg")).alias("filename"))
    return export.deduplicated(p, ["p_brand"], ["id"]).select("id", "target")


@_query(f"""SELECT folder, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, count(DISTINCT lower(relative_path)) AS paths FROM (
  SELECT p.name AS folder, m.file_size, p.name || '/' || CASE WHEN media_type = 'video' THEN 'Videos' ELSE 'Photos' END || '/' || filename AS relative_path FROM seen s JOIN people p ON p.id = s.person_id JOIN media m ON m.id = s.media_id WHERE s.shoot_id = 1996
  UNION ALL SELECT 'Unidentified', m.file_size, filename FROM (SELECT DISTINCT media_id FROM faces WHERE shoot_id = 1996 AND person_id IS NULL AND assignment <> 'ignored') u JOIN media m ON m.id = u.media_id) GROUP BY 1""")
def export_plan(spark, sf):
    s = state(spark, sf, "faces", "people", "media")
    rows = albums.player_albums(s).unionByName(albums.unidentified_albums(s)).where("shoot_id = 1996")
    media = s["media"].select(F.col("id").alias("media_id"), F.col("path").alias("source"), "filename", "media_type", "file_size", "captured_at")
    groups = rows.withColumn("group", F.concat("album_type", F.lit(":"), F.col("sort_order").cast("string"))).select("group", "name", "media_id").join(media, "media_id")
    plan = export.export_plan(groups, export.ExportOptions())
    return plan.groupBy("folder").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.count_distinct(F.lower("relative_path")).alias("paths"))


@_query("SELECT id, CASE WHEN id % 8 = 0 THEN 'video' ELSE 'photo' END AS kind, CASE WHEN id % 8 = 0 THEN 'ffmpeg' ELSE 'native' END AS decoder FROM media")
def format_classify(spark, sf):
    return state(spark, sf, "media")["media"].select("id", scalars.media_kind(F.col("path")).alias("kind"), scalars.decoder(F.col("path")).alias("decoder"))


@_query("SELECT id, substr(sha256(path || '|' || file_size || '|' || id), 1, 32) AS key FROM media")
def content_key(spark, sf):
    return state(spark, sf, "media")["media"].select("id", scalars.content_key(F.col("path"), F.col("file_size"), F.col("id")).alias("key"))


@_query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') END AS t FROM events""")
def timestamp_normalise(spark, sf):
    ts, k = F.col("ts"), F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise("nonsense")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), scalars.normal_timestamp(raw).alias("t"))


@_query("""SELECT event_id AS id, CASE ((d % 360) + 360) % 360 WHEN 90 THEN 6 WHEN 180 THEN 3 WHEN 270 THEN 8 ELSE 1 END AS orientation FROM (SELECT event_id, CAST(event_id % 9 - 4 AS INTEGER) * 90 AS d FROM events)""")
def orientation(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), scalars.rotation_orientation(((F.col("event_id") % 9 - 4) * 90).cast("int")).alias("orientation"))


@_query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey AS DOUBLE) / (p_size % 5) END AS rate FROM part")
def rational(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), scalars.rational(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), (F.col("p_size") % 5).cast("string"))).alias("rate"))


@_query("""SELECT event_id AS id, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS label FROM (SELECT event_id, CAST(3600 + event_id * 7 AS BIGINT) AS s FROM events)""")
def time_labels(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), scalars.time_label((F.col("event_id") * 7 + 3600).cast("double")).alias("label"))


@_query("""SELECT id, CASE WHEN t = 0 THEN NULL WHEN a >= t THEN NULL ELSE a END AS first, CASE WHEN t = 0 OR a >= t THEN NULL ELSE least(a + 99, t - 1) END AS last FROM (SELECT event_id AS id, event_id % 1000 AS a, event_id % 777 AS t FROM events)""")
def byte_ranges(spark, sf):
    e = table(spark, sf, "events")
    a, t = F.col("event_id") % 1000, F.col("event_id") % 777
    r = scalars.byte_range(F.concat(F.lit("bytes="), a.cast("string"), F.lit("-"), (a + 99).cast("string")), t)
    return e.select(F.col("event_id").alias("id"), r["first"].alias("first"), r["last"].alias("last"))


@_query("""SELECT round(side, 9) AS side, round(least(greatest(x + w / 2 - side / 2, 0), 1 - side), 9) AS "left", id FROM (SELECT l_orderkey * 100 + l_linenumber AS id, l_discount * 8 AS x, l_tax AS w, least(greatest(l_tax, l_discount) * 1.7, 1.0) AS side FROM lineitem)""")
def crop_views(spark, sf):
    item = table(spark, sf, "lineitem")
    v = geometry.crop_view(F.col("l_discount") * 8, F.lit(0.1), F.col("l_tax"), F.col("l_discount"))
    return item.select(F.round(v["side"], 9).alias("side"), F.round(v["left"], 9).alias("left"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))


