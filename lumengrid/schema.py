"""Tables of the media index: columns, defaults, closed sets of values, and what deletes do.

A state is a dict of table name to DataFrame. Operators that change data take a state and
return a new one; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

State = dict[str, DataFrame]

#: DDL of each table, in the order of its columns.
TABLES = {
    "shoots": "id long, name string, source_path string, status string, notes string, created_at string, updated_at string",
    "people": "id long, name string, team string, notes string, cover_face_id long, created_at string, updated_at string",
    "media": "id long, shoot_id long, path string, filename string, media_type string, extension string, width long, height long, duration double, file_size long, content_key string, captured_at string, indexed_at string, camera_make string, camera_model string, lens string, iso long, focal_length double, aperture double, shutter string, orientation long, thumbnail_path string, processing_status string, face_count long, error string",
    "clusters": "id long, shoot_id long, label string, person_id long, status string, face_count long, cover_face_id long, created_at string",
    "faces": "id long, media_id long, shoot_id long, person_id long, cluster_id long, embedding array<float>, embedding_dim long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, landmarks array<float>, detection_confidence double, recognition_confidence double, assignment string, quality double, frame_time double, crop_path string, created_at string",
    "video_detections": "id long, media_id long, person_id long, face_id long, timestamp double, end_timestamp double, confidence double",
    "albums": "id long, shoot_id long, name string, album_type string, person_ids array<bigint>, cluster_id long, cover_media_id long, media_count long, photo_count long, video_count long, sort_order long, generated_at string",
    "album_media": "album_id long, media_id long",
    "jobs": "id long, shoot_id long, media_id long, kind string, state string, priority long, attempts long, payload string, error string, created_at string, started_at string, finished_at string",
    "exports": "id long, shoot_id long, destination string, options string, status string, files_total long, files_done long, bytes_done long, error string, started_at string, finished_at string",
    "settings": "key string, value string",
    "app_log": "id long, timestamp string, event string, shoot_id long, media_id long, person_id long, detail string",
}

#: Values a new row gets where none is given.
DEFAULTS = {
    "shoots": {"status": "created"},
    "media": {"orientation": 1, "processing_status": "pending", "face_count": 0, "file_size": 0},
    "clusters": {"status": "unnamed", "face_count": 0},
    "faces": {"assignment": "unassigned"},
    "albums": {"sort_order": 0, "media_count": 0, "photo_count": 0, "video_count": 0},
    "jobs": {"state": "queued", "priority": 100, "attempts": 0},
    "exports": {"status": "queued", "files_total": 0, "files_done": 0, "bytes_done": 0},
}

# The closed sets of text that columns hold.
SHOOT_STATUS = ("created", "scanning", "scanned", "processing", "paused", "completed", "failed")
MEDIA_TYPE = ("photo", "video")
PROCESSING_STATUS = ("pending", "indexed", "thumbnailed", "analysing", "analysed", "failed", "skipped")
ASSIGNMENT = ("unassigned", "suggested", "confirmed", "rejected", "ignored")
CLUSTER_STATUS = ("unnamed", "named", "ignored")
ALBUM_TYPE = ("player", "multiPlayer", "unidentified", "team")
JOB_KIND = ("scan", "thumbnail", "analysePhoto", "analyseVideo", "recognise", "cluster", "albums")
JOB_STATE = ("queued", "running", "done", "failed", "cancelled")
EXPORT_STATUS = ("queued", "running", "completed", "failed", "cancelled")

#: Assignments with which a person counts as appearing in a medium.
PRESENT = ("suggested", "confirmed")
#: Assignments that keep a face out of the pool of unknown faces.
SETTLED = ("ignored", "rejected")

#: (child, column, parent, action) of every reference between tables.
REFERENCES = (
    ("media", "shoot_id", "shoots", "cascade"),
    ("clusters", "shoot_id", "shoots", "cascade"),
    ("clusters", "person_id", "people", "null"),
    ("faces", "media_id", "media", "cascade"),
    ("faces", "shoot_id", "shoots", "cascade"),
    ("faces", "person_id", "people", "null"),
    ("faces", "cluster_id", "clusters", "null"),
    ("video_detections", "media_id", "media", "cascade"),
    ("video_detections", "person_id", "people", "cascade"),
    ("video_detections", "face_id", "faces", "cascade"),
    ("albums", "shoot_id", "shoots", "cascade"),
    ("albums", "cluster_id", "clusters", "cascade"),
    ("albums", "cover_media_id", "media", "null"),
    ("album_media", "album_id", "albums", "cascade"),
    ("album_media", "media_id", "media", "cascade"),
    ("jobs", "shoot_id", "shoots", "cascade"),
    ("jobs", "media_id", "media", "cascade"),
    ("exports", "shoot_id", "shoots", "cascade"),
)


def empty_state(spark: SparkSession) -> State:
    return {name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the table's columns and types in order: missing ones get their default or null, others go."""
    out = []
    for field in _schema(df.sparkSession, table):
        default = DEFAULTS.get(table, {}).get(field.name)
        value = F.col(field.name) if field.name in df.columns else F.lit(default)
        if field.name in df.columns and default is not None:
            value = F.coalesce(value, F.lit(default))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def _schema(spark: SparkSession, table: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TABLES[table]).fields


def checked(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose ``column`` is one of the values of a closed set."""
    return df.where(F.col(column).isin(*allowed))
