"""Reading the index: the media grid, the review queue, lookups and short lists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import matches_search, nocase, trimmed
from ..schema import PRESENT, State


@dataclass(frozen=True)
class MediaQuery:
    shoot_id: int | None = None
    album_id: int | None = None
    person_id: int | None = None
    cluster_id: int | None = None
    only_unidentified: bool = False
    media_type: str | None = None
    search: str | None = None
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class FaceQuery:
    shoot_id: int | None = None
    person_id: int | None = None
    cluster_id: int | None = None
    assignment: str | None = None
    min_confidence: float | None = None
    max_confidence: float | None = None
    limit: int | None = None
    offset: int | None = None


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else value))


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def by_id(state: State, table: str, id_: int) -> DataFrame:
    """The row with this id, or none."""
    return state[table].where(F.col("id") == id_).limit(1)


def shoot_list(state: State) -> DataFrame:
    return state["shoots"].orderBy(F.desc("created_at"), F.desc("id"))


def people_list(state: State) -> DataFrame:
    return state["people"].orderBy(nocase(F.col("name")), "id")


def find_person(state: State, name: str) -> DataFrame:
    """The person of this name, blanks around it and the case of A-Z aside."""
    return state["people"].where(nocase(F.col("name")) == nocase(trimmed(F.lit(name)))).limit(1)


def media_grid(state: State, q: MediaQuery) -> DataFrame:
    """Media that meet all that is asked, by time (unknown last), name and id.

    Albums and faces are semi-joined, only where asked for, so no duplicates arise. One and
    the same face has to meet person, cluster and unidentified.
    """
    media = state["media"]
    plain = [F.col(c) == v for c, v in (("shoot_id", q.shoot_id), ("media_type", q.media_type)) if v is not None]
    found = matches_search(F.col("filename"), q.search)
    out = media.where(_all(plain + ([found] if found is not None else [])))
    if q.album_id is not None:
        out = out.join(state["album_media"].where(F.col("album_id") == q.album_id).select(F.col("media_id").alias("id")), "id", "left_semi")
    asked: list[Column] = []
    if q.person_id is not None:
        asked += [F.col("person_id") == q.person_id, F.col("assignment").isin(*PRESENT)]
    if q.cluster_id is not None:
        asked.append(F.col("cluster_id") == q.cluster_id)
    if q.only_unidentified:
        asked += [F.col("person_id").isNull(), F.col("assignment") != "ignored"]
    if asked:
        out = out.join(state["faces"].where(_all(asked)).select(F.col("media_id").alias("id")), "id", "left_semi")
    ordered = out.orderBy(F.asc_nulls_last("captured_at"), "filename", "id")
    return ordered.offset(max(0, q.offset or 0)).limit(clamp(q.limit, 500, 1, 5000))


def face_queue(state: State, q: FaceQuery) -> DataFrame:
    """Faces for review with the names of their medium, person and cluster, least sure first.
    A face without confidence counts as 0."""
    sure = F.coalesce("recognition_confidence", F.lit(0.0))
    asked = [F.col(c) == v for c, v in (("shoot_id", q.shoot_id), ("person_id", q.person_id), ("cluster_id", q.cluster_id), ("assignment", q.assignment)) if v is not None]
    if q.min_confidence is not None:
        asked.append(sure >= q.min_confidence)
    if q.max_confidence is not None:
        asked.append(sure <= q.max_confidence)
    first = state["faces"].where(_all(asked)).drop("embedding", "landmarks")
    media = state["media"].select(F.col("id").alias("media_id"), F.col("filename").alias("media_filename"), "media_type")
    people = state["people"].select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    clusters = state["clusters"].select(F.col("id").alias("cluster_id"), F.col("label").alias("cluster_label"))
    # a medium is never missing from its faces: the page is cut before the names are joined
    page = first.join(media.select("media_id"), "media_id", "left_semi").orderBy(sure, "id").offset(max(0, q.offset or 0)).limit(clamp(q.limit, 300, 1, 5000))
    return page.join(media, "media_id").join(people, "person_id", "left").join(clusters, "cluster_id", "left").orderBy(sure, "id")


def pending_media(state: State, shoot_id: int, limit: int) -> DataFrame:
    """Media still to be analysed, by id."""
    return state["media"].where((F.col("shoot_id") == shoot_id) & F.col("processing_status").isin("pending", "indexed", "thumbnailed")).orderBy("id").limit(limit)


def media_count(state: State, shoot_id: int) -> DataFrame:
    return state["media"].where(F.col("shoot_id") == shoot_id).agg(F.count("*").alias("n"))


def face_count(state: State, media_id: int) -> DataFrame:
    return state["faces"].where((F.col("media_id") == media_id) & (F.col("assignment") != "ignored")).agg(F.count("*").alias("n"))


def pending_jobs(state: State, shoot_id: int | None = None) -> DataFrame:
    own = [F.col("shoot_id") == shoot_id] if shoot_id is not None else []
    return state["jobs"].where(_all([F.col("state").isin("queued", "running"), *own])).agg(F.count("*").alias("n"))


def faces_of_media(state: State, media_id: int) -> DataFrame:
    return state["faces"].where(F.col("media_id") == media_id).orderBy("bbox_x", "id")


def detections_of_media(state: State, media_id: int) -> DataFrame:
    return state["video_detections"].where(F.col("media_id") == media_id).orderBy(F.asc_nulls_first("person_id"), "timestamp", "id")


def failed_jobs(state: State, shoot_id: int, limit: int = 200) -> DataFrame:
    rows = state["jobs"].where((F.col("shoot_id") == shoot_id) & (F.col("state") == "failed"))
    return rows.orderBy(F.desc_nulls_last("finished_at"), F.desc("id")).limit(limit)


def export_history(state: State, shoot_id: int, limit: int | None = None) -> DataFrame:
    return state["exports"].where(F.col("shoot_id") == shoot_id).orderBy(F.desc("id")).limit(clamp(limit, 20, 1, 200))


def recent_log(state: State, limit: int | None = None, shoot_id: int | None = None) -> DataFrame:
    own = [F.col("shoot_id") == shoot_id] if shoot_id is not None else []
    return state["app_log"].where(_all(own)).orderBy(F.desc("id")).limit(clamp(limit, 200, 1, 2000))


def analysis_outstanding(state: State, shoot_id: int) -> DataFrame:
    """Whether work on single files is still queued or running, which holds back the stages after it."""
    kinds = ("scan", "thumbnail", "analysePhoto", "analyseVideo")
    rows = state["jobs"].where((F.col("shoot_id") == shoot_id) & F.col("kind").isin(*kinds) & F.col("state").isin("queued", "running"))
    return rows.agg((F.count("*") > 0).alias("outstanding"))


def active_shoots(state: State) -> DataFrame:
    return state["jobs"].where(F.col("state").isin("queued", "running")).select("shoot_id").distinct()


def visible_confidence(faces: DataFrame) -> DataFrame:
    return faces.agg(F.min("recognition_confidence").alias("low"), F.max("recognition_confidence").alias("high"))


def content_keys(state: State, shoot_id: int) -> DataFrame:
    return state["media"].where(F.col("shoot_id") == shoot_id).select("path", "content_key")


def library_vectors(state: State) -> DataFrame:
    """Confirmed faces with a vector, of all shoots."""
    return _vectors(state["faces"].where(F.col("person_id").isNotNull() & (F.col("assignment") == "confirmed") & F.col("embedding").isNotNull()))


def unknown_vectors(state: State, shoot_id: int) -> DataFrame:
    """The shoot's faces with a vector that nobody has named or set aside."""
    open_ = F.col("person_id").isNull() & ~F.col("assignment").isin("ignored", "rejected")
    return _vectors(state["faces"].where((F.col("shoot_id") == shoot_id) & open_ & F.col("embedding").isNotNull()))


def media_vectors(state: State, media_id: int) -> DataFrame:
    return _vectors(state["faces"].where((F.col("media_id") == media_id) & F.col("embedding").isNotNull()))


def _vectors(faces: DataFrame) -> DataFrame:
    return faces.select(F.col("id").alias("face_id"), "media_id", "person_id", "embedding", F.coalesce("quality", F.lit(0.0)).alias("quality"))
