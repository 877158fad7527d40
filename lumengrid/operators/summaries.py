"""Counts by shoot, person, cluster and album, and the progress of processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nocase
from ..schema import PRESENT, State
from ..scratch import written


def _zero(*columns: str) -> dict[str, Column]:
    return {c: F.coalesce(c, F.lit(0).cast("long")) for c in columns}


def shoot_summaries(state: State, shoot_id: int | None = None) -> DataFrame:
    """Every shoot with its counts; zeros are kept. Each child is counted once and joined."""
    own = (lambda df: df) if shoot_id is None else (lambda df: df.where(F.col("shoot_id") == shoot_id))
    shoots = state["shoots"] if shoot_id is None else state["shoots"].where(F.col("id") == shoot_id)
    media = own(state["media"]).groupBy("shoot_id").agg(F.count_if(F.col("media_type") == "photo").alias("photo_count"), F.count_if(F.col("media_type") == "video").alias("video_count"))
    faces = own(state["faces"]).groupBy("shoot_id").agg(F.count("*").alias("face_count"), F.count_distinct(F.when(F.col("assignment").isin(*PRESENT), F.col("person_id"))).alias("person_count"))
    clusters = own(state["clusters"]).groupBy("shoot_id").agg(F.count_if(F.col("status") == "unnamed").alias("unknown_cluster_count"))
    jobs = own(state["jobs"]).groupBy("shoot_id").agg(F.count_if(F.col("state").isin("queued", "running")).alias("pending_jobs"), F.count_if(F.col("state") == "failed").alias("failed_jobs"))
    out = shoots.withColumnRenamed("id", "shoot_id")
    for child in (media, faces, clusters, jobs):
        out = out.join(child, "shoot_id", "left")
    counted = out.withColumns(_zero("photo_count", "video_count", "face_count", "person_count", "unknown_cluster_count", "pending_jobs", "failed_jobs"))
    return counted.withColumnRenamed("shoot_id", "id").orderBy(F.desc("created_at"), F.desc("id"))


def person_summaries(state: State, shoot_id: int | None = None) -> DataFrame:
    """Every person with samples, media and shoots. A shoot limits samples and media, not shoots."""
    here = F.lit(True) if shoot_id is None else F.col("shoot_id") == shoot_id
    present = F.col("assignment").isin(*PRESENT)
    counts = state["faces"].where(F.col("person_id").isNotNull()).groupBy("person_id").agg(
        F.count_if((F.col("assignment") == "confirmed") & F.col("embedding").isNotNull() & here).alias("face_sample_count"),
        F.count_distinct(F.when(present & here, F.col("media_id"))).alias("media_count"),
        F.count_distinct(F.when(present, F.col("shoot_id"))).alias("shoot_count"),
    )
    out = state["people"].withColumnRenamed("id", "person_id").join(counts, "person_id", "left").withColumns(_zero("face_sample_count", "media_count", "shoot_count"))
    return out.withColumnRenamed("person_id", "id").orderBy(F.desc("media_count"), nocase(F.col("name")), "id")


def cluster_summaries(state: State, shoot_id: int, include_named: bool = False) -> DataFrame:
    """Clusters of a shoot, largest first, with the name of their person and their cover's medium.
    Unnamed ones only, unless ``include_named``, which shows ignored ones too."""
    clusters = state["clusters"].where(F.col("shoot_id") == shoot_id)
    if not include_named:
        clusters = clusters.where(F.col("status") == "unnamed")
    # written, so that the few clusters of a shoot are known to be few when they meet faces and media
    clusters = written(clusters, "shoot-clusters")
    media = state["faces"].where((F.col("shoot_id") == shoot_id) & F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count_distinct("media_id").alias("media_count"))
    people = state["people"].select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    covers = state["faces"].where(F.col("shoot_id") == shoot_id).select(F.col("id").alias("cover_face_id"), F.col("media_id").alias("cover_media_id"))
    covers = written(covers.join(clusters.select("cover_face_id"), "cover_face_id", "left_semi"), "cluster-covers")
    thumbs = state["media"].select(F.col("id").alias("cover_media_id"), F.col("thumbnail_path").alias("cover_thumbnail")).join(covers.select("cover_media_id"), "cover_media_id", "left_semi")
    out = clusters.join(media, clusters.id == media.cluster_id, "left").drop("cluster_id").join(people, "person_id", "left").join(covers, "cover_face_id", "left").join(thumbs, "cover_media_id", "left")
    return out.withColumns(_zero("media_count")).orderBy(F.desc("face_count"), "id")


def progress(state: State) -> DataFrame:
    """How far each shoot is: counts, percent of media and the stage it is in."""
    s = F.col("processing_status")
    media = state["media"].groupBy("shoot_id").agg(
        F.count("*").alias("media_total"), F.count_if(s != "pending").alias("media_scanned"), F.count_if(s == "analysed").alias("media_analysed"), F.count_if(s == "failed").alias("media_failed"),
    )
    known = F.col("person_id").isNotNull()
    faces = state["faces"].groupBy("shoot_id").agg(
        F.count("*").alias("faces_detected"), F.count_if(known).alias("faces_recognised"), F.count_if(~known & (F.col("assignment") != "ignored")).alias("faces_unknown"),
    )
    j = F.col("state")
    jobs = state["jobs"].groupBy("shoot_id").agg(F.count_if(j == "queued").alias("jobs_queued"), F.count_if(j == "running").alias("jobs_running"), F.count_if(j == "failed").alias("jobs_failed"))
    counts = ("media_total", "media_scanned", "media_analysed", "media_failed", "faces_detected", "faces_recognised", "faces_unknown", "jobs_queued", "jobs_running", "jobs_failed")
    out = state["shoots"].select(F.col("id").alias("shoot_id"))
    for child in (media, faces, jobs):
        out = out.join(child, "shoot_id", "left")
    out = out.withColumns(_zero(*counts))
    percent = F.when(F.col("media_total") > 0, (F.col("media_analysed") + F.col("media_failed")) / F.col("media_total") * 100.0).otherwise(0.0)
    busy = F.col("jobs_queued") + F.col("jobs_running") > 0
    stage = (
        F.when(~busy & (F.col("media_total") == 0), "idle").when(~busy, "complete").when(F.col("media_scanned") < F.col("media_total"), "scanning")
        .when(F.col("media_analysed") < F.col("media_total"), "analysing").otherwise("finishing")
    )
    return out.select("shoot_id", *counts, percent.alias("percent"), stage.alias("stage"))


def finished_status(progress_rows: DataFrame) -> DataFrame:
    """completed, or failed where media failed and none was analysed."""
    return progress_rows.select("shoot_id", F.when((F.col("media_failed") > 0) & (F.col("media_analysed") == 0), "failed").otherwise("completed").alias("status"))


def cluster_covers(state: State) -> DataFrame:
    """(cluster_id, face_count, cover_face_id): the face of best quality, then detection, then least id."""
    rank = F.struct(F.coalesce("quality", F.lit(0.0)), F.col("detection_confidence"), -F.col("id"))
    return state["faces"].where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("face_count"), F.max_by("id", rank).alias("cover_face_id"))


def media_face_counts(state: State) -> DataFrame:
    """(media_id, face_count) of faces that aren't ignored."""
    return state["faces"].where(F.col("assignment") != "ignored").groupBy("media_id").agg(F.count("*").alias("face_count"))


def library_stats(state: State) -> DataFrame:
    rows = state["faces"].where(F.col("person_id").isNotNull() & (F.col("assignment") == "confirmed") & F.col("embedding").isNotNull())
    return rows.agg(F.count_distinct("person_id").alias("player_count"), F.count("*").alias("total_samples"))


def video_timelines(state: State, media_id: int | None = None, gap: float = 4.0) -> DataFrame:
    """Stretches in which a person is on screen: hits up to ``gap`` seconds apart are one stretch.

    A stretch keeps the first hit's id, face and start; its end is the last hit, null for a
    single one; its confidence the highest. Persons without a name are one row of stretches and
    come last.
    """
    hits = state["video_detections"] if media_id is None else state["video_detections"].where(F.col("media_id") == media_id)
    order = Window.partitionBy("media_id", "person_id").orderBy("timestamp", "id")
    apart = F.coalesce((F.col("timestamp") - F.lag("timestamp").over(order) > gap).cast("int"), F.lit(0))
    numbered = hits.withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(order))
    first = F.struct("timestamp", "id")
    out = numbered.groupBy("media_id", "person_id", "stretch").agg(
        F.min_by("id", first).alias("id"), F.min_by("face_id", first).alias("face_id"), F.min("timestamp").alias("start_time"),
        F.when(F.count("*") > 1, F.max("timestamp")).alias("end_time"), F.max("confidence").alias("confidence"),
    )
    people = state["people"].select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return out.drop("stretch").join(people, "person_id", "left").orderBy("media_id", F.col("person_id").isNull(), nocase(F.col("person_name")), "person_id", "start_time")
