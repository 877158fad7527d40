"""Streams, beyond what the batch operators need: new files, stretches on screen, jobs without repeats.

The batch operators answer each question on a whole state; these keep answers up to date as
rows arrive, with the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_key, media_kind


def watch_folder(spark: SparkSession, root: str) -> DataFrame:
    """Photos and videos as they arrive: (path, media_type, file_size, content_key, modified)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    kind = media_kind(F.col("path"))
    return files.where(kind.isNotNull()).select("path", kind.alias("media_type"), F.col("length").alias("file_size"), content_key(F.col("path"), F.col("length"), F.unix_timestamp("modificationTime")).alias("content_key"), F.col("modificationTime").alias("modified"))


def live_timelines(hits: DataFrame, gap: str = "4 seconds", late: str = "1 minute") -> DataFrame:
    """Stretches (media_id, person_id, start_time, end_time, hits, confidence) from hits with a time
    ``ts``: a session ends when nothing comes for longer than ``gap``; later rows than ``late`` are dropped."""
    out = hits.withWatermark("ts", late).groupBy("media_id", "person_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("hits"), F.max("confidence").alias("confidence"))
    return out.drop("w")


def new_jobs(requests: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Requests (shoot_id, kind, media_id, ts) without those repeated within a time."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(["shoot_id", "kind", "media_id"])


def live_progress(media: DataFrame) -> DataFrame:
    """Counts of media by shoot and status as their rows arrive; for complete or update mode."""
    return media.groupBy("shoot_id", "processing_status").agg(F.count("*").alias("n"))
