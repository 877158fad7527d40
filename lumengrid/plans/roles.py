"""The star schema in the roles of the media index, so that every operator can run on it.

``ROLES_SQL`` says the same as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import State


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _year(c: str):
    return F.year(c).cast("long")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    video = F.col("o_orderkey") % 8 == 0
    name = F.concat(F.lit("IMG_"), F.col("o_orderkey").cast("string"), F.when(video, ".mp4").otherwise(".JPG"))
    return o.select(
        F.col("o_orderkey").alias("id"), _year("o_orderdate").alias("shoot_id"), F.concat(F.lit("/shoots/"), _year("o_orderdate").cast("string"), F.lit("/"), name).alias("path"), name.alias("filename"),
        F.when(video, "video").otherwise("photo").alias("media_type"), F.floor("o_totalprice").cast("long").alias("file_size"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("content_key"),
        F.when(F.col("o_orderkey") % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("captured_at"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("/thumbs/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))).alias("thumbnail_path"),
        F.when(F.col("o_orderstatus") == "F", "analysed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("processing_status"), F.lit(0).cast("long").alias("face_count"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as faces. They have no key, so the id is a hash of all that tells them apart."""
    item = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], cents("l_extendedprice").cast("string"), cents("l_discount").cast("string"), cents("l_tax").cast("string"))
    flag = F.col("l_returnflag")
    none = flag == "N"
    assignment = F.when(flag == "A", "confirmed").when(flag == "R", "suggested").when(F.col("l_linestatus") == "O", "unassigned").otherwise("ignored")
    # worked out before the join, so that it shuffles an id and not all that the id is made of
    own = item.select(
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("id"), F.col("l_orderkey").alias("media_id"), F.when(~none, F.col("l_suppkey")).alias("person_id"),
        F.when(none, F.col("l_partkey") % 50).alias("_place"), assignment.alias("assignment"), F.col("l_discount").alias("quality"), (1 - F.col("l_tax")).alias("detection_confidence"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 50).alias("recognition_confidence"),
    )
    shoots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), _year("o_orderdate").alias("shoot_id"))
    return own.join(shoots, "media_id").select(
        "id", "media_id", "shoot_id", "person_id", (F.col("shoot_id") * 100 + F.col("_place")).alias("cluster_id"), "assignment", "quality", "detection_confidence",
        "recognition_confidence", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(None).cast("array<float>").alias("landmarks"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team"))
    return table(spark, sf_dir, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "team", F.lit(None).cast("long").alias("cover_face_id"), F.lit("").alias("updated_at"))


def shoots(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(_year("o_orderdate").alias("id")).distinct()
    return years.select("id", F.concat(F.lit("Shoot "), F.col("id").cast("string")).alias("name"), F.concat(F.col("id").cast("string"), F.lit("-01-01T00:00:00Z")).alias("created_at"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = faces(spark, sf_dir).where("cluster_id is not null").groupBy(F.col("cluster_id").alias("id"), "shoot_id").agg(F.count("*").alias("face_count"), F.min("id").alias("cover_face_id"))
    n = F.col("id") % 100
    return c.select("id", "shoot_id", F.concat(F.lit("Unknown Person "), n.cast("string")).alias("label"), F.when(n % 10 == 0, n + 1).alias("person_id"), F.when(n % 10 == 0, "named").when(n % 10 == 9, "ignored").otherwise("unnamed").alias("status"), "face_count", "cover_face_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise(F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("done"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "thumbnail").when(F.col("o_orderkey") % 8 == 0, "analyseVideo").otherwise("analysePhoto")
    return o.select(
        F.col("o_orderkey").alias("id"), _year("o_orderdate").alias("shoot_id"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey")).alias("media_id"), kind.alias("kind"), state.alias("state"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"), (F.col("o_orderkey") % 4).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("started_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits: a user is a person, of the suppliers' ids; the event type is the medium."""
    e = table(spark, sf_dir, "events")
    kinds = F.crc32(F.col("event_type").cast("binary")).cast("long")
    return e.select(F.col("event_id").alias("id"), kinds.alias("media_id"), F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("person_id"), F.col("event_id").alias("face_id"), F.unix_timestamp("ts").cast("double").alias("timestamp"), F.col("value").alias("confidence"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_type").alias("event"), _year("ts").alias("shoot_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, media_id, person_id, embedding): every fifth vector is a sample of the library."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).cast("long").alias("media_id"), F.when(F.col("vec_id") % 5 == 0, F.col("label").cast("long")).alias("person_id"), "embedding")


_ROLES = {"media": media, "faces": faces, "people": people, "shoots": shoots, "clusters": clusters, "jobs": jobs, "video_detections": detections, "app_log": log}


def state(spark: SparkSession, sf_dir: str, *tables: str) -> State:
    """The tables asked for; nothing is read before it is used."""
    return {t: _ROLES[t](spark, sf_dir) for t in tables or _ROLES}


ROLES_SQL = r"""
media AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS shoot_id, '/shoots/' || year(o_orderdate) || '/IMG_' || o_orderkey || CASE WHEN o_orderkey % 8 = 0 THEN '.mp4' ELSE '.JPG' END AS path,
         'IMG_' || o_orderkey || CASE WHEN o_orderkey % 8 = 0 THEN '.mp4' ELSE '.JPG' END AS filename, CASE WHEN o_orderkey % 8 = 0 THEN 'video' ELSE 'photo' END AS media_type,
         CAST(floor(o_totalprice) AS BIGINT) AS file_size, 'k' || o_orderkey AS content_key,
         CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS captured_at, CASE WHEN o_orderkey % 5 <> 0 THEN '/thumbs/' || o_orderkey || '.jpg' END AS thumbnail_path,
         CASE o_orderstatus WHEN 'F' THEN 'analysed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS processing_status, CAST(0 AS BIGINT) AS face_count
  FROM orders
), faces AS (
  SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT))), 1, 15) AS BIGINT) AS id,
         l_orderkey AS media_id, CAST(year(o_orderdate) AS BIGINT) AS shoot_id, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS person_id,
         CASE WHEN l_returnflag = 'N' THEN CAST(year(o_orderdate) AS BIGINT) * 100 + l_partkey % 50 END AS cluster_id,
         CASE WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'R' THEN 'suggested' WHEN l_linestatus = 'O' THEN 'unassigned' ELSE 'ignored' END AS assignment,
         l_discount AS quality, 1 - l_tax AS detection_confidence, CASE WHEN l_linenumber <> 7 THEN l_quantity / 50 END AS recognition_confidence
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), people AS (
  SELECT s_suppkey AS id, s_name AS name, n_name AS team FROM supplier JOIN nation ON n_nationkey = s_nationkey
), shoots AS (
  SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS id, 'Shoot ' || year(o_orderdate) AS name, year(o_orderdate) || '-01-01T00:00:00Z' AS created_at FROM orders
), clusters AS (
  SELECT cluster_id AS id, shoot_id, 'Unknown Person ' || (cluster_id % 100) AS label, CASE WHEN cluster_id % 10 = 0 THEN cluster_id % 100 + 1 END AS person_id,
         CASE WHEN cluster_id % 10 = 0 THEN 'named' WHEN cluster_id % 10 = 9 THEN 'ignored' ELSE 'unnamed' END AS status, count(*) AS face_count, min(id) AS cover_face_id
  FROM faces WHERE cluster_id IS NOT NULL GROUP BY cluster_id, shoot_id
), jobs AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS shoot_id, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey END AS media_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'thumbnail' WHEN o_orderkey % 8 = 0 THEN 'analyseVideo' ELSE 'analysePhoto' END AS kind,
         CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'done' END AS state,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, o_orderkey % 4 AS attempts, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS finished_at
  FROM orders
), detections AS (
  SELECT event_id AS id, event_type, CASE WHEN user_id % 9 <> 0 THEN user_id END AS person_id, event_id AS face_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, value AS confidence FROM events
), app_log AS (
  SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_type AS event, CAST(year(ts) AS BIGINT) AS shoot_id FROM events
), seen AS (
  SELECT DISTINCT shoot_id, media_id, person_id FROM faces WHERE person_id IS NOT NULL AND assignment IN ('suggested', 'confirmed')
), pairs AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY shared DESC, a_id, b_id) - 1 AS sort_order FROM (
      SELECT a.shoot_id, a.person_id AS a_id, b.person_id AS b_id, count(*) AS shared FROM seen a JOIN seen b ON a.media_id = b.media_id AND b.person_id > a.person_id GROUP BY ALL HAVING count(*) >= 2
    )) WHERE sort_order < 60
), vectors AS (
  SELECT vec_id AS id, CAST(floor(vec_id / 4) AS BIGINT) AS media_id, CASE WHEN vec_id % 5 = 0 THEN CAST(label AS BIGINT) END AS person_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), scores AS (
  SELECT q.id, l.person_id, max(greatest(-1, least(1, list_dot_product(q.v, l.v)))) AS similarity FROM vectors q JOIN vectors l ON q.person_id IS NULL AND l.person_id IS NOT NULL GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, person_id) AS rank FROM scores
)
"""
