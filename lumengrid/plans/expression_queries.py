"""Queries for column functions, settings, logs and exports, each over a whole table; registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import albums, changes, export, frames, grid, stages
from ..sources import files
from . import roles
from .queries import _query
from .roles import state, table

NOW = "2026-01-01T00:00:00Z"
_ALBUMS = "id long, shoot_id long, name string, album_type string, person_ids array<bigint>, cluster_id long, cover_media_id long, media_count long, photo_count long, video_count long, sort_order long, generated_at string"


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)


# ---------------------------------------------------------------- files


_FOLDERS = ("DCIM", ".Git", "node_modules", "__MACOSX", "trash", ".Thumbnails", "nodes")
_PATH_SQL = "'/shoots/' || ['DCIM', '.Git', 'node_modules', '__MACOSX', 'trash', '.Thumbnails', 'nodes'][o_orderkey % 7 + 1] || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/a/IMG.jpg' END"


@_query(f"SELECT o_orderkey AS id, list_has_any(string_split(lower({_PATH_SQL}), '/')[:-2], ['.git', 'node_modules', '__macosx', '.trash', '.thumbnails']) AS ignored FROM orders")
def ignored_folders(spark, sf):
    """Paths through folders that are never entered; a file of such a name is none."""
    o = _orders(spark, sf)
    path = F.concat(F.lit("/shoots/"), _pick(_FOLDERS, F.col("id")), F.when(F.col("id") % 5 == 0, "").otherwise("/a/IMG.jpg"))
    return o.select("id", scalars.in_ignored_folder(path).alias("ignored"))


@_query("SELECT CAST(count(*) FILTER (k IN (0, 1, 2)) AS BIGINT) AS photos, CAST(count(*) FILTER (k IN (3, 4)) AS BIGINT) AS videos, CAST(count(*) FILTER (k > 4) AS BIGINT) AS skipped FROM (SELECT o_orderkey % 8 AS k FROM orders)")
def scan_counts(spark, sf):
    """What a scan found, by kind."""
    path = F.concat(F.lit("/s/"), F.col("id").cast("string"), _pick((".JPG", ".cr2", ".x.heic", ".MP4", ".m2ts", ".txt", "", ".jpg.bak"), F.col("id")))
    return files.scan_report(_orders(spark, sf).select(path.alias("path")))


@_query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS modified_at FROM events")
def file_times(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), scalars.rfc3339(F.col("ts")).alias("modified_at"))


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'original' WHEN o_orderkey % 3 = 0 THEN 'digitised' WHEN o_orderkey % 5 = 0 THEN 'modified' WHEN o_orderkey % 7 = 0 THEN 'container' ELSE 'file' END || o_orderkey AS captured_at FROM orders")
def capture_times(spark, sf):
    """The first of five times that a file has."""
    o = _orders(spark, sf)
    time = lambda name, n: F.when(F.col("id") % n == 0, F.concat(F.lit(name), F.col("id").cast("string")))
    return o.select("id", scalars.capture_time(time("original", 2), time("digitised", 3), time("modified", 5), time("container", 7), time("file", 1)).alias("captured_at"))


@_query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 999.0 ELSE o_orderkey / 8 END AS duration, o_orderkey % 4000 AS width, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2000 END AS height,
    CAST(CASE WHEN o_orderkey % 2 = 0 THEN -90 ELSE 180 END AS BIGINT) AS rotation, CASE WHEN o_orderkey % 4 = 0 THEN '2020-01-01T00:00:00Z' END AS creation_time FROM orders""")
def video_probes(spark, sf):
    """A probe's key=value lines: the first duration, of all else the last, no empty and no N/A values."""
    k = F.col("id")
    text = F.concat_ws(
        "\n", F.lit("width=640"), F.concat(F.lit("duration="), F.when(k % 3 == 0, "N/A").otherwise((k / 8).cast("string"))), F.concat(F.lit("width="), (k % 4000).cast("string")), F.lit("duration=999\r"),
        F.concat(F.lit("height="), F.when(k % 5 != 0, (k % 2000).cast("string")).otherwise("")), F.lit("rotation=180"), F.when(k % 2 == 0, F.lit("TAG:rotate=-90")), F.when(k % 4 == 0, F.lit("TAG:creation_time=2020-01-01T00:00:00Z")), F.lit("no pair"),
    )
    return _orders(spark, sf).select("id", frames.video_info(text).alias("v")).select("id", "v.duration", "v.width", "v.height", "v.rotation", "v.creation_time")


@_query("""SELECT user_id, unnest(range(0, len(kept))) AS place, unnest(kept) AS "at" FROM (SELECT user_id, list_reduce(list_transform(list_sort(list(value / 50) FILTER (value IS NOT NULL)), lambda x: [x]), lambda kept, x: CASE WHEN x[1] - kept[-1] >= 0.05 THEN list_append(kept, x[1]) ELSE kept END) AS kept FROM events GROUP BY user_id)""")
def scene_changes(spark, sf):
    """A scene filter's log lines, a log for each user: times in order, none within 0.05 s of the one kept before it."""
    line = F.concat(F.lit("[f] n:1 pts_time:"), (F.col("value") / 50).cast("string"), F.lit(" pos:3"))
    logs = table(spark, sf, "events").groupBy("user_id").agg(F.concat_ws("\n", F.collect_list(line)).alias("log"))
    return logs.select("user_id", F.posexplode(frames.scene_times(F.col("log"))).alias("place", "at")).select("user_id", F.col("place").cast("long").alias("place"), "at")


_EXIF_SQL = "['plain', '  \"' || p_name || '\" ', '\"\"' || p_name, '\" \"', '  ', NULL][p_partkey % 6 + 1]"


@_query(f"SELECT p_partkey AS id, nullif(trim(trim(trim({_EXIF_SQL}), '\"')), '') AS camera FROM part")
def exif_texts(spark, sf):
    """Text of EXIF tags without blanks and quotation marks around it."""
    name = F.col("p_name")
    raw = F.array(F.lit("plain"), F.concat(F.lit('  "'), name, F.lit('" ')), F.concat(F.lit('""'), name), F.lit('" "'), F.lit("  "), F.lit(None).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.clean_exif(F.element_at(raw, (F.col("p_partkey") % 6).cast("int") + 1)).alias("camera"))


@_query("SELECT vec_id AS id, 4 * len(embedding) AS bytes, unnest(range(0, len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def vector_blobs(spark, sf):
    """Vectors as blobs of little-endian floats, and what is read back from them."""
    packed = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), scalars.float_blob(F.col("embedding")).alias("blob"))
    rows = packed.select("id", F.octet_length("blob").cast("long").alias("bytes"), F.posexplode(scalars.blob_floats(F.col("blob"))).alias("place", "value"))
    return rows.select("id", "bytes", F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value"))


@_query("SELECT o_orderkey AS id, CASE WHEN d > 0 THEN greatest(0, least(d * 0.1, d - 0.1)) ELSE 0 END AS poster, CASE WHEN greatest(w, h) <= 512 THEN w ELSE greatest(w * 512 // greatest(w, h), 1) END AS width, CASE WHEN greatest(w, h) <= 512 THEN h ELSE greatest(h * 512 // greatest(w, h), 1) END AS height FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 40) / 16 END AS d, o_orderkey % 5000 + 1 AS w, o_orderkey * 7 % 3000 + 1 AS h FROM orders)")
def thumbnail_targets(spark, sf):
    """The time of a video's poster and the size of a thumbnail."""
    k = F.col("id")
    size = scalars.thumbnail_size(k % 5000 + 1, k * 7 % 3000 + 1)
    return _orders(spark, sf).select("id", scalars.poster_time(F.when(k % 9 != 0, (k % 40) / 16)).alias("poster"), size["width"].alias("width"), size["height"].alias("height"))


@_query("SELECT o_orderkey AS id, ['video/mp4', 'video/mp4', 'video/quicktime', 'video/webm', 'video/x-matroska', 'video/x-msvideo', 'application/octet-stream', 'application/octet-stream'][o_orderkey % 8 + 1] AS mime FROM orders")
def video_types(spark, sf):
    return _orders(spark, sf).select("id", scalars.video_mime(_pick(("mp4", "M4V", "mov", "WebM", "mkv", "avi", "wmv", ""), F.col("id"))).alias("mime"))


_MODELS_SQL = """models AS (SELECT name, CASE WHEN contains(lower(name), 'scrfd') OR contains(lower(name), 'det_') THEN 'detector' WHEN contains(lower(name), 'w600k') OR contains(lower(name), 'arcface') THEN 'embedder' ELSE 'unknown' END AS role, p_size AS size
  FROM (SELECT ['scrfd_', 'W600K_', 'Det_arcface_', 'buffalo_', 'arcface_'][p_partkey % 5 + 1] || p_partkey || ['.onnx', '.ONNX', '.txt'][p_partkey % 3 + 1] AS name, p_size FROM part) WHERE name NOT LIKE '%.txt')"""


@_query(f", {_MODELS_SQL} SELECT name, role, CAST(size AS BIGINT) AS size_bytes, role || CASE WHEN name = (SELECT max(name) FROM models WHERE role = 'detector' AND size = (SELECT max(size) FROM models WHERE role = 'detector')) THEN ', chosen' WHEN lower(name) = 'arcface_4.onnx' THEN ', chosen' ELSE '' END AS state FROM models")
def model_choices(spark, sf):
    """Model files by the role that their names tell; the largest detector and a named embedder are chosen."""
    p = table(spark, sf, "part")
    name = F.concat(_pick(("scrfd_", "W600K_", "Det_arcface_", "buffalo_", "arcface_"), F.col("p_partkey")), F.col("p_partkey").cast("string"), _pick((".onnx", ".ONNX", ".txt"), F.col("p_partkey")))
    models = files.model_files(p.select(F.concat(F.lit("/models/"), name).alias("path"), F.col("p_size").cast("long").alias("length")))
    chosen = files.resolve_model(models, "detector", "gone.onnx").unionByName(files.resolve_model(models, "embedder", "ARCFACE_4.onnx")).withColumn("_chosen", F.lit(", chosen"))
    return models.join(chosen, "name", "left").select("name", "role", "size_bytes", F.concat("role", F.coalesce("_chosen", F.lit(""))).alias("state"))


# ---------------------------------------------------------------- geometry and frames


@_query("""SELECT id, CASE WHEN ok THEN round(a, 6) + 0.0 END AS a, CASE WHEN ok THEN round(b, 6) + 0.0 END AS b, CASE WHEN ok THEN round(dx - a * sx + b * sy, 6) + 0.0 END AS tx, CASE WHEN ok THEN round(dy - b * sx - a * sy, 6) + 0.0 END AS ty FROM (
  SELECT id, count(*) >= 2 AND sum(u * u + v * v) >= 1e-12 AS ok, sum(u * p + v * q) / sum(u * u + v * v) AS a, sum(u * q - v * p) / sum(u * u + v * v) AS b, any_value(sx) AS sx, any_value(sy) AS sy, any_value(dx) AS dx, any_value(dy) AS dy FROM (
    SELECT id, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, p - avg(p) OVER w AS p, q - avg(q) OVER w AS q, avg(x) OVER w AS sx, avg(y) OVER w AS sy, avg(p) OVER w AS dx, avg(q) OVER w AS dy FROM (
      SELECT l_orderkey AS id, l_quantity AS x, l_discount * 100 AS y, l_quantity * 2.718281828 - l_tax AS p, l_discount * 314.1592653 AS q FROM lineitem) WINDOW w AS (PARTITION BY id)) GROUP BY id)""")
def landmark_fits(spark, sf):
    """The turn, scale and shift that best take one set of points to another, a set for each medium."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    both = F.collect_list(F.struct(point(x, y).alias("s"), point(x * 2.718281828 - F.col("l_tax"), F.col("l_discount") * 314.1592653).alias("d")))
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(both.alias("both"))
    fit = sets.select("id", geometry.similarity_transform(F.col("both.s"), F.col("both.d")).alias("f"))
    return fit.select("id", *[(F.round(F.col(f"f.{c}"), 6) + F.lit(0.0)).alias(c) for c in ("a", "b", "tx", "ty")])


@_query("""SELECT id, place, 'f' || place AS image FROM (SELECT id, unnest(range(0, n)) AS place FROM (SELECT o_orderkey AS id, CASE WHEN d <= 0 THEN 1 ELSE CAST(ceil(d / 5.0) AS BIGINT) END AS n FROM (SELECT o_orderkey, floor(o_totalprice / 1000) AS d FROM orders))) WHERE place % 3 <> 0""")
def sampled_frames(spark, sf):
    """The frames that could be decoded; each third of a video could not."""
    o = _orders(spark, sf).select("id", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("d"))
    plan = frames.with_frame_plan(o.withColumn("cuts", F.array().cast("array<double>")), "d", "cuts", most=1000)
    decoded = plan.select("id", F.transform("frames", lambda f, i: F.when(i % 3 != 0, F.concat(F.lit("f"), i.cast("string")))).alias("images"))
    return stages.sampled_frames(plan, decoded, "id").select("id", "place", "image")


# ---------------------------------------------------------------- rows of the index


@_query(", hits AS (SELECT id, media_id + 1 AS media_id, id AS face_id, media_id AS face_media FROM faces) SELECT 'face' AS kind, id, media_id FROM faces WHERE media_id <> 1 UNION ALL SELECT 'hit', id, media_id FROM hits WHERE media_id <> 1 AND face_media <> 1")
def media_faces_removed(spark, sf):
    """A medium's faces and hits go before it is analysed again, and hits elsewhere of faces that go."""
    s = state(spark, sf, "faces")
    s["video_detections"] = s["faces"].select("id", (F.col("media_id") + 1).alias("media_id"), F.lit(None).cast("long").alias("person_id"), F.col("id").alias("face_id"))
    after = changes.remove_faces_of_media(s, 1)
    rows = lambda kind, t: after[t].select(F.lit(kind).alias("kind"), "id", "media_id")
    return rows("face", "faces").unionByName(rows("hit", "video_detections"))


@_query("SELECT id, name, team FROM people WHERE lower(name) IN ('supplier#000000003', 'supplier#000000007')")
def people_by_name(spark, sf):
    """Persons asked for by name, blanks around it and its case aside; one of the names is nobody's."""
    s = state(spark, sf, "people")
    found = [grid.find_person(s, name) for name in ("  sUPPLIER#000000003 ", "SUPPLIER#000000007\t", "Supplier#0")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("id", "name", "team")


@_query("SELECT DISTINCT m.id, m.filename FROM seen JOIN media m ON m.id = media_id WHERE person_id = 3 AND media_type = 'photo'")
def album_media_ids(spark, sf):
    """The photos of one album; here a person's number is an album's."""
    s = state(spark, sf, "faces", "media")
    s["album_media"] = albums.appearances(s).select(F.col("person_id").alias("album_id"), "media_id")
    return albums.album_media_ids(s, 3, "photo").join(s["media"], "id").select("id", "filename")


@_query("SELECT n_name AS key, CASE WHEN n_nationkey = 3 THEN '7' ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation UNION ALL SELECT 'a new one', '[]'")
def settings_put(spark, sf):
    """One setting overwritten, one added."""
    n = table(spark, sf, "nation")
    s = {"settings": n.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))}
    known = n.where("n_nationkey = 3").first()["n_name"]
    return changes.put_setting(changes.put_setting(s, known, "7"), "a new one", "[]")["settings"]


@_query("SELECT id, timestamp, event, shoot_id FROM app_log UNION ALL SELECT max(id) + 1, '2026-01-01T00:00:00Z', 'export', 1996 FROM app_log")
def log_recorded(spark, sf):
    """A line added to the log."""
    return changes.record_quietly(state(spark, sf, "app_log"), "export", NOW, shoot_id=1996)["app_log"].select("id", "timestamp", "event", "shoot_id")


@_query("SELECT id, shoot_id, CASE WHEN id = (SELECT max(id) FROM jobs) THEN 'completed' ELSE 'queued' END AS status, CAST(CASE WHEN id = (SELECT max(id) FROM jobs) THEN 9 ELSE 0 END AS BIGINT) AS files_done FROM jobs UNION ALL SELECT max(id) + 1, 1996, 'running', 0 FROM jobs")
def export_records(spark, sf):
    """An export begins, another one ends."""
    j = state(spark, sf, "jobs")["jobs"]
    last = j.agg(F.max("id").alias("m")).first()["m"]
    s = {"exports": j.select("id", "shoot_id", F.lit("queued").alias("status"), F.lit(0).cast("long").alias("files_done"))}
    s = changes.update_export(s, last, status="completed", files_done=9)
    return changes.start_export(s, 1996, "/out", "{}", NOW)["exports"].select("id", "shoot_id", "status", "files_done")


# Texts for lists of ids: good ones in the first four places, then what isn't a list of whole numbers.
_LISTS_SQL = "['[' || o_orderkey || ',' || -o_orderkey - 1 || ']', ' [ ' || o_orderkey || ' ] ', '[]', '[9223372036854775807]', '[9223372036854775808]', '[1,2.5]', '[1,]', '[1', '[01]', 'null', '[\"1\"]', NULL][o_orderkey % 12 + 1]"


@_query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 12 < 4 THEN replace({_LISTS_SQL}, ' ', '') ELSE '[]' END AS ids FROM orders")
def id_lists(spark, sf):
    """Stored lists of ids read and written again; what isn't one is empty."""
    k = F.col("id").cast("string")
    texts = F.array(
        F.concat(F.lit("["), k, F.lit(","), (-F.col("id") - 1).cast("string"), F.lit("]")), F.concat(F.lit(" [ "), k, F.lit(" ] ")),
        *map(F.lit, ("[]", "[9223372036854775807]", "[9223372036854775808]", "[1,2.5]", "[1,]", "[1", "[01]", "null", '["1"]')), F.lit(None).cast("string"),
    )
    ids = scalars.id_list(F.element_at(texts, (F.col("id") % 12).cast("int") + 1))
    return _orders(spark, sf).select("id", scalars.id_list_text(ids).alias("ids"))


# ---------------------------------------------------------------- exports


@_query("""SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS pairs, o_orderkey % 4 <> 1 AS split, CASE WHEN o_orderkey % 4 = 0 THEN 'rename' ELSE 'skip' END AS on_conflict, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS person FROM orders""")
def export_options(spark, sf):
    """Stored options of exports: whole, in part, with a rule that doesn't exist, and no JSON."""
    k = F.col("id").cast("string")
    whole, rest = export.options_text(export.ExportOptions(person_ids=(-5,), include_multi_player=True, on_conflict="rename")), ('{"split_photos_videos": false, "new": 1}', '{"on_conflict": "ask"}', "{")
    text = F.element_at(F.array(F.replace(F.lit(whole), F.lit("-5"), k), *map(F.lit, rest)), (F.col("id") % 4).cast("int") + 1)
    o = _orders(spark, sf).select("id", export.options_of(text).alias("o"))
    return o.select("id", F.col("o.include_multi_player").alias("pairs"), F.col("o.split_photos_videos").alias("split"), "o.on_conflict", F.try_element_at("o.person_ids", F.lit(1)).alias("person"))


def _exported(spark, sf, present=None):
    s = state(spark, sf, "faces", "people", "media")
    s |= {"albums": spark.createDataFrame([], _ALBUMS), "album_media": spark.createDataFrame([], "album_id long, media_id long")}
    options = export.ExportOptions(include_unidentified=False)
    return export.export_plan(export.export_groups(albums.regenerate(s, 1996, NOW), 1996, options, present), options)


@_query("SELECT p.name, m.path AS source, p.name || CASE WHEN m.media_type = 'video' THEN '/Videos/' ELSE '/Photos/' END || m.filename AS relative_path FROM seen JOIN people p ON p.id = person_id JOIN media m ON m.id = media_id WHERE seen.shoot_id = 1996 AND m.id % 3 = 0")
def export_present(spark, sf):
    """The files of each player's folder that are still there: every third one is."""
    present = roles.media(spark, sf).where("id % 3 = 0").select("path")
    return _exported(spark, sf, present).select("name", "source", "relative_path")


@_query("""SELECT folder, row_number() OVER (ORDER BY n DESC, lower(name), newest IS NULL, newest, first) - 1 AS position FROM (
  SELECT p.name, p.name || CASE WHEN m.media_type = 'video' THEN '/Videos' ELSE '/Photos' END AS folder, any_value(n) AS n, min(captured_at) AS newest, arg_min(m.filename, (captured_at IS NULL, captured_at, m.filename)) AS first
  FROM (SELECT *, count(*) OVER (PARTITION BY person_id) AS n FROM seen WHERE shoot_id = 1996) s JOIN people p ON p.id = person_id JOIN media m ON m.id = media_id GROUP BY ALL)""")
def export_folders(spark, sf):
    """The folders of an export in the order in which it meets them."""
    return export.plan_folders(_exported(spark, sf))


@_query("SELECT CAST(count(*) AS BIGINT) AS files_total, CAST(sum(file_size) AS BIGINT) AS bytes_total FROM seen JOIN media m ON m.id = media_id WHERE seen.shoot_id = 1996")
def export_totals(spark, sf):
    return export.plan_totals(_exported(spark, sf)).select("files_total", "bytes_total")


@_query("SELECT o_orderkey AS id FROM orders WHERE year(o_orderdate) % 2 = 0 AND o_orderkey % 6 IN (0, 1, 2)")
def destinations_refused(spark, sf):
    """Destinations that are a shoot's folder or lie in one; only shoots of even years have a folder."""
    o = _orders(spark, sf)
    own = F.concat(F.lit("/shoots/"), F.year("o_orderdate").cast("string"))
    tail = _pick(("", "/out/./deep//er", "/../x/../{}/y", "x/out", "/..", "/../../shoots"), F.col("id"))
    asked = o.select("id", F.replace(F.concat(own, tail), F.lit("{}"), F.year("o_orderdate").cast("string")).alias("path"))
    sources = o.select(own.alias("path")).distinct().where("cast(substring(path, 9) as int) % 2 = 0")
    return export.refused_destinations(asked, sources).select("id")
