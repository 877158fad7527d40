"""Facts about the index on tables of a few rows."""

import pytest
from pyspark.sql import functions as F

from lumengrid.operators import albums, changes, clustering, export, grid, summaries
from lumengrid.schema import conform, empty_state
from lumengrid.sources import settings, snapshots

NOW = "2026-01-01T00:00:00Z"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def with_rows(state, table, data, ddl):
    spark = state[table].sparkSession
    return {**state, table: state[table].unionByName(conform(spark.createDataFrame(data, ddl), table))}


@pytest.fixture
def base(spark):
    """Four photos of one shoot: Jonathan in the first three, Mavi in the last three, one team."""
    s = empty_state(spark)
    s = with_rows(s, "shoots", [(1, "S", NOW)], "id long, name string, created_at string")
    s = with_rows(s, "people", [(1, "Jonathan", "Red"), (2, "mavi", "Red"), (3, "Zoe", "Red")], "id long, name string, team string")
    s = with_rows(s, "media", [(i, 1, f"/s/{i}.jpg", f"{i}.jpg", "photo", f"k{i}", f"t{i}") for i in range(1, 5)], "id long, shoot_id long, path string, filename string, media_type string, content_key string, thumbnail_path string")
    seen = [(m, 1) for m in (1, 2, 3)] + [(m, 2) for m in (2, 3, 4)]
    data = [(i + 1, m, 1, p, [1.0, 0.0], "confirmed", 0.9, 0.5) for i, (m, p) in enumerate(seen)]
    return with_rows(s, "faces", data, "id long, media_id long, shoot_id long, person_id long, embedding array<float>, assignment string, detection_confidence double, quality double")


def test_albums(base):
    s = albums.regenerate(base, 1, NOW)
    got = rows(albums.album_list(s, 1), "name", "album_type", "media_count", "cover_media_id")
    assert got == [("Jonathan", "player", 3, 1), ("mavi", "player", 3, 2), ("Jonathan + mavi", "multiPlayer", 2, 2), ("Red", "team", 4, 1)]
    assert rows(s["albums"].where("album_type = 'team'"), "person_ids") == [([1, 2, 3],)]
    again = albums.regenerate(s, 1, NOW)
    assert rows(albums.album_list(again, 1), "name", "media_count") == [(x[0], x[2]) for x in got]
    assert again["album_media"].count() == s["album_media"].count() == 12


def test_unidentified_album(base):
    s = with_rows(base, "faces", [(9, 4, 1, "unassigned"), (10, 1, 1, "ignored")], "id long, media_id long, shoot_id long, assignment string")
    assert rows(albums.album_counts(albums.unidentified_albums(s), s["media"], ["name"]), "name", "media_count") == [("Unidentified", 1)]


def test_upsert(base):
    spark = base["media"].sparkSession
    s = changes.set_media_status(base, 1, "analysed")
    scan = spark.createDataFrame([(1, "/s/1.jpg", "1.jpg", "photo", 5, "new", NOW), (1, "/s/9.jpg", "9.jpg", "photo", 6, "k9", NOW), (1, "/s/2.jpg", "2.jpg", "photo", 7, "k2", NOW)], "shoot_id long, path string, filename string, media_type string, file_size long, content_key string, captured_at string")
    s = changes.upsert_media(s, scan)
    got = rows(s["media"].orderBy("id"), "id", "file_size", "processing_status", "thumbnail_path", "captured_at")
    assert got[0] == (1, 5, "pending", None, NOW)
    assert got[1] == (2, 7, "pending", "t2", NOW)
    assert got[2] == (3, 0, "pending", "t3", None)
    assert got[4] == (5, 6, "pending", None, NOW)


def test_face_changes(base):
    spark = base["faces"].sparkSession
    assert rows(summaries.library_stats(base), "player_count", "total_samples") == [(2, 6)]
    hint = spark.createDataFrame([(1, 2, 0.8), (7, 2, 0.8)], "face_id long, person_id long, confidence double")
    s = with_rows(base, "faces", [(7, 4, 1, [1.0, 0.0], "unassigned")], "id long, media_id long, shoot_id long, embedding array<float>, assignment string")
    s = changes.set_suggestions(s, hint)
    assert rows(s["faces"].where("id in (1, 7)").orderBy("id"), "person_id", "assignment") == [(1, "confirmed"), (2, "suggested")]
    assert grid.unknown_vectors(s, 1).count() == 0
    s = changes.reject_faces(s, [7])
    assert rows(s["faces"].where("id = 7"), "person_id", "assignment") == [(None, "unassigned")]
    assert grid.unknown_vectors(s, 1).count() == 1
    s = changes.confirm_faces(changes.ignore_faces(s, [1]), [1, 2])
    assert rows(s["faces"].where("id in (1, 2)").orderBy("id"), "assignment") == [("ignored",), ("confirmed",)]
    assert rows(grid.face_count(s, 1), "n") == [(0,)]


def test_people(base):
    s = changes.get_or_create_person(base, "  JONATHAN ", "Blue", NOW)
    assert s["people"].count() == 3
    s = changes.get_or_create_person(s, "New", None, NOW)
    assert rows(s["people"].where("name = 'New'"), "id") == [(4,)]
    with pytest.raises(changes.ChangeError):
        changes.rename_person(s, 4, "MAVI", NOW)
    with pytest.raises(changes.ChangeError):
        changes.merge_people(s, 1, 1, NOW)
    merged = changes.merge_people(s, 1, 2, NOW)
    assert merged["faces"].where("person_id = 1").count() == 6
    gone = changes.delete_person(s, 2)
    assert sorted(rows(gone["faces"].where("person_id is null"), "assignment")) == [("confirmed",)] * 3
    assert rows(grid.find_person(s, " maVI "), "id") == [(2,)]


def test_clusters(base):
    s = with_rows(base, "clusters", [(1, 1, "Unknown Person 1")], "id long, shoot_id long, label string")
    s = with_rows(s, "faces", [(20 + i, 1, 1, 1, "unassigned", 0.9, i / 10) for i in range(4)], "id long, media_id long, shoot_id long, cluster_id long, assignment string, detection_confidence double, quality double")
    s = changes.refresh_clusters(s)
    assert rows(s["clusters"], "face_count", "cover_face_id") == [(4, 23)]
    named = changes.name_cluster(s, 1, 3)
    assert named["faces"].where("person_id = 3 and assignment = 'confirmed'").count() == 4
    s = with_rows(s, "clusters", [(9, 2, "Empty elsewhere", 5)], "id long, shoot_id long, label string, face_count long")
    split = changes.split_cluster(s, 1, [22, 23, 1], "Split", NOW)
    assert rows(split["clusters"].where("shoot_id = 2"), "id", "face_count") == [(9, 5)]
    split = {**split, "clusters": split["clusters"].where("shoot_id = 1")}
    assert sorted(rows(split["clusters"], "id", "face_count")) == [(1, 2), (10, 2)]
    back = changes.merge_clusters(split, 1, 10)
    assert rows(back["clusters"], "id", "face_count") == [(1, 4)]
    cleared = changes.clear_unnamed(split, 1)
    assert cleared["clusters"].count() == 0
    assert cleared["faces"].where("cluster_id is not null").count() == 0


def test_jobs(base):
    spark = base["jobs"].sparkSession
    new = spark.createDataFrame([(1, "scan", None, 200), (1, "scan", 5, 10)], "shoot_id long, kind string, media_id long, priority long")
    s = changes.enqueue(base, new)
    s, first = changes.claim_next(s, NOW)
    assert rows(first, "priority", "state", "attempts") == [(10, "running", 1)]
    s, second = changes.claim_next(s, NOW)
    assert rows(second, "priority") == [(200,)]
    assert changes.claim_next(s, NOW)[1].count() == 0
    again = changes.enqueue(s, new, unique=True)
    assert again["jobs"].count() == 2
    done = changes.complete_job(s, 1, NOW)
    assert changes.enqueue(done, new, unique=True)["jobs"].count() == 3
    for want in ("queued", "queued", "failed"):
        s = changes.fail_jobs(s, F.col("id") == 1, "lost", NOW)
        assert rows(s["jobs"].where("id = 1"), "state") == [(want,)]
        if want == "queued":
            s = changes.changed(s, "jobs", F.col("id") == 1, state="running", attempts=F.col("attempts") + 1)
    s = changes.retry_failed(s, 1)
    assert rows(s["jobs"].where("id = 1"), "state", "attempts") == [("queued", 0)]


def test_cascade(base):
    s = changes.delete_shoot(base, 1)
    assert [s[t].count() for t in ("shoots", "media", "faces", "people")] == [0, 0, 0, 3]


def test_timelines(base):
    hits = [(i, 1, 1, 100 + i, t, c) for i, (t, c) in enumerate([(74.0, 0.5), (76.0, 0.9), (78.0, 0.6), (208.0, 0.7), (210.0, 0.4), (300.0, 0.1)])]
    s = with_rows(base, "video_detections", hits, "id long, media_id long, person_id long, face_id long, timestamp double, confidence double")
    got = rows(summaries.video_timelines(s, 1), "id", "face_id", "start_time", "end_time", "confidence")
    assert got == [(0, 100, 74.0, 78.0, 0.9), (3, 103, 208.0, 210.0, 0.7), (5, 105, 300.0, None, 0.1)]


def test_progress(base):
    got = rows(summaries.progress(changes.set_media_status(base, 1, "failed")), "media_total", "media_failed", "percent", "stage")
    assert got == [(4, 1, 25.0, "complete")]


def test_grid(base):
    assert rows(grid.media_grid(base, grid.MediaQuery(person_id=1)), "id") == [(1,), (2,), (3,)]
    assert rows(grid.media_grid(base, grid.MediaQuery(person_id=1, only_unidentified=True)), "id") == []
    assert rows(grid.media_grid(base, grid.MediaQuery(search="2.J")), "id") == [(2,)]
    assert rows(grid.media_grid(base, grid.MediaQuery(limit=0, offset=-3)), "id") == [(1,)]


def test_matching(spark):
    library = spark.createDataFrame([(4, [0.6, 0.8]), (4, [0.8, 0.6]), (5, [-1.0, 0.0])], "person_id long, embedding array<float>")
    # two faces of one frame are both nearest to the same person, the third is like nobody
    faces = spark.createDataFrame([(1, 7, [0.7, 0.714]), (2, 7, [0.62, 0.785]), (3, 8, [0.0, -1.0])], "id long, media_id long, embedding array<float>")
    assert {r["id"]: r["person_id"] for r in clustering.match_frames(faces, library).collect()} == {2: 4}
    free = {r["id"]: r["person_id"] for r in clustering.match_frames(faces, library, clustering.MatchSettings(unique=False)).collect()}
    assert free == {1: 4, 2: 4}


def test_export_names():
    taken = set()
    assert [export.free_name(n, taken) for n in ("IMG_0231.JPG", "img_0231.jpg", "IMG_0231.JPG")] == ["IMG_0231.JPG", "img_0231 (2).jpg", "IMG_0231 (3).JPG"]
    taken = set()
    assert [export.free_name(n, taken) for n in ("a (2).jpg", "a.jpg", "a.jpg", ".hidden", ".hidden")] == ["a (2).jpg", "a.jpg", "a (3).jpg", ".hidden", ".hidden (2)"]


def test_export(base, tmp_path):
    for i in range(1, 5):
        (tmp_path / f"{i}.jpg").write_bytes(b"x" * i)
    s = {**base, "media": base["media"].withColumn("path", F.concat(F.lit(f"{tmp_path}/"), "filename")).withColumn("file_size", F.col("id"))}
    s = albums.regenerate(s, 1, NOW)
    plan = export.export_plan(export.export_groups(s, 1, export.ExportOptions(person_ids=(1,))), export.ExportOptions())
    assert sorted(rows(plan, "relative_path")) == [(f"Jonathan/Photos/{i}.jpg",) for i in (1, 2, 3)]
    assert rows(export.plan_totals(plan), "files_total", "bytes_total", "folders") == [(3, 6, 1)]
    out = tmp_path / "out"
    assert sorted(rows(export.execute_export(plan, str(out), export.ExportOptions()), "outcome")) == [("copied",)] * 3
    assert sorted(rows(export.execute_export(plan, str(out), export.ExportOptions()), "outcome")) == [("skipped",)] * 3
    assert not export.destination_allowed("/s/out", ["/s"])
    assert export.destination_allowed("/sx", ["/s"])


def test_settings(spark):
    s = settings.Settings(detection_input_size=700, cluster_min_size=0, analysis_max_dim=10).sanitised()
    assert (s.detection_input_size, s.cluster_min_size, s.analysis_max_dim) == (672, 1, 640)
    df = spark.createDataFrame([("app", '{"cluster_min_size": 5, "unknown": 1, "video_enabled": "x"}'), ("bad", "{")], "key string, value string")
    assert settings.load_settings(df).cluster_min_size == 5
    assert settings.setting(df, "bad", 7) == 7
    assert settings.setting(df, "none", 8) == 8


def exported(base, tmp_path):
    """The base with albums, its files on disk."""
    s = albums.regenerate(base, 1, NOW)
    media = s["media"].withColumn("path", F.concat(F.lit(str(tmp_path) + "/in/"), "filename")).withColumn("file_size", F.lit(2).cast("long"))
    (tmp_path / "in").mkdir()
    for i in range(1, 5):
        (tmp_path / "in" / f"{i}.jpg").write_bytes(b"xy")
    return {**s, "media": media, "shoots": s["shoots"].withColumn("source_path", F.lit(str(tmp_path) + "/in"))}


def test_export_runs(base, tmp_path):
    s = exported(base, tmp_path)
    options = export.ExportOptions(person_ids=(1,))
    columns = ("id", "status", "files_total", "files_done", "bytes_done")
    s = export.run_export(s, 1, str(tmp_path / "out"), options, NOW)
    assert rows(s["exports"], *columns, "error") == [(1, "completed", 3, 3, 6, None)]
    assert rows(s["app_log"], "event", "shoot_id", "detail") == [("export", 1, f"completed → {tmp_path}/out")]
    # all there: nothing is copied, which is no failure
    run = export.ExportRun(base["media"].sparkSession)
    s = export.run_export(s, 1, str(tmp_path / "out"), options, NOW, run)
    assert rows(s["exports"].where("id = 2"), *columns) == [(2, "completed", 3, 0, 0)]
    assert run.progress() == {"copied": 0, "skipped": 3, "failed": 0, "bytes": 0}
    (tmp_path / "in" / "2.jpg").unlink()
    s = export.run_export(s, 1, str(tmp_path / "again"), options, NOW)
    last = s["exports"].where("id = 3").first()
    assert (last["status"], last["files_done"], last["bytes_done"]) == ("failed", 2, 4) and "2.jpg" in last["error"]
    for wrong in (lambda: export.run_export(s, 1, str(tmp_path / "x"), export.ExportOptions(person_ids=(99,), include_unidentified=False), NOW), lambda: export.run_export(s, 7, str(tmp_path / "x"), options, NOW), lambda: export.run_export(s, 1, str(tmp_path / "in" / "x"), options, NOW)):
        with pytest.raises(export.ExportError):
            wrong()
    assert not (tmp_path / "x").exists()


def test_a_run_can_be_called_off(base, tmp_path, monkeypatch):
    import threading
    import time

    from pyspark import cloudpickle

    def slow(source, target, options):
        open(target.replace("/", "_").join([str(tmp_path) + "/began", ""]), "w").close()
        time.sleep(60)
        return "copied", None

    monkeypatch.setattr(export, "_copied", slow)
    cloudpickle.register_pickle_by_value(export)
    try:
        run = export.ExportRun(base["media"].sparkSession)

        def call_off():
            while not list(tmp_path.glob("began*")):
                time.sleep(0.1)
            run.cancel()

        watcher = threading.Thread(target=call_off, daemon=True)
        watcher.start()
        began = time.time()
        s = export.run_export(exported(base, tmp_path), 1, str(tmp_path / "out"), export.ExportOptions(), NOW, run)
        assert time.time() - began < 50
    finally:
        cloudpickle.unregister_pickle_by_value(export)
    assert rows(s["exports"], "status", "files_done", "error") == [("cancelled", 0, None)]


def test_versions(base, tmp_path):
    spark = base["media"].sparkSession
    root = f"file://{tmp_path}/state"
    assert snapshots.current(spark, root) is None and snapshots.vacuum(spark, root) == []
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, root)
    assert snapshots.save(spark, root, base) == 1
    loaded = snapshots.load(spark, root)
    assert loaded["faces"].count() == 6
    assert snapshots.save(spark, root, changes.delete_shoot(loaded, 1)) == 2
    assert snapshots.load(spark, root)["faces"].count() == 0
    assert snapshots.load(spark, root, 1)["faces"].count() == 6
    assert snapshots.vacuum(spark, root) == [1]
    assert snapshots.load(spark, root)["faces"].count() == 0
    assert len(list((tmp_path / "state" / "_data").iterdir())) == 1


def test_of_two_writers_one_comes_after_the_other(base, tmp_path):
    spark = base["media"].sparkSession
    root = f"file://{tmp_path}/state"
    snapshots.save(spark, root, base)
    before = snapshots.load(spark, root)
    seen = []

    def rename(state):
        seen.append(rows(state["people"].where("id = 1"), "name"))
        if len(seen) == 1:
            # somebody else commits while this change is being worked out
            snapshots.save(spark, root, changes.rename_person(before, 1, "Other", NOW), 1, before)
        return changes.rename_person(state, 2, "Mine", NOW)

    assert snapshots.commit(spark, root, rename) == 3
    assert seen == [[("Jonathan",)], [("Other",)]]
    assert dict(rows(snapshots.load(spark, root)["people"], "id", "name")) == {1: "Other", 2: "Mine", 3: "Zoe"}
    with pytest.raises(snapshots.Conflict):
        snapshots.save(spark, root, before, 1)
    # tables that neither changed are written once
    assert len({snapshots._manifest(spark, root, n)["faces"] for n in (1, 2, 3)}) == 1


@pytest.mark.parametrize("step", ["tables", "publish", "manifest"])
def test_a_crash_leaves_the_last_version(base, tmp_path, monkeypatch, step):
    spark = base["media"].sparkSession
    root = f"file://{tmp_path}/state"
    snapshots.save(spark, root, base)
    broken = changes.delete_shoot(snapshots.load(spark, root), 1)
    if step == "tables":
        broken["people"] = broken["people"].withColumn("name", F.raise_error(F.lit("lost")))
    elif step == "publish":
        # all tables are there, the manifest isn't
        monkeypatch.delattr(snapshots, "_publish")
    else:
        # the manifest is begun, but has no name yet
        monkeypatch.setattr(snapshots, "json", None)
    with pytest.raises(Exception):  # noqa: B017
        snapshots.save(spark, root, broken)
    monkeypatch.undo()
    assert snapshots.current(spark, root) == 1
    assert snapshots.load(spark, root)["faces"].count() == 6
    assert snapshots.save(spark, root, changes.delete_shoot(snapshots.load(spark, root), 1)) == 2
    assert snapshots.vacuum(spark, root, grace_seconds=-60) == [1]
    assert len(list((tmp_path / "state" / "_data").iterdir())) == 1
    assert [p.name for p in (tmp_path / "state" / "_versions").iterdir() if not p.name.endswith(".crc")] == ["000000000002"]


def test_log(base):
    s = changes.record(base, "scan", NOW, shoot_id=1)
    s = changes.record_quietly(s, "scan", NOW)
    assert rows(grid.recent_log(s), "id", "event") == [(2, "scan"), (1, "scan")]
    assert changes.trim_log(s, 1)["app_log"].count() == 2


def test_refused_destinations(spark):
    asked = spark.createDataFrame([(1, "/s"), (2, "/s/a/b"), (3, "/sx"), (4, "/t/../s/c"), (5, None), (6, "/"), (7, "/s")], "id long, path string")
    sources = spark.createDataFrame([("/s/",), (None,)], "path string")
    assert rows(export.refused_destinations(asked, sources).orderBy("id"), "id") == [(1,), (2,), (4,), (7,)]
    assert rows(export.refused_destinations(asked, spark.createDataFrame([("/",)], "path string")).orderBy("id"), "id") == [(1,), (2,), (3,), (4,), (6,), (7,)]


def test_options_come_back(spark):
    options = export.ExportOptions(person_ids=(3, 4), split_photos_videos=False, on_conflict="overwrite")
    texts = [(1, export.options_text(options)), (2, None), (3, "[]"), (4, '{"preserve_times": "no", "include_unidentified": false}')]
    got = spark.createDataFrame(texts, "id long, t string").select("id", export.options_of(F.col("t")).alias("o")).orderBy("id").collect()
    assert export.ExportOptions(**{**got[0]["o"].asDict(), "person_ids": tuple(got[0]["o"]["person_ids"])}) == options
    assert [export.ExportOptions(**r["o"].asDict()) for r in got[1:]] == [export.ExportOptions(), export.ExportOptions(), export.ExportOptions(include_unidentified=False)]


def test_album_sections_neither_tell_rows_apart_by_member_lists_nor_rank_pairs_whole(spark):
    people = spark.createDataFrame([(i, f"P{i}", "T") for i in range(1, 5)], "id long, name string, team string")
    faces = spark.createDataFrame([(7, m, p, "confirmed") for m in range(3) for p in (1, 2, 3)], "shoot_id long, media_id long, person_id long, assignment string")
    s = {"people": people, "faces": faces}
    assert sorted((r["media_id"], tuple(r["person_ids"])) for r in albums.team_albums(s).collect()) == [(m, (1, 2, 3, 4)) for m in range(3)]
    plan = albums.team_albums(s)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("members" in line.split("],")[0] for line in plan.splitlines() if "Aggregate [" in line)
    assert "WindowGroupLimit" in albums.album_pairs(s)._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["a_id"], r["b_id"], r["shared"], r["sort_order"]) for r in albums.album_pairs(s).orderBy("sort_order").collect()] == [(1, 2, 3, 0), (1, 3, 3, 1), (2, 3, 3, 2)]


def test_deletes_by_a_condition_join_no_ids_where_few_go(spark):
    """A delete of few rows is a filter; of many a table of ids, with the same outcome."""
    faces = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("media_id"), F.lit(1).cast("long").alias("shoot_id"), F.lit(None).cast("long").alias("person_id"), F.lit(None).cast("long").alias("cluster_id"))
    hits = spark.range(400).select(F.col("id"), F.lit(9).cast("long").alias("media_id"), F.lit(None).cast("long").alias("person_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("face_id"))
    s = {"faces": faces, "video_detections": hits}
    for gone in (F.col("id") < 4, F.col("id") < 150, F.col("id") < 0):
        limit = faces.where(gone).count()
        after, joined = changes.deleted(s, "faces", gone), changes.deleted(s, "faces", faces.where(gone))
        want = {i for i in range(400) if i % 2 or i >= limit}
        assert {r["id"] for r in after["video_detections"].collect()} == want == {r["id"] for r in joined["video_detections"].collect()}
        assert {r["id"] for r in after["faces"].collect()} == set(range(limit, 200)) == {r["id"] for r in joined["faces"].collect()}
        assert "Join" not in after["faces"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in changes.deleted(s, "faces", F.col("id") < 4)["video_detections"]._jdf.queryExecution().optimizedPlan().toString()
