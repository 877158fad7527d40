import math
import os
import struct

import pytest
from pyspark.sql import functions as F

from lumengrid.functions import geometry as g
from lumengrid.functions import scalars as s
from lumengrid.operators import frames, stages


def values(spark, rows, ddl, *columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    ("text", "safe"),
    [("Team/Player", "Team_Player"), ("Player...", "Player"), ("nul", "nul_"), ("NUL.txt", "NUL.txt_"), ("", "Unnamed"), (None, "Unnamed"), ("a" * 500, "a" * 80), (" . x . ", ". x"), ("a ", "a"), ("a:b*c\t", "a_b_c_")],
)
def test_safe_component(spark, text, safe):
    assert values(spark, [(text,)], "t string", s.safe_component(F.col("t"))) == [(safe,)]


def test_timestamps(spark):
    cases = {"2026-08-09T10:45:21.000000Z": "2026-08-09T10:45:21Z", "2026-08-09 10:45:21": "2026-08-09T10:45:21Z", "2026-08-09T10:45:21.5": "2026-08-09T10:45:21Z", "2026-08-09T10:45:21+02:00": "2026-08-09T10:45:21+02:00", "nonsense": None, "2026-13-09 10:45:21": None, "": None}
    got = values(spark, [(c,) for c in cases], "t string", s.normal_timestamp(F.col("t")))
    assert [x[0] for x in got] == list(cases.values())


def test_rational(spark):
    got = [x[0] for x in values(spark, [("30000/1001",), ("25/1",), ("0/0",), ("59.94",), ("x",), (None,)], "t string", s.rational(F.col("t")))]
    assert got[0] == pytest.approx(29.97, abs=1e-2)
    assert got[1:] == [25.0, None, 59.94, None, None]


def test_classify(spark):
    rows = [("a/IMG_0231.JPG",), ("a/clip.MP4",), ("a/shot.heic",), ("a/raw.CR3",), ("notes.txt",), ("no_extension",), ("a.b/c",)]
    got = values(spark, rows, "p string", s.media_kind(F.col("p")), s.decoder(F.col("p")))
    assert got == [("photo", "native"), ("video", "ffmpeg"), ("photo", "ffmpeg"), ("photo", "ffmpeg"), (None, None), (None, None), (None, None)]


def test_ignored_folders(spark):
    got = values(spark, [("x/__MacOSX/a.jpg",), ("x/a.jpg",), ("x/.GIT/b/c.jpg",), (".git",)], "p string", s.in_ignored_folder(F.col("p")))
    assert [x[0] for x in got] == [True, False, True, False]


def test_nocase_folds_ascii_alone(spark):
    assert values(spark, [("ÉAz",)], "t string", s.nocase(F.col("t"))) == [("Éaz",)]


def test_search(spark):
    assert s.matches_search(F.col("t"), "  ") is None
    got = values(spark, [("IMG_1.JPG",), ("img\\1",), ("x",)], "t string", s.matches_search(F.col("t"), "mg_1"), s.matches_search(F.col("t"), "\\"))
    assert got == [(True, False), (True, True), (False, False)]


def test_byte_ranges(spark):
    cases = {"bytes=0-99": (0, 99), "bytes=-500": (500, 999), "bytes=-5000": (0, 999), "bytes=900-": (900, 999), "bytes=1000-": None, "bytes=-0": None, "bytes=5-2": None, "bytes=0-1,5-6": (0, 1), "x": None, "bytes=-": None}
    got = values(spark, [(c,) for c in cases], "h string", s.byte_range(F.col("h"), F.lit(1000).cast("long")))
    assert [tuple(x[0]) if x[0] else None for x in got] == list(cases.values())


def test_blobs(spark):
    numbers = [1.0, -2.5, 0.0, 3.1415927410125732, 1e-40]
    got = values(spark, [(bytearray(struct.pack("<5f", *numbers)),), (bytearray(b"abc"),), (bytearray(b""),)], "b binary", s.blob_floats(F.col("b")))
    assert got[0][0] == pytest.approx(numbers, rel=1e-6)
    assert got[1][0] is None
    assert got[2][0] == []


def test_labels(spark):
    got = values(spark, [(512, 65.9, 0.984), (1536, 3725.0, None), (150 * 1024 * 1024, -1.0, 1.0)], "n long, t double, c double", s.bytes_label(F.col("n")), s.time_label(F.col("t")), s.confidence_label(F.col("c")))
    assert got == [("512 B", "1:05", "98.4%"), ("1.5 KB", "1:02:05", "—"), ("150 MB", "0:00", "100.0%")]


def test_model_roles(spark):
    got = values(spark, [("det_10g.onnx",), ("w600k_r50.onnx",), ("SCRFD.onnx",), ("x.onnx",)], "n string", s.model_role(F.col("n")))
    assert [x[0] for x in got] == ["detector", "embedder", "detector", "unknown"]


def test_orientation(spark):
    got = values(spark, [(-90,), (90,), (180,), (450,), (7,)], "d int", s.rotation_orientation(F.col("d")))
    assert [x[0] for x in got] == [8, 6, 3, 6, 1]
    assert [x[0] for x in values(spark, [(i,) for i in (0, 1, 5, 6, 9)], "o int", s.orientation_transform(F.col("o")))] == ["normal", "normal", "transpose", "rotate90", "normal"]


def box(*v):
    return dict(zip(("x1", "y1", "x2", "y2"), map(float, v), strict=True))


RECT = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_iou(spark):
    got = values(spark, [(box(0, 0, 10, 10), box(5, 0, 15, 10)), (box(0, 0, 0, 0), box(0, 0, 0, 0))], f"a {RECT}, b {RECT}", g.iou(F.col("a"), F.col("b")))
    assert got[0][0] == pytest.approx(1 / 3)
    assert got[1][0] == 0


def test_letterbox(spark):
    assert tuple(values(spark, [(1920.0, 1080.0)], "w double, h double", g.letterbox(F.col("w"), F.col("h"), F.lit(640.0)))[0][0])[:2] == (640, 360)


def test_cosine(spark):
    got = values(spark, [([1.0, 0.0], [0.6, 0.8]), ([1.0, 0.0], [1.0, 0.0, 0.0])], "a array<float>, b array<float>", g.cosine(F.col("a"), F.col("b")))
    assert got[0][0] == pytest.approx(0.6)
    assert got[1][0] == 0


def test_similarity_transform(spark):
    src = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    dst = [(3 + 2 * (x * 0.8 - y * 0.6), 4 + 2 * (x * 0.6 + y * 0.8)) for x, y in src]
    kind = "array<struct<x:double,y:double>>"
    got = values(spark, [(src, dst), (src[:1], dst[:1])], f"s {kind}, d {kind}", g.similarity_transform(F.col("s"), F.col("d")))
    assert tuple(got[0][0]) == pytest.approx((1.6, 1.2, 3, 4))
    assert got[1][0] is None


def test_anchor(spark):
    # centre (80, 40) of stride 8 is cell 5 * 80 + 10 of a grid of 80; two anchors for each cell
    got = values(spark, [(2 * (5 * 80 + 10), [2.0] * 4)], "i long, d array<double>", frames.anchor_box(F.col("i"), F.lit(0), F.lit(640.0), F.col("d"), F.lit(0.5)))
    assert tuple(got[0][0]) == (128, 48, 192, 112)


def test_suppress(spark):
    boxes = [(0.0, 0.0, 10.0, 10.0, 0.80), (1.0, 1.0, 11.0, 11.0, 0.95), (50.0, 50.0, 60.0, 60.0, 0.70)]
    got = values(spark, [(boxes,)], "b array<struct<x1:double,y1:double,x2:double,y2:double,score:double>>", frames.suppress(F.col("b")))
    assert [round(b["score"], 2) for b in got[0][0]] == [0.95, 0.7]


def plan(duration, scenes, interval=5.0, gap=1.0, most=60):
    """The rules in plain Python."""
    if not duration or duration <= 0:
        return [(0.0, False)], False
    c = [(0.0, False)] + [(min(x + 0.2, duration - 0.05), True) for x in scenes if 0 < x < duration]
    k = 1
    while interval > 0 and k * interval < duration:
        c.append((k * interval, False))
        k += 1
    kept = []
    for at, scene in sorted(c, key=lambda f: f[0]):
        if kept and abs(at - kept[-1][0]) < gap:
            if scene and not kept[-1][1]:
                kept[-1] = (at, scene)
        else:
            kept.append((at, scene))
    if len(kept) <= most:
        return kept, False
    some = lambda x, n: [] if n <= 0 else x if len(x) <= n else [x[math.floor(i * len(x) / n)] for i in range(n)]
    cuts = some([f for f in kept if f[1]], most)
    return sorted(cuts + some([f for f in kept if not f[1]], most - len(cuts))), True


def test_frame_plans(spark):
    cases = [(30.0, [], 60), (2.0, [], 60), (None, [], 60), (5400.0, [], 60), (1800.0, [float(i * 40 + 3) for i in range(40)], 45), (20.0, [0.5, 4.9, 5.1, 19.99, 25.0], 60), (12.0, [float(i) / 3 for i in range(40)], 5), (0.03, [0.01], 60)]
    for duration, scenes, most in cases:
        df = spark.createDataFrame([(duration, scenes)], "d double, s array<double>")
        r = frames.with_frame_plan(df, "d", "s", most=most).first()
        want, cut = plan(duration, scenes, most=most)
        assert [f["scene"] for f in r["frames"]] == [f[1] for f in want]
        assert [f["at"] for f in r["frames"]] == pytest.approx([f[0] for f in want])
        assert r["truncated"] == cut


def test_scene_times_and_probe(spark):
    log = "x pts_time:3.5 y\npts_time:1 z pts_time:1.03\npts_time:bad"
    probe = "duration=N/A\nduration=12.5\nduration=99\nwidth=1920\nwidth=1280\nheight=\nTAG:rotate=90"
    got = values(spark, [(log, probe)], "l string, p string", frames.scene_times(F.col("l")), frames.video_info(F.col("p")))
    assert got[0][0] == [1.0, 3.5]
    assert tuple(got[0][1]) == (12.5, 1280, None, 90, None)


def test_float_blob(spark):
    rows = [([1.5, -2.0, 1e-45],), ([],), (None,), ([1.0, None],)]
    got = values(spark, rows, "v array<double>", s.float_blob(F.col("v")))
    assert [None if r[0] is None else bytes(r[0]) for r in got] == [struct.pack("<3f", 1.5, -2.0, 1e-45), b"", None, None]


def test_id_lists(spark):
    texts = ["[1,-2]", " [ 3 ]\n", "[]", "[1,2.5]", "[1,]", "[-0]", "[01]", "{}", "null", "", "[9223372036854775808]", None]
    got = values(spark, [(t,) for t in texts], "t string", s.id_list(F.col("t")), s.id_list_text(s.id_list(F.col("t"))))
    assert [list(r[0]) for r in got] == [[1, -2], [3]] + [[]] * 10
    assert [r[1] for r in got][:3] == ["[1,-2]", "[3]", "[]"]
    assert values(spark, [(None,)], "v array<bigint>", s.id_list_text(F.col("v")))[0][0] == "[]"


def test_clean_path(spark):
    paths = ["/a/b/../c", "/..", "/a//./b/", "a/../../b", "../x", "", ".", "/", "/a/../..", "a/.."]
    got = values(spark, [(p,) for p in paths], "p string", s.clean_path(F.col("p")))
    assert [r[0] for r in got] == [os.path.normpath(p) for p in paths]


def test_sampled_frames_never_broadcasts_what_it_joins(spark):
    """Arrays are guessed too small, so a broadcast of them would fill the driver."""
    frame = "array<struct<at:double,scene:boolean>>"
    plans = spark.createDataFrame([(1, [(0.0, False), (5.0, False), (7.0, True)]), (2, [(0.0, False)]), (3, [(0.0, False)])], f"id long, frames {frame}")
    decoded = spark.createDataFrame([(1, ["a", None, "c"]), (2, [None]), (4, ["x"])], "id long, images array<string>")
    got = stages.sampled_frames(plans, decoded, "id")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0.0, False, "a"), (1, 2, 7.0, True, "c")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_frame_plan_without_scene_changes_equals_the_fold(spark):
    """Nothing is thinned without scene changes; a cut after the end sends a video through the fold and adds no frame."""
    rows = [(i, d, c) for i, d in enumerate((None, -1.0, 0.0, 0.5, 5.0, 5.1, 61.0, 400.0)) for c in (None, [], [9999.0])]
    for interval, gap, most in ((5.0, 1.0, 60), (0.5, 1.0, 60), (0.0, 1.0, 60), (5.0, 1.0, 7)):
        got = frames.with_frame_plan(spark.createDataFrame(rows, "id long, d double, c array<double>"), "d", "c", interval=interval, gap=gap, most=most).collect()
        for i in range(0, len(got), 3):
            assert got[i]["frames"] == got[i + 1]["frames"] == got[i + 2]["frames"] and got[i]["truncated"] == got[i + 2]["truncated"]


def test_bytes_label_stops_at_the_largest_unit(spark):
    got = values(spark, [(1023,), (5 * 1024**2,), (1024**3,), (3 * 1024**4,), (-1,), (None,)], "n long", s.bytes_label(F.col("n"), "MB"), s.bytes_label(F.col("n")))
    assert got == [("1023 B", "1023 B"), ("5.0 MB", "5.0 MB"), ("1024 MB", "1.0 GB"), ("3145728 MB", "3.0 TB"), ("—", "—"), ("—", "—")]


def test_detector_outputs_are_brought_together_without_a_join(spark):
    """Levels with and without points; a broadcast of raw outputs would fill the driver."""
    ddl = "id long, rows int, channels int, values array<double>, scale double"
    rows = [(1, 32, 1, [0.95] + [0.0] * 31, 0.5), (1, 32, 4, [1.0] * 128, 0.5), (1, 8, 1, [0.0] * 7 + [0.99], 0.5), (1, 8, 4, [2.0] * 32, 0.5), (1, 32, 10, [1.0] * 320, 0.5), (2, 32, 4, [1.0] * 128, 0.5)]
    got = frames.scrfd_faces(spark.createDataFrame(rows, ddl), "id", 32.0, 0.9)
    found = {(r["id"], r["level"], r["index"]): (tuple(r["box"]), r["landmarks"]) for r in got.collect()}
    assert set(found) == {(1, 0, 0), (1, 1, 7)}
    assert found[1, 0, 0] == ((-16.0, -16.0, 16.0, 16.0), [16.0] * 10)
    assert found[1, 1, 7] == ((-32.0, -32.0, 96.0, 96.0), None)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_similarity_transform_goes_over_its_points_twice(spark):
    """Means were worked out again for each point of each sum."""
    kind = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0)], [(1.0, 1.0), (1.0, 3.0)]), ([(1.0, 1.0)] * 2, [(1.0, 1.0)] * 2), ([], []), (None, None)], f"s {kind}, d {kind}")
    got = df.select(g.similarity_transform(F.col("s"), F.col("d")).alias("f"))
    assert [r["f"] and tuple(r["f"]) for r in got.collect()] == [(0.0, 2.0, 1.0, 1.0), None, None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2
