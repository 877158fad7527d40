import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import pixels
from lumengrid.sources import cache, container, files, walk
from lumengrid.streaming import live


def tiff():
    """A big-endian block with a make, an orientation, an aperture and a time in the EXIF folder."""
    make, time = b"Maker\0", b"2026:08:09 10:45:21\0"
    head = 8
    first = 2 + 12 * 3 + 4
    second = 2 + 12 * 2 + 4
    data_at = head + first + second
    body = make + time + struct.pack(">II", 28, 10)
    out = b"MM\0*" + struct.pack(">I", head)
    out += struct.pack(">H", 3) + struct.pack(">HHII", 0x010F, 2, len(make), data_at) + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack(">HHII", 0x8769, 4, 1, head + first) + struct.pack(">I", 0)
    out += struct.pack(">H", 2) + struct.pack(">HHII", 0x9003, 2, len(time), data_at + len(make)) + struct.pack(">HHII", 0x829D, 5, 1, data_at + len(make) + len(time)) + struct.pack(">I", 0)
    return out + body


def test_exif(spark, tmp_path):
    block = tiff()
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda\0\0"
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.jpg").write_bytes(b"no picture")
    got = {r["path"].rpartition("/")[2]: r for r in files.read_metadata(spark, str(tmp_path)).collect()}
    a = got["a.jpg"]
    assert (a["camera_make"], a["orientation"], a["original"]) == ("Maker", 6, "2026-08-09T10:45:21Z")
    assert a["aperture"] == pytest.approx(2.8)
    assert (got["b.jpg"]["camera_make"], got["b.jpg"]["orientation"]) == (None, 1)


def test_scan(spark, tmp_path):
    for name in ("1.jpg", "2.PNG", "clip.mp4", "notes.txt", "sub/3.jpg", "__MACOSX/4.jpg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    listed = files.listing(spark, str(tmp_path))
    root = listed.select("path").first()["path"].partition(str(tmp_path))[0] + str(tmp_path)
    got = files.scan(listed, root)
    assert sorted(r[0] for r in got.select("relative").collect()) == ["1.jpg", "2.PNG", "clip.mp4", "sub/3.jpg"]
    assert files.scan(files.listing(spark, str(tmp_path), recursive=False), root).count() == 3
    assert files.new_or_changed(got, got.limit(1)).count() == 3
    assert tuple(files.folder_size(listed).first()) == (5, 5)


def test_models(spark):
    df = spark.createDataFrame([("/m/det_a.onnx", 5), ("/m/det_b.onnx", 5), ("/m/arcface.onnx", 9), ("/m/x.txt", 1)], "path string, length long")
    models = files.model_files(df)
    assert models.count() == 3
    assert files.resolve_model(models, "detector").first()[0] == "det_b.onnx"
    assert files.resolve_model(models, "detector", "DET_A.onnx").first()[0] == "det_a.onnx"
    assert tuple(files.model_status(models).first()) == (True, "ready")
    assert tuple(files.model_status(models.where("role = 'detector'")).first()) == (False, "no face embedder found")


def test_pixels():
    image = np.arange(2 * 3 * 3).reshape(2, 3, 3)
    assert pixels.oriented(image, 6).shape == (3, 2, 3)
    assert (pixels.oriented(pixels.oriented(image, 6), 8) == image).all()
    assert (pixels.oriented(pixels.oriented(image, 7), 7) == image).all()
    tensor, scale = pixels.detector_tensor(np.full((108, 192, 3), 255), 64)
    assert tensor.shape == (1, 3, 64, 64)
    assert scale == pytest.approx(64 / 192)
    assert tensor[0, 0, 0, 0] == pytest.approx(127.5 / 128)
    face = pixels.aligned_face(np.random.default_rng(1).integers(0, 255, (112, 112, 3)), pixels.ALIGNED)
    assert face.shape == (112, 112, 3)
    assert pixels.fit_similarity(pixels.ALIGNED[:1], pixels.ALIGNED[:1]) is None


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "2026-01-01 00:00:00", 0.5), (1, 1, "2026-01-01 00:00:03", 0.9), (1, 1, "2026-01-01 00:01:00", 0.1)], "media_id long, person_id long, ts string, confidence double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.live_timelines(stream).writeStream.format("memory").queryName("stretches").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = live.live_timelines(rows).orderBy("start_time").collect()
    assert [(r["hits"], r["confidence"]) for r in batch] == [(2, 0.9), (1, 0.1)]


# ---------------------------------------------------------------- folders and containers


@pytest.mark.parametrize("frontier", [1, 3, 256])
def test_walk_of_a_golden_tree(spark, tmp_path, monkeypatch, frontier):
    monkeypatch.setattr(walk, "FRONTIER", frontier)
    root = tmp_path / "shoot"
    for name in ("1.jpg", "_2.png", ".3.mp4", "notes.txt", "a/4.jpg", "a/b/5.jpg", "a/b/c/6.jpg", "__MacOSX/7.jpg", "a/.Thumbnails/8.jpg", "_out/9.mov"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"12345")
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere" / "10.jpg").write_bytes(b"x")
    os.symlink(tmp_path / "elsewhere", root / "linked")
    os.symlink(root / "a", root / "a" / "b" / "again")
    os.symlink(root / "nowhere.jpg", root / "broken.jpg")
    os.symlink(root / "1.jpg", root / "same.jpg")

    def names(**options):
        found = walk.walk(spark, str(root), **options)
        return sorted(r["relative"] for r in found.where("status = 'file'").collect()), tuple(walk.walk_report(found).first())

    plain = [".3.mp4", "1.jpg", "_2.png", "_out/9.mov", "a/4.jpg", "a/b/5.jpg", "a/b/c/6.jpg", "notes.txt"]
    assert names() == (plain, (5, 2, 1, False))
    followed, report = names(follow_links=True)
    assert followed == sorted([*plain, "linked/10.jpg", "same.jpg"])
    # the text file, the link that leads nowhere and the one that leads back
    assert report == (7, 2, 3, False)
    assert names(recursive=False)[0] == [".3.mp4", "1.jpg", "_2.png", "notes.txt"]
    assert names(max_depth=2)[0] == [n for n in plain if n.count("/") < 2]
    (tmp_path / "stop").write_bytes(b"")
    assert names(cancel_file=str(tmp_path / "stop")) == ([], (0, 0, 0, True))
    row = walk.walk(spark, str(root)).where("relative = '1.jpg'").first()
    assert row["length"] == 5 and row["path"] == str(root / "1.jpg")
    assert walk.walk(spark, str(root / "__MacOSX")).count() == 0
    with pytest.raises(Exception, match="no folder"):
        walk.walk(spark, str(tmp_path / "none")).count()


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(made=3_840_000_000, scale=600, ticks=7_530, matrix=(0, 65536), version=0, handler=b"vide", stored=(1920, 1080)):
    head = struct.pack(">B3xIIII", 0, made, 0, scale, ticks) if version == 0 else struct.pack(">B3xQQIQ", 1, made, 0, scale, ticks)
    times = bytes(20) if version == 0 else bytes(32)
    track = struct.pack(">B3x", version) + times + bytes(16) + struct.pack(">9i", matrix[0], matrix[1], 0, -matrix[1], matrix[0], 0, 0, 0, 1 << 30) + struct.pack(">II", 1080 << 16, 1920 << 16)
    sample = struct.pack(">I", 0) + struct.pack(">I", 1) + struct.pack(">I4s", 86, b"avc1") + bytes(24) + struct.pack(">HH", *stored) + bytes(50)
    media = box(b"mdia", box(b"hdlr", bytes(8) + handler + bytes(12)) + box(b"minf", box(b"stbl", box(b"stsd", sample))))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + b"soun" + bytes(12))))
    return box(b"moov", box(b"mvhd", head + bytes(80)) + sound + box(b"trak", box(b"tkhd", track) + media))


def test_containers(spark, tmp_path):
    front = box(b"ftyp", b"isom")
    files_ = {
        "early.mp4": front + movie() + box(b"mdat", bytes(100)),
        "late.mov": front + struct.pack(">I4sQ", 1, b"mdat", 5016) + bytes(5000) + movie(matrix=(-65536, 0), version=1),
        "upright.mp4": movie(made=0, matrix=(65536, 0)),
        "turned.mp4": movie(matrix=(0, -65536), scale=0),
        "sound.mp4": movie(handler=b"soun"),
        "cut.mp4": front + movie()[:-40],
        "lies.mp4": struct.pack(">I4s", 1 << 31, b"moov") + bytes(50),
        "tiny.mp4": b"abc",
        "empty.mp4": b"",
    }
    for name, data in files_.items():
        (tmp_path / name).write_bytes(data)
    listed = spark.createDataFrame([(str(tmp_path / n), "2020-01-01T00:00:00Z") for n in [*files_, "gone.mp4"]], "path string, modified_at string")
    got = {os.path.basename(r["path"]): tuple(r)[1:] for r in container.video_metadata(listed).collect()}
    assert got["early.mp4"] == (1920, 1080, 12.55, 8, "2025-09-06T10:40:00Z")
    assert got["late.mov"] == (1920, 1080, 12.55, 3, "2025-09-06T10:40:00Z")
    assert got["upright.mp4"] == (1920, 1080, 12.55, 1, "2020-01-01T00:00:00Z")
    assert got["turned.mp4"] == (1920, 1080, None, 6, "2025-09-06T10:40:00Z")
    assert got["sound.mp4"] == (None, None, 12.55, 1, "2025-09-06T10:40:00Z")
    for name in ("cut.mp4", "lies.mp4", "tiny.mp4", "empty.mp4", "gone.mp4"):
        assert got[name] == (None, None, None, 1, "2020-01-01T00:00:00Z")


def test_cache(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert cache.clear(spark, root) == 0
    rows = spark.createDataFrame([("abcd", b"one"), ("abce", b"two"), ("f", b"short"), (None, b"x"), ("ffff", None)], "key string, content binary")
    cache.store(rows, root)
    assert (tmp_path / "cache" / "ab" / "abcd.jpg").read_bytes() == b"one"
    assert (tmp_path / "cache" / "00" / "f.jpg").read_bytes() == b"short"
    assert tuple(cache.cache_size(spark, root).first()) == (3, 11)
    # what is there stays, and a key that many tasks write is there once and whole
    again = spark.range(200).select(F.lit("abcd").alias("key"), F.lit(b"other").alias("content")).unionByName(spark.range(0, 200, 1, 8).select(F.lit("ee11").alias("key"), F.lit(b"same").alias("content")))
    cache.store(again, root)
    assert (tmp_path / "cache" / "ab" / "abcd.jpg").read_bytes() == b"one"
    assert (tmp_path / "cache" / "ee" / "ee11.jpg").read_bytes() == b"same"
    # a run that breaks off leaves whole files and nothing aside
    bad = spark.createDataFrame([("0001", b"fine"), ("../up", b"no")], "key string, content binary").coalesce(1)
    with pytest.raises(Exception, match="name a file"):
        cache.store(bad, root)
    assert not list((tmp_path / "cache" / ".aside").iterdir())
    assert not (tmp_path / "up.jpg").exists()
    assert (tmp_path / "cache" / "00" / "0001.jpg").read_bytes() == b"fine"
    with pytest.raises(Exception, match="clear it first"):
        rows.write.format("filecache").mode("overwrite").save(root)
    assert cache.clear(spark, root) == 5
    assert tuple(cache.cache_size(spark, root).first()) == (0, 0)
