"""Streams with state: late rows, a restart, and the same stretches as the batch rule."""

import datetime
import random

import pytest

from lumengrid.operators import summaries
from lumengrid.streaming import stateful


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class Stream:
    """Rows come as files, a batch each; every call starts the query anew from its checkpoint."""

    def __init__(self, spark, folder, ddl, make):
        self.spark, self.folder, self.ddl, self.make, self.n = spark, folder, ddl, make, 0
        (folder / "in").mkdir()

    def feed(self, rows):
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.make(self.spark.readStream.schema(self.ddl).parquet(f"{self.folder}/in"))
        got = []

        def keep(df, _):
            got.extend(tuple(r) for r in df.collect())

        query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
        return sorted(got, key=repr)


def at(seconds):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)


def test_progress_with_late_rows_and_restarts(spark, tmp_path):
    stream = Stream(spark, tmp_path, "job_id long, shoot_id long, state string, ts timestamp", lambda jobs: stateful.shoot_progress(jobs, every=1000, late="2 seconds"))
    counts = lambda rows: [(r[0], *r[2:]) for r in rows]
    stream.feed([(1, 1, "queued", at(0)), (2, 1, "queued", at(0)), (9, 2, "queued", at(0)), (1, 1, "running", at(1))])
    got = stream.feed([(1, 1, "completed", at(5))])
    assert counts(got)[-1:] == [(2, 1, 0, 0, 0, False)] and (1, 1, 0, 1, 0, False) in counts(got)
    # the row of an earlier time comes later and changes nothing; both shoots have no work then and say so once
    got = counts(stream.feed([(1, 1, "running", at(4)), (2, 1, "failed", at(9)), (9, 2, "cancelled", at(9))]))
    assert [c for c in got if c[-1]] == [(1, 0, 0, 1, 1, True), (2, 0, 0, 0, 0, True)]
    got = stream.feed([(50, 3, "queued", at(20))])
    assert {c[0] for c in counts(got)} == {3}
    got = stream.feed([(50, 3, "running", at(40))])
    assert counts(got) == [(3, 0, 1, 0, 0, False)]
    # work again: the first shoot speaks again
    got = counts(stream.feed([(2, 1, "queued", at(41)), (50, 3, "completed", at(60))]))
    assert (1, 1, 0, 1, 0, False) in got and (3, 0, 0, 1, 0, True) in got


def test_live_stretches_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, 1 + i % 2, rng.choice([7, 8, None]), rng.choice([i, None]), float(rng.randint(0, 120)) / 2, rng.random()) for i in range(150)]
    ddl = "id long, media_id long, person_id long, face_id long, timestamp double, confidence double"
    stream = Stream(spark, tmp_path, ddl, lambda hits: stateful.live_stretches(hits, gap=1.0, late="20 seconds"))
    rows.sort(key=lambda r: r[4] + rng.uniform(0, 15))
    got = []
    for lo in range(0, 150, 50):
        got += stream.feed(rows[lo : lo + 50])
    got += stream.feed([(999, 99, 1, None, 1e6, 0.5)])
    state = {"video_detections": spark.createDataFrame(rows, ddl), "people": spark.createDataFrame([(7, "A"), (8, "B")], "id long, name string")}
    want = [tuple(r) for r in summaries.video_timelines(state, gap=1.0).select("media_id", "person_id", "id", "face_id", "start_time", "end_time", "confidence").collect()]
    assert (set(got) - set(want), set(want) - set(got), len(got)) == (set(), set(), len(want))
