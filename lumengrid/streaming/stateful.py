"""Streams that remember: progress of shoots, and who is on screen when.

Both keep what they know of a key in the state store and speak when the watermark passes a timer, so
rows may come late within the watermark and a query may be stopped and started again. The session's
``spark.sql.streaming.stateStore.providerClass`` must be the RocksDB one, as Spark asks for timers.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# ---------------------------------------------------------------- progress of shoots

PROGRESS = "shoot_id long, at timestamp, jobs_queued long, jobs_running long, jobs_completed long, jobs_failed long, last boolean"
# States of jobs that a report counts, and those in which a shoot has work.
COUNTED, ACTIVE = ("queued", "running", "completed", "failed"), ("queued", "running")


class ShootProgress(StatefulProcessor):
    """A report of a shoot each ``interval`` milliseconds while it has work, and one last when it has none any more."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id long", "state string, at long")
        self.counts = handle.getValueState("counts", "queued long, running long, completed long, failed long")

    def _counts(self) -> dict[str, int]:
        held = self.counts.get() if self.counts.exists() else (0,) * len(COUNTED)
        return dict(zip(COUNTED, held, strict=True))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        counts, seen = self._counts(), False
        for r in rows:
            at, job = int(r["ts"].timestamp() * 1000), (r["job_id"],)
            known = self.jobs.getValue(job) if self.jobs.containsKey(job) else None
            # of two rows of a job the later one counts, whichever comes first; of equals the one that comes last
            if known is not None and known[1] > at:
                continue
            if known is not None and known[0] in counts:
                counts[known[0]] -= 1
            if r["state"] in counts:
                counts[r["state"]] += 1
            self.jobs.updateValue(job, (r["state"], at))
            seen = True
        if seen:
            self.counts.update(tuple(counts[s] for s in COUNTED))
            if not any(True for _ in self.handle.listTimers()):
                self._wait(timerValues)
        return iter(())

    def _wait(self, timerValues: Any) -> None:
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        self.handle.registerTimer((now // self.interval + 1) * self.interval)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        counts = self._counts()
        idle = not any(counts[s] for s in ACTIVE)
        if not idle:
            self._wait(timerValues)
        at = expiredTimerInfo.getExpiryTimeInMs()
        yield _row(PROGRESS, key[0], datetime.datetime.fromtimestamp(at / 1000), *(counts[s] for s in COUNTED), idle)

    def close(self) -> None:
        pass


def _row(ddl: str, *values: Any) -> Row:
    return Row(*(field.split(" ")[0] for field in ddl.split(", ")))(*values)


def shoot_progress(jobs: DataFrame, every: int = 500, late: str = "10 seconds") -> DataFrame:
    """(shoot_id, at, jobs_queued, jobs_running, jobs_completed, jobs_failed, last) from a stream of job
    rows (job_id, shoot_id, state, ts).

    A row says what state a job is in from ``ts`` on. While a shoot has queued or running jobs there is a report
    every ``every`` milliseconds of the stream's time; when it goes idle there is one more, the ``last``,
    and none until it has work again. Where the watermark skips several intervals there is one report for all.
    """
    rows = jobs.select("job_id", "shoot_id", "state", "ts").withWatermark("ts", late)
    return rows.groupBy("shoot_id").transformWithState(statefulProcessor=ShootProgress(every), outputStructType=PROGRESS, outputMode="Update", timeMode="EventTime")


# ---------------------------------------------------------------- who is on screen when

STRETCHES = "media_id long, person_id long, id long, face_id long, start_time double, end_time double, confidence double"
#: The stream's time of a video's start in milliseconds: later than the watermark that a stream begins with.
START = 1000


class Stretches(StatefulProcessor):
    """Hits of a person in a video, joined to stretches in order of their time and id."""

    def __init__(self, gap: float, second: float):
        self.gap, self.second = gap, second

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # hits that an earlier one may still come before, by time and id, and the stretch that is not over
        self.waiting = handle.getMapState("waiting", "timestamp double, id long", "face_id long, confidence double")
        self.open = handle.getValueState("open", "id long, face_id long, start double, last double, hits long, confidence double")

    def _ms(self, timestamp: float) -> int:
        return START + math.floor(timestamp * self.second)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r["timestamp"], r["id"]), (r["face_id"], r["confidence"]))
            self.handle.registerTimer(self._ms(r["timestamp"]) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # no row of an earlier time than the watermark comes any more, so all timers up to it are answered at once
        done = timerValues.getCurrentWatermarkInMs()
        stretch = tuple(self.open.get()) if self.open.exists() else None
        ready = sorted((k[0], k[1], v[0], v[1]) for k, v in list(self.waiting.iterator()) if self._ms(k[0]) < done)
        for at, hit, face, confidence in ready:
            if stretch and at - stretch[3] > self.gap:
                yield self._row(key, stretch)
                stretch = None
            first = stretch or (hit, face, at, at, 0, confidence)
            stretch = (*first[:3], at, first[4] + 1, max((c for c in (first[5], confidence) if c is not None), default=None))
            self.waiting.removeKey((at, hit))
        if stretch and self._ms(stretch[3] + self.gap) < done:
            yield self._row(key, stretch)
            stretch = None
        if stretch:
            self.open.update(stretch)
            self.handle.registerTimer(self._ms(stretch[3] + self.gap) + 1)
        else:
            self.open.clear()

    def _row(self, key: Any, s: tuple) -> Row:
        return _row(STRETCHES, key[0], key[1], s[0], s[1], s[2], s[3] if s[4] > 1 else None, s[5])

    def close(self) -> None:
        pass


def live_stretches(hits: DataFrame, gap: float = 4.0, late: str = "1 minute") -> DataFrame:
    """(media_id, person_id, id, face_id, start_time, end_time, confidence): the stretches that
    ``summaries.video_timelines`` finds, from a stream of hits (id, media_id, person_id, face_id, timestamp, confidence).

    The stream's time is that of the video. A stretch is told when the watermark has passed its last hit by more than
    ``gap``; hits that come later than ``late`` are dropped.
    """
    rows = hits.select("id", "media_id", "person_id", "face_id", F.col("timestamp").cast("double").alias("timestamp"), F.col("confidence").cast("double").alias("confidence"))
    rows = rows.withColumn("ts", F.timestamp_millis(F.floor(F.col("timestamp") * 1000) + START)).withWatermark("ts", late)
    return rows.groupBy("media_id", "person_id").transformWithState(statefulProcessor=Stretches(gap, 1000.0), outputStructType=STRETCHES, outputMode="Append", timeMode="EventTime")
