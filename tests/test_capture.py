"""Captures over several micro-batches: cameras that are late or silent, and sinks that are killed and start again."""

import datetime

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tempofuse.streaming import capture, flows

WINDOWS = "session long, window_id long, w0 double, w1 double, ts timestamp"
CAMERA = "session long, seq long, t double, ts timestamp"


def at(t):
    return datetime.datetime.fromtimestamp(t, datetime.UTC).replace(tzinfo=None)


def stream_of(spark, path, schema, batches):
    """A stream whose micro-batch k is batches[k]; a null time makes a batch that says nothing."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def cut(spark, tmp_path, windows, camera, **kw):
    with capture.rocks_state(spark):
        a, b = stream_of(spark, f"{tmp_path}/w", WINDOWS, windows), stream_of(spark, f"{tmp_path}/c", CAMERA, camera)
        rows = flows.drained(capture.camera_windows(a, b, **kw)).collect()
    assert len({(r.session, r.window_id) for r in rows}) == len(rows)
    return {(r.session, r.window_id): (r.complete, list(r.frames)) for r in rows}


def window(session, number, w0, w1):
    return session, number, w0, w1, at(w1)


def frame(session, t):
    return session, round(t * 10), t, at(t)


def test_a_window_waits_for_the_camera(spark, tmp_path):
    windows = [[window(1, 1, 100.0, 106.0)], [], [], []]
    camera = [[frame(1, t / 2) for t in range(180, 206)], [frame(1, 103.0 + t / 2) for t in range(3)], [frame(1, 104.5 + t / 2) for t in range(5)], [frame(1, 300.0)]]
    got = cut(spark, tmp_path, windows, camera)
    # it is cut when the frame of 106.0 s or later has come; margins are 0.3 s
    assert got == {(1, 1): (True, [round(t * 5) for t in range(200, 213)])}


def test_silent_and_late_cameras(spark, tmp_path):
    windows = [[window(1, 1, 100.0, 106.0), window(2, 7, 100.0, 106.0)], [window(1, 2, 200.0, 206.0)], [], [window(3, 1, 400.0, 406.0)], []]
    camera = [[frame(1, 101.0), frame(1, 105.0)], [frame(9, 206.0)], [frame(9, 207.0)], [frame(1, 206.0), frame(1, 205.0)], [frame(9, 500.0)]]
    got = cut(spark, tmp_path, windows, camera)
    assert got[1, 1] == (False, [1010, 1050])  # the camera was silent from 105 s on
    assert got[2, 7] == (False, [])  # there never was a camera
    assert got[1, 2] == (True, [2050, 2060])
    assert got[3, 1] == (False, []) and set(got) == {(1, 1), (2, 7), (1, 2), (3, 1)}


def test_frames_are_let_go_but_for_waiting_windows(spark, tmp_path):
    windows = [[], [window(1, 1, 100.0, 130.0)], [window(1, 2, 100.0, 129.0)], []]
    camera = [[frame(1, float(t)) for t in range(90, 121)], [frame(1, float(t)) for t in range(121, 126)], [frame(1, 131.0)], [frame(9, 500.0)]]
    got = cut(spark, tmp_path, windows, camera, keep=10.0, late="60 seconds")
    # of what came before a window only the last ten seconds are left; what came while one waited is all there
    assert got == {(1, 1): (True, [t * 10 for t in range(110, 126)]), (1, 2): (True, [t * 10 for t in range(110, 126)])}


def test_one_batch_is_the_interval_join(spark, tmp_path):
    windows = [[window(s, k, 50.0 * k, 50.0 * k + 6) for s in (1, 2) for k in range(1, 8)]]
    camera = [[frame(s, t / 4) for s in (1, 2) for t in range(0, 2000, s)]]
    got = cut(spark, tmp_path, windows, camera, keep=1e6)
    seqs = {s: [(t / 4, round(t / 4 * 10)) for t in range(0, 2000, s)] for s in (1, 2)}
    assert got == {(s, k): (True, [q for t, q in seqs[s] if 50 * k - 0.3 <= t <= 50 * k + 6.3]) for s in (1, 2) for k in range(1, 8)}


SEGMENTS = pd.DataFrame([(1, 0.0, 10.0, True), (1, 10.0, 20.0, True), (1, 20.0, 30.0, False), (2, 0.0, 40.0, True)], columns=["session", "s0", "s1", "closed"])


@pytest.fixture()
def triggered(spark, tmp_path):
    batches = [[window(1, 1, 2.0, 8.0), window(2, 1, 5.0, 11.0)], [window(1, 2, 12.0, 18.0), window(1, 1, 2.0, 8.0)], [window(1, 3, 18.0, 24.0)]]
    return stream_of(spark, f"{tmp_path}/w", WINDOWS, batches)


def rows_of(df):
    return sorted((r.session, r.window_id) for r in df.collect())


@pytest.mark.parametrize("dies", ["before", "windows", "queue"])
def test_killed_and_started_again(spark, tmp_path, triggered, monkeypatch, dies):
    held = capture.Captures(spark, f"{tmp_path}/held")
    segments = lambda: spark.createDataFrame(SEGMENTS)
    whole, failed = held.sink(segments, 20.0), []

    def sink(rows, number):
        if number == 1 and not failed:
            failed.append(number)
            if dies != "before":
                held.persist(rows, number)
            if dies == "queue":
                held.queue(segments(), 20.0, number)
            raise RuntimeError("killed")
        whole(rows, number)

    monkeypatch.setattr(held, "sink", lambda *_: sink)
    with pytest.raises(StreamingQueryException):
        held.run(triggered, segments, 20.0)
    held.run(triggered, segments, 20.0)
    assert failed and rows_of(held.read("windows")) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert rows_of(held.read("queue")) == [(1, 1), (1, 2), (2, 1)]
    assert {r.session: r.m for r in held.read("seals").groupBy("session").agg(F.max("through").alias("m")).collect()} == {1: 24.02, 2: 11.02}


def test_a_window_is_queued_when_its_segment_closes(spark, tmp_path, triggered):
    held, now = capture.Captures(spark, f"{tmp_path}/held"), [SEGMENTS]
    held.run(triggered, lambda: spark.createDataFrame(now[0]), 20.0)
    assert (1, 3) not in rows_of(held.read("queue"))
    now[0] = SEGMENTS.assign(closed=True)
    more = spark.createDataFrame([window(2, 2, 20.0, 26.0)], WINDOWS)
    more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/w/part=100")
    held.run(triggered, lambda: spark.createDataFrame(now[0]), 20.0)
    assert rows_of(held.read("queue")) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_a_session_costs_one_read_and_one_write(monkeypatch):
    calls = []

    class Held:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")

    class Handle:
        def getValueState(self, *_):
            return Held()

        def registerTimer(self, at):
            calls.append(at)

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    run = capture.CameraWindows(0.3, 1.5, 1e9)
    run.init(Handle())
    nothing = float("nan")
    windows = [(float(k), float(k), k + 2.0, nothing, nothing) for k in range(50)]
    frames = [(nothing, nothing, nothing, float(k), k / 2) for k in range(60)]
    rows = pd.DataFrame(windows + frames, columns=["window_id", "w0", "w1", "seq", "t"])
    out = pd.concat(list(run.handleInputRows((1,), iter([rows]), Timers())))
    # the clock is at 29.5 s: windows that end later wait, each with a timer, and the others were never stored
    assert out["window_id"].tolist() == list(range(28)) and out["complete"].all()
    assert out["frames"].iloc[3] == [6, 7, 8, 9, 10]
    assert calls[0] == "get" and calls[-1] == "update" and len(calls) == 2 + 22
