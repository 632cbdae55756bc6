"""A capture as it runs: windows that wait for the camera, and windows that are kept, sealed and handed on once.

camera_windows() is a stateful processor over two tagged streams of one session, the windows of the inertial trigger
and the camera's frames. Captures is the sink behind a stream of windows: whatever is written is keyed by the number of
the micro-batch, so that a batch that is made again after a failure replaces what it had written before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tempofuse.streaming.live import ready_windows

OUTPUT = "session long, window_id long, w0 double, w1 double, complete boolean, frames array<long>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which timers and lists of state need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class CameraWindows(StatefulProcessor):
    """State of a session, one value: frames that a window may still want, windows that wait, and how far the camera's
    clock is. It is read once and written once for all rows of a micro-batch, as each call costs a message to the store;
    a window that its first batch settles is neither stored nor timed.

    A window is cut when the camera's clock has passed its end. One that waits sets a timer, `patience` seconds after
    its end in event time; when that goes off the window gets the frames there are. Frames older than `keep` seconds
    before the camera's clock are let go, unless a window waits for them.
    """

    def __init__(self, margin: float, patience: float, keep: float):
        self.margin, self.patience, self.keep = margin, patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "clock double, ts array<double>, seqs array<bigint>, ids array<bigint>, starts array<double>, ends array<double>")

    def _held(self) -> tuple[float, list[tuple[float, int]], dict[int, tuple[float, float]]]:
        """The camera's clock, frames, and windows that wait."""
        held = self.held.get()
        if held is None:
            return float("-inf"), [], {}
        clock, ts, seqs, ids, starts, ends = held
        return clock, list(zip(ts, seqs, strict=True)), dict(zip(ids, zip(starts, ends, strict=True), strict=True))

    def _hold(self, clock: float, frames: list, waiting: dict) -> None:
        if clock == float("-inf") and not waiting:
            self.held.clear()
        else:
            columns = [float(t) for t, _ in frames], [int(s) for _, s in frames], list(waiting), [w0 for w0, _ in waiting.values()], [w1 for _, w1 in waiting.values()]
            self.held.update((clock, *columns))

    def _cut(self, key, windows: dict, complete: bool, frames: list) -> pd.DataFrame:
        placed = sorted(set(frames))
        ts = [t for t, _ in placed]
        near = [[s for _, s in placed[bisect_left(ts, w0 - self.margin) : bisect_right(ts, w1 + self.margin)]] for w0, w1 in windows.values()]
        n = len(windows)
        return pd.DataFrame({"session": [key[0]] * n, "window_id": list(windows), "w0": [w[0] for w in windows.values()], "w1": [w[1] for w in windows.values()], "complete": [complete] * n, "frames": near})

    def _deadline(self, w1: float) -> int:
        return int(round((w1 + self.patience) * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, frames, waiting = self._held()
        timed = set(waiting)
        for part in rows:
            window = part["window_id"].notna().to_numpy()
            ts = part["t"].to_numpy()[~window].tolist()
            frames += zip(ts, part["seq"].to_numpy()[~window].tolist(), strict=True)
            clock = max([clock, *ts])
            for window_id, w0, w1 in zip(*(part[c].to_numpy()[window].tolist() for c in ("window_id", "w0", "w1")), strict=True):
                waiting.setdefault(int(window_id), (float(w0), float(w1)))
        done = {k: w for k, w in waiting.items() if clock >= w[1]}
        if done:
            yield self._cut(key, done, True, frames)
        waiting = {k: w for k, w in waiting.items() if k not in done}
        for k, (_, w1) in waiting.items():
            if k not in timed:
                self.handle.registerTimer(max(self._deadline(w1), timerValues.getCurrentWatermarkInMs() + 1))
        least = min([clock - self.keep, *[w0 - self.margin for w0, _ in waiting.values()]])
        self._hold(clock, [(t, s) for t, s in frames if t >= least], waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock, frames, waiting = self._held()
        late = {k: w for k, w in waiting.items() if self._deadline(w[1]) <= expiredTimerInfo.getExpiryTimeInMs()}
        if late:
            yield self._cut(key, late, False, frames)
            self._hold(clock, frames, {k: w for k, w in waiting.items() if k not in late})

    def close(self) -> None:
        pass


def camera_windows(windows: DataFrame, camera: DataFrame, margin: float = 0.3, patience: float = 1.5, keep: float = 16.0, late: str = "5 seconds") -> DataFrame:
    """session, window_id, w0, w1, complete and frames (seq in order of time) of each window of one stream, with the
    frames of another from margin seconds before it to margin seconds after it.

    windows has session, window_id, w0, w1 (seconds) and ts; camera has session, seq, t (seconds) and ts. Both are
    streams, with ts their event time, which is t in seconds from 1970. Frames may be `late` behind the newest row of
    either stream. complete tells that the camera's clock passed the window's end; of a camera that is silent or later than
    that the window has what was there when all that may be late was in, `patience` seconds after its end. To be started
    within rocks_state().
    """
    none = lambda kind: F.lit(None).cast(kind)
    a = windows.select("session", "ts", "window_id", "w0", "w1", none("long").alias("seq"), none("double").alias("t"))
    b = camera.select("session", "ts", none("long").alias("window_id"), none("double").alias("w0"), none("double").alias("w1"), "seq", "t")
    both = a.unionByName(b).withWatermark("ts", late)
    return both.groupBy("session").transformWithStateInPandas(CameraWindows(margin, patience, keep), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


@dataclass
class Captures:
    """The folders of a capture, each with one part for each micro-batch: `windows` that were triggered, `seals` (up to
    when recorded segments are asked to be closed), and the `queue` of windows whose segments are all closed.

    A window goes into the queue once, with the first batch that finds it ready.
    """

    spark: SparkSession
    path: str
    slack: float = 0.02

    SCHEMAS = {"windows": "session long, window_id long, w0 double, w1 double", "seals": "session long, through double", "queue": "session long, window_id long, w0 double, w1 double, n_segments long"}

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """What all batches wrote, or those before a number."""
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(self.SCHEMAS[name] + ", batch long").parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was written yet
            rows = self.spark.createDataFrame([], self.SCHEMAS[name] + ", batch long")
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def persist(self, rows: DataFrame, number: int) -> None:
        """Windows and seals of a batch. A window that was there before is not taken again."""
        fresh = rows.select("session", "window_id", "w0", "w1").dropDuplicates(["session", "window_id"])
        self._write(fresh.join(self.read("windows", number), ["session", "window_id"], "left_anti"), "windows", number)
        done = self.spark.read.schema(self.SCHEMAS["windows"]).parquet(f"{self.path}/windows/batch={number}")
        self._write(done.groupBy("session").agg((F.max("w1") + self.slack).alias("through")), "seals", number)

    def queue(self, segments: DataFrame, bucket: float, number: int) -> None:
        """The windows that wait and whose segments (session, s0, s1, closed) are now all closed."""
        waiting = self.read("windows", number + 1).join(self.read("queue", number), ["session", "window_id"], "left_anti").select("session", "window_id", "w0", "w1")
        ready = ready_windows(waiting, segments, bucket).where("ready")
        self._write(ready.select("session", "window_id", "w0", "w1", F.col("n_segments").cast("long")), "queue", number)

    def sink(self, segments, bucket: float):
        """The function of foreachBatch; segments() gives the recorded segments as they are now."""

        def take(rows: DataFrame, number: int) -> None:
            self.persist(rows, number)
            self.queue(segments(), bucket, number)

        return take

    def run(self, windows: DataFrame, segments, bucket: float):
        """Take a stream of windows to the end of what is there now; a later call goes on from the same checkpoint."""
        query = windows.writeStream.foreachBatch(self.sink(segments, bucket)).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query
