"""Streams with state: device clocks, frames of bytes, events as they end, and windows over recorded segments.

Each stateful function keeps, of a session, only what later rows can still need, and takes the rows of a micro-batch in
order of seq. The same inputs in one batch or many give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempofuse.operators.segment import _events, overlapping
from tempofuse.sources.bytestreams import CheckedFrames, walk


def _rows(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(groups)).sort_values("seq", kind="stable")


def unwrapped_clock(stream: DataFrame, counter: str = "counter", bits: int = 32) -> DataFrame:
    """session, seq, unwrapped: a device clock that starts over, made to go on. A fall of over half its range is a lap;
    the state of a session is its last count and its laps."""

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _rows(groups)
        last, laps = state.get if state.exists else (None, 0)
        x = rows[counter].to_numpy(np.int64)
        step = np.diff(x, prepend=x[0] if last is None else last)
        laps_ = laps + np.cumsum(step < -(1 << (bits - 1)))
        state.update((int(x[-1]), int(laps_[-1])))
        yield pd.DataFrame({"session": key[0], "seq": rows["seq"], "unwrapped": x + (laps_ << bits)})

    return stream.select("session", "seq", counter).groupBy("session").applyInPandasWithState(run, "session long, seq long, unwrapped long", "last long, laps long", "append", GroupStateTimeout.NoTimeout)


def parsed_frames(stream: DataFrame, size: int = 30, sync: bytes = b"\x0f\xff", data: str = "data") -> DataFrame:
    """session, number, frame, skipped: frames of fixed size in each session's stream of bytes.

    A frame ends with the sync word, and so does the one after it; else the reader moves on by a byte. What is not yet
    followed by a whole frame waits for more: the state is the bytes left (under two frames) and the frames so far.
    """

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, number, skipped = state.get if state.exists else (b"", 0, 0)
        buffer, at, out = bytes(rest) + b"".join(bytes(x) for x in _rows(groups)[data]), 0, []
        while at + 2 * size <= len(buffer):
            if buffer[at + size - len(sync) : at + size] == sync and buffer[at + 2 * size - len(sync) : at + 2 * size] == sync:
                out.append((key[0], number, buffer[at : at + size], skipped))
                number, skipped, at = number + 1, 0, at + size
            else:
                at, skipped = at + 1, skipped + 1
        state.update((buffer[at:], number, skipped))
        yield pd.DataFrame(out, columns=["session", "number", "frame", "skipped"])

    return stream.select("session", "seq", data).groupBy("session").applyInPandasWithState(run, "session long, number long, frame binary, skipped long", "rest binary, number long, skipped long", "append", GroupStateTimeout.NoTimeout)


def parsed_checked_frames(stream: DataFrame, framing: CheckedFrames | None = None, clock: tuple[int, int] = (0, 4), data: str = "data") -> DataFrame:
    """session, number, payload, skipped: frames with a header and a check sum in each session's stream of bytes.

    clock is the place of the device clock in the payload: a frame whose clock is not ahead of the last one kept is
    dropped, as it was repeated or comes late. The bytes that may still begin a frame wait for more: the state is these
    (under a frame's length), the last clock kept, the frames found so far and the bytes passed over since the last.
    """
    framing = framing or CheckedFrames()
    size, head = framing.size, len(framing.header)

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, last, number, before = state.get if state.exists else (b"", None, 0, 0)
        buffer = bytes(rest) + b"".join(bytes(x) for x in _rows(groups)[data] if x is not None)
        end, out = 0, []
        for at in walk(framing.starts(np.frombuffer(buffer, dtype=np.uint8), len(buffer)), size):
            payload, skipped = buffer[at + head : at + size - 2], before + at - end
            tick = int.from_bytes(payload[clock[0] : clock[0] + clock[1]], "big")
            if last is None or 0 < (tick - last) % (1 << 8 * clock[1]) < 1 << (8 * clock[1] - 1):
                out.append((key[0], number, payload, skipped))
                last = tick
            number, before, end = number + 1, 0, at + size
        done = max(end, len(buffer) - size + 1, 0)
        state.update((buffer[done:], last, number, before + done - end))
        yield pd.DataFrame(out, columns=["session", "number", "payload", "skipped"])

    return stream.select("session", "seq", data).groupBy("session").applyInPandasWithState(run, "session long, number long, payload binary, skipped long", "rest binary, last long, number long, before long", "append", GroupStateTimeout.NoTimeout)


def live_events(stream: DataFrame, trigger: float, onset: float, quiet: float, hold: float, most: float, min_gap: float) -> DataFrame:
    """session, t_onset, t_peak, t_end, peak: the events of operators.segment.detect_events(), each as soon as it is
    over, of a stream of session, seq, t and signal.

    The state is the end of the last accepted event and the rows that an event to come may begin with: those since the
    last row at or below onset. An event that is not over at the end of the stream is not given.
    """

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_end, ts, xs = state.get if state.exists else (None, [], [])
        rows = _rows(groups)
        t, x = np.concatenate([np.array(ts, float), rows["t"].to_numpy(float)]), np.concatenate([np.array(xs, float), rows["signal"].to_numpy(float)])
        out, at = [], 0
        while True:
            above = np.flatnonzero(x[at:] > trigger)
            if not len(above):
                break
            i = at + int(above[0])
            done, over = _over(t[i:], x[i:], quiet, hold, most)
            if not over:
                break
            a, p, e = _events(t[at : i + done + 1], x[at : i + done + 1], x[at : i + done + 1] > trigger, x[at : i + done + 1] <= quiet, onset, hold, most, -np.inf)[0]
            a, p, e = at + a, at + p, at + e
            if last_end is None or t[a] - last_end >= min_gap:
                out.append((key[0], t[a], t[p], t[e], x[p]))
                last_end = float(t[e])
            # rows after the one that ended it may begin the next, whose onset may be before them
            keep = np.flatnonzero(x[: i + done + 1] <= onset)
            start = i + done + 1
            at = int(keep[-1]) if len(keep) else 0
            x[at:start] = np.minimum(x[at:start], trigger)  # what is over does not trigger again
        low = np.flatnonzero(x[at:] <= onset)
        waiting = np.flatnonzero(x[at:] > trigger)
        stop = at + int(waiting[0]) if len(waiting) else len(x)
        low = low[low + at <= stop]
        begin = at + int(low[-1]) if len(low) else at
        state.update((last_end, t[begin:].tolist(), x[begin:].tolist()))
        yield pd.DataFrame(out, columns=["session", "t_onset", "t_peak", "t_end", "peak"])

    ddl = "session long, t_onset double, t_peak double, t_end double, peak double"
    return stream.select("session", "seq", "t", "signal").groupBy("session").applyInPandasWithState(run, ddl, "last_end double, ts array<double>, xs array<double>", "append", GroupStateTimeout.NoTimeout)


def _over(t: np.ndarray, x: np.ndarray, quiet: float, hold: float, most: float) -> tuple[int, bool]:
    """The row by which an event that begins with the first row is known to be over, and whether it is."""
    low = x <= quiet
    begun = np.maximum.accumulate(np.where(low & ~np.concatenate([[False], low[:-1]]), np.arange(len(x)), 0))
    held = np.flatnonzero(low & (t - t[begun] >= hold) & (t < t[0] + most))
    late = np.flatnonzero(t >= t[0] + most)
    first = min([int(k[0]) for k in (held, late) if len(k)], default=-1)
    return first, first >= 0


def rows_in_windows(rows: DataFrame, windows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of one stream that fall in the windows of another (session, window_id, w0, w1, ts; ends count): either side
    waits as long as its watermark says, and no longer."""
    a = rows.withWatermark("ts", late).select(F.col("session").alias("row_session"), "seq", F.col("ts").alias("row_ts"))
    b = windows.withWatermark("ts", late)
    near = F.expr("session = row_session and row_ts between w0 and w1 and row_ts between ts - interval 1 day and ts + interval 1 day")
    return b.join(a, near).select("session", "window_id", "seq")


def ready_windows(windows: DataFrame, segments: DataFrame, bucket: float) -> DataFrame:
    """windows (session, window_id, w0, w1) with n_segments and ready: whether all recorded segments that a window
    overlaps are closed, and these go on to its end.

    segments: session, s0, s1, closed. A window without a segment yet is not ready.
    """
    met = overlapping(windows, segments, "session", ("w0", "w1"), ("s0", "s1"), bucket)
    found = met.groupBy("session", "window_id").agg(F.count("*").alias("n"), F.bool_and("closed").alias("c"), F.max("s1").alias("e"))
    out = windows.join(found, ["session", "window_id"], "left")
    return out.select(*windows.columns, F.coalesce("n", F.lit(0)).alias("n_segments"), F.coalesce(F.col("c") & (F.col("e") >= F.col("w1")), F.lit(False)).alias("ready"))


def complete_lines(text: Column, fields: int, header: bool = False) -> Column:
    """The whole lines of what has been read of a growing CSV file, as an array: not the last one, which may still grow,
    nor those with another number of fields."""
    lines = F.split(text, "\n", -1)
    whole = F.slice(lines, 2 if header else 1, F.greatest(F.size(lines) - (2 if header else 1), F.lit(0)))
    return F.filter(whole, lambda x: F.size(F.split(x, ",", -1)) == fields)
