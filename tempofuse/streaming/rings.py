"""Triggered windows over streams, as stateful streaming operators; the same function runs on a batch.

A stream has session, seq, t and signal. A window opens where the signal passes the threshold from below, once the
time before is full, and holds what was within `before` of the trigger and `after` it. Rows that do not move the clock
on are dropped; a fall of the clock by over `reboot` starts the session anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session long, trigger_t double, t_first double, t_last double, n_before long, n_after long, n_gaps long, peak double, complete boolean"
STATE = "started double, last double, below boolean, trigger double, gaps long, ts array<double>, xs array<double>"


@dataclass
class Ring:
    """State of one session."""

    before: float
    after: float
    threshold: float
    most_gap: float
    reboot: float
    started: float | None = None
    last: float | None = None
    below: bool = False
    trigger: float | None = None
    gaps: int = 0
    ts: list[float] = field(default_factory=list)
    xs: list[float] = field(default_factory=list)

    def push(self, t: float, x: float) -> tuple | None:
        """Take a row; the window that it closes, if any."""
        out = None
        if self.last is not None and t < self.last - self.reboot:
            self.started = self.trigger = None
            self.below, self.gaps, self.ts, self.xs = False, 0, [], []
        elif self.last is not None and t <= self.last:
            return None
        if self.trigger is not None and t > self.trigger + self.after:
            out = self.close(True)
        if self.started is None:
            self.started = t
        elif self.last is not None and self.trigger is not None and t - self.last > self.most_gap:
            self.gaps += 1
        self.last = t
        self.ts.append(t), self.xs.append(x)
        if self.trigger is None:
            if x > self.threshold and self.below and t - self.started >= self.before:
                self.trigger, self.gaps = t, 0
            edge = (self.trigger if self.trigger is not None else t) - self.before
            keep = next((k for k, u in enumerate(self.ts) if u >= edge), len(self.ts))
            del self.ts[:keep], self.xs[:keep]
        self.below = x <= self.threshold
        return out

    def close(self, complete: bool) -> tuple:
        """The window as a row. What it had serves as the time before the next."""
        n = sum(t < self.trigger for t in self.ts)
        out = self.trigger, self.ts[0], self.ts[-1], n, len(self.ts) - n, self.gaps, max(self.xs), complete
        self.trigger, self.gaps, self.below = None, 0, self.xs[-1] <= self.threshold
        return out


@dataclass
class CountRing:
    """State of one session of a ring that counts rows: `before` rows before the trigger and `after` from it on.

    A step over most_gap, or a signal that is not a number, empties the ring, and a quiet row is needed before the next
    edge. The last rows of a window are the first of what comes before the next; a window that ends above the threshold
    waits for a quiet row.
    """

    before: int
    after: int
    threshold: float
    most_gap: float
    started: float | None = None
    last: float | None = None
    below: bool = False
    trigger: float | None = None
    gaps: int = 0
    ts: list[float] = field(default_factory=list)
    xs: list[float] = field(default_factory=list)

    def push(self, t: float, x: float) -> tuple | None:
        if self.last is not None and t <= self.last:
            return None
        if x != x or (self.last is not None and t - self.last > self.most_gap):
            self.gaps += 1
            self.trigger, self.below, self.ts, self.xs = None, False, [], []
            if x != x:
                self.last = t
                return None
        self.last = t
        if self.trigger is None and x > self.threshold and self.below and len(self.ts) >= self.before:
            self.trigger = t
            del self.ts[: len(self.ts) - self.before], self.xs[: len(self.xs) - self.before]
        self.ts.append(t), self.xs.append(x)
        self.below = x <= self.threshold
        if self.trigger is None:
            del self.ts[: -self.before], self.xs[: -self.before]
        elif len(self.ts) == self.before + self.after:
            return self.close(True)
        return None

    def close(self, complete: bool) -> tuple:
        out = self.trigger, self.ts[0], self.ts[-1], self.before, len(self.ts) - self.before, self.gaps, max(self.xs), complete
        self.trigger = None
        del self.ts[: -self.before], self.xs[: -self.before]
        return out


def _frame(session, found: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")][1:]
    out = pd.DataFrame(found, columns=names)
    out.insert(0, "session", session)
    return out


def ring_windows(df: DataFrame, before: float, after: float, threshold: float, most_gap: float, reboot: float = 0.5, silence_ms: int = 0, rows: bool = False) -> DataFrame:
    """Windows of each session, one row each, of a batch or a stream. With rows, before and after are numbers of rows.

    On a stream the state of a session is its ring alone. With silence_ms, a window whose session falls silent for so
    long is closed with what it has (complete is false); no rows are made up.
    """

    def fresh() -> Ring | CountRing:
        return CountRing(int(before), int(after), threshold, most_gap) if rows else Ring(before, after, threshold, most_gap, reboot)

    if not df.isStreaming:

        def batch(group: pd.DataFrame) -> pd.DataFrame:
            ring, found = fresh(), []
            for t, x in group.sort_values("seq", kind="stable")[["t", "signal"]].itertuples(index=False):
                if (w := ring.push(t, x)) is not None:
                    found.append(w)
            return _frame(group["session"].iloc[0], found)

        return df.select("session", "seq", "t", "signal").groupBy("session").applyInPandas(batch, OUTPUT)

    def live(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, found = fresh(), []
        if state.exists:
            ring.started, ring.last, ring.below, ring.trigger, ring.gaps, ts, xs = state.get
            ring.ts, ring.xs = list(ts), list(xs)
        if state.hasTimedOut:
            if ring.trigger is not None:
                found.append(ring.close(False))
            state.remove()
        else:
            rows = pd.concat(list(groups)).sort_values("seq", kind="stable")
            for t, x in rows[["t", "signal"]].itertuples(index=False):
                if (w := ring.push(t, x)) is not None:
                    found.append(w)
            state.update((ring.started, ring.last, ring.below, ring.trigger, ring.gaps, ring.ts, ring.xs))
            if silence_ms:
                state.setTimeoutDuration(silence_ms)
        yield _frame(key[0], found)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if silence_ms else GroupStateTimeout.NoTimeout
    return df.select("session", "seq", "t", "signal").groupBy("session").applyInPandasWithState(live, OUTPUT, STATE, "append", timeout)


def configured_rings(df: DataFrame, event, source: str = "gyro", rate: float = 400.0, silence_ms: int = 500) -> DataFrame:
    """Windows about the triggers of an inertial stream (session, seq, t, gx..gz, ax..az), with times and threshold from
    the settings of events: pre-roll before, the longest event and its hold after. The live trigger watches the raw
    signal, as a mean would come late."""
    from pyspark.sql import functions as F

    from tempofuse.operators.segment import trigger_signal

    gyro, accel = tuple(F.col(c) for c in ("gx", "gy", "gz")), tuple(F.col(c) for c in ("ax", "ay", "az"))
    rows = df.select("session", "seq", "t", trigger_signal(source, gyro, accel).alias("signal"))
    return ring_windows(rows, event.pre_roll, event.most + event.hold, event.trigger, 4.0 / rate, silence_ms=silence_ms if df.isStreaming else 0)
