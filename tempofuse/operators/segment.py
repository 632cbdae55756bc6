"""Events in streams: triggers, spikes, merging, detection by hysteresis, and the choice among events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempofuse.operators.align import over_time

GRAVITY = 9.80665


def trigger_signal(source: str, gyro: tuple[Column, ...], accel: tuple[Column, ...]) -> Column:
    """The signal that a trigger watches: gyro, accel_mag, accel_xy, or a signed axis as accel_+x."""
    length = lambda v: F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))
    if source == "gyro":
        return length(gyro)
    if source == "accel_mag":
        return F.abs(length(accel) - GRAVITY)
    if source == "accel_xy":
        return length(accel[:2])
    if len(source) == 8 and source[:6] == "accel_" and source[6] in "+-" and source[7] in "xyz":
        axis = accel["xyz".index(source[7])]
        return axis if source[6] == "+" else -axis
    raise ValueError(f"no such trigger source: {source}")


def still(gyro: tuple[Column, ...], accel: tuple[Column, ...], most_rate: float = 1.5, most_off: float = 1.0) -> Column:
    length = lambda v: F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))
    return (F.abs(length(accel) - GRAVITY) < most_off) & (length(gyro) < most_rate)


def spikes(df: DataFrame, size: int, threshold: float, by: str = "session", t: str = "t", v: str = "v", tie: str = "seq") -> DataFrame:
    """Rows that stand off the centred median of `size` rows (odd) by over threshold; beyond a session's ends the edge
    row stands for those that are missing."""
    w, half = over_time(by, t, tie), size // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumns({"__w": F.collect_list(v).over(w.rowsBetween(-half, half)), "__i": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(by)), "__a": F.first(v).over(whole), "__b": F.last(v).over(whole)})
    padded = F.concat(F.array_repeat("__a", F.greatest(half + 1 - F.col("__i"), F.lit(0)).cast("int")), "__w", F.array_repeat("__b", F.greatest(half + F.col("__i") - F.col("__n"), F.lit(0)).cast("int")))
    return rows.where(F.abs(F.col(v) - F.array_sort(padded)[half]) > threshold).drop("__w", "__i", "__n", "__a", "__b")


def merged_events(df: DataFrame, pad: float, by: str = "session", start: str = "t0", end: str = "t1") -> DataFrame:
    """Intervals padded on both sides, with those that then touch as one: by, t0, t1, n_events."""
    w = Window.partitionBy(by).orderBy("__a", "__b")
    rows = df.select(by, (F.col(start) - pad).alias("__a"), (F.col(end) + pad).alias("__b"))
    rows = rows.withColumn("__cut", F.when(F.col("__a") > F.max("__b").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0))
    rows = rows.withColumn("__id", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "__id").agg(F.min("__a").alias("t0"), F.max("__b").alias("t1"), F.count("*").alias("n_events")).drop("__id")


def overlapping(left: DataFrame, right: DataFrame, by: str, a: tuple[str, str], b: tuple[str, str], bucket: float) -> DataFrame:
    """Pairs of intervals of a session that overlap (ends count). Both are dealt to the time buckets that they touch, so
    that the join is on equal keys, and a pair is kept in the bucket where the later of the two begins."""

    def dealt(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        return df.withColumn("__k", F.explode(F.sequence(F.floor(F.col(span[0]) / bucket), F.floor(F.col(span[1]) / bucket))))

    met = dealt(left, a).join(dealt(right, b), [by, "__k"])
    return met.where((F.col(b[1]) >= F.col(a[0])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("__k") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / bucket))).drop("__k")


def nearest_event(triggers: DataFrame, events: DataFrame, by: str, at: str, span: tuple[str, str], slack: float, key: list[str], bucket: float) -> DataFrame:
    """For each trigger (by, key, at) the event of its session that holds it (slack before its start counts), else that of
    the nearest end; of equal ones the earliest: cost, t0, t1.

    Events that hold a trigger are met by time buckets, and the nearest ends are the neighbours of an as-of join; no
    trigger meets all events of its session.
    """
    from tempofuse.operators.align import asof

    e = events.select(by, F.col(span[0]).alias("t0"), F.col(span[1]).alias("t1"))
    around = overlapping(triggers.withColumns({"__a": F.col(at), "__b": F.col(at)}), e.withColumns({"__c": F.col("t0") - slack, "__d": F.col("t1")}), by, ("__a", "__b"), ("__c", "__d"), bucket)
    inside = around.groupBy(by, *key).agg(F.min(F.struct("t0", "t1")).alias("__in"))
    ends = e.select(by, "t0", "t1", F.explode(F.array("t0", "t1")).alias(at))
    near = asof(triggers.select(by, *key, at), ends, by, at, ("t0", "t1")).join(inside, [by, *key], "left")
    side = lambda p, d: F.when(F.col(p + at).isNotNull(), F.struct(d.alias("cost"), F.col(p + "t0").alias("t0"), F.col(p + "t1").alias("t1")))
    held = F.when(F.col("__in").isNotNull(), F.struct(F.lit(0.0).alias("cost"), F.col("__in.t0").alias("t0"), F.col("__in.t1").alias("t1")))
    best = F.coalesce(held, F.least(side("prev_", F.col(at) - F.col("prev_" + at)), side("next_", F.col("next_" + at) - F.col(at))))
    return near.withColumn("__e", best).where("__e is not null").select(by, *key, "__e.cost", "__e.t0", "__e.t1")


def _candidates(df: DataFrame, above: Column, onset: Column, most: float, min_gap: float, by: str, t: str) -> DataFrame:
    """The rows that can matter to a detector, with __chunk: rows of different chunks cannot influence each other.

    An event ends at the latest at the first row that is `most` or more after its trigger. A row is idle where the signal
    is at or below the onset level and that row, for the last trigger before, is min_gap or more ago: the onset of an
    event to come is not before an idle row, so that the pause between the two is long enough whatever came before. A
    chunk is a run of rows that are not idle with the idle row before it, if it has a trigger. All this is windows; only
    chunks reach Python, each of a few events.
    """
    w = Window.partitionBy(by).orderBy(t)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__above", F.coalesce(above, F.lit(False)))
    rows = rows.withColumn("__last", F.last(F.when(F.col("__above"), F.col(t)), ignorenulls=True).over(so_far)).withColumn("__past", F.coalesce(F.col(t) - F.col("__last") >= most, F.lit(False)))
    rows = rows.withColumn("__first", F.col("__past") & ~F.coalesce(F.lag("__past").over(w), F.lit(False)))
    ended = F.last(F.when(F.col("__first"), F.col(t)), ignorenulls=True).over(so_far)
    rows = rows.withColumn("__idle", onset & (F.col("__last").isNull() | (F.col("__past") & (F.col(t) - ended >= min_gap)))).drop("__last", "__past", "__first")
    rows = rows.withColumn("__next", F.lead("__idle").over(w)).where(~F.col("__idle") | ~F.coalesce("__next", F.lit(True)))
    rows = rows.withColumn("__chunk", F.sum(F.col("__idle").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    whole = Window.partitionBy(by, "__chunk").orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("__any", F.max("__above").over(whole)).where("__any").drop("__next", "__any", "__idle")


def _events(times: np.ndarray, level: np.ndarray, above: np.ndarray, quiet: np.ndarray, onset: float, hold: float, most: float, min_gap: float) -> list[tuple[int, int, int]]:
    """(onset, peak, end) as row numbers, of accepted events: see detect_events()."""
    found, last_end, i, n = [], -np.inf, 0, len(times)
    starts = np.flatnonzero(above)
    begun = np.zeros(n, dtype=np.int64)  # where the quiet stretch that a row is in begins
    fresh = quiet & ~np.concatenate([[False], quiet[:-1]])
    np.maximum.accumulate(np.where(fresh, np.arange(n), 0), out=begun)
    low = np.maximum.accumulate(np.where(level <= onset, np.arange(n), 0))  # the last row at or below the onset level
    while (k := np.searchsorted(starts, i)) < len(starts):
        i = int(starts[k])
        stop = int(np.searchsorted(times, times[i] + most, side="left"))
        stretch = np.maximum(begun[i:stop], i)
        done = np.flatnonzero(quiet[i:stop] & (times[i:stop] - times[stretch] >= hold))
        if len(done):
            j = i + int(done[0])
            end = int(stretch[done[0]])
        else:
            j = stop
            end = int(stretch[-1]) if stop > i and quiet[stop - 1] else min(stop, n - 1)
        peak = i + int(np.argmax(level[i : max(i + 1, end + 1)]))
        back = int(low[min(i, peak)])
        if times[back] - last_end >= min_gap:
            found.append((back, peak, end))
            last_end = times[end]
        i = j + 1
    return found


def _each_chunk(rows: DataFrame, by: str, t: str, find, ddl: str) -> DataFrame:
    """The rows that find(chunk) gives of each chunk, in order of t. Chunks are many and small: a task reads them one after
    the other from sorted rows, and holds one batch and the chunk that it ends in. The windows that cut the chunks have
    dealt the rows by session and left them in this order, so that they are not shuffled again."""

    def run(batches):
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[[by, "__chunk"]]
            new = np.flatnonzero((keys[by].to_numpy()[1:] != keys[by].to_numpy()[:-1]) | (keys["__chunk"].to_numpy()[1:] != keys["__chunk"].to_numpy()[:-1])) + 1
            cuts = [0, *new.tolist()]
            found = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in find({c: v[a:b] for c, v in columns.items()})] if (columns := {c: rows[c].to_numpy() for c in rows}) else []
            rest = rows.iloc[cuts[-1] :]
            yield pd.DataFrame(found, columns=names).astype(kinds)
        if rest is not None and len(rest):
            yield pd.DataFrame(list(find({c: rest[c].to_numpy() for c in rest})), columns=names).astype(kinds)

    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {c.split()[0]: "float64" for c in ddl.split(", ") if c.split()[1] == "double"}
    return rows.sortWithinPartitions(by, "__chunk", t).mapInPandas(run, ddl)


def detect_events(df: DataFrame, trigger: float, onset: float, quiet: float, hold: float, most: float, min_gap: float, by: str = "session", t: str = "t", v: str = "v") -> DataFrame:
    """session, event, t_onset, t_peak, t_end, peak: events by hysteresis.

    An event opens where v passes trigger, and ends where v has stayed at or below quiet for `hold` (at the start of
    that stretch), or after `most`. Its onset is the last row at or below onset before it (else the first row); one
    that begins within min_gap of the end of the last accepted event is passed over. What is accepted depends on what
    was before, but not on what is beyond a long enough pause: sessions are cut there, so that neither a session nor
    its idle rows go through one task.
    """

    def find(c: dict) -> list[tuple]:
        times, x = c[t], c[v]
        return [(c[by][0], times[a], times[p], times[e], x[p]) for a, p, e in _events(times, x, c["__above"], x <= quiet, onset, hold, most, min_gap)]

    rows = _candidates(df.select(by, t, v), F.col(v) > trigger, F.col(v) <= onset, most, min_gap, by, t)
    found = _each_chunk(rows, by, t, find, f"session {dict(df.dtypes)[by]}, t_onset double, t_peak double, t_end double, peak double")
    return _numbered(found, ["t_onset", "t_peak", "t_end", "peak"])


def _numbered(found: DataFrame, columns: list[str]) -> DataFrame:
    number = (F.row_number().over(Window.partitionBy("session").orderBy("t_onset", "t_peak")) - 1).cast("long")
    return found.select("session", number.alias("event"), *columns)


def still_end(rate: Column, force: Column | None, most_rate: float = 4.0, most_off: float = 3.0) -> Column:
    """Whether the bar is held still at an event's end: a smoothed rate, and if given the smoothed distance of the
    specific force from gravity, at or below their bounds."""
    return rate <= most_rate if force is None else (rate <= most_rate) & (force <= most_off)


def nearest_padded_median(x: np.ndarray, size: int) -> np.ndarray:
    """Running medians of each column over `size` rows (odd), the edge rows repeated beyond the edges."""
    half = size // 2
    padded = np.pad(x, ((half, half), (0, 0)), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size, axis=0), axis=-1)


def detect_swings(
    imu: DataFrame, rate: float = 400.0, trigger_source: str = "gyro", trigger: float = 10.0, onset: float = 4.0, end_rate: float = 4.0, end_off: float | None = 3.0, hold: float = 0.1, most: float = 1.2, min_gap: float = 1.5, impact: float = 300.0,
    by: str = "session", t: str = "t", tie: str = "seq", impact_axes: tuple[str, str, str] = ("hx", "hy", "hz"),
) -> DataFrame:
    """session, event, t_onset, t_peak, t_end, t_contact, peak: events of a bar that is swung, in inertial rows.

    The trigger's signal, the rate and the distance of the specific force from gravity are means over 10, 10 and 20 ms;
    events then are those of detect_events(), with the peak in the rate and an end that needs the bar held still.
    t_contact is the first row of an event where the impact axes stand off their running median of 25 ms by more than
    impact; null without one. Sessions of under ten rows have no events.
    """
    from tempofuse.operators.align import box_mean

    w = over_time(by, t, tie)
    gyro, accel = tuple(F.col(c) for c in ("gx", "gy", "gz")), tuple(F.col(c) for c in ("ax", "ay", "az"))
    whole = Window.partitionBy(by)
    rows = imu.withColumns({"__row": F.row_number().over(w) - 1, "__rows": F.count("*").over(whole), "__rate": F.sqrt(sum((g * g for g in gyro[1:]), gyro[0] * gyro[0])), "__sig": trigger_signal(trigger_source, gyro, accel), "__off": trigger_signal("accel_mag", gyro, accel)})
    rows = rows.where(F.col("__rows") >= 10)
    short, long = max(1, round(rate * 0.01)), max(1, round(rate * 0.02))
    smooth = {"__rate": short, "__sig": short, "__off": long}
    # rounded, so that means that are equal but for the order of their sums are equal, and the first of them is the peak
    rows = rows.withColumns({c: F.round(box_mean(F.col(c), k, w, F.col("__row"), F.col("__rows")), 9) for c, k in smooth.items()})
    rows = rows.withColumn("__quiet", still_end(F.col("__rate"), F.col("__off") if end_off is not None else None, end_rate, end_off or 0.0))
    size = max(3, round(rate * 0.025) | 1)
    cut = _candidates(rows.select(by, t, "__rate", "__sig", "__quiet", *impact_axes), F.col("__sig") > trigger, F.col("__rate") <= onset, most, min_gap, by, t)

    def find(c: dict) -> list[tuple]:
        times, level, out = c[t], c["__rate"], []
        high = np.stack([c[x] for x in impact_axes], axis=1).astype(float)
        for a, p, e in _events(times, level, c["__above"], c["__quiet"], onset, hold, most, min_gap):
            part = high[a : e + 1]
            hit = np.flatnonzero(np.linalg.norm(part - nearest_padded_median(part, size), axis=1) > impact) if len(part) >= 3 else []
            out.append((c[by][0], times[a], times[p], times[e], times[a + hit[0]] if len(hit) else None, level[p]))
        return out

    found = _each_chunk(cut, by, t, find, f"session {dict(imu.dtypes)[by]}, t_onset double, t_peak double, t_end double, t_contact double, peak double")
    return _numbered(found, ["t_onset", "t_peak", "t_end", "t_contact", "peak"])


def events_in_view(events: DataFrame, sights: DataFrame, slack: float, triggers: DataFrame | None = None, by: str = "session", t: str = "t") -> DataFrame:
    """The event of each session that a capture is saved for: of those that overlap the camera's span, give or take the
    slack, the one nearest to the session's trigger (by, t), or without one that of the greatest peak (of equal ones
    the first)."""
    span = sights.groupBy(by).agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    near = events.join(span, by).where((F.col("t_end") >= F.col("__a") - slack) & (F.col("t_onset") <= F.col("__b") + slack)).drop("__a", "__b")
    far = F.lit(None).cast("double")
    if triggers is not None:
        near = near.join(triggers.select(by, F.col(t).alias("__t")), by, "left")
        far = F.when(F.col("__t").between(F.col("t_onset"), F.col("t_end")), 0.0).otherwise(F.least(F.abs(F.col("__t") - F.col("t_onset")), F.abs(F.col("__t") - F.col("t_end"))))
    order = Window.partitionBy(by).orderBy(far.asc_nulls_last(), F.col("peak").desc(), "t_onset")
    return near.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(*events.columns)
