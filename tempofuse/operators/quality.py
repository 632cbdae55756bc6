"""Quality of captures: clock lines, optical support, rigid geometry, spikes, gaps and audits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempofuse.operators.align import over_time


def clock_line(df: DataFrame, device: str, host: str, by: str = "session", low: float = 0.05) -> DataFrame:
    """One row a session: slope, intercept and lift. Host time is intercept + slope * device + lift, from the session's
    first times; lift is the given percentile of what the least squares line leaves, as batches arrive late only."""
    whole = Window.partitionBy(by)
    df = df.withColumn("__x", F.col(device) - F.min(device).over(whole)).withColumn("__y", F.col(host) - F.min(host).over(whole))
    line = df.groupBy(by).agg(F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"))
    rest = df.join(line, by).groupBy(by).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.percentile(F.col("__y") - (F.col("intercept") + F.col("slope") * F.col("__x")), low).alias("lift"))
    return rest


def on_clock_line(df: DataFrame, device: str, host: str, by: str = "session", low: float = 0.05) -> DataFrame:
    """df with slope, intercept and lift of its session's clock_line(), by windows over the session: rows are read and
    dealt once, not once for each step. Rows without a host time do not count; null where none has one."""
    w = Window.partitionBy(by)
    known = F.col(host).isNotNull()
    df = df.withColumns({"__x": F.when(known, F.col(device)) - F.min(F.when(known, F.col(device))).over(w), "__y": F.col(host) - F.min(host).over(w)})
    df = df.withColumns({"slope": F.regr_slope("__y", "__x").over(w), "intercept": F.regr_intercept("__y", "__x").over(w)})
    return df.withColumn("lift", F.percentile(F.col("__y") - (F.col("intercept") + F.col("slope") * F.col("__x")), low).over(w)).drop("__x", "__y")


def optical_support(samples: DataFrame, camera: DataFrame, most_gap: float, guard: float, by: str = "session", t: str = "t") -> DataFrame:
    """samples with supported: inside a bracket of camera times no longer than most_gap, and not within guard of a longer gap.

    Each sample looks at the camera times about it: its own bracket, and the long gaps that end or begin within guard.
    """
    from tempofuse.operators.align import asof

    w = Window.partitionBy(by).orderBy(t)
    times = camera.select(by, t).distinct().withColumn("__before", F.lag(t).over(w)).withColumn("__after", F.lead(t).over(w))
    met = asof(samples, times.select(by, t, "__before", "__after"), by, t, ("__before", "__after"))
    before, after = F.col("prev_" + t), F.col("next_" + t)
    bracketed = (after - before <= most_gap) | ((before == after) & ((before - F.col("prev___before") <= most_gap) | (F.col("next___after") - after <= most_gap)))
    # the nearest long gap on either side: the last start of one at or before, and the first end of one at or after
    gaps = times.where(F.col("__after") - F.col(t) > most_gap).select(by, F.col(t).alias("g0"), F.col("__after").alias("g1"))
    ends = asof(met, gaps.select(by, F.col("g1").alias(t), "g0"), by, t, ("g0",), ("gone_", "end_"))
    starts = asof(ends, gaps.select(by, F.col("g0").alias(t), "g1"), by, t, ("g1",), ("start_", "soon_"))
    held = (F.col("gone_" + t) >= F.col(t) - guard) | (F.col("soon_" + t) <= F.col(t) + guard) | (F.col("start_g1") >= F.col(t) - guard)
    return starts.select(*samples.columns, (F.coalesce(bracketed, F.lit(False)) & ~F.coalesce(held, F.lit(False))).alias("supported"))


def gap_flags(df: DataFrame, most_gap: float, by: str = "session", t: str = "t", tie: str = "seq") -> DataFrame:
    """df with after_gap: whether the row before is further off than most_gap."""
    return df.withColumn("after_gap", F.coalesce(F.col(t) - F.lag(t).over(over_time(by, t, tie)) > most_gap, F.lit(False)))


def gap_guarded(df: DataFrame, most_gap: float, guard: float, by: str = "session", t: str = "t", tie: str = "seq") -> DataFrame:
    """df with after_gap, and near_gap: whether a row is within guard of a longer gap between rows (or at its ends). A
    gap's rows invalidate accelerations, and those near it invalidate speeds."""
    w = over_time(by, t, tie)
    rows = gap_flags(df, most_gap, by, t, tie)
    rows = rows.withColumn("__opens", F.coalesce(F.lead("after_gap").over(w), F.lit(False)))
    ended = F.last(F.when(F.col("after_gap"), F.col(t)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    opens = F.first(F.when(F.col("__opens"), F.col(t)), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.coalesce(F.col(t) - ended <= guard, F.lit(False)) | F.coalesce(opens - F.col(t) <= guard, F.lit(False))
    return rows.withColumn("near_gap", near).drop("__opens")


def ringing(t: Column, contact: Column, before: float = 0.005, after: float = 0.05) -> Column:
    """Whether the impact of an event rings at a time; not without one."""
    return F.coalesce(t.between(contact - before, contact + after), F.lit(False))


def rigid_subset(present: dict[str, Column], places: dict[str, tuple[Column, Column, Column]], along: dict[str, float], least: float = 0.05, share: float = 0.2) -> dict[str, Column]:
    """For each marker of a wide frame, whether it is kept: the one largest set of markers whose distances fit those
    along the bar. Of several largest sets none is kept; a lone marker is."""
    ids = list(along)

    def fits(a: str, b: str) -> Column:
        want = abs(along[a] - along[b])
        d = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(places[a], places[b], strict=True)), F.lit(0.0)))
        return F.abs(d - want) <= max(least, share * want)

    subsets = {}
    for size in range(len(ids), 1, -1):
        subsets[size] = {}
        for some in combinations(ids, size):
            ok = F.lit(True)
            for m in some:
                ok = ok & present[m]
            for a, b in combinations(some, 2):
                ok = ok & fits(a, b)
            subsets[size][some] = F.coalesce(ok, F.lit(False))
    seen = sum((F.when(present[m], 1).otherwise(0) for m in ids), F.lit(0))
    numbers = {size: sum((F.when(ok, 1).otherwise(0) for ok in found.values()), F.lit(0)) for size, found in subsets.items()}
    kept = {}
    for m in ids:
        out = None
        for size, found in subsets.items():
            mine = F.lit(False)
            for some, ok in found.items():
                if m in some:
                    mine = mine | ok
            choice = F.when(numbers[size] == 1, mine).otherwise(False)
            out = F.when(numbers[size] > 0, choice) if out is None else out.when(numbers[size] > 0, choice)
        kept[m] = out.otherwise(present[m] & (seen < 2))
    return kept


def spike_flags(df: DataFrame, most_span: float, off: float, by: str | list[str], frame_index: str, t: str, axes: tuple[str, ...]) -> DataFrame:
    """df with spike: further than `off` from the line between the rows of the frames just before and after, where
    these are no more than most_span apart."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(frame_index)
    near = (F.lag(frame_index).over(w) == F.col(frame_index) - 1) & (F.lead(frame_index).over(w) == F.col(frame_index) + 1)
    t0, t1 = F.lag(t).over(w), F.lead(t).over(w)
    span = t1 - t0
    f = (F.col(t) - t0) / F.when(span > 0, span).otherwise(1.0)
    rest = None
    for a in axes:
        r = F.col(a) - ((1 - f) * F.lag(a).over(w) + f * F.lead(a).over(w))
        rest = r * r if rest is None else rest + r * r
    return df.withColumn("spike", F.coalesce(near & (span > 0) & (span <= most_span) & (F.sqrt(rest) > off), F.lit(False)))


def capture_quality(df: DataFrame, rate: float, by: str = "session", order: str = "seq", t: str = "t") -> DataFrame:
    """Audit of one capture a session: rows, span, effective rate, longest gap, times that do not rise, missing slots."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(by).orderBy(order))
    gaps = df.withColumn("__step", step)
    span = F.max(t) - F.min(t)
    return gaps.groupBy(by).agg(
        F.count("*").alias("n_frames"), span.alias("span"), ((F.count("*") - 1) / F.when(span > 0, span)).alias("effective_rate"), F.max("__step").alias("longest_gap"),
        F.count_if(F.col("__step") <= 0).alias("n_not_rising"), F.coalesce(F.sum(F.greatest(F.rint(F.col("__step") * rate).cast("long") - 1, F.lit(0))), F.lit(0)).alias("n_missing"),
    )


def bring_up(df: DataFrame, by: str = "session", order: str = "seq", t: str = "t", late: float = 1.5) -> DataFrame:
    """Rates of a stream: from the median and mean step, its 99th percentile, and steps of over `late` medians."""
    gaps = df.withColumn("__step", F.col(t) - F.lag(t).over(Window.partitionBy(by).orderBy(order)))
    middle = gaps.groupBy(by).agg(F.median("__step").alias("step"))
    return gaps.join(middle, by).groupBy(by).agg(
        (1 / F.first("step")).alias("rate"), (1 / F.avg("__step")).alias("mean_rate"), F.first("step").alias("median_step"), F.percentile("__step", 0.99).alias("p99_step"), F.max("__step").alias("longest_step"),
        F.count_if(F.col("__step") > late * F.col("step")).alias("n_late"), F.count_if(F.col("__step") <= 0).alias("n_not_rising"),
    )


def marker_summary(df: DataFrame, by: str = "session", t: str = "t", tie: str = "seq", seen: str = "seen") -> DataFrame:
    """Of a marker's rows: share seen, rows filled, and the longest stretch unseen, from the last sight before it (or the
    first row) to the first after it (or the last row); 0 if always seen."""
    w = over_time(by, t, tie)
    known = F.when(F.col(seen), F.col(t))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy(by)
    rows = df.withColumn("__gap", F.when(~F.col(seen), F.coalesce(after, F.max(t).over(whole)) - F.coalesce(before, F.min(t).over(whole))).otherwise(0.0))
    return rows.groupBy(by).agg(F.avg(F.col(seen).cast("double")).alias("seen_share"), F.count_if(~F.col(seen)).alias("n_filled"), F.max("__gap").alias("longest_gap"))


def merged_acceleration(low: tuple[Column, ...], high: tuple[Column, ...], low_full: float, high_full: float, margin: float = 0.95) -> tuple[tuple[Column, ...], Column]:
    """The low-range channel, or the high-range one where the low is near full scale; and whether either is usable."""
    clipped, usable = F.lit(False), F.lit(True)
    for a, b in zip(low, high, strict=True):
        clipped = clipped | (F.abs(a) >= margin * low_full)
        usable = usable & (F.abs(b) < margin * high_full)
    usable = F.coalesce(usable, F.lit(False))
    return tuple(F.when(clipped & usable, b).otherwise(a) for a, b in zip(low, high, strict=True)), ~clipped | usable
