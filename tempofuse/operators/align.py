"""Alignment of irregular streams: as-of neighbours, interpolation, gradients, islands, fills.

Streams are DataFrames with a session, a time and values. Every function shuffles once, on the session, whatever
number of values it carries; union and window stand in for an as-of join, so that no pair of rows is formed but the
one wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)
_ALL_AFTER = (Window.currentRow, Window.unboundedFollowing)


def asof(left: DataFrame, right: DataFrame, by: str = "session", t: str = "t", values: tuple[str, ...] = ("v",), prefix: tuple[str, str] = ("prev_", "next_")) -> DataFrame:
    """left with the last row of right at or before its time and the first at or after it: times and values.

    Of right rows of one time, the first in order of values counts. Sides without a row are null.
    """
    right = right.groupBy(by, t).agg(*[F.min(F.struct(*values)).alias("__r")])
    one = left.withColumns({"__side": F.lit(1), "__r": F.lit(None).cast(right.schema["__r"].dataType)})
    names = one.columns
    other = right.select(*[F.col(c) if c in (by, t, "__r") else (F.lit(0).alias(c) if c == "__side" else F.lit(None).cast(one.schema[c].dataType).alias(c)) for c in names])
    both = one.unionByName(other)
    hit = F.when(F.col("__side") == 0, F.struct(F.col(t).alias("t"), F.col("__r").alias("r")))
    before = Window.partitionBy(by).orderBy(t, "__side").rowsBetween(*_ALL_BEFORE)
    after = Window.partitionBy(by).orderBy(t, F.col("__side").desc()).rowsBetween(*_ALL_AFTER)
    found = both.withColumn("__p", F.last(hit, ignorenulls=True).over(before)).withColumn("__n", F.first(hit, ignorenulls=True).over(after)).where("__side = 1")
    out = {}
    for at, name in (("__p", prefix[0]), ("__n", prefix[1])):
        out[name + t] = F.col(f"{at}.t")
        for v in values:
            out[name + v] = F.col(f"{at}.r.{v}")
    return found.withColumns(out).select(*left.columns, *out)


def nearest_distance(t: str = "t") -> Column:
    """Distance to the nearer of the neighbours that asof() gave; null without any."""
    return F.least(F.col(t) - F.col("prev_" + t), F.col("next_" + t) - F.col(t))


def interpolated(v: str = "v", t: str = "t", hold: bool = True, most_gap: float | None = None) -> Column:
    """Value on the line between the neighbours that asof() gave. Outside, the edge's value if hold, else null; and null
    in a bracket that is longer than most_gap."""
    span = F.col("next_" + t) - F.col("prev_" + t)
    inner = F.col("prev_" + v) + (F.col("next_" + v) - F.col("prev_" + v)) * (F.col(t) - F.col("prev_" + t)) / F.when(span > 0, span).otherwise(1.0)
    if most_gap is not None:
        inner = F.when(span <= most_gap, inner)
    if hold:
        inner = F.when(F.col("prev_" + t).isNull(), F.col("next_" + v)).when(F.col("next_" + t).isNull(), F.col("prev_" + v)).otherwise(inner)
    return inner


def attach_forward(fixes: DataFrame, samples: DataFrame, by: str = "session", t: str = "t", key: str = "seq", value: str = "v") -> DataFrame:
    """samples with the fix that falls on each: a fix goes to the first sample at or after it; of many, the last stays."""
    ahead = asof(fixes.select(by, t, value), samples.select(by, t, F.col(key)), by, t, (key,))
    taken = ahead.where(F.col("next_" + key).isNotNull()).groupBy(by, F.col("next_" + key).alias(key)).agg(F.max(F.struct(F.col(t), F.col(value))).alias("__f"))
    return samples.join(taken, [by, key], "left").select(*[samples[c] for c in samples.columns], F.col(f"__f.{t}").alias("fix_" + t), F.col(f"__f.{value}").alias("fix_" + value))


def over_time(by: str | list[str] = "session", t: str = "t", tie: str = "seq") -> Window:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(t, tie)


def gradient(v: Column, t: Column, window, edge_order: int = 1) -> Column:
    """Derivative on uneven times: second order inside, one-sided at the edges; null for a lone row."""
    v0, v1, t0, t1 = F.lag(v).over(window), F.lead(v).over(window), F.lag(t).over(window), F.lead(t).over(window)
    back, ahead = t - t0, t1 - t
    inner = (back * back * v1 + (ahead * ahead - back * back) * v - ahead * ahead * v0) / (back * ahead * (back + ahead))
    first, last = (v1 - v) / ahead, (v - v0) / back
    if edge_order == 2:
        v2, t2, vm, tm = F.lead(v, 2).over(window), F.lead(t, 2).over(window), F.lag(v, 2).over(window), F.lag(t, 2).over(window)
        next_, prior = t2 - t1, t0 - tm
        first = F.coalesce(-(2 * ahead + next_) / (ahead * (ahead + next_)) * v + (ahead + next_) / (ahead * next_) * v1 - ahead / (next_ * (ahead + next_)) * v2, first)
        last = F.coalesce(back / (prior * (prior + back)) * vm - (prior + back) / (prior * back) * v0 + (2 * back + prior) / (back * (prior + back)) * v, last)
    return F.when(v0.isNull(), first).when(v1.isNull(), last).otherwise(inner)


def islands(df: DataFrame, most_gap: float, by: str = "session", t: str = "t", tie: str = "seq") -> DataFrame:
    """df with island: the number, from 0, of the run of rows without a longer gap that a row is in."""
    w = over_time(by, t, tie)
    cut = df.withColumn("__cut", F.when(F.col(t) - F.lag(t).over(w) > most_gap, 1).otherwise(0))
    return cut.withColumn("island", F.sum("__cut").over(w.rowsBetween(*_ALL_BEFORE)).cast("long")).drop("__cut")


def island_rate(df: DataFrame, most_gap: float, least_rows: int = 3, by: str = "session", t: str = "t", v: str = "v", tie: str = "seq") -> DataFrame:
    """df with island and rate: the gradient within each island, null in those of fewer rows or with a time twice."""
    inside, whole = over_time([by, "island"], t, tie), Window.partitionBy(by, "island")
    df = islands(df, most_gap, by, t, tie).withColumn("__step", F.col(t) - F.lag(t).over(over_time([by, "island"], t, tie)))
    good = (F.count("*").over(whole) >= least_rows) & (F.min("__step").over(whole) > 0)
    return df.withColumn("__good", good).withColumn("rate", F.when(F.col("__good"), gradient(F.col(v), F.col(t), inside, 2))).drop("__step", "__good")


def fill_missing(df: DataFrame, by: str = "session", t: str = "t", v: str = "v", tie: str = "seq", least: int = 2) -> DataFrame:
    """df with filled: v, or where null the line between its neighbours, edges held; null in sessions with fewer values."""
    w = over_time(by, t, tie)
    known = F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    df = df.withColumn("__p", F.last(known, ignorenulls=True).over(w.rowsBetween(*_ALL_BEFORE))).withColumn("__n", F.first(known, ignorenulls=True).over(w.rowsBetween(*_ALL_AFTER)))
    span = F.col("__n.t") - F.col("__p.t")
    line = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (F.col(t) - F.col("__p.t")) / F.when(span > 0, span).otherwise(1.0)
    enough = F.count(v).over(Window.partitionBy(by)) >= least
    return df.withColumn("filled", F.when(enough, F.coalesce(F.col(v), F.when(F.col("__p").isNull(), F.col("__n.v")).when(F.col("__n").isNull(), F.col("__p.v")).otherwise(line)))).drop("__p", "__n")


def box_mean(v: Column, size: int, window, row: Column, rows: Column) -> Column:
    """Moving mean over size rows, [i - size // 2, i + size - 1 - size // 2], mirrored at the edges with the edge row
    twice. row is the row's number from 0 and rows their number in its partition, at least size // 2."""
    left = size // 2
    total = None
    for j in range(-left, size - left):
        plain = v if j == 0 else (F.lag(v, -j).over(window) if j < 0 else F.lead(v, j).over(window))
        value = plain
        for k in range(abs(j)):  # rows so near the edge that row + j lies beyond it
            if j < 0:
                shift = (-(k + j) - 1) - k
                beyond = row == k
            else:
                shift = (2 * 1 - 1) - j + 2 * k
                beyond = rows - 1 - row == k
            mirror = v if shift == 0 else (F.lead(v, shift).over(window) if shift > 0 else F.lag(v, -shift).over(window))
            value = F.when(beyond, mirror).otherwise(value)
        total = value if total is None else total + value
    return total / size


def unwrapped(df: DataFrame, counter: str, by: str = "session", order: tuple[str, ...] = ("seq",), bits: int = 32) -> DataFrame:
    """df with unwrapped: a counter that starts over, made to go on; a fall of over half its range is a lap."""
    w = Window.partitionBy(by).orderBy(*order)
    laps = df.withColumn("__lap", F.when(F.col(counter) - F.lag(counter).over(w) < -(1 << (bits - 1)), 1).otherwise(0))
    return laps.withColumn("unwrapped", F.col(counter) + F.sum("__lap").over(w.rowsBetween(*_ALL_BEFORE)) * F.lit(1 << bits)).drop("__lap")


def merge_streams(*streams: DataFrame) -> DataFrame:
    """One stream of all rows, with columns that some lack as nulls."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def joint_grid(*streams: DataFrame, by: str = "session", t: str = "t") -> DataFrame:
    """The distinct times of all streams."""
    return merge_streams(*[s.select(by, t) for s in streams]).distinct()


def parabola_rate(v: str, window, row: Column, rows: Column, reach: int = 3) -> Column:
    """First derivative, per row, of the parabola through 2 * reach + 1 rows about each by least squares. The first and
    last `reach` rows of a partition are on the parabola of the first and last such rows; null in shorter partitions."""
    steps = range(-reach, reach + 1)
    squares = sum(k * k for k in steps)
    mean = squares / len(steps)
    curve = sum((k * k - mean) ** 2 for k in steps)

    def at(off: int) -> Column:
        return F.lead(v, off).over(window) if off > 0 else (F.lag(v, -off).over(window) if off < 0 else F.col(v))

    def rate(centre: int) -> Column:
        """The slope here of the parabola about the row that is `centre` rows on."""
        slope = sum((k * at(centre + k) for k in steps if k), F.lit(0.0)) / squares
        if not centre:
            return slope
        bend = sum(((k * k - mean) * at(centre + k) for k in steps), F.lit(0.0)) / curve
        return slope - 2 * centre * bend

    out = F.when(rows < len(steps), None)
    for k in range(reach):
        out = out.when(row == k, rate(reach - k)).when(rows - 1 - row == k, rate(k - reach))
    return out.otherwise(rate(0))
