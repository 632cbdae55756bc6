"""Time offset between streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(x: str, y: str) -> Column:
    """Pearson's correlation, as an aggregate; NaN where either side is constant, which F.corr() stops at."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    x_, y_ = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    return F.when(F.count_if(pair) > 0, F.coalesce(F.try_divide(F.covar_pop(x_, y_), F.stddev_pop(x_) * F.stddev_pop(y_)), F.lit(float("nan"))))


def best_lag(a: DataFrame, b: DataFrame, most_steps: int, least: int, by: str = "session", grid: str = "g") -> DataFrame:
    """session, lag_steps, correlation: the shift of b's grid against a's of greatest Pearson correlation.

    a has x and b has y at whole grid steps. Rows are dealt to blocks of most_steps, a's to the two about its own too, so
    that each row is shuffled three times at most, however many lags there are; a block's rows then meet in its task, and
    sums leave it. Lags of fewer than `least` pairs or of constant values do not count, and of equal correlations (to six
    places) the least lag wins.
    """
    width = max(most_steps, 1)
    block = F.floor(F.col(grid) / width)
    left = a.select(by, F.col(grid).alias("__ga"), "x", F.explode(F.array(block - 1, block, block + 1)).alias("__b"))
    right = b.select(by, F.col(grid).alias("__gb"), "y", block.alias("__b"))
    pairs = left.join(right, [by, "__b"]).withColumn("k", F.col("__gb") - F.col("__ga")).where(F.abs("k") <= most_steps)
    scored = pairs.groupBy(by, "k").agg(F.count("*").alias("n"), F.round(pearson("x", "y"), 6).alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    return scored.groupBy(by).agg(F.max(F.struct("r", (-F.col("k")).alias("k"))).alias("best")).select(by, (-F.col("best.k")).cast("int").alias("lag_steps"), F.col("best.r").alias("correlation"))


def zscore(v: str, window):
    """Distance from the mean in population deviations; a constant counts as having a deviation of 1."""
    spread = F.stddev_pop(v).over(window)
    return (F.col(v) - F.avg(v).over(window)) / F.when(spread > 0, spread).otherwise(1.0)


def full_lag(a: DataFrame, b: DataFrame, most_rows: int = 1 << 20, by: str = "session", t: str = "t", v: str = "v") -> DataFrame:
    """session, offset, step, n: what to add to b's times so that it lines up with a, by full cross-correlation.

    Both are read on a common grid of the smaller median step, in the span that both cover, less their means; of equal
    sums the least lag counts. A session is a recording of seconds to hours, one group; one whose grid would have more
    than most_rows points, as its step is too fine for its span, has a null offset and the number of points that it
    would take, and the other sessions go on. Sessions without a common span have no row.
    """

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = (d.sort_values(t).drop_duplicates(t) for d in (x, y))
        tx, ty = x[t].to_numpy(), y[t].to_numpy()
        names = [by, "offset", "step", "n"]
        if len(tx) < 2 or len(ty) < 2:
            return pd.DataFrame(columns=names)
        step, low, high = min(np.median(np.diff(tx)), np.median(np.diff(ty))), max(tx[0], ty[0]), min(tx[-1], ty[-1])
        if high <= low:
            return pd.DataFrame(columns=names)
        if (high - low) / step > most_rows:
            return pd.DataFrame([(key[0], None, float(step), int((high - low) / step))], columns=names)
        grid = np.arange(low, high, step)
        p, q = (np.interp(grid, u, d[v].to_numpy()) for u, d in ((tx, x), (ty, y)))
        size = 1 << int(np.ceil(np.log2(2 * len(grid))))
        sums = np.fft.irfft(np.fft.rfft(p - p.mean(), size) * np.conj(np.fft.rfft(q - q.mean(), size)), size)
        lags = np.concatenate([np.arange(-len(grid) + 1, 0), np.arange(len(grid))])
        sums = np.round(sums[lags], 9)
        return pd.DataFrame([(key[0], float(lags[int(np.argmax(sums))] * step), float(step), len(grid))], columns=names)

    kind = dict(a.dtypes)[by]
    own = [F.col(c).alias(c) for c in (by, t, v)]  # names of their own, as both sides may come from one table
    return a.select(by, t, v).groupBy(by).cogroup(b.select(*own).groupBy(by)).applyInPandas(run, f"{by} {kind}, offset double, step double, n long")


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| / a; null where a is zero or either is not a number."""
    off = F.try_divide(F.abs(a - b), a)
    return F.when(~F.isnan(off) & (F.abs(off) < float("inf")), off)
