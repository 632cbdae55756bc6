"""Lines of markers along a bar, camera pairing and replays, by frame."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bar_line(df: DataFrame, by: str | list[str] = "frame", s: str = "s", axes: tuple[str, ...] = ("x", "y", "z"), also: dict[str, Column] | None = None) -> DataFrame:
    """Per frame the bar through its markers: unit axis u_*, end k_* (where s is 0), n_markers. The axes are fitted each
    by least squares over s, whose mean is s_mean; the end is the mean of the markers moved back along the axis. Null with fewer than two
    places on the bar, or where the fit has no direction. also has more aggregates of a frame, by name."""
    also = also or {}
    keys = [by] if isinstance(by, str) else by
    fit = df.groupBy(*keys).agg(F.count("*").alias("n_markers"), F.avg(s).alias("__s"), *[F.avg(a).alias(f"__m{a}") for a in axes], *[F.regr_slope(a, s).alias(f"__v{a}") for a in axes], *[c.alias(n) for n, c in also.items()])
    size = F.sqrt(sum((F.col(f"__v{a}") * F.col(f"__v{a}") for a in axes[1:]), F.col(f"__v{axes[0]}") * F.col(f"__v{axes[0]}")))
    fit = fit.withColumn("__size", size).withColumn("__size", F.when(F.col("__size") >= 1e-6, F.col("__size")))
    out = {f"u_{a}": F.col(f"__v{a}") / F.col("__size") for a in axes}
    out |= {f"k_{a}": F.col(f"__m{a}") - F.col("__s") * F.col(f"__v{a}") / F.col("__size") for a in axes}
    return fit.withColumns(out).select(*keys, *out, "n_markers", F.col("__s").alias("s_mean"), *also)


def end_from_markers(df: DataFrame, lines: DataFrame, by: str = "frame", s: str = "s", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Mean over a frame's markers of the bar's end that each implies, given the frame's axis u_*; and their number."""
    met = df.join(lines.select(by, *[f"u_{a}" for a in axes]), by)
    return met.groupBy(by).agg(*[F.avg(F.col(a) - F.col(s) * F.col(f"u_{a}")).alias(f"end_{a}") for a in axes], F.count("*").alias("n_markers"))


def filled_markers(df: DataFrame, lines: DataFrame, by: str = "frame", s: str = "s", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """df with model_* (the place of each marker on its frame's bar) and residual, the distance to it."""
    met = df.join(lines, by)
    model = {f"model_{a}": F.col(f"k_{a}") + F.col(s) * F.col(f"u_{a}") for a in axes}
    rest = sum(((F.col(a) - model[f"model_{a}"]) * (F.col(a) - model[f"model_{a}"]) for a in axes), F.lit(0.0))
    return met.withColumns(model | {"residual": F.sqrt(rest)}).select(*df.columns, *model, "residual")


def assigned_pairs(left: DataFrame, right: DataFrame, by: str, most_off: float, places: int = 3) -> DataFrame:
    """One-to-one pairs of up to `places` unnamed points a side in each frame: the most pairs, then the fewest that are
    out of order from side to side, then the least row difference, then the first in order of place.

    left and right have by, place (1 to places), u and v; of points of one place the first in order of u and v counts. A
    pair needs v within most_off and a positive disparity. A frame becomes one row of all its points, and the few
    permutations are expressions over it: one shuffle, and no pairs as rows.
    """
    sides = left.select(by, F.lit("l").alias("side"), "place", "u", "v").unionByName(right.select(by, F.lit("r").alias("side"), "place", "u", "v"))
    point = lambda side, k: F.min(F.when((F.col("side") == side) & (F.col("place") == k), F.struct("u", "v"))).alias(f"{side}{k}")
    wide = sides.groupBy(by).agg(*[point(side, k) for side in "lr" for k in range(1, places + 1)])
    offs = {}
    for k in range(1, places + 1):
        for j in range(1, places + 1):
            l, r = F.col(f"l{k}"), F.col(f"r{j}")
            offs[k, j] = F.when((F.abs(l["v"] - r["v"]) <= most_off) & (l["u"] > r["u"]), F.abs(l["v"] - r["v"]))
    wide = wide.select(by, *[c.alias(f"o{k}{j}") for (k, j), c in offs.items()])
    tries = []
    for number, p in enumerate(permutations(range(1, places + 1))):
        pair = [F.when(F.col(f"o{k}{j}").isNotNull(), F.struct(F.lit(k).alias("left_place"), F.lit(j).alias("right_place"))) for k, j in enumerate(p, 1)]
        n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in pair), F.lit(0))
        off = sum((F.coalesce(F.col(f"o{k}{j}"), F.lit(0.0)) for k, j in enumerate(p, 1)), F.lit(0.0))
        turned = sum((F.when(pair[x].isNotNull() & pair[y].isNotNull(), 1).otherwise(0) for x in range(places) for y in range(x + 1, places) if p[x] > p[y]), F.lit(0))
        tries.append(F.struct((-n).alias("less"), turned.alias("turned"), F.round(off, 6).alias("off"), F.lit(number).alias("number"), F.array_compact(F.array(*pair)).alias("to")))
    return wide.select(by, F.array_min(F.array(*tries)).alias("best")).select(by, F.inline("best.to"))


def replay_source(supported: Column) -> Column:
    return F.when(supported, F.lit("camera_supported")).otherwise(F.lit("imu_estimate"))


def patch_median(df: DataFrame, centers: DataFrame, half: int, by: str, u: str = "u", v: str = "v", depth: str = "z") -> DataFrame:
    """Median of the finite depths in the square patch about each centre; null where there are none."""
    near = F.sequence(F.lit(-half), F.lit(half))
    patch = centers.withColumn("__du", F.explode(near)).withColumn("__dv", F.explode(near)).withColumn(u, F.col("cu") + F.col("__du")).withColumn(v, F.col("cv") + F.col("__dv"))
    got = patch.join(df.where(F.col(depth).isNotNull() & ~F.isnan(depth)), [by, u, v], "left")
    return got.groupBy(by, "cu", "cv").agg(F.median(depth).alias("depth"), F.count(depth).alias("n"))


def rows_newest(df: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("place") <= keep)


def most_collinear_three(df: DataFrame, by: str = "frame", place: str = "marker", axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """frame, a, b, c, off: of each frame the three points (by place, in order) that lie nearest to a line. off is the
    second singular value of the three about their mean, the third being none; of equal ones (to six digits) the first.

    A frame has a handful of points, which are gathered in one array; its triples are formed within the row.
    """
    point = F.struct(place, *axes)
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(point)).alias("__p")).where(F.size("__p") >= 3)
    n = F.size("__p") - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.flatten(F.transform(F.sequence(i + 1, n - 1), lambda j: F.transform(F.sequence(j + 1, n), lambda k: F.struct(F.get("__p", i).alias("a"), F.get("__p", j).alias("b"), F.get("__p", k).alias("c")))))))

    def spread(x: Column) -> Column:
        u, v = ([x[e][c] - x["a"][c] for c in axes] for e in "bc")
        d = [q - p for p, q in zip(u, v, strict=True)]
        total = sum((e * e for e in (*u, *v, *d)), F.lit(0.0)) / 3
        area = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        minor = sum((e * e for e in area), F.lit(0.0)) / 3
        return F.sqrt(F.greatest((total - F.sqrt(F.greatest(total * total - 4 * minor, F.lit(0.0)))) / 2, F.lit(0.0)))

    best = F.array_min(F.transform(pairs, lambda x: F.struct(F.round(spread(x), 6).alias("off"), x["a"][place].alias("a"), x["b"][place].alias("b"), x["c"][place].alias("c"))))
    return rows.select(by, best.alias("m")).select(by, "m.a", "m.b", "m.c", "m.off")


def least_of(df: DataFrame, by: str, cost: str, tie: str, n: int = 3) -> DataFrame:
    """The n rows of least cost of each group, with their place from 1."""
    order = Window.partitionBy(by).orderBy(cost, tie)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def posed_frames(df: DataFrame, model: DataFrame, by: list[str], order: str, marker: str = "marker", axes: tuple[str, str, str] = ("x", "y", "z"), least: int = 3) -> DataFrame:
    """Pose of each frame's points against a model of the bar: n, qw to qz, rms, and tx, ty, tz of the model's origin.

    model has marker, place (the order of names) and mx, my, mz: a handful of rows, which is broadcast. Of four or more
    known points all count, of three those; frames with fewer have none. Places are told from the anchor: the mean of
    the points of the session's first frame that has enough. by is the session and the frame, order the frame.
    """
    from tempofuse.operators.attitude import point_set_rotation

    met = df.join(F.broadcast(model), marker).withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where(F.col("__n") >= least)
    first = met.groupBy(by[0], order).agg(*[F.avg(a).alias(f"a{a}") for a in axes])
    anchor = first.groupBy(by[0]).agg(F.min_by(F.struct(*[f"a{a}" for a in axes]), order).alias("__a")).select(by[0], "__a.*")
    told = met.join(anchor, by[0]).withColumns({a: F.col(a) - F.col(f"a{a}") for a in axes}).withColumn("__key", F.struct(*by))
    turn = point_set_rotation(told, "__key", ("mx", "my", "mz"), axes, least)
    middle = told.groupBy("__key").agg(*[F.avg(c).alias(f"c{c}") for c in (*axes, "mx", "my", "mz")])
    from tempofuse.functions.vectors import rotate

    out = turn.join(middle, "__key")
    moved = rotate(tuple(F.col(c) for c in ("qw", "qx", "qy", "qz")), tuple(F.col(c) for c in ("cmx", "cmy", "cmz")))
    return out.select("__key.*", "n", "qw", "qx", "qy", "qz", "rms", *[(F.col(f"c{a}") - m).alias(f"t{a}") for a, m in zip(axes, moved, strict=True)])


#: Points a side that assigned_sets() takes: its states are the sets of points of one side.
MOST_PLACES = 8


def assigned_sets(left: DataFrame, right: DataFrame, by: str, most_off: float, places: int = MOST_PLACES) -> DataFrame:
    """assigned_pairs() for up to MOST_PLACES points a side: by, left_place, right_place.

    The best pairing has the most pairs, then the fewest that are out of order of place, then the least sum of row
    differences (each to six digits), then the first list of right places in order of left place, none last. Left points
    are taken in order; what counts of the pairs so far is the set of right points they took, so that the best of each
    set is all that is kept: 2^places states a frame, not places! pairings. Frames are worked on a batch at a time.
    """
    if places > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} places")
    point = lambda side, k: F.min(F.when((F.col("side") == side) & (F.col("place") == k), F.struct("u", "v"))).alias(f"{side}{k}")
    sides = left.select(by, F.lit("l").alias("side"), "place", "u", "v").unionByName(right.select(by, F.lit("r").alias("side"), "place", "u", "v"))
    wide = sides.groupBy(by).agg(*[point(side, k) for side in "lr" for k in range(1, places + 1)])
    off = []
    for k in range(1, places + 1):
        for j in range(1, places + 1):
            l, r = F.col(f"l{k}"), F.col(f"r{j}")
            gap = F.abs(l["v"] - r["v"])
            off.append(F.when((gap <= most_off) & (l["u"] > r["u"]), F.round(gap * 1e6).cast("long")).otherwise(-1))
    kind = dict(left.dtypes)[by]

    def run(batches):
        for batch in batches:
            off = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(places * places)], axis=1).reshape(-1, places, places)
            lists = best_pairing(off)
            frame, k = np.nonzero(lists)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(frame)), pa.array(k + 1, pa.int32()), pa.array(lists[frame, k], pa.int32())], names=[by, "left_place", "right_place"])

    return wide.select(by, *[c.alias(f"o{k}") for k, c in enumerate(off)]).mapInArrow(run, f"`{by}` {kind}, left_place int, right_place int")


def best_pairing(off: np.ndarray) -> np.ndarray:
    """The right place (from 1, 0 for none) of each left place, by off (frames, left, right), whole and -1 for no pair.

    Points without any pair are left out first, so that a frame costs as much as the points that it has. Frames of one
    size are worked together, a few at a time, as all their sets then fit a processor's cache.
    """
    may = off >= 0
    rows, columns = may.any(axis=2), may.any(axis=1)
    n_rows, n_columns = rows.sum(axis=1), columns.sum(axis=1)
    left, right = np.argsort(~rows, axis=1, kind="stable"), np.argsort(~columns, axis=1, kind="stable")
    out = np.zeros(off.shape[:2], dtype=np.int64)
    for l, r in np.unique(np.stack([n_rows, n_columns], axis=1), axis=0).tolist():
        if not l:
            continue
        same = np.flatnonzero((n_rows == l) & (n_columns == r))
        for k in range(0, len(same), 1 << max(16 - r, 6)):
            at = same[k : k + (1 << max(16 - r, 6))]
            a, b = left[at, :l], right[at, :r]
            lists = _best_of_sets(off[at[:, None, None], a[:, :, None], b[:, None, :]])
            out[at[:, None], a] = np.where(lists > 0, np.take_along_axis(b, np.maximum(lists - 1, 0), axis=1) + 1, 0)
    return out


def _best_of_sets(off: np.ndarray) -> np.ndarray:
    frames, n, m = off.shape
    pair, turned, never = 1 << 50, 1 << 44, 1 << 60  # a pair outweighs all inversions, and one of these all differences
    add = np.where(off >= 0, off - pair, never).transpose(1, 2, 0)
    cost = np.full((1 << m, frames), never, dtype=np.int64)
    cost[0] = 0
    order = np.zeros((1 << m, frames), dtype=np.int64)  # the right places so far, as digits; 9 for none
    for i in range(n):
        order *= 10
        next_cost, next_order = cost.copy(), order + 9
        for j in range(m):
            # sets without j and the same with it, by what they have above j and below
            shape = (1 << (m - 1 - j), 2, 1 << j, frames)
            above = np.array([bin(s).count("1") * turned for s in range(shape[0])])[:, None, None]
            c, d = cost.reshape(shape)[:, 0] + (add[i, j] + above), order.reshape(shape)[:, 0] + (j + 1)
            to_cost, to_order = next_cost.reshape(shape)[:, 1], next_order.reshape(shape)[:, 1]
            better = (c < to_cost) | ((c == to_cost) & (d < to_order) & (c < never >> 1))
            np.copyto(to_cost, c, where=better)
            np.copyto(to_order, d, where=better)
        cost, order = next_cost, next_order
    digits = np.where(cost == cost.min(axis=0), order, np.iinfo(np.int64).max).min(axis=0)
    lists = digits[:, None] // 10 ** np.arange(n - 1, -1, -1) % 10
    return np.where(lists == 9, 0, lists)


def predicted(df: DataFrame, by: tuple[str, ...] = ("session", "marker"), order: tuple[str, ...] = ("seq",), u: str = "u", v: str = "v") -> DataFrame:
    """df with lost, pred_u and pred_v: where a marker should be by its last sights, at a velocity that is their difference.

    Each row is a frame, with nulls where the marker was not seen. A marker is lost by a frame without it: the next
    frame has no prediction, and the one after a first sight expects it where it was. lost tells that a row's marker was
    not seen in the frame before.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    seen = lambda k: F.lag(F.col(u).isNotNull() & F.col(v).isNotNull(), k, False).over(w)
    ahead = lambda c: F.when(seen(1), F.lag(c, 1).over(w) + F.when(seen(2), F.lag(c, 1).over(w) - F.lag(c, 2).over(w)).otherwise(0))
    return df.withColumns({"lost": ~seen(1), "pred_u": ahead(u), "pred_v": ahead(v)})
