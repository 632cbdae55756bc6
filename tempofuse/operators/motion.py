"""Measures of motion events from fused samples, with windows and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempofuse.functions.notes import MPH
from tempofuse.functions.vectors import angle_to_horizontal, cross, dot, unit
from tempofuse.operators.align import asof, interpolated, parabola_rate
from tempofuse.operators.segment import overlapping


def swing_measures(samples: DataFrame, events: DataFrame, early: float = 0.0025, about: float = 0.02, near_peak: float = 0.08) -> DataFrame:
    """One row an event: speeds, angle, times and whether they can be relied on.

    samples: session, event, t, speed (m/s), hand_speed, elevation (degrees of the motion's direction), rate (rad/s),
    valid. events: session, event, t_onset, t_peak, t_end, t_contact (null if none was sensed). Contact is the sensed
    one, else the time of the greatest valid speed, else the peak. With a sensed contact what holds at it is read
    `early` before. Speeds need a valid row there, five valid active rows and 80 % valid rows near the peak; the angle
    needs three valid rows within `about`.
    """
    active = F.col("t").between(F.col("t_onset"), F.col("t_end"))
    met = samples.join(events, ["session", "event"]).withColumn("active", active)
    whole = Window.partitionBy("session", "event")
    fastest = F.max(F.when(F.col("active") & F.col("valid"), F.struct("speed", (-F.col("t")).alias("back")))).over(whole)
    met = met.withColumn("contact", F.coalesce("t_contact", -fastest["back"], "t_peak"))
    met = met.withColumn("read_at", F.when(F.col("t_contact").isNotNull(), F.col("contact") - early).otherwise(F.col("contact")))
    # the last row not after the reading time, or the first of all
    met = met.withColumn("at", F.coalesce(F.max(F.when(F.col("t") <= F.col("read_at") + 1e-9, F.col("t"))).over(whole), F.min("t").over(whole)))
    here = F.col("t") == F.col("at")
    pre = F.col("t").between(F.col("t_onset"), F.col("at")) & F.col("valid")
    peak = F.col("active") & (F.abs(F.col("t") - F.col("t_peak")) <= near_peak)
    around = (F.abs(F.col("t") - F.col("at")) <= about) & F.col("valid")
    g = met.groupBy("session", "event").agg(
        F.first("contact").alias("t_contact"), F.first(F.col("t_contact").isNotNull()).alias("contact_sensed"), (F.first("contact") - F.first("t_onset")).alias("time_to_contact"),
        F.max(F.when(here, F.col("speed"))).alias("s"), F.max(F.when(pre, F.col("speed"))).alias("p"), F.max(F.when(pre, F.col("hand_speed"))).alias("h"), F.max(F.when(here & F.col("valid"), F.col("elevation"))).alias("a"),
        F.degrees(F.max(F.when(pre, F.col("rate")))).alias("peak_rate_dps"), F.bool_or(here & F.col("valid")).alias("ok"), F.count_if(F.col("active") & F.col("valid")).alias("n_valid"),
        F.avg(F.when(peak, F.col("valid").cast("double"))).alias("support"), F.avg(F.when(F.col("active"), F.col("valid").cast("double"))).alias("valid_fraction"), F.count_if(around).alias("n_around"),
    )
    sure = F.col("ok") & (F.col("n_valid") >= 5) & (F.coalesce("support", F.lit(0.0)) >= 0.8)
    angles = F.col("ok") & (F.col("n_around") >= 3)
    return g.select(
        "session", "event", *[F.when(sure, F.col(c) * MPH).alias(n) for c, n in (("s", "speed_mph"), ("p", "peak_speed_mph"), ("h", "peak_hand_mph"))], F.when(angles, F.col("a")).alias("path_angle_deg"),
        "time_to_contact", "peak_rate_dps", "t_contact", "contact_sensed", sure.alias("speed_reliable"), angles.alias("angles_reliable"), F.coalesce("valid_fraction", F.lit(0.0)).alias("valid_fraction"),
    )


def bridged(df: DataFrame, by: str = "session", t: str = "t", place: str = "x", velocity: str = "v", accel: str = "a", supported: str = "supported", tie: str = "seq") -> DataFrame:
    """df with bridge, bridge_velocity and estimated: places of unsupported rows, dead-reckoned from the last supported row
    by the trapezoid of acceleration (0 where either end has none) and drawn to the next supported row by a cubic that
    meets its place and velocity; before the first and after the last they are dead-reckoned only. Null without any
    support."""
    w = Window.partitionBy(by).orderBy(t, tie)
    known = F.when(F.col(supported), F.struct(F.col(t).alias("t"), F.col(place).alias("x"), F.col(velocity).alias("v"), F.col("__dv").alias("dv"), F.col("__dx").alias("dx")))
    dt = F.col(t) - F.lag(t).over(w)
    usable = F.coalesce(F.when(~F.isnan(accel), F.col(accel)), F.lit(None).cast("double"))
    df = df.withColumn("__a", usable).withColumn("__dt", F.coalesce(dt, F.lit(0.0))).withColumn("__step", F.coalesce((F.col("__a") + F.lag("__a").over(w)) / 2 * F.col("__dt"), F.lit(0.0)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # integrals of acceleration from the session's start: differences of these are those from any anchor
    df = df.withColumn("__dv", F.sum("__step").over(so_far))
    df = df.withColumn("__move", F.coalesce((F.col("__dv") + F.lag("__dv").over(w)) / 2 * F.col("__dt"), F.lit(0.0))).withColumn("__dx", F.sum("__move").over(so_far))
    df = df.withColumn("__p", F.last(known, ignorenulls=True).over(so_far)).withColumn("__n", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))

    def reckoned(anchor: str, to_t, to_dx):
        p = F.col(anchor)
        return p["x"] + (p["v"] - p["dv"]) * (to_t - p["t"]) + to_dx - p["dx"]

    ahead, back = reckoned("__p", F.col(t), F.col("__dx")), reckoned("__n", F.col(t), F.col("__dx"))
    span = F.col("__n.t") - F.col("__p.t")
    u = (F.col(t) - F.col("__p.t")) / F.when(span > 0, span).otherwise(1.0)
    miss = F.col("__n.x") - reckoned("__p", F.col("__n.t"), F.col("__n.dx"))
    slip = (F.col("__n.v") - (F.col("__p.v") - F.col("__p.dv") + F.col("__n.dv"))) * span
    draw = miss * u * u * (3 - 2 * u) + slip * u * u * (u - 1)
    value = F.when(F.col(supported), F.col(place)).when(F.col("__p").isNull(), back).when(F.col("__n").isNull(), ahead).otherwise(ahead + draw)
    going = lambda anchor: F.col(anchor)["v"] - F.col(anchor)["dv"] + F.col("__dv")
    turn = (miss * 6 * u * (1 - u) + slip * u * (3 * u - 2)) / F.when(span > 0, span).otherwise(1.0)
    speed = F.when(F.col(supported), F.col(velocity)).when(F.col("__p").isNull(), going("__n")).when(F.col("__n").isNull(), going("__p")).otherwise(going("__p") + turn)
    return df.withColumn("bridge", value).withColumn("bridge_velocity", speed).withColumn("estimated", ~F.col(supported)).drop("__a", "__dt", "__step", "__dv", "__move", "__dx", "__p", "__n")


def plane_tilt(path: DataFrame, by: tuple[str, ...] = ("session", "event"), axes: tuple[str, str, str] = ("x", "y", "z"), up: tuple[float, float, float] = (0.0, -1.0, 0.0), least: int = 3) -> DataFrame:
    """by, tilt_deg: the angle between up and the normal of the plane that lies closest to a path's points; null for fewer
    points. The second moments are an aggregate; only these reach Python, many groups at once."""
    moments = {f"m{i}{j}": F.covar_pop(axes[i], axes[j]) for i in range(3) for j in range(i, 3)}
    sums = path.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in moments.items()])
    up_ = np.array(up) / np.linalg.norm(up)

    @F.pandas_udf("double")
    def angle(m: pd.DataFrame) -> pd.Series:
        s = np.zeros((len(m), 3, 3))
        for i in range(3):
            for j in range(i, 3):
                s[:, i, j] = s[:, j, i] = m[f"m{i}{j}"]
        normal = np.linalg.eigh(s)[1][:, :, 0]
        return pd.Series(np.degrees(np.arccos(np.clip(np.abs(normal @ up_), 0, 1))))

    return sums.withColumn("tilt_deg", F.when(F.col("n") >= least, angle(F.struct(*moments)))).select(*by, "tilt_deg")


def turning_measures(fused: DataFrame, events: DataFrame, rate: float = 400.0, before: float = 0.005, sweet: float = 0.686, early: float = 0.0025) -> DataFrame:
    """One row an event: the greatest angular acceleration before contact, the tilt of the sweet spot's path, and the
    angles of the bar and of its motion at contact.

    fused: session, event, seq, t, the axis u*, place k*, velocity v* and world rate w* of the fused samples, with
    bar_elevation, elevation and supported. events: session, event, t_onset, t_contact. The angular acceleration is the
    slope of local parabolas of 15 ms; the path is that from onset to contact; angles are null without support.
    """
    w, whole = Window.partitionBy("session", "event").orderBy("t", "seq"), Window.partitionBy("session", "event")
    rows = fused.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(whole)})
    reach = max(5, round(0.015 * rate) | 1) // 2
    slope = [parabola_rate(c, w, F.col("__i"), F.col("__n"), reach) * rate for c in ("wx", "wy", "wz")]
    rows = rows.withColumn("__turn", F.sqrt(sum((c * c for c in slope[1:]), slope[0] * slope[0]))).join(events.select("session", "event", "t_onset", "t_contact"), ["session", "event"])
    at = F.coalesce(F.max(F.when(F.col("t") <= F.col("t_contact") - early + 1e-9, F.col("t"))).over(whole), F.min("t").over(whole))
    rows = rows.withColumn("__at", at)
    here = (F.col("t") == F.col("__at")) & F.col("supported")
    found = rows.groupBy("session", "event").agg(
        F.max(F.when(F.col("t").between(F.col("t_onset"), F.col("t_contact") - before), F.col("__turn"))).alias("peak_turn_accel"), F.max(F.when(here, F.col("bar_elevation"))).alias("bar_angle_deg"), F.max(F.when(here, F.col("elevation"))).alias("path_angle_deg")
    )
    path = rows.where(F.col("t").between(F.col("t_onset"), F.col("t_contact"))).select("session", "event", *[(F.col(f"k{a}") + sweet * F.col(f"u{a}")).alias(a) for a in "xyz"])
    return found.join(plane_tilt(path), ["session", "event"], "left")


def camera_angles(lines: DataFrame, events: DataFrame, up: tuple[float, float, float], sweet: float = 0.686, within: float = 0.02) -> DataFrame:
    """session, event, bar_angle_deg, path_angle_deg from the camera alone: the axis of the sight nearest to contact (and
    within `within`), and the direction of the sweet spot's motion, as the slope over the sights that near."""
    n = float(np.linalg.norm(up))
    up_ = tuple(F.lit(c / n) for c in up)
    spot = {f"__{a}": F.col(f"k_{a}") + sweet * F.col(f"u_{a}") for a in "xyz"}
    spans = events.select("session", "event", "t_contact", (F.col("t_contact") - within).alias("__c"), (F.col("t_contact") + within).alias("__d"))
    near = overlapping(lines.where("u_x is not null").withColumns({"__p": F.col("t"), "__q": F.col("t"), **spot}), spans, "session", ("__p", "__q"), ("__c", "__d"), 1.0)
    nearest = F.min_by(F.struct("u_x", "u_y", "u_z"), F.struct(F.abs(F.col("t") - F.col("t_contact")), "t"))
    g = near.groupBy("session", "event").agg(nearest.alias("u"), *[F.regr_slope(f"__{a}", "t").alias(f"v_{a}") for a in "xyz"])
    return g.select("session", "event", angle_to_horizontal(tuple(F.col(f"u.u_{a}") for a in "xyz"), up_).alias("bar_angle_deg"), angle_to_horizontal(tuple(F.col(f"v_{a}") for a in "xyz"), up_).alias("path_angle_deg"))


def guided_replay(samples: DataFrame, sights: DataFrame, most_gap: float, reach: float, by: str = "session", t: str = "t", tie: str = "seq", place: str = "x", accel: str = "a") -> DataFrame:
    """samples with guided, velocity, supported, bridge and estimated: a replay that follows the camera where it sees, and
    the inertial estimate elsewhere.

    The difference of a sight (session, t, place) from the samples' place is read at each sight and carried in between
    on straight lines, so that samples run through the sights. The velocity at a sight is the slope over sights within
    `reach`. Samples in a bracket of sights no longer than most_gap are supported; the others are bridged from the
    accelerations by bridged().
    """
    near = f"over (partition by `{by}` order by `{t}` range between {reach}D preceding and {reach}D following)"
    moving = sights.withColumn("__slope", F.expr(f"try_divide(covar_pop(`{place}`, `{t}`) {near}, var_pop(`{t}`) {near})"))
    own = asof(moving, samples, by, t, (place,)).withColumn("__off", F.col(place) - interpolated(place, t))
    met = asof(samples, own.select(by, t, F.col("__off").alias("off"), F.coalesce("__slope", F.lit(0.0)).alias("slope")), by, t, ("off", "slope"))
    span = F.col(f"next_{t}") - F.col(f"prev_{t}")
    met = met.withColumns({"guided": F.col(place) + F.coalesce(interpolated("off", t), F.lit(0.0)), "velocity": F.coalesce(interpolated("slope", t), F.lit(0.0)), "supported": F.coalesce(span <= most_gap, F.lit(False))})
    met = met.select(*samples.columns, "guided", "velocity", "supported")
    return bridged(met, by, t, "guided", "velocity", accel, "supported", tie)


_AXES = "xyz"


def _names(name: str) -> list[str]:
    return [f"{name}{a}" for a in _AXES]


def _with_arc(df: DataFrame, name: str, a, b) -> DataFrame:
    """df with the rotation vector (name x, y, z) of the shortest turn from one unit vector to the other; of opposite
    ones, half a turn about a normal. Parts are columns of their own, as expressions of expressions grow out of hand."""
    df = df.withColumns({f"__n{k}": c for k, c in zip(_AXES, cross(a, b), strict=True)} | {"__c": dot(a, b)})
    df = df.withColumn("__size", F.sqrt(F.col("__nx") * F.col("__nx") + F.col("__ny") * F.col("__ny") + F.col("__nz") * F.col("__nz")))
    steep = F.abs(a[0]) < 0.9
    normal = [F.when(steep, x).otherwise(y) for x, y in zip((F.lit(0.0), a[2], -a[1]), (-a[2], F.lit(0.0), a[0]), strict=True)]
    df = df.withColumns({f"__m{k}": c for k, c in zip(_AXES, normal, strict=True)})
    other = F.sqrt(F.col("__mx") * F.col("__mx") + F.col("__my") * F.col("__my") + F.col("__mz") * F.col("__mz"))
    df = df.withColumn("__k", F.when(F.col("__size") > 1e-12, F.atan2("__size", "__c") / F.col("__size")).when(F.col("__c") < 0, F.lit(np.pi) / other).otherwise(0.0))
    out = {f"{name}{k}": F.when((F.col("__size") > 1e-12) | (F.col("__c") > 0), F.col(f"__n{k}")).otherwise(F.col(f"__m{k}")) * F.col("__k") for k in _AXES}
    return df.withColumns(out).drop("__c", "__size", "__k", *[f"__{n}{k}" for n in "nm" for k in _AXES])


def _with_turned(df: DataFrame, name: str, by, v) -> DataFrame:
    """df with a vector (name x, y, z): v turned by a rotation vector."""
    df = df.withColumn("__th", F.sqrt(dot(by, by)))
    small = F.col("__th") < 1e-6
    df = df.withColumns({"__s0": F.cos("__th"), "__s1": F.when(small, 1.0).otherwise(F.sin("__th") / F.col("__th")), "__s2": F.when(small, 0.5).otherwise((1 - F.cos("__th")) / (F.col("__th") * F.col("__th"))), "__d": dot(by, v)})
    out = {f"{name}{k}": x * F.col("__s0") + c * F.col("__s1") + r * F.col("__d") * F.col("__s2") for k, x, c, r in zip(_AXES, v, cross(by, v), by, strict=True)}
    return df.withColumns(out).drop("__th", "__s0", "__s1", "__s2", "__d")


def camera_guided(samples: DataFrame, sights: DataFrame, most_gap: float = 0.06, reach: float = 0.04, by: str = "session", t: str = "t", tie: str = "seq") -> DataFrame:
    """samples with the pose of a replay: place rk*, velocity rv* and axis ru*, estimated, camera_distance and replay_accel.

    samples: session, seq, t, the end's place k*, velocity v*, the bar's axis u* and acceleration a* (null where it is
    not to be used), each in x, y, z; times of a session differ. sights: session, t, place p* and axis d* as the camera
    has them; of equal times the first in order of place counts, and those outside the samples' time or with nulls do not.

    Poses are found on the joint grid of both times. Between two sights no longer than most_gap apart the place goes
    straight and the axis along the shortest turn. Elsewhere the place is bridged from the accelerations, from and to the
    place and velocity at sights; a sight's velocity is the slope over the sights within `reach` that no longer gap parts
    it from, or the samples' own where it is alone. The axis is there the samples' axis, turned by a rotation vector that
    is the difference at each sight and goes straight between sights. A sample is estimated unless it is between two near
    sights or a sight is within half the usual step of it. Without a sight, poses are null.
    """
    v3 = lambda name, of="": tuple(F.col(of + c) for c in _names(name))
    named = lambda name, v: {f"{name}{a}": x for a, x in zip(_AXES, v, strict=True)}
    own, seen = [c for n in "kvua" for c in _names(n)], [c for n in "pd" for c in _names(n)]
    w = Window.partitionBy(by).orderBy(t, tie)
    spans = samples.select(by, t, (F.col(t) - F.lag(t).over(w)).alias("__step")).groupBy(by).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"), (F.median("__step") / 2 + 1e-8).alias("__near"))
    good = sights.select(by, t, *seen).dropna().groupBy(by, t).agg(F.min(F.struct(*seen)).alias("s")).select(by, t, "s.*").join(spans, by).where(F.col(t).between(F.col("__t0"), F.col("__t1"))).select(by, t, *seen)
    good = good.withColumns(named("d", unit(v3("d"))))

    # sights: what the samples have there, the turn to the seen axis, the neighbours, and the local velocity
    met = asof(good, samples, by, t, (tie, *own))
    x = (F.col(t) - F.col(f"prev_{t}")) / F.when(F.col(f"next_{t}") > F.col(f"prev_{t}"), F.col(f"next_{t}") - F.col(f"prev_{t}")).otherwise(1.0)
    met = met.withColumns({c: F.col(f"prev_{c}") + (F.col(f"next_{c}") - F.col(f"prev_{c}")) * x for c in own}).withColumn(tie, F.when(F.col(f"prev_{t}") == F.col(t), F.col(f"prev_{tie}")))
    met = met.select(by, t, tie, *own, *seen)
    met = met.withColumns(named("u", unit(v3("u"))))
    met = _with_arc(met, "r", v3("u"), v3("d"))
    order = Window.partitionBy(by).orderBy(t)
    met = met.withColumn("__cut", F.when(F.col(t) - F.lag(t).over(order) > most_gap, 1).otherwise(0)).withColumn("__run", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = f"over (partition by `{by}`, __run order by `{t}` range between {reach}D preceding and {reach}D following)"
    met = met.withColumns({f"v{a}": F.coalesce(F.expr(f"try_divide(covar_pop(p{a}, `{t}`) {near}, var_pop(`{t}`) {near})"), F.col(f"v{a}")) for a in _AXES})
    met = met.withColumns({"nt": F.lead(t).over(order), "lt": F.lag(t).over(order)} | {f"n{c}": F.lead(c).over(order) for c in seen} | {f"l{c}": F.lag(c).over(order) for c in _names("p")})

    # the joint grid: a sight takes the place of a sample of its time
    here = met.select(by, t, tie, *[F.col(f"p{a}").alias(f"k{a}") for a in _AXES], *[f"{n}{a}" for n in "vua" for a in _AXES], F.lit(True).alias("__sight"))
    joint = here.unionByName(samples.select(by, t, tie, *own, F.lit(False).alias("__sight")).join(here.where(f"`{tie}` is not null").select(by, tie), [by, tie], "left_anti"))
    marks = ["nt", "lt", *[f"r{a}" for a in _AXES], *seen, *[f"n{c}" for c in seen], *[f"l{c}" for c in _names("p")]]
    joint = asof(joint, met, by, t, tuple(marks))
    share = (F.col(t) - F.col(f"prev_{t}")) / F.when(F.col(f"next_{t}") > F.col(f"prev_{t}"), F.col(f"next_{t}") - F.col(f"prev_{t}")).otherwise(1.0)
    turn = {f"__r{a}": F.coalesce(F.col(f"prev_r{a}") + (F.col(f"next_r{a}") - F.col(f"prev_r{a}")) * share, F.col(f"prev_r{a}"), F.col(f"next_r{a}")) for a in _AXES}
    joint = _with_turned(joint.withColumns(turn | named("u", unit(v3("u")))), "ru", v3("__r"), v3("u"))
    for a in _AXES:
        joint = bridged(joint, by, t, f"k{a}", f"v{a}", f"a{a}", "__sight", t).withColumnsRenamed({"bridge": f"rk{a}", "bridge_velocity": f"rv{a}"}).drop("estimated")

    # between near sights: straight, and along the shortest turn
    ahead = F.coalesce(F.col("prev_nt") - F.col(f"prev_{t}") <= most_gap, F.lit(False))
    behind = F.coalesce((F.col(t) == F.col(f"prev_{t}")) & (F.col(t) - F.col("prev_lt") <= most_gap), F.lit(False))
    f = (F.col(t) - F.col(f"prev_{t}")) / (F.col("prev_nt") - F.col(f"prev_{t}"))
    joint = joint.withColumns({"__ahead": ahead, "__behind": behind, "__f": f})
    joint = _with_arc(joint, "__arc", v3("d", "prev_"), v3("nd", "prev_"))
    joint = _with_turned(joint.withColumns({c: F.col(c) * F.col("__f") for c in _names("__arc")}), "__on", v3("__arc"), v3("d", "prev_"))
    out = {}
    for a in _AXES:
        p, n, last = F.col(f"prev_p{a}"), F.col(f"prev_np{a}"), F.col(f"prev_lp{a}")
        out[f"rk{a}"] = F.when(F.col("__ahead"), p + (n - p) * F.col("__f")).otherwise(F.col(f"rk{a}"))
        out[f"rv{a}"] = F.when(F.col("__ahead"), (n - p) / (F.col("prev_nt") - F.col(f"prev_{t}"))).when(F.col("__behind"), (p - last) / (F.col(f"prev_{t}") - F.col("prev_lt"))).otherwise(F.col(f"rv{a}"))
        out[f"ru{a}"] = F.when(F.col("__ahead"), F.col(f"__on{a}")).otherwise(F.col(f"ru{a}"))
    distance = F.least(F.col(t) - F.col(f"prev_{t}"), F.col(f"next_{t}") - F.col(t))
    poses = joint.where(f"`{tie}` is not null").select(by, tie, *[c.alias(n) for n, c in out.items()], distance.alias("camera_distance"), (F.col("__ahead") | F.col("__behind") | F.col("__sight")).alias("__near_two"), F.col("ax").isNotNull().alias("__usable"))
    poses = poses.join(spans.select(by, "__near"), by).withColumn("estimated", ~(F.col("__near_two") | F.coalesce(F.col("camera_distance") <= F.col("__near"), F.lit(False))))
    poses = poses.withColumn("replay_accel", F.col("estimated") & F.col("__usable") & F.col("camera_distance").isNotNull())
    added = [f"{n}{a}" for n in ("rk", "rv", "ru") for a in _AXES]
    return samples.join(poses.select(by, tie, *added, "estimated", "camera_distance", "replay_accel"), [by, tie], "left").select(*samples.columns, *added, "estimated", "camera_distance", "replay_accel")
