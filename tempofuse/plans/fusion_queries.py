"""Queries of the whole chain of events, on streams that Spark derives from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofuse.operators import fusion, measures, motion
from tempofuse.operators.geometry import bar_line
from tempofuse.operators.labels import label_bands
from tempofuse.plans.base import SAMPLES, query
from tempofuse.plans.quality_queries import events_sql
from tempofuse.session import stored
from tempofuse.sources.tables import samples, stream_parts, swing_streams

UP = (0.0, -1.0, 0.0)


# the turning rates of the derived streams, their mean over four rows (mirrored at the ends), and the detector on it
_BAR = f"""{SAMPLES}, b AS (SELECT session, v, marker, row_number() OVER w - 1 AS k, CASE WHEN marker IN ('view', 'click') THEN 0e0 WHEN marker = 'error' THEN -least(v, 100e0) / 4 ELSE least(v, 100e0) / 4 END AS goal FROM s WINDOW w AS (PARTITION BY session ORDER BY seq)),
 d AS (SELECT session, k, goal, coalesce(lag(goal) OVER (PARTITION BY session ORDER BY k), 0) AS start FROM b), x AS (SELECT session, k * 16 + j AS r, abs(start + (goal - start) * (1 - cos(j * (3.141592653589793e0 / 16))) / 2) AS rate, count(*) OVER (PARTITION BY session) AS n FROM d, (SELECT unnest(range(16)) AS j) j),
 y AS (SELECT x.session, x.r, x.n, sum(z.rate) / 4 AS v FROM x, (SELECT unnest([-2, -1, 0, 1]) AS f) f JOIN x z ON z.session = x.session AND z.r = CASE WHEN x.r + f.f < 0 THEN -1 - x.r - f.f WHEN x.r + f.f >= x.n THEN 2 * x.n - 1 - x.r - f.f ELSE x.r + f.f END GROUP BY ALL),
 o AS (SELECT session, r * 0.0025e0 AS t, round(v, 9) AS v, r + 1 AS i, n, lag(round(v, 9)) OVER (PARTITION BY session ORDER BY r) AS p FROM y)"""


#: What swing_events() gives, for the tests: on larger tables it is too slow.
SWING_EVENTS_SQL = (
    events_sql(_BAR, 10, 4, 4, 0.1, 1.2, 1.5) + " SELECT session, row_number() OVER (PARTITION BY session ORDER BY t_onset, t_peak) - 1 AS event, t_onset, t_peak, t_end, NULL::DOUBLE AS t_contact, round(peak, 5) AS peak FROM f"
)


@query()
def swing_events(spark, d):
    """Events of each session's bar, by the full detector; held against SQL on the smallest tables in the tests."""
    return fusion.find_swings(swing_streams(spark, d)[0]).withColumn("peak", F.round("peak", 5))


@query()
def fused_events(spark, d):
    """Fused samples of every event; held against the known motion in the tests."""
    imu, markers, _ = swing_streams(spark, d)
    return fusion.fused_events(imu, markers, stored(fusion.find_swings(imu)), UP, parts=stream_parts(spark, d))


@query()
def fused_measures(spark, d):
    """Measures of every fused event, with those of turning and of the camera alone."""
    schema = f"session long, event long, {measures.MEASURES}, {measures.TURNING}, {measures.CAMERA}"
    imu, markers, _ = swing_streams(spark, d)
    return fusion.each_event(imu, markers, stored(fusion.find_swings(imu)), UP, measures.all_measures, schema, parts=stream_parts(spark, d))


@query()
def camera_orientation(spark, d):
    """Orientation of each session's bar from its sights alone; held against the known motion in the tests."""
    return fusion.camera_orientation(bar_line(swing_streams(spark, d)[1], ["session", "frame_id", "t"]))


@query(
    f"""WITH {SAMPLES}, k AS (SELECT session, seq, v, marker, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS k FROM s)
 SELECT session, ((k * 16 + j) // 3)::BIGINT AS frame_id, 'pink_' || b AS marker_id FROM k, (SELECT unnest(range(16)) AS j) j, (SELECT unnest([1, 2, 3]) AS b) b WHERE (k * 16 + j) % 3 = 0"""
)
def band_labels(spark, d):
    """Names given to the bands of every sight, which come without; all are known here."""
    markers = swing_streams(spark, d)[1]
    named = label_bands(markers.select("session", "frame_id", "t", "x", "y", "z"), ["pink_1", "pink_2", "pink_3"], [0.2, 0.4, 0.7], up=(-1.0, 0.0, 0.0))
    return named.select("session", "frame_id", "marker_id")


_BOTH = "ASOF LEFT JOIN {0} p ON p.session = l.session AND l.t >= p.t ASOF LEFT JOIN {0} n ON n.session = l.session AND l.t <= n.t"
_HELD = "CASE WHEN p.t IS NULL THEN n.{0} WHEN n.t IS NULL THEN p.{0} WHEN n.t > p.t THEN p.{0} + (n.{0} - p.{0}) * (l.t - p.t) / (n.t - p.t) ELSE p.{0} END"
_ROWS = "OVER (PARTITION BY session ORDER BY t, seq)"
_GUIDED = f"""WITH {SAMPLES}, own AS (SELECT session, seq, t, v / 10 AS x, v / 1000 AS a FROM s WHERE marker <> 'view'), ot AS (SELECT session, t, min(x) AS x FROM own GROUP BY ALL),
 sight AS (SELECT session, t, v / 10 AS x, var_pop(t) OVER w AS vt, covar_pop(v / 10, t) OVER w AS ct FROM s WHERE marker = 'view' WINDOW w AS (PARTITION BY session ORDER BY t RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
 off AS (SELECT l.session, l.t, l.x - {_HELD.format("x")} AS off, coalesce(CASE WHEN l.vt <> 0 THEN l.ct / l.vt END, 0) AS slope FROM sight l {_BOTH.format("ot")}), ft AS (SELECT session, t, min(struct_pack(off := off, slope := slope)) AS b FROM off GROUP BY ALL), fs AS (SELECT session, t, b.off AS off, b.slope AS slope FROM ft),
 g AS (SELECT l.*, l.x + coalesce({_HELD.format("off")}, 0) AS guided, coalesce({_HELD.format("slope")}, 0) AS velocity, coalesce(n.t - p.t <= 24, false) AS supported FROM own l {_BOTH.format("fs")}),
 d AS (SELECT *, coalesce(t - lag(t) {_ROWS}, 0) AS dt, coalesce((a + lag(a) {_ROWS}) / 2, 0) AS ma FROM g), e AS (SELECT *, sum(ma * dt) {_ROWS[:-1]} ROWS UNBOUNDED PRECEDING) AS dv FROM d), f AS (SELECT *, sum(coalesce((dv + lag_dv) / 2 * dt, 0)) {_ROWS[:-1]} ROWS UNBOUNDED PRECEDING) AS dx FROM (SELECT *, lag(dv) {_ROWS} AS lag_dv FROM e)),
 k AS (SELECT *, last_value(CASE WHEN supported THEN struct_pack(t := t, x := guided, v := velocity, dv := dv, dx := dx) END IGNORE NULLS) {_ROWS[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(CASE WHEN supported THEN struct_pack(t := t, x := guided, v := velocity, dv := dv, dx := dx) END IGNORE NULLS) {_ROWS[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM f),
 r AS (SELECT *, p.x + (p.v - p.dv) * (t - p.t) + dx - p.dx AS ahead, q.x + (q.v - q.dv) * (t - q.t) + dx - q.dx AS back, q.t - p.t AS span, CASE WHEN q.t > p.t THEN (t - p.t) / (q.t - p.t) ELSE t - p.t END AS u, q.x - (p.x + (p.v - p.dv) * (q.t - p.t) + q.dx - p.dx) AS miss, (q.v - (p.v - p.dv + q.dv)) * (q.t - p.t) AS slip FROM k)
 SELECT session, seq, round(guided, 4) + 0 AS guided, round(velocity, 4) + 0 AS velocity, supported, round(CASE WHEN supported THEN guided WHEN p IS NULL THEN back WHEN q IS NULL THEN ahead ELSE ahead + miss * u * u * (3 - 2 * u) + slip * u * u * (u - 1) END, 4) + 0 AS bridge,
 round(CASE WHEN supported THEN velocity WHEN p IS NULL THEN q.v - q.dv + dv WHEN q IS NULL THEN p.v - p.dv + dv ELSE p.v - p.dv + dv + (miss * 6 * u * (1 - u) + slip * u * (3 * u - 2)) / CASE WHEN span > 0 THEN span ELSE 1 END END, 4) + 0 AS bridge_velocity, NOT supported AS estimated FROM r"""


@query(_GUIDED)
def guided_replay(spark, d):
    """A replay that follows one kind of event where it is dense, and the estimate elsewhere."""
    s = samples(spark, d)
    own = s.where("marker <> 'view'").select("session", "seq", "t", (F.col("v") / 10).alias("x"), (F.col("v") / 1000).alias("a"))
    sights = s.where("marker = 'view'").select("session", "t", (F.col("v") / 10).alias("x"))
    out = motion.guided_replay(own, sights, 24.0, 12.0)
    return out.select("session", "seq", *[(F.round(c, 4) + 0.0).alias(c) for c in ("guided", "velocity")], "supported", *[(F.round(c, 4) + 0.0).alias(c) for c in ("bridge", "bridge_velocity")], "estimated")
