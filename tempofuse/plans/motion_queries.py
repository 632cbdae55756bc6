"""Queries on curves, attitude and measures of motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempofuse.operators import attitude, curves, motion, scans
from tempofuse.operators import segment as S
from tempofuse.plans.base import SAMPLES, query
from tempofuse.sources.tables import samples, vectors


@query(
    f"""WITH {SAMPLES}, l AS (SELECT session, seq, t FROM s WHERE marker = 'view'), r AS (SELECT session, t, min(v) AS v FROM s WHERE marker = 'click' GROUP BY ALL),
 a AS (SELECT *, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, (v - lag(v) OVER w) / (t - lag(t) OVER w) AS d0, (lead(v) OVER w - v) / (lead(t) OVER w - t) AS d1 FROM r WINDOW w AS (PARTITION BY session ORDER BY t)),
 b AS (SELECT *, lead(h1) OVER w AS hn, lead(d1) OVER w AS dn, lag(h0) OVER w AS hp, lag(d0) OVER w AS dp FROM a WINDOW w AS (PARTITION BY session ORDER BY t)),
 e AS (SELECT *, ((2*h1 + hn)*d1 - h1*dn)/(h1 + hn) AS mf, ((2*h0 + hp)*d0 - h0*dp)/(h0 + hp) AS ml FROM b),
 m AS (SELECT session, t, v, CASE WHEN h0 IS NULL THEN CASE WHEN dn IS NULL THEN d1 WHEN sign(mf) <> sign(d1) THEN 0 WHEN sign(d1) <> sign(dn) AND abs(mf) > 3*abs(d1) THEN 3*d1 ELSE mf END
  WHEN h1 IS NULL THEN CASE WHEN dp IS NULL THEN d0 WHEN sign(ml) <> sign(d0) THEN 0 WHEN sign(d0) <> sign(dp) AND abs(ml) > 3*abs(d0) THEN 3*d0 ELSE ml END
  WHEN d0*d1 <= 0 THEN 0 ELSE (3*h1 + 3*h0) / ((2*h1 + h0)/d0 + (h1 + 2*h0)/d1) END AS m FROM e),
 k AS (SELECT l.session, l.seq, l.t, p.t AS pt, p.v AS pv, p.m AS pm, n.t AS nt, n.v AS nv, n.m AS nm FROM l ASOF LEFT JOIN m p ON l.session = p.session AND l.t >= p.t ASOF LEFT JOIN m n ON l.session = n.session AND l.t <= n.t), x AS (SELECT *, nt - pt AS h, (t - pt) / (nt - pt) AS x FROM k)
 SELECT session, seq, round(CASE WHEN h > 0 THEN (1 + 2*x)*(1 - x)*(1 - x)*pv + x*(1 - x)*(1 - x)*h*pm + x*x*(3 - 2*x)*nv + x*x*(x - 1)*h*nm WHEN h = 0 THEN pv END, 5) AS value FROM x"""
)
def monotone_cubic(spark, d):
    """Shape-preserving cubic of one stream at another's times."""
    s = samples(spark, d)
    right = s.where("marker = 'click'").groupBy("session", "t").agg(F.min("v").alias("v"))
    return curves.monotone_interpolated(s.where("marker = 'view'").select("session", "seq", "t"), right).select("session", "seq", F.round("value", 5).alias("value"))


# the band of a spline's second derivatives is taken apart going up and solved going down, one knot of all sessions at a time
_SPLINE = f"""WITH RECURSIVE {SAMPLES}, u AS (SELECT * FROM (SELECT session, t, min(seq) AS seq, arg_min(v, seq) AS v FROM s GROUP BY session, t) QUALIFY count(*) OVER (PARTITION BY session) >= 6), o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY session) AS n, lead(t) OVER w - t AS h, lead(t, 2) OVER w - lead(t) OVER w AS h1, v AS y0, lead(v) OVER w AS y1, lead(v, 2) OVER w AS y2 FROM u WINDOW w AS (PARTITION BY session ORDER BY t)),
 q AS (SELECT *, 1 / h AS q0, -1 / h - 1 / h1 AS q1, 1 / h1 AS q2 FROM o WHERE k <= n - 2), b AS (SELECT session, k, n, q0, q1, q2, (h + h1) / 3 + 50 * (q0*q0 + q1*q1 + q2*q2) AS d0, h1 / 6 + 50 * (q1 * lead(q0) OVER w + q2 * lead(q1) OVER w) AS e0, 50 * q2 * lead(q0, 2) OVER w AS f0, q0*y0 + q1*y1 + q2*y2 AS r FROM q WINDOW w AS (PARTITION BY session ORDER BY k)),
 up(session, k, d, e, f, x, d1, f1, x1) AS (SELECT session, k, d0, e0, f0, r, 1e0, 0e0, 0e0 FROM b WHERE k = 1 UNION ALL
  SELECT b.session, b.k, b.d0 - up.e * up.e / up.d - up.f1 * up.f1 / up.d1, b.e0 - up.e * up.f / up.d, b.f0, b.r - up.e / up.d * up.x - up.f1 / up.d1 * up.x1, up.d, up.f, up.x FROM up JOIN b ON b.session = up.session AND b.k = up.k + 1),
 down(session, k, g, g1) AS (SELECT up.session, up.k, x / d, 0e0 FROM up JOIN (SELECT session, max(k) AS k FROM b GROUP BY session) m ON m.session = up.session AND m.k = up.k UNION ALL SELECT up.session, up.k, up.x / up.d - up.e / up.d * down.g - coalesce(up.f, 0) / up.d * down.g1, down.g FROM down JOIN up ON up.session = down.session AND up.k = down.k - 1),
 g AS (SELECT o.session, o.seq, o.k, o.n, o.h, o.v - 50 * (coalesce(a.q0 * x.g, 0) + coalesce(b1.q1 * y.g, 0) + coalesce(c.q2 * z.g, 0)) AS fit, coalesce(y.g, 0) AS bend FROM o LEFT JOIN b a ON a.session = o.session AND a.k = o.k LEFT JOIN down x ON x.session = o.session AND x.k = o.k LEFT JOIN b b1 ON b1.session = o.session AND b1.k = o.k - 1 LEFT JOIN down y ON y.session = o.session AND y.k = o.k - 1 LEFT JOIN b c ON c.session = o.session AND c.k = o.k - 2 LEFT JOIN down z ON z.session = o.session AND z.k = o.k - 2)
 SELECT session, seq, round(fit, 4) + 0 AS value, round(CASE WHEN k < n THEN (lead(fit) OVER w - fit) / h - h * (2 * bend + lead(bend) OVER w) / 6 ELSE (fit - lag(fit) OVER w) / lag(h) OVER w + lag(h) OVER w * (lag(bend) OVER w + 2 * bend) / 6 END, 4) + 0 AS slope FROM g WINDOW w AS (PARTITION BY session ORDER BY k)"""


@query(_SPLINE)
def smoothing_spline(spark, d):
    """Spline of each session, of one penalty."""
    return curves.smoothed(samples(spark, d), 50.0).withColumns({c: F.round(c, 4) + 0.0 for c in ("value", "slope")})


# one row of all islands at a time: forwards the prediction (p, w with covariance a, b, c) and what a sight makes of it, backwards the smoothing
_TRACK = f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT session, seq, t, CASE WHEN marker <> 'error' THEN v END AS v, CASE WHEN t - lag(t) OVER w > 24 THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)), i AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY t, seq)::BIGINT AS island FROM o),
 k AS (SELECT *, row_number() OVER w AS k, coalesce(t - lag(t) OVER w, 0) AS h, count(v) OVER (PARTITION BY session, island) AS known, first_value(v IGNORE NULLS) OVER (PARTITION BY session, island ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v0 FROM i WINDOW w AS (PARTITION BY session, island ORDER BY t, seq)), z AS (SELECT * FROM k WHERE known >= 3),
 fwd(session, island, k, p, w, a, b, c, x, y, pa, pb, pc, refused) AS (
  SELECT session, island, 0::BIGINT, 0e0, 0e0, 0e0, 0e0, 0e0, v0, 0e0, 25e0, 0e0, 2e0, 0 FROM z WHERE k = 1 UNION ALL
  SELECT session, island, k, p, w, a, b, c, CASE WHEN used THEN p + a / (a + 25) * (v - p) ELSE p END, CASE WHEN used THEN w + b / (a + 25) * (v - p) ELSE w END, CASE WHEN used THEN a - a * a / (a + 25) ELSE a END, CASE WHEN used THEN b - a * b / (a + 25) ELSE b END, CASE WHEN used THEN c - b * b / (a + 25) ELSE c END, refused + (v IS NOT NULL AND NOT used)::INT
  FROM (SELECT *, coalesce((v - p) * (v - p) / (a + 25) < 50, false) AS used FROM (SELECT z.session, z.island, z.k, z.v, x + h * y AS p, y AS w, pa + 2 * h * pb + h * h * pc + h * h * h * h AS a, pb + h * pc + 2 * h * h * h AS b, pc + 4 * h * h AS c, refused FROM fwd JOIN z ON z.session = fwd.session AND z.island = fwd.island AND z.k = fwd.k + 1))),
 bwd(session, island, k, x, y) AS (SELECT session, island, k, x, y FROM fwd QUALIFY row_number() OVER (PARTITION BY session, island ORDER BY k DESC) = 1 UNION ALL
  SELECT session, island, k, x0 + ((u * c - pb * b) * (x - p) + (pb * a - u * b) * (y - w)) / (a * c - b * b), y0 + ((g * c - pc * b) * (x - p) + (pc * a - g * b) * (y - w)) / (a * c - b * b)
  FROM (SELECT f.session, f.island, f.k, f.x AS x0, f.y AS y0, f.pa + z.h * f.pb AS u, f.pb + z.h * f.pc AS g, f.pb, f.pc, n.a, n.b, n.c, n.p, n.w, bwd.x, bwd.y FROM bwd JOIN fwd n ON n.session = bwd.session AND n.island = bwd.island AND n.k = bwd.k JOIN z ON z.session = n.session AND z.island = n.island AND z.k = n.k JOIN fwd f ON f.session = n.session AND f.island = n.island AND f.k = n.k - 1 AND f.k > 0)),
 m AS (SELECT session, island, max(refused) AS n_refused FROM fwd GROUP BY ALL)
 SELECT k.session, k.seq, k.island, round(bwd.x, 3) + 0 AS place, round(bwd.y, 3) + 0 AS speed, coalesce(m.n_refused, 0)::BIGINT AS n_refused FROM k LEFT JOIN bwd USING (session, island, k) LEFT JOIN m ON m.session = k.session AND m.island = k.island"""


@query(_TRACK)
def velocity_track(spark, d):
    """Filtered and smoothed place and speed of each island."""
    s = samples(spark, d).withColumn("v", F.when(F.col("marker") != "error", F.col("v")))
    return curves.tracked(s, 5.0, 2.0, most_gap=24.0).withColumns({c: F.round(c, 3) + 0.0 for c in ("place", "speed")})


_HALF = "sqrt(wx*wx + wy*wy + wz*wz) * dt / 2"
_SINC = f"CASE WHEN {_HALF} * 2 > 1e-9 THEN sin({_HALF}) / ({_HALF} * 2) ELSE 0.5e0 END * dt"


@query(
    f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT session, seq, row_number() OVER w AS i, (lag(v) OVER w + v) / 200 AS m, t - lag(t) OVER w AS dt FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)), a AS (SELECT session, seq, i, m AS wx, m * 0.5e0 AS wy, -m AS wz, dt FROM o),
 e AS (SELECT session, seq, i, cos({_HALF}) AS c, wx * {_SINC} AS x, wy * {_SINC} AS y, wz * {_SINC} AS z FROM a),
 r(session, seq, i, qw, qx, qy, qz) AS (SELECT session, seq, i, 1e0, 0e0, 0e0, 0e0 FROM e WHERE i = 1 UNION ALL SELECT e.session, e.seq, e.i, qw*c - qx*x - qy*y - qz*z, qw*x + qx*c + qy*z - qz*y, qw*y - qx*z + qy*c + qz*x, qw*z + qx*y - qy*x + qz*c FROM r JOIN e ON e.session = r.session AND e.i = r.i + 1)
 SELECT session, seq, round(qw, 6) + 0 AS qw, round(qx, 6) + 0 AS qx, round(qy, 6) + 0 AS qy, round(qz, 6) + 0 AS qz FROM r"""
)
def rate_integration(spark, d):
    """Orientation by integrating rates, by chunks of 2,000 rows whose turns are combined."""
    v = F.col("v") / 100
    q = scans.integrated_turns(samples(spark, d).withColumns({"wx": v, "wy": v * 0.5, "wz": -v}), rates=("wx", "wy", "wz"), rows=2_000)
    return q.select("session", "seq", *[(F.round(c, 6) + 0.0).alias(c) for c in ("qw", "qx", "qy", "qz")])


@query()
def point_set_rotation(spark, d):
    """Best turn between two sets of points of each label; held against known turns in the tests."""
    return attitude.point_set_rotation(vectors(spark, d), "label", ("e0", "e1", "e2"), ("e3", "e4", "e5"))


_EVENTS = "ev AS (SELECT session, seq AS event, t - 30 AS t_onset, t AS t_peak, t + 18 AS t_end, CASE WHEN seq % 2 = 0 THEN t + 6 END AS t_contact FROM s WHERE v > 120)"


@query(
    f"""WITH {SAMPLES}, {_EVENTS}, m AS (SELECT s.session, ev.event, s.t, v / 3 AS speed, v / 5 AS hand, v - 40 AS elev, v / 10 AS rate, marker <> 'error' AS valid, t_onset, t_peak, t_end, ev.t_contact AS sensed, s.t BETWEEN t_onset AND t_end AS active FROM s JOIN ev ON s.session = ev.session AND s.t BETWEEN ev.t_onset - 24 AND ev.t_end + 24),
 f AS (SELECT *, first_value(t) OVER (PARTITION BY session, event ORDER BY (active AND valid) DESC, speed DESC, t) AS ft, max((active AND valid)::INT) OVER (PARTITION BY session, event) AS anyv FROM m), c AS (SELECT *, coalesce(sensed, CASE WHEN anyv = 1 THEN ft END, t_peak) AS contact FROM f),
 r AS (SELECT *, coalesce(max(CASE WHEN t <= (CASE WHEN sensed IS NOT NULL THEN contact - 2 ELSE contact END) + 1e-9 THEN t END) OVER (PARTITION BY session, event), min(t) OVER (PARTITION BY session, event)) AS rt FROM c),
 g AS (SELECT session, event, any_value(contact) AS t_contact, bool_or(sensed IS NOT NULL) AS contact_sensed, any_value(contact) - any_value(t_onset) AS time_to_contact, max(speed) FILTER (WHERE t = rt) AS sp, max(speed) FILTER (WHERE t BETWEEN t_onset AND rt AND valid) AS pk, max(elev) FILTER (WHERE t = rt AND valid) AS a, bool_or(t = rt AND valid) AS ok,
  count(*) FILTER (WHERE active AND valid) AS nv, avg(valid::INT) FILTER (WHERE active AND abs(t - t_peak) <= 12) AS support, avg(valid::INT) FILTER (WHERE active) AS vf, count(*) FILTER (WHERE abs(t - rt) <= 24 AND valid) AS na FROM r GROUP BY session, event)
 SELECT session, event, round(CASE WHEN ok AND nv >= 5 AND coalesce(support, 0) >= 0.8 THEN sp * 2.2369362920544e0 END, 5) AS speed_mph, round(CASE WHEN ok AND nv >= 5 AND coalesce(support, 0) >= 0.8 THEN pk * 2.2369362920544e0 END, 5) AS peak_speed_mph, round(CASE WHEN ok AND na >= 3 THEN a END, 5) AS path_angle_deg, round(time_to_contact, 6) AS time_to_contact, contact_sensed, ok AND nv >= 5 AND coalesce(support, 0) >= 0.8 AS speed_reliable, ok AND na >= 3 AS angles_reliable, round(coalesce(vf, 0), 6) AS valid_fraction FROM g"""
)
def swing_measures(spark, d):
    """Measures of each event with rules of reliability."""
    s = samples(spark, d)
    events = s.where("v > 120").select("session", F.col("seq").alias("event"), (F.col("t") - 30).alias("t_onset"), F.col("t").alias("t_peak"), (F.col("t") + 18).alias("t_end"), F.when(F.col("seq") % 2 == 0, F.col("t") + 6).alias("t_contact"))
    v = F.col("v")
    near = S.overlapping(
        s.select("session", "t", v, "marker", F.col("t").alias("s0"), F.col("t").alias("s1")), events.select("session", "event", (F.col("t_onset") - 24).alias("e0"), (F.col("t_end") + 24).alias("e1")), "session", ("s0", "s1"), ("e0", "e1"), 96.0
    )
    fused = near.select("session", "event", "t", (v / 3).alias("speed"), (v / 5).alias("hand_speed"), (v - 40).alias("elevation"), (v / 10).alias("rate"), (F.col("marker") != "error").alias("valid"))
    m = motion.swing_measures(fused, events, 2.0, 24.0, 12.0)
    return m.select("session", "event", *[F.round(c, 5).alias(c) for c in ("speed_mph", "peak_speed_mph", "path_angle_deg")], F.round("time_to_contact", 6).alias("time_to_contact"), "contact_sensed", "speed_reliable", "angles_reliable", F.round("valid_fraction", 6).alias("valid_fraction"))


_SO_FAR = "OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, t, v AS x, marker <> 'error' AS sup, coalesce(t - lag(t) OVER (PARTITION BY session ORDER BY t, seq), 0) AS dt FROM s), p AS (SELECT *, sum(0.01e0 * dt) {_SO_FAR} AS dv FROM o),
 m AS (SELECT *, coalesce((dv + lag(dv) OVER (PARTITION BY session ORDER BY t, seq)) / 2 * dt, 0) AS move FROM p), q AS (SELECT *, sum(move) {_SO_FAR} AS dx FROM m),
 k AS (SELECT *, last_value(CASE WHEN sup THEN struct_pack(t := t, x := x, dv := dv, dx := dx) END IGNORE NULLS) {_SO_FAR} AS a, first_value(CASE WHEN sup THEN struct_pack(t := t, x := x, dv := dv, dx := dx) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM q),
 r AS (SELECT *, a.x + (0.5e0 - a.dv) * (t - a.t) + dx - a.dx AS ahead, b.x + (0.5e0 - b.dv) * (t - b.t) + dx - b.dx AS back, b.t - a.t AS span, (t - a.t) / (b.t - a.t) AS u, b.x - (a.x + (0.5e0 - a.dv) * (b.t - a.t) + b.dx - a.dx) AS miss, (0.5e0 - (0.5e0 - a.dv + b.dv)) * (b.t - a.t) AS slip FROM k)
 SELECT session, seq, round(CASE WHEN sup THEN x WHEN a IS NULL THEN back WHEN b IS NULL THEN ahead ELSE ahead + miss * u * u * (3 - 2 * u) + slip * u * u * (u - 1) END, 4) AS bridge, NOT sup AS estimated FROM r"""
)
def bridged_replay(spark, d):
    """Places across unsupported stretches."""
    s = samples(spark, d).withColumns({"x": F.col("v"), "a": F.lit(0.01), "supported": F.col("marker") != "error"}).withColumn("v", F.col("v") * 0 + 0.5)
    return motion.bridged(s).select("session", "seq", F.round("bridge", 4).alias("bridge"), "estimated")
