"""Queries on windows over time and on the alignment of streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempofuse.operators import align as A
from tempofuse.plans.base import SAMPLES, query
from tempofuse.sources.tables import samples


def _two(spark, d):
    s = samples(spark, d)
    return s.where("marker = 'view'").select("session", "seq", "t", "v"), s.where("marker = 'click'").select("session", "t", "v")


_TWO = f"WITH {SAMPLES}, l AS (SELECT session, seq, t, v FROM s WHERE marker = 'view'), r AS (SELECT session, t, min(v) AS v FROM s WHERE marker = 'click' GROUP BY ALL)"
_BRACKET = _TWO + ", b AS (SELECT l.session, l.seq, l.t, p.t AS pt, p.v AS pv, n.t AS nt, n.v AS nv FROM l ASOF LEFT JOIN r p ON l.session = p.session AND l.t >= p.t ASOF LEFT JOIN r n ON l.session = n.session AND l.t <= n.t)"


_BOX = f"""WITH {SAMPLES}, o AS (SELECT session, seq, t, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session) AS n,
 lag(v, 1) OVER w AS a1, lag(v, 2) OVER w AS a2, lead(v, 1) OVER w AS b1 FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
 x AS (SELECT *, CASE WHEN i = 0 THEN b1 WHEN i = 1 THEN a1 ELSE a2 END AS m2, CASE WHEN i = 0 THEN v ELSE a1 END AS m1, CASE WHEN i = n - 1 THEN v ELSE b1 END AS p1 FROM o WHERE n >= 4)"""


@query(_BOX + " SELECT session, seq, round((m2 + m1 + v + p1) / 4, 5) AS boxed FROM x")
def omega_box(spark, d):
    """Moving mean of four samples, mirrored at the edges."""
    return _boxed(spark, d).select("session", "seq", F.round("boxed", 5).alias("boxed"))


def _boxed(spark, d):
    w, whole = A.over_time(), Window.partitionBy("session")
    s = samples(spark, d).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole)).where("n >= 4")
    return s.withColumn("boxed", A.box_mean(F.col("v"), 4, w, F.col("i"), F.col("n")))


@query(
    _BOX
    + """, y AS (SELECT session, seq, t, round((m2 + m1 + v + p1) / 4, 5) AS b FROM x), a AS (SELECT *, (b > 60)::INT AS up, lag((b > 60)::INT, 1, 0) OVER (PARTITION BY session ORDER BY t, seq) AS was FROM y),
 g AS (SELECT *, sum(CASE WHEN up = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t, seq)::BIGINT AS event FROM a)
 SELECT session, event, count(*) AS n_samples, max(b) AS peak, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end FROM g WHERE up = 1 GROUP BY session, event"""
)
def event_peaks(spark, d):
    """Flagship: smoothed signal, threshold crossings, islands, and the peak of each event."""
    w = A.over_time()
    y = _boxed(spark, d).select("session", "seq", "t", F.round("boxed", 5).alias("b")).withColumn("up", (F.col("b") > 60).cast("int"))
    y = y.withColumn("rise", F.when((F.col("up") == 1) & (F.lag("up", 1, 0).over(w) == 0), 1).otherwise(0))
    y = y.withColumn("event", F.sum("rise").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return y.where("up = 1").groupBy("session", "event").agg(F.count("*").alias("n_samples"), F.max("b").alias("peak"), F.round(F.min("t"), 6).alias("t_start"), F.round(F.max("t"), 6).alias("t_end"))


@query(
    f"""WITH {SAMPLES}, o AS (SELECT *, lag(v) OVER w AS v0, lead(v) OVER w AS v1, t - lag(t) OVER w AS h1, lead(t) OVER w - t AS h2 FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq))
 SELECT session, seq, round(CASE WHEN v0 IS NULL THEN (v1 - v) / h2 WHEN v1 IS NULL THEN (v - v0) / h1 ELSE (h1*h1*v1 + (h2*h2 - h1*h1)*v - h2*h2*v0) / (h1*h2*(h1+h2)) END, 3) AS slope FROM o"""
)
def grad_nonuniform(spark, d):
    return samples(spark, d).select("session", "seq", F.round(A.gradient(F.col("v"), F.col("t"), A.over_time()), 3).alias("slope"))


@query(
    f"""WITH {SAMPLES}, o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t, seq) > 12 THEN 1 ELSE 0 END AS cut FROM s),
 g AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY t, seq)::BIGINT AS island FROM o)
 SELECT session, island, count(*) AS n_samples, round(max(t) - min(t), 6) AS span_h FROM g GROUP BY ALL"""
)
def islands_gap(spark, d):
    g = A.islands(samples(spark, d), 12.0)
    return g.groupBy("session", "island").agg(F.count("*").alias("n_samples"), F.round(F.max("t") - F.min("t"), 6).alias("span_h"))


@query(_BRACKET + " SELECT session, seq, round(pt, 6) AS prev_t, pv AS prev_v, round(nt, 6) AS next_t, nv AS next_v FROM b")
def asof_prev_next(spark, d):
    left, right = _two(spark, d)
    return A.asof(left.drop("v"), right).select("session", "seq", F.round("prev_t", 6).alias("prev_t"), "prev_v", F.round("next_t", 6).alias("next_t"), "next_v")


@query(_BRACKET + " SELECT session, seq, round(least(t - pt, nt - t), 6) AS distance FROM b")
def nearest_support(spark, d):
    left, right = _two(spark, d)
    return A.asof(left.drop("v"), right).select("session", "seq", F.round(A.nearest_distance(), 6).alias("distance"))


@query(_BRACKET + " SELECT session, seq, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt > pt THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE pv END, 5) AS value FROM b")
def interp_hold(spark, d):
    left, right = _two(spark, d)
    return A.asof(left.drop("v"), right).select("session", "seq", F.round(A.interpolated(), 5).alias("value"))


@query(_BRACKET + " SELECT session, seq, round(CASE WHEN nt - pt <= 48 THEN CASE WHEN nt > pt THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE pv END END, 5) AS value FROM b")
def interp_gapaware(spark, d):
    left, right = _two(spark, d)
    return A.asof(left.drop("v"), right).select("session", "seq", F.round(A.interpolated(hold=False, most_gap=48.0), 5).alias("value"))


@query(
    f"""WITH {SAMPLES}, l AS (SELECT session, seq, t, v FROM s WHERE marker = 'view'), r AS (SELECT session, seq, t, v FROM s WHERE marker = 'click'),
 m AS (SELECT r.session, r.t AS ft, r.v AS fv, l.seq FROM r ASOF JOIN l ON r.session = l.session AND r.t <= l.t), k AS (SELECT session, seq, max(ft) AS fix_t, arg_max(fv, ft) AS fix_v FROM m GROUP BY ALL)
 SELECT l.session, l.seq, round(k.fix_t, 6) AS fix_t, k.fix_v FROM l LEFT JOIN k USING (session, seq)"""
)
def ceil_attach(spark, d):
    """Fixes go to the first sample at or after them; the last of several stays."""
    left, right = _two(spark, d)
    out = A.attach_forward(right, left)
    return out.select("session", "seq", F.round("fix_t", 6).alias("fix_t"), F.col("fix_v"))


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, t, CASE WHEN marker <> 'error' THEN v END AS v FROM s), q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN struct_pack(t := t, v := v) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
 first_value(CASE WHEN v IS NOT NULL THEN struct_pack(t := t, v := v) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n, count(v) OVER (PARTITION BY session) AS k FROM o)
 SELECT session, seq, round(CASE WHEN k >= 2 THEN CASE WHEN v IS NOT NULL THEN v WHEN p IS NULL THEN n.v WHEN n IS NULL THEN p.v ELSE p.v + (n.v - p.v) * (t - p.t) / (n.t - p.t) END END, 5) AS filled FROM q"""
)
def fill_nulls(spark, d):
    s = samples(spark, d).withColumn("v", F.when(F.col("marker") != "error", F.col("v")))
    return A.fill_missing(s).select("session", "seq", F.round("filled", 5).alias("filled"))


@query(
    f"""WITH {SAMPLES}, o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t, seq) > 12 THEN 1 ELSE 0 END AS cut FROM s),
 g AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY t, seq)::BIGINT AS island FROM o),
 h AS (SELECT *, count(*) OVER (PARTITION BY session, island) AS n, lag(v) OVER w AS v0, lead(v) OVER w AS v1, lag(v, 2) OVER w AS vm, lead(v, 2) OVER w AS v2, t - lag(t) OVER w AS h1, lead(t) OVER w - t AS h2, lead(t, 2) OVER w - lead(t) OVER w AS k2, lag(t) OVER w - lag(t, 2) OVER w AS k1 FROM g WINDOW w AS (PARTITION BY session, island ORDER BY t, seq))
 SELECT session, seq, island, round(CASE WHEN n >= 3 THEN CASE WHEN v0 IS NULL THEN -(2*h2+k2)/(h2*(h2+k2))*v + (h2+k2)/(h2*k2)*v1 - h2/(k2*(h2+k2))*v2 WHEN v1 IS NULL THEN h1/(k1*(k1+h1))*vm - (k1+h1)/(k1*h1)*v0 + (2*h1+k1)/(h1*(k1+h1))*v
 ELSE (h1*h1*v1 + (h2*h2 - h1*h1)*v - h2*h2*v0) / (h1*h2*(h1+h2)) END END, 2) AS rate FROM h"""
)
def axis_rate(spark, d):
    """Rate within islands, with second-order edges."""
    return A.island_rate(samples(spark, d), 12.0).select("session", "seq", "island", F.round("rate", 2).alias("rate"))


@query(f"WITH {SAMPLES} SELECT session, seq, round(sum(v) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM s")
def running_total(spark, d):
    return samples(spark, d).select("session", "seq", F.round(F.sum("v").over(A.over_time().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("total"))


@query(
    f"""WITH {SAMPLES}, c AS (SELECT session, seq, t, (t_us * 7) % 4294967296 AS tx FROM s), o AS (SELECT *, CASE WHEN tx - lag(tx) OVER (PARTITION BY session ORDER BY seq) < -2147483648 THEN 1 ELSE 0 END AS lap FROM c)
 SELECT session, seq, (tx + sum(lap) OVER (PARTITION BY session ORDER BY seq) * 4294967296)::BIGINT AS unwrapped FROM o"""
)
def clock_unwrap(spark, d):
    s = samples(spark, d).withColumn("tx", (F.col("t_us") * 7) % F.lit(1 << 32))
    return A.unwrapped(s, "tx").select("session", "seq", "unwrapped")


@query(
    f"""WITH {SAMPLES}, k AS (SELECT session, seq, t, v, min(t) OVER (PARTITION BY session) AS t0, t * 3600e0 + (seq % 7) * 0.001e0 AS host FROM s), c AS (SELECT session, t - t0 AS tx, host - min(host) OVER (PARTITION BY session) AS h FROM k),
 r AS (SELECT session, regr_slope(h, tx) AS b, regr_intercept(h, tx) AS a FROM c GROUP BY session)
 SELECT c.session, round(any_value(b), 6) AS slope, round(quantile_cont(h - (a + b * tx), 0.05), 6) AS lift FROM c JOIN r USING (session) GROUP BY c.session"""
)
def clock_fit(spark, d):
    """Line of host times over device times, lifted to the fifth percentile of what is left."""
    from tempofuse.operators.quality import clock_line

    s = samples(spark, d)
    s = s.withColumn("host", F.col("t") * 3600.0 + F.pmod("seq", F.lit(7)) * F.lit(0.001))
    out = clock_line(s, "t", "host")
    return out.select("session", F.round("slope", 6).alias("slope"), F.round("lift", 6).alias("lift"))


@query(f"WITH {SAMPLES} SELECT seq, session, round(t, 6) AS t, CASE WHEN marker = 'view' THEN v END AS camera, CASE WHEN marker = 'click' THEN v END AS inertial FROM s WHERE marker IN ('view', 'click')")
def event_merge(spark, d):
    """Two streams of different columns as one."""
    s = samples(spark, d).select("seq", "session", F.round("t", 6).alias("t"), "marker", "v")
    return A.merge_streams(s.where("marker = 'view'").select("seq", "session", "t", F.col("v").alias("camera")), s.where("marker = 'click'").select("seq", "session", "t", F.col("v").alias("inertial"))).select("seq", "session", "t", "camera", "inertial")


@query(f"WITH {SAMPLES} SELECT DISTINCT session, floor(t)::BIGINT AS hour FROM s WHERE marker IN ('view', 'click')")
def joint_grid(spark, d):
    s = samples(spark, d).withColumn("hour", F.floor("t"))
    return A.joint_grid(s.where("marker = 'view'"), s.where("marker = 'click'"), t="hour")


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY session) AS n FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
 m AS (SELECT a.session, a.seq, any_value(a.v) AS v, median(b.v) AS m FROM o a, (SELECT unnest(range(-5, 6)) AS k) k JOIN o b ON b.session = a.session AND b.i = greatest(1, least(a.n, a.i + k.k)) GROUP BY ALL)
 SELECT session, min(seq) AS first_hit, count(*) AS hits FROM m WHERE abs(v - m) > 100 GROUP BY session"""
)
def impact_spike(spark, d):
    """First sample that stands off the median of eleven by over a threshold."""
    from tempofuse.operators.segment import spikes

    return spikes(samples(spark, d), 11, 100.0).groupBy("session").agg(F.min("seq").alias("first_hit"), F.count("*").alias("hits"))


_ROW7 = "(-3*a[{0}+1] - 2*a[{0}+2] - a[{0}+3] + a[{0}+5] + 2*a[{0}+6] + 3*a[{0}+7]) / 28"
_BEND7 = "(5*a[{0}+1] - 3*a[{0}+3] - 4*a[{0}+4] - 3*a[{0}+5] + 5*a[{0}+7]) / 84"


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY session) AS n FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)), l AS (SELECT session, list(v ORDER BY i) AS a FROM o GROUP BY session)
 SELECT session, seq, round(CASE WHEN i <= 3 THEN {_ROW7.format("0")} + 2 * (i - 4) * {_BEND7.format("0")} WHEN i > n - 3 THEN {_ROW7.format("n-7")} + 2 * (i - n + 3) * {_BEND7.format("n-7")} ELSE {_ROW7.format("i-4")} END, 5) + 0 AS slope FROM o JOIN l USING (session) WHERE n >= 7"""
)
def savgol_deriv(spark, d):
    """First derivative of the local parabola over seven samples; at the ends, of the first and last such parabola."""
    w = A.over_time()
    s = samples(spark, d).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("session"))})
    return s.select("session", "seq", (F.round(A.parabola_rate("v", w, F.col("i"), F.col("n")), 5) + 0.0).alias("slope")).where("slope is not null")


@query(
    f"""WITH {SAMPLES}, a AS (SELECT session, v AS x, t AS h FROM s WHERE marker = 'view'), lags AS (SELECT unnest(range(-6, 7)) * 4.0e0 AS lag_h),
 ga AS (SELECT session, floor(t / 4)::BIGINT AS g, avg(v) AS x FROM s WHERE marker = 'view' GROUP BY ALL), gb AS (SELECT session, floor(t / 4)::BIGINT AS g, avg(v) AS y FROM s WHERE marker = 'click' GROUP BY ALL),
 p AS (SELECT ga.session, k, x, y FROM ga, (SELECT unnest(range(-6, 7)) AS k), gb WHERE gb.session = ga.session AND gb.g = ga.g + k),
 c AS (SELECT session, k, count(*) AS n, corr(x, y) AS r FROM p GROUP BY ALL), ok AS (SELECT session, k, round(r, 6) AS r FROM c WHERE n >= 3 AND r IS NOT NULL AND NOT isnan(r))
 SELECT session, min(k)::INTEGER AS lag_steps, any_value(r) AS correlation FROM (SELECT *, max(r) OVER (PARTITION BY session) AS best FROM ok) WHERE r = best GROUP BY session"""
)
def xcorr_offset(spark, d):
    """Lag of the greatest correlation between two streams on one grid."""
    from tempofuse.operators.sync import best_lag

    s = samples(spark, d).withColumn("g", F.floor(F.col("t") / 4))
    a = s.where("marker = 'view'").groupBy("session", "g").agg(F.avg("v").alias("x"))
    b = s.where("marker = 'click'").groupBy("session", "g").agg(F.avg("v").alias("y"))
    return best_lag(a, b, 6, 3)
