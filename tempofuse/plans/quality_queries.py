"""Queries on quality, audits, segmentation and catalogues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempofuse.operators import align as A
from tempofuse.operators import quality as Q
from tempofuse.operators import segment as S
from tempofuse.operators.sync import pearson, zscore
from tempofuse.plans.base import FRAMES, SAMPLES, query
from tempofuse.sources.tables import frames, samples, table

_SESSION_STEP = f"WITH {SAMPLES}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY session ORDER BY seq) AS step FROM s)"


@query(
    f"""WITH {SAMPLES}, c AS (SELECT DISTINCT session, t FROM s WHERE marker = 'click'), p AS (SELECT session, t AS a, lead(t) OVER (PARTITION BY session ORDER BY t) AS b FROM c),
 x AS (SELECT session, seq, t FROM s WHERE marker = 'view')
 SELECT x.session, x.seq, coalesce(bool_or(p.b - p.a <= 48 AND x.t BETWEEN p.a AND p.b), false) AND NOT coalesce(bool_or(p.b - p.a > 48 AND x.t BETWEEN p.a - 4 AND p.b + 4), false) AS supported
 FROM x LEFT JOIN p ON x.session = p.session AND p.b IS NOT NULL GROUP BY ALL"""
)
def optical_support(spark, d):
    s = samples(spark, d)
    return Q.optical_support(s.where("marker = 'view'").select("session", "seq", "t"), s.where("marker = 'click'"), 48.0, 4.0).select("session", "seq", "supported")


@query(_SESSION_STEP.replace("ORDER BY seq", "ORDER BY t, seq") + " SELECT session, seq, coalesce(step > 12, false) AS after_gap FROM g")
def gap_flag(spark, d):
    return Q.gap_flags(samples(spark, d), 12.0).select("session", "seq", "after_gap")


_AUDIT = """ SELECT session, count(*) AS n_frames, round(max(t) - min(t), 5) AS span, round((count(*) - 1) / (max(t) - min(t)), 5) AS effective_rate, round(max(step), 5) AS longest_gap,
 count(*) FILTER (WHERE step <= 0) AS n_not_rising, coalesce(sum(greatest(round_even(step * 0.14e0, 0)::BIGINT - 1, 0)), 0)::BIGINT AS n_missing FROM g GROUP BY session"""


@query(_SESSION_STEP + _AUDIT)
def capture_quality(spark, d):
    q = Q.capture_quality(samples(spark, d), 0.14)
    return q.select("session", "n_frames", *[F.round(c, 5).alias(c) for c in ("span", "effective_rate", "longest_gap")], "n_not_rising", "n_missing")


@query(
    _SESSION_STEP
    + """ SELECT session, count(*) FILTER (WHERE step > 0) AS n_steps, round(avg(step) FILTER (WHERE step > 0), 5) AS mean_step, round(median(step) FILTER (WHERE step > 0), 5) AS median_step, round(max(step) FILTER (WHERE step > 0), 5) AS longest_step FROM g GROUP BY session"""
)
def timestamp_stats(spark, d):
    step = F.col("t") - F.lag("t").over(Window.partitionBy("session").orderBy("seq"))
    g = samples(spark, d).withColumn("step", step).withColumn("step", F.when(F.col("step") > 0, F.col("step")))
    return g.groupBy("session").agg(F.count("step").alias("n_steps"), F.round(F.avg("step"), 5).alias("mean_step"), F.round(F.median("step"), 5).alias("median_step"), F.round(F.max("step"), 5).alias("longest_step"))


@query(
    _SESSION_STEP
    + """, m AS (SELECT *, median(step) OVER (PARTITION BY session) AS mid FROM g) SELECT session, round(1 / any_value(mid), 5) AS rate, round(1 / avg(step), 5) AS mean_rate, round(any_value(mid), 5) AS median_step, round(quantile_cont(step, 0.99), 5) AS p99_step,
 round(max(step), 5) AS longest_step, count(*) FILTER (WHERE step > 1.5 * mid) AS n_late, count(*) FILTER (WHERE step <= 0) AS n_not_rising FROM m GROUP BY session"""
)
def bringup_stats(spark, d):
    b = Q.bring_up(samples(spark, d))
    return b.select("session", *[F.round(c, 5).alias(c) for c in ("rate", "mean_rate", "median_step", "p99_step", "longest_step")], "n_late", "n_not_rising")


@query(
    f"""WITH {SAMPLES}, k AS (SELECT session, seq, t, marker <> 'error' AS seen FROM s), w AS (SELECT *, last_value(CASE WHEN seen THEN t END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
 first_value(CASE WHEN seen THEN t END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n, min(t) OVER (PARTITION BY session) AS lo, max(t) OVER (PARTITION BY session) AS hi FROM k)
 SELECT session, round(avg(seen::INT), 6) AS seen_share, count(*) FILTER (WHERE NOT seen) AS n_filled, round(max(CASE WHEN seen THEN 0 ELSE coalesce(n, hi) - coalesce(p, lo) END), 5) AS longest_gap FROM w GROUP BY session"""
)
def marker_summary(spark, d):
    m = Q.marker_summary(samples(spark, d).withColumn("seen", F.col("marker") != "error"))
    return m.select("session", F.round("seen_share", 6).alias("seen_share"), "n_filled", F.round("longest_gap", 5).alias("longest_gap"))


@query(
    f"""WITH {FRAMES}, w AS (SELECT frame, max(CASE WHEN marker = 1 THEN x END) AS x1, max(CASE WHEN marker = 2 THEN x END) AS x2, max(CASE WHEN marker = 3 THEN x END) AS x3, max(CASE WHEN marker = 1 THEN y END) AS y1, max(CASE WHEN marker = 2 THEN y END) AS y2, max(CASE WHEN marker = 3 THEN y END) AS y3 FROM f WHERE marker <= 3 GROUP BY frame),
 k AS (SELECT *, coalesce(abs(sqrt((x1-x2)*(x1-x2) + (y1-y2)*(y1-y2)) - 2) <= 1.6, false) AS p12, coalesce(abs(sqrt((x1-x3)*(x1-x3) + (y1-y3)*(y1-y3)) - 5) <= 4, false) AS p13, coalesce(abs(sqrt((x2-x3)*(x2-x3) + (y2-y3)*(y2-y3)) - 3) <= 2.4, false) AS p23 FROM w),
 c AS (SELECT *, p12 AND p13 AND p23 AS all3, p12::INT + p13::INT + p23::INT AS pairs, (x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT AS seen FROM k)
 SELECT frame, CASE WHEN all3 THEN true WHEN pairs = 1 THEN p12 OR p13 WHEN pairs > 1 THEN false ELSE x1 IS NOT NULL AND seen < 2 END AS keep_1,
 CASE WHEN all3 THEN true WHEN pairs = 1 THEN p12 OR p23 WHEN pairs > 1 THEN false ELSE x2 IS NOT NULL AND seen < 2 END AS keep_2,
 CASE WHEN all3 THEN true WHEN pairs = 1 THEN p13 OR p23 WHEN pairs > 1 THEN false ELSE x3 IS NOT NULL AND seen < 2 END AS keep_3 FROM c"""
)
def geometry_keep(spark, d):
    """The one largest set of markers in rigid agreement."""
    wide = frames(spark, d).where("marker <= 3").groupBy("frame").agg(*[F.max(F.when(F.col("marker") == m, F.col(a))).alias(f"{a}{m}") for m in (1, 2, 3) for a in "xy"])
    kept = Q.rigid_subset({str(m): F.col(f"x{m}").isNotNull() for m in (1, 2, 3)}, {str(m): (F.col(f"x{m}"), F.col(f"y{m}")) for m in (1, 2, 3)}, {"1": 0.0, "2": 2.0, "3": 5.0}, share=0.8)
    return wide.select("frame", *[kept[str(m)].alias(f"keep_{m}") for m in (1, 2, 3)])


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, t, v, lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(v) OVER w AS v0, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq))
 SELECT session, seq, coalesce(t1 - t0 > 0 AND t1 - t0 <= 24 AND abs(v - (v0 + (v1 - v0) * (t - t0) / (t1 - t0))) > 60, false) AS spike FROM o"""
)
def spike_reject(spark, d):
    """Rows off the line between their neighbours in adjacent frames."""
    s = samples(spark, d).withColumn("i", F.row_number().over(A.over_time()))
    return Q.spike_flags(s, 24.0, 60.0, "session", "i", "t", ("v",)).select("session", "seq", "spike")


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, v AS gx, v * 0.5e0 AS gy, v * 0.1e0 AS gz FROM s) SELECT session, seq, sqrt(gx*gx + gy*gy + gz*gz) < 20 AND abs(sqrt((gx/10)*(gx/10) + 96.1703842225e0) - 9.80665e0) < 1 AS still FROM o"""
)
def still_mask(spark, d):
    v = F.col("v")
    return samples(spark, d).select("session", "seq", S.still((v, v * 0.5, v * 0.1), (v / 10, F.lit(0.0), F.lit(9.80665)), 20.0, 1.0).alias("still"))


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, v AS ax, v - 20 AS ay, v * 1.01e0 AS hx, v - 19 AS hy FROM s), k AS (SELECT *, abs(ax) >= 95 OR abs(ay) >= 95 AS clipped, abs(hx) < 190 AND abs(hy) < 190 AS usable FROM o)
 SELECT session, seq, round(CASE WHEN clipped AND usable THEN hx ELSE ax END, 5) AS x, round(CASE WHEN clipped AND usable THEN hy ELSE ay END, 5) AS y, NOT clipped OR usable AS valid FROM k"""
)
def merge_accels(spark, d):
    v = F.col("v")
    (x, y), valid = Q.merged_acceleration((v, v - 20), (v * 1.01, v - 19), 100.0, 200.0)
    return samples(spark, d).select("session", "seq", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), valid.alias("valid"))


@query(
    f"""WITH {SAMPLES}, q AS (SELECT session, t - 1 AS a, t + 1 AS b, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS i FROM s WHERE v > 60), c AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY session ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut FROM q),
 g AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM c) SELECT session, round(min(a), 6) AS t0, round(max(b), 6) AS t1, count(*) AS n_events FROM g GROUP BY session, id"""
)
def merged_events(spark, d):
    out = S.merged_events(samples(spark, d).where("v > 60").select("session", F.col("t").alias("t0"), F.col("t").alias("t1")), 1.0)
    return out.select("session", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "n_events")


@query(
    f"""WITH {SAMPLES}, a AS (SELECT session, seq, t - 2 AS a0, t + 2 AS a1 FROM s WHERE marker = 'view'), b AS (SELECT session, seq AS other, t - 3 AS b0, t + 3 AS b1 FROM s WHERE marker = 'click')
 SELECT a.session, seq, other FROM a JOIN b ON a.session = b.session AND b1 >= a0 AND b0 <= a1"""
)
def segment_overlap(spark, d):
    s = samples(spark, d)
    a = s.where("marker = 'view'").select("session", "seq", (F.col("t") - 2).alias("a0"), (F.col("t") + 2).alias("a1"))
    b = s.where("marker = 'click'").select("session", F.col("seq").alias("other"), (F.col("t") - 3).alias("b0"), (F.col("t") + 3).alias("b1"))
    return S.overlapping(a, b, "session", ("a0", "a1"), ("b0", "b1"), 12.0).select("session", "seq", "other")


@query(
    f"""WITH {SAMPLES}, w AS (SELECT session, t - 24 AS t0, t + 2 AS t1 FROM s WHERE v > 120), x AS (SELECT session, seq, t FROM s WHERE marker = 'signup'),
 c AS (SELECT x.session, x.seq, CASE WHEN t BETWEEN t0 - 0.05e0 AND t1 THEN 0 ELSE least(abs(t - t0), abs(t - t1)) END AS cost, t0, t1 FROM x JOIN w USING (session)),
 r AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY cost, t0, t1) AS k FROM c) SELECT session, seq, round(cost, 6) AS cost, round(t0, 6) AS t0 FROM r WHERE k = 1"""
)
def window_pick(spark, d):
    s = samples(spark, d)
    w = s.where("v > 120").select("session", (F.col("t") - 24).alias("t0"), (F.col("t") + 2).alias("t1"))
    out = S.nearest_event(s.where("marker = 'signup'").select("session", "seq", "t"), w, "session", "t", ("t0", "t1"), 0.05, ["seq"], 24.0)
    return out.select("session", "seq", F.round("cost", 6).alias("cost"), F.round("t0", 6).alias("t0"))


@query(f"WITH {SAMPLES} SELECT session, seq, round(CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE v - avg(v) OVER w END, 5) AS z FROM s WINDOW w AS (PARTITION BY session)")
def z_score(spark, d):
    return samples(spark, d).select("session", "seq", F.round(zscore("v", Window.partitionBy("session")), 5).alias("z"))


@query(f"WITH {SAMPLES} SELECT session, CASE WHEN count(*) FILTER (WHERE v < 20) >= 5 THEN round(median(v) FILTER (WHERE v < 20), 5) ELSE 0 END AS bias, count(*) FILTER (WHERE v < 20) AS n_still FROM s GROUP BY session")
def stance_bias(spark, d):
    """Median of the still samples, 0 where there are too few."""
    still = F.when(F.col("v") < 20, F.col("v"))
    return samples(spark, d).groupBy("session").agg(F.when(F.count(still) >= 5, F.round(F.median(still), 5)).otherwise(0.0).alias("bias"), F.count(still).alias("n_still"))


@query(f"WITH {SAMPLES} SELECT session, round(avg(v), 5) AS mean_v, round(stddev_pop(v), 5) AS std_v, count(*) AS n, round(count(*) / (max(t) - min(t)), 5) AS rate FROM s GROUP BY session HAVING count(*) >= 10")
def calibration_stats(spark, d):
    g = samples(spark, d).groupBy("session").agg(F.round(F.avg("v"), 5).alias("mean_v"), F.round(F.stddev_pop("v"), 5).alias("std_v"), F.count("*").alias("n"), F.round(F.count("*") / (F.max("t") - F.min("t")), 5).alias("rate"))
    return g.where("n >= 10")


@query(
    f"""WITH {SAMPLES}, a AS (SELECT session, floor(t / 12)::BIGINT AS g, avg(v) AS x FROM s WHERE marker = 'view' GROUP BY ALL), b AS (SELECT session, floor(t / 12)::BIGINT AS g, avg(v) AS y FROM s WHERE marker = 'click' GROUP BY ALL), p AS (SELECT * FROM a JOIN b USING (session, g))
 SELECT session, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(sqrt(avg((x - y) * (x - y))), 5) END AS rms, CASE WHEN count(*) >= 5 THEN round(corr(x, y), 5) END AS r, CASE WHEN count(*) >= 5 THEN round(max(x), 5) END AS peak_x, CASE WHEN count(*) >= 5 THEN round(avg(abs(x - y) / nullif(x, 0)), 5) END AS mean_share FROM p GROUP BY session"""
)
def compare_streams(spark, d):
    """Agreement of two streams on a grid; the number alone where there are fewer than five pairs."""
    s = samples(spark, d).withColumn("g", F.floor(F.col("t") / 12))
    a = s.where("marker = 'view'").groupBy("session", "g").agg(F.avg("v").alias("x"))
    b = s.where("marker = 'click'").groupBy("session", "g").agg(F.avg("v").alias("y"))
    e = F.col("x") - F.col("y")
    out = a.join(b, ["session", "g"]).groupBy("session").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rms"), pearson("x", "y").alias("r"), F.max("x").alias("peak_x"), F.avg(F.abs(e) / F.nullif(F.col("x"), F.lit(0.0))).alias("mean_share"))
    return out.select("session", "n", *[F.when(F.col("n") >= 5, F.round(c, 5)).alias(c) for c in ("rms", "r", "peak_x", "mean_share")])


@query(
    f"""WITH {SAMPLES}, k AS (SELECT session, t, v, abs(v) AS c0, abs(v - 9.80665e0) AS c1, v * v / 50 AS c2, v > 60 AS inside FROM s), l AS (SELECT session, 'magnitude' AS source, c0 AS c, inside FROM k UNION ALL SELECT session, 'off_gravity', c1, inside FROM k UNION ALL SELECT session, 'power', c2, inside FROM k),
 q AS (SELECT session, source, min(c) FILTER (WHERE inside) AS least_event, max(c) FILTER (WHERE NOT inside) AS most_quiet FROM l GROUP BY ALL), r AS (SELECT *, least_event - most_quiet AS separation, most_quiet + 0.4e0 * (least_event - most_quiet) AS threshold FROM q WHERE least_event IS NOT NULL AND most_quiet IS NOT NULL)
 SELECT session, arg_max(source, separation) AS source, round(max(separation), 4) AS separation, round(arg_max(threshold, separation), 4) AS threshold FROM r GROUP BY session"""
)
def trigger_tune(spark, d):
    """The signal that parts events from quiet best, and a threshold 40 % into the gap."""
    v = F.col("v")
    l = samples(spark, d).select("session", F.explode(F.array(*[F.struct(F.lit(n).alias("source"), c.alias("c")) for n, c in (("magnitude", F.abs(v)), ("off_gravity", F.abs(v - 9.80665)), ("power", v * v / 50))])).alias("k"), (v > 60).alias("inside"))
    q = l.groupBy("session", "k.source").agg(F.min(F.when(F.col("inside"), F.col("k.c"))).alias("low"), F.max(F.when(~F.col("inside"), F.col("k.c"))).alias("high")).where("low is not null and high is not null")
    best = q.groupBy("session").agg(F.max(F.struct((F.col("low") - F.col("high")).alias("separation"), (F.col("high") + 0.4 * (F.col("low") - F.col("high"))).alias("threshold"), "source")).alias("b"))
    return best.select("session", "b.source", F.round("b.separation", 4).alias("separation"), F.round("b.threshold", 4).alias("threshold"))


@query(f"WITH {SAMPLES} SELECT session, seq, round(CASE WHEN t > lag(t, 29) OVER w THEN 29 / (t - lag(t, 29) OVER w) END, 5) AS rate FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)")
def rolling_rate(spark, d):
    w = A.over_time()
    span = F.col("t") - F.lag("t", 29).over(w)
    return samples(spark, d).select("session", "seq", F.round(F.when(span > 0, 29 / F.when(span > 0, span)), 5).alias("rate"))


@query(
    f"""WITH {SAMPLES} SELECT session, count(*) FILTER (WHERE marker = 'view') AS n_camera, count(*) FILTER (WHERE marker = 'click') AS n_inertial, count(DISTINCT marker) AS n_kinds, round(count(*) FILTER (WHERE marker = 'view') / count(*), 6) AS share,
 round(greatest(least(max(t) FILTER (WHERE marker = 'view'), max(t) FILTER (WHERE marker = 'click')) - greatest(min(t) FILTER (WHERE marker = 'view'), min(t) FILTER (WHERE marker = 'click')), 0), 5) AS overlap FROM s GROUP BY session"""
)
def capture_summary(spark, d):
    is_ = lambda m: F.when(F.col("marker") == m, F.col("t"))
    cam, imu = is_("view"), is_("click")
    return samples(spark, d).groupBy("session").agg(
        F.count(cam).alias("n_camera"), F.count(imu).alias("n_inertial"), F.count_distinct("marker").alias("n_kinds"), F.round(F.count(cam) / F.count("*"), 6).alias("share"),
        F.round(F.greatest(F.least(F.max(cam), F.max(imu)) - F.greatest(F.min(cam), F.min(imu)), F.lit(0.0)), 5).alias("overlap"),
    )


@query(
    f"""WITH {SAMPLES}, k AS (SELECT session, min(t) AS lo, max(t) AS hi, count(DISTINCT floor(t / 6)) AS n FROM s GROUP BY session) SELECT session, n AS n_slots, (floor(hi / 6) - floor(lo / 6))::BIGINT + 1 AS expected, round(least(n / (floor(hi / 6) - floor(lo / 6) + 1), 1), 6) AS coverage FROM k"""
)
def camera_coverage(spark, d):
    slot = F.floor(F.col("t") / 6)
    k = samples(spark, d).groupBy("session").agg(F.count_distinct(slot).alias("n_slots"), (F.max(slot) - F.min(slot) + 1).alias("expected"))
    return k.select("session", "n_slots", "expected", F.round(F.least(F.col("n_slots") / F.col("expected"), F.lit(1.0)), 6).alias("coverage"))


@query(
    f"""WITH {SAMPLES}, k AS (SELECT DISTINCT session, floor(t / 24)::BIGINT AS slot FROM s), r AS (SELECT session, unnest(range(min(slot), max(slot) + 1)) AS slot FROM k GROUP BY session) SELECT r.session, r.slot FROM r ANTI JOIN k USING (session, slot)"""
)
def missing_slots(spark, d):
    k = samples(spark, d).select("session", F.floor(F.col("t") / 24).alias("slot")).distinct()
    whole = k.groupBy("session").agg(F.explode(F.sequence(F.min("slot"), F.max("slot"))).alias("slot"))
    return whole.join(k, ["session", "slot"], "left_anti")


@query(f"WITH {SAMPLES} SELECT session, t_us, max(seq) AS seq, arg_max(v, seq) AS v FROM (SELECT session, (t_us // 3600000000)::BIGINT AS t_us, seq, v FROM s) GROUP BY ALL")
def last_payload(spark, d):
    """Of several rows of one slot the last wins."""
    s = samples(spark, d).withColumn("t_us", F.floor(F.col("t_us") / 3600000000).cast("long"))
    return s.groupBy("session", "t_us").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v"))


@query(
    """WITH o AS (SELECT c.c_custkey AS session, c.c_mktsegment AS label, max(o.o_orderdate) AS latest, count(o.o_orderkey) AS n, round(max(o.o_totalprice), 2) AS best FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL)
 SELECT session, label, n, best, rank() OVER (PARTITION BY label ORDER BY latest DESC NULLS LAST)::INTEGER AS place FROM o"""
)
def catalog(spark, d):
    """Catalogue of captures: those without results stay; newest first within a label."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    g = o.groupBy(F.col("o_custkey").alias("session")).agg(F.max("o_orderdate").alias("latest"), F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("best"))
    j = c.select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("label")).join(g, "session", "left")
    return j.select("session", "label", F.coalesce("n", F.lit(0)).alias("n"), "best", F.rank().over(Window.partitionBy("label").orderBy(F.col("latest").desc_nulls_last())).alias("place"))


@query(f"WITH {FRAMES}, r AS (SELECT frame, marker, x, row_number() OVER (PARTITION BY frame ORDER BY x DESC, marker) AS k FROM f) SELECT frame, k::INTEGER AS place, marker, x AS area FROM r WHERE k <= 2")
def largest_blobs(spark, d):
    r = F.row_number().over(Window.partitionBy("frame").orderBy(F.col("x").desc(), "marker"))
    return frames(spark, d).withColumn("place", r).where("place <= 2").select("frame", "place", "marker", F.col("x").alias("area"))


@query(f"WITH {SAMPLES}, o AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM s) SELECT session, seq FROM o WHERE n <= 20 OR floor(ceil(i * 19 / (n - 1)) * (n - 1) / 19) = i")
def even_pick(spark, d):
    """Twenty rows evenly over a session, all where it has no more."""
    o = samples(spark, d).withColumn("i", F.row_number().over(A.over_time()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("session")))
    step = F.when(F.col("n") > 1, F.col("n") - 1).otherwise(1)
    return o.where((F.col("n") <= 20) | (F.floor(F.ceil(F.col("i") * 19 / step) * step / 19) == F.col("i"))).select("session", "seq")


@query(f"WITH {SAMPLES} SELECT session, round(avg(v - 20), 5) AS mean_error, round(avg(abs(v - 20)), 5) AS mean_abs, round(quantile_cont(abs(v - 20), 0.95), 5) AS p95_abs, avg(abs(v - 20)) / 20 < 0.85 AS passed FROM s GROUP BY session")
def validation_stats(spark, d):
    e = F.col("v") - 20
    return samples(spark, d).groupBy("session").agg(F.round(F.avg(e), 5).alias("mean_error"), F.round(F.avg(F.abs(e)), 5).alias("mean_abs"), F.round(F.percentile(F.abs(e), 0.95), 5).alias("p95_abs"), (F.avg(F.abs(e)) / 20 < 0.85).alias("passed"))


@query(
    f"""WITH {SAMPLES}, k AS (SELECT session, marker, sum(v) AS total, count(*) AS n FROM s GROUP BY ROLLUP (session, marker)) SELECT coalesce(session, -1) AS session, coalesce(marker, 'all') AS marker, round(total, 3) AS total, n FROM k"""
)
def metric_rollup(spark, d):
    """Totals by session and marker, by session, and over all."""
    return samples(spark, d).rollup("session", "marker").agg(F.round(F.sum("v"), 3).alias("total"), F.count("*").alias("n")).select(F.coalesce("session", F.lit(-1)).cast("long").alias("session"), F.coalesce("marker", F.lit("all")).alias("marker"), "total", "n")


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, t, v, lag(v) OVER w AS pv FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)) SELECT session, seq, v - pv AS jump, ntile(4) OVER (PARTITION BY session ORDER BY v, seq)::INTEGER AS quarter, dense_rank() OVER (PARTITION BY session ORDER BY v DESC)::INTEGER AS place FROM o"""
)
def ranked_samples(spark, d):
    w = Window.partitionBy("session")
    return samples(spark, d).select("session", "seq", (F.col("v") - F.lag("v").over(A.over_time())).alias("jump"), F.ntile(4).over(w.orderBy("v", "seq")).alias("quarter"), F.dense_rank().over(w.orderBy(F.col("v").desc())).alias("place"))


# the detector step by step: from the first trigger after row `at`, to its end and on; an event that is too near to the
# one before is passed over. q has, of each row, where its quiet stretch begins and the last row at or below the onset.
# It reads o (session, t, v, i: the row's number, n: their number, p: the value before).
_DETECTOR = """q AS (SELECT *, v <= {quiet} AS quiet, max(CASE WHEN v <= {quiet} AND coalesce(p > {quiet}, true) THEN i END) OVER u AS begun, coalesce(max(CASE WHEN v <= {onset} THEN i END) OVER u, 1) AS low, first_value(CASE WHEN v > {trigger} THEN i END IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM o WINDOW u AS (PARTITION BY session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 g AS (SELECT a.session, a.i, a.n, a.low, any_value(a.t) AS t, min(b.i) FILTER (b.t < a.t + {most} AND b.quiet AND b.t - c.t >= {hold}) AS held, min(b.i) FILTER (b.t >= a.t + {most}) AS late, arg_min(greatest(b.begun, a.i), b.i) FILTER (b.t < a.t + {most} AND b.quiet AND b.t - c.t >= {hold}) AS rest, max(b.i) FILTER (b.t < a.t + {most}) AS last
  FROM q a JOIN q b ON b.session = a.session AND b.i >= a.i LEFT JOIN q c ON c.session = b.session AND c.i = greatest(b.begun, a.i) WHERE a.v > {trigger} GROUP BY a.session, a.i, a.n, a.low),
 h AS (SELECT g.session, g.i, coalesce(g.held, g.late, g.n + 1) + 1 AS after, CASE WHEN g.held IS NOT NULL THEN g.rest WHEN l.quiet THEN greatest(l.begun, g.i) ELSE least(coalesce(g.late, g.n + 1), g.n) END AS e, g.held IS NOT NULL OR g.late IS NOT NULL AS over FROM g JOIN q l ON l.session = g.session AND l.i = g.last),
 k AS (SELECT h.session, h.i, h.after, h.e, h.over, arg_max(x.i, (x.v, -x.i)) AS peak FROM h JOIN q x ON x.session = h.session AND x.i BETWEEN h.i AND h.e GROUP BY ALL),
 m AS (SELECT k.*, least(a.low, 1000000000) AS back FROM k JOIN q a ON a.session = k.session AND a.i = k.i),
 r(session, i, last_end, good) AS (SELECT session, next, -1e18::DOUBLE, false FROM q WHERE i = 1 AND next IS NOT NULL
  UNION ALL SELECT r.session, z.next, CASE WHEN b.t - r.last_end >= {gap} THEN e.t ELSE r.last_end END, true FROM r JOIN m ON m.session = r.session AND m.i = r.i JOIN q b ON b.session = m.session AND b.i = m.back JOIN q e ON e.session = m.session AND e.i = m.e LEFT JOIN q z ON z.session = m.session AND z.i = m.after WHERE r.i IS NOT NULL),
 f AS (SELECT r.session, b.t AS t_onset, p.t AS t_peak, e.t AS t_end, p.v AS peak, m.over FROM r JOIN m ON m.session = r.session AND m.i = r.i JOIN q b ON b.session = m.session AND b.i = m.back JOIN q p ON p.session = m.session AND p.i = m.peak JOIN q e ON e.session = m.session AND e.i = m.e WHERE b.t - r.last_end >= {gap})"""


def events_sql(o: str, trigger: float, onset: float, quiet: float, hold: float, most: float, gap: float) -> str:
    """SQL of detected events over the tables in o; the last is named o."""
    return f"WITH RECURSIVE {o}, " + _DETECTOR.format(trigger=trigger, onset=onset, quiet=quiet, hold=hold, most=most, gap=gap)


EVENTS_SQL = events_sql(f"{SAMPLES}, o AS (SELECT session, t, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY session) AS n, lag(v) OVER w AS p FROM s WINDOW w AS (PARTITION BY session ORDER BY t))", 60, 30, 30, 6, 48, 24)


@query(EVENTS_SQL + " SELECT session, row_number() OVER (PARTITION BY session ORDER BY t_onset, t_peak) - 1 AS event, t_onset, t_peak, t_end, peak FROM f")
def detected_events(spark, d):
    """Events by hysteresis; sequential within a session, so there is no SQL (see the tests)."""
    return S.detect_events(samples(spark, d), 60.0, 30.0, 30.0, 6.0, 48.0, 24.0)
