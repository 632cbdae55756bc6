"""Queries that run as streams over the events table, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempofuse.functions.codec import FrameFormat, decode_frame, encode_frame
from tempofuse.plans.base import SAMPLES, query
from tempofuse.plans.quality_queries import EVENTS_SQL
from tempofuse.sources.tables import samples
from tempofuse.streaming import capture, flows, live, rings


# a window is triggered by a row above 60 whose row before is not, a day after the session's first, after the window before
_RINGS = f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT session, t, v, t - lag(t) OVER w AS step, lag(v) OVER w AS v0, t - first_value(t) OVER w AS age FROM s WINDOW w AS (PARTITION BY session ORDER BY seq)),
 c AS (SELECT session, t FROM o WHERE v > 60 AND v0 <= 60 AND age >= 24), r(session, t) AS (SELECT session, min(t) FROM c GROUP BY session UNION ALL SELECT r.session, (SELECT min(c.t) FROM c WHERE c.session = r.session AND c.t > r.t + 24) AS n FROM r WHERE n IS NOT NULL)
 SELECT r.session, round(r.t, 6) AS trigger_t, round(min(o.t), 6) AS t_first, round(max(o.t), 6) AS t_last, count(*) FILTER (WHERE o.t < r.t) AS n_before, count(*) FILTER (WHERE o.t >= r.t) AS n_after, count(*) FILTER (WHERE o.t > r.t AND o.step > 12) AS n_gaps, max(o.v) AS peak, true AS complete
 FROM r JOIN o ON o.session = r.session AND o.t BETWEEN r.t - 24 AND r.t + 24 WHERE EXISTS (SELECT 1 FROM o x WHERE x.session = r.session AND x.t > r.t + 24) GROUP BY r.session, r.t"""


def _rounded(windows):
    return windows.withColumns({c: F.round(c, 6) for c in ("trigger_t", "t_first", "t_last")})


@query(_RINGS)
def stream_ring_windows(spark, d):
    """Triggered windows, by a stateful operator."""
    return _rounded(flows.drained(rings.ring_windows(flows.event_stream(spark, d), 24.0, 24.0, 60.0, 12.0, 1e9)))


@query(_RINGS)
def batch_ring_windows(spark, d):
    """The same machine over a batch."""
    return _rounded(rings.ring_windows(samples(spark, d).withColumnRenamed("v", "signal"), 24.0, 24.0, 60.0, 12.0, 1e9))


@query(
    f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT *, CASE WHEN t - lag(t) OVER w > 48 THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY session ORDER BY seq)), g AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY seq) AS island FROM o),
 i AS (SELECT session, island, t, v, row_number() OVER w - 1 AS pos, lag(v) OVER w AS v0, count(*) OVER (PARTITION BY session, island) AS n FROM g WINDOW w AS (PARTITION BY session, island ORDER BY seq)), c AS (SELECT * FROM i WHERE v > 60 AND v0 <= 60 AND pos >= 3),
 r(session, island, pos) AS (SELECT session, island, min(pos) FROM c GROUP BY ALL UNION ALL SELECT r.session, r.island, (SELECT min(c.pos) FROM c WHERE c.session = r.session AND c.island = r.island AND c.pos > r.pos + 3) AS p FROM r WHERE p IS NOT NULL)
 SELECT r.session, round(any_value(i.t) FILTER (WHERE i.pos = r.pos), 6) AS trigger_t, round(min(i.t), 6) AS t_first, round(max(i.t), 6) AS t_last, 3 AS n_before, 4 AS n_after, r.island::BIGINT AS n_gaps, max(i.v) AS peak, true AS complete
 FROM r JOIN i ON i.session = r.session AND i.island = r.island AND i.pos BETWEEN r.pos - 3 AND r.pos + 3 WHERE i.n > r.pos + 3 GROUP BY r.session, r.island, r.pos"""
)
def stream_count_windows(spark, d):
    """Windows of so many rows about a trigger, in runs of rows without a gap."""
    return _rounded(flows.drained(rings.ring_windows(flows.event_stream(spark, d), 3, 4, 60.0, 48.0, rows=True)))


_CLOSED = "(SELECT max(epoch_us(ts)) - 3600000000 AS mark FROM events)"


@query(f"WITH w AS (SELECT user_id AS session, ((epoch_us(ts) // 21600000000) * 21600000000)::BIGINT AS start_us, value FROM events) SELECT session, start_us, count(*) AS n, max(value) AS peak FROM w WHERE start_us + 21600000000 <= (SELECT mark FROM {_CLOSED}) GROUP BY session, start_us")
def stream_rolling_counts(spark, d):
    return flows.drained(flows.rolling_counts(flows.event_stream(spark, d)))


@query(
    f"""WITH {SAMPLES}, o AS (SELECT session, seq, t_us, v, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY session ORDER BY t_us) >= 43200000000 THEN 1 ELSE 0 END AS cut FROM s), g AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY t_us) AS id FROM o)
 SELECT session, min(t_us) AS start_us, count(*) AS n, max(v) AS peak FROM g GROUP BY session, id HAVING max(t_us) + 43200000000 <= (SELECT mark FROM {_CLOSED})"""
)
def stream_sessions(spark, d):
    return flows.drained(flows.sessions_of(flows.event_stream(spark, d)))


@query("SELECT user_id AS session, event_id AS seq, value AS signal FROM events")
def stream_without_duplicates(spark, d):
    """Every row comes twice, the second ten minutes of event time later; one of each stays."""
    rows = flows.event_stream(spark, d)
    again = flows.event_stream(spark, d).withColumn("ts", F.expr("ts + interval 10 minutes"))
    return flows.drained(flows.without_duplicates(rows.unionByName(again)).select("session", "seq", "signal"))


@query(
    """SELECT a.user_id AS session, a.event_id AS left_seq, b.event_id AS right_seq FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'view' AND b.event_type = 'click'"""
)
def stream_interval_join(spark, d):
    left = flows.event_stream(spark, d).where(F.col("marker") == "view")
    return flows.drained(flows.interval_join(left, flows.event_stream(spark, d).where(F.col("marker") == "click")))


@query(f"WITH {SAMPLES}, o AS (SELECT session, seq, t_us % 8589934592 // 2 AS c FROM s), l AS (SELECT *, CASE WHEN c - lag(c) OVER w < -2147483648 THEN 1 ELSE 0 END AS lap FROM o WINDOW w AS (PARTITION BY session ORDER BY seq)) SELECT session, seq, (c + 4294967296 * sum(lap) OVER (PARTITION BY session ORDER BY seq))::BIGINT AS unwrapped FROM l")
def stream_clock(spark, d):
    """The device clock of a stream, made to go on."""
    rows = flows.event_stream(spark, d).select("session", "seq", F.floor((F.unix_micros("ts") % (1 << 33)) / 2).alias("counter"))
    return flows.drained(live.unwrapped_clock(rows))


@query(f"WITH {SAMPLES}, k AS (SELECT session, seq, t_us, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS number, count(*) OVER (PARTITION BY session) AS n FROM s) SELECT session, number, t_us % 4294967296 AS tx_us, CASE WHEN number = 0 THEN 3 ELSE 0 END::BIGINT AS skipped FROM k WHERE number < n - 1")
def stream_frames(spark, d):
    """Frames found in a stream of bytes that begins with some that are none; the last waits for what follows."""
    rows = flows.event_stream(spark, d)
    zero = {n: F.lit(0.0) for n in FrameFormat().signed} | {n: F.lit(0) for n in FrameFormat().unsigned[:-1]}
    frame = encode_frame(F.unix_micros("ts"), zero, FrameFormat())
    lead = flows.event_stream(spark, d).where("signal >= 0").select("session", F.lit(-1).cast("long").alias("seq"), F.unhex(F.lit("0102FF")).alias("data")).dropDuplicates(["session"])
    sent = rows.select("session", "seq", frame.alias("data")).unionByName(lead)
    found = live.parsed_frames(sent)
    got = decode_frame(F.col("frame"), FrameFormat())
    return flows.drained(found).select("session", "number", got["tx_us"].alias("tx_us"), "skipped")


@query(EVENTS_SQL + " SELECT session, t_onset, t_peak, t_end, peak FROM f WHERE over")
def stream_events(spark, d):
    """Events as they end."""
    return flows.drained(live.live_events(flows.event_stream(spark, d), 60.0, 30.0, 30.0, 6.0, 48.0, 24.0))


@query("SELECT a.user_id AS session, a.event_id AS window_id, b.event_id AS seq FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts + INTERVAL 6 HOUR WHERE a.value > 150")
def stream_window_rows(spark, d):
    """Rows of a stream in the windows about its triggers, which are another stream."""
    rows = flows.event_stream(spark, d)
    windows = flows.event_stream(spark, d).where("signal > 150").select("session", F.col("seq").alias("window_id"), "ts", F.expr("ts - interval 12 hours").alias("w0"), F.expr("ts + interval 6 hours").alias("w1"))
    return flows.drained(live.rows_in_windows(rows, windows))


@query(
    f"""WITH {SAMPLES}, g AS (SELECT session, floor(t / 48)::BIGINT AS k, min(t) AS s0, max(t) AS s1 FROM s GROUP BY ALL), c AS (SELECT *, k < max(k) OVER (PARTITION BY session) AS closed FROM g), w AS (SELECT session, seq AS window_id, t - 12 AS w0, t + 12 AS w1 FROM s WHERE v > 150)
 SELECT w.session, w.window_id, count(c.k) AS n_segments, coalesce(bool_and(c.closed) AND max(c.s1) >= any_value(w.w1), false) AS ready FROM w LEFT JOIN c ON c.session = w.session AND c.s1 >= w.w0 AND c.s0 <= w.w1 GROUP BY ALL"""
)
def ready_windows(spark, d):
    """Windows whose recorded segments are all closed."""
    s = samples(spark, d)
    parts = s.groupBy("session", F.floor(F.col("t") / 48).alias("k")).agg(F.min("t").alias("s0"), F.max("t").alias("s1"))
    segments = parts.withColumn("closed", F.col("k") < F.max("k").over(Window.partitionBy("session"))).drop("k")
    windows = s.where("v > 150").select("session", F.col("seq").alias("window_id"), (F.col("t") - 12).alias("w0"), (F.col("t") + 12).alias("w1"))
    return live.ready_windows(windows, segments, 24.0).select("session", "window_id", "n_segments", "ready")


@query(f"WITH {SAMPLES}, n AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS back FROM s) SELECT session, count(*) FILTER (seq % 7 <> 0) AS n_lines, sum(seq) FILTER (seq % 7 <> 0)::BIGINT AS total FROM n WHERE back > 1 GROUP BY session")
def tailed_rows(spark, d):
    """Whole rows of each session's growing file: not its last, and not those with a field too many."""
    line = F.concat(F.col("seq").cast("string"), F.when(F.col("seq") % 7 == 0, ",1,2").otherwise(",1"))
    text = samples(spark, d).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    lines = live.complete_lines(F.col("text"), 2)
    number = lambda x: F.split(x, ",")[0].cast("long")
    return text.select("session", F.size(lines).cast("long").alias("n_lines"), F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + number(x)).alias("total"))


# The device's clock in seconds is the events' in hours, so that windows of hours are windows of seconds.
_TRIGGERS = f"""{SAMPLES}, w AS (SELECT session, seq AS window_id, t - 12 AS w0, t + 6 AS w1 FROM s WHERE v > 150), c AS (SELECT session, seq, t FROM s WHERE marker = 'click'), m AS (SELECT session, max(t) AS newest FROM c GROUP BY session),
 mark AS (SELECT max(x) AS x FROM (SELECT max(w1) AS x FROM w UNION ALL SELECT max(t) FROM c))"""


@query(
    f"""WITH {_TRIGGERS} SELECT w.session, w.window_id, coalesce(any_value(m.newest) >= any_value(w.w1), false) AS complete, count(c.seq) AS n_frames, coalesce(sum(c.seq), 0)::BIGINT AS total FROM w LEFT JOIN m ON m.session = w.session LEFT JOIN c ON c.session = w.session AND c.t BETWEEN w.w0 - 0.3e0 AND w.w1 + 0.3e0, mark
 WHERE m.newest >= w.w1 OR w.w1 + 1.5e0 <= mark.x - 5 GROUP BY w.session, w.window_id"""
)
def stream_camera_windows(spark, d):
    """Windows of one stream with the frames of another, as soon as the camera is past them or has been silent."""
    rows = flows.event_stream(spark, d)
    clock = lambda t: F.timestamp_micros(F.round(t * 1e6).cast("long"))
    windows = rows.where("signal > 150").select("session", F.col("seq").alias("window_id"), (F.col("t") - 12).alias("w0"), (F.col("t") + 6).alias("w1"), clock(F.col("t") + 6).alias("ts"))
    camera = flows.event_stream(spark, d).where("marker = 'click'").select("session", "seq", "t", clock(F.col("t")).alias("ts"))
    with capture.rocks_state(spark):
        out = flows.drained(capture.camera_windows(windows, camera, keep=1e9))
    return out.select("session", "window_id", "complete", F.size("frames").cast("long").alias("n_frames"), F.aggregate("frames", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    EVENTS_SQL
    + """, seg AS (SELECT session, floor(t / 48)::BIGINT AS k, min(t) AS s0, max(t) AS s1 FROM s GROUP BY ALL), parts AS (SELECT *, k < max(k) OVER (PARTITION BY session) AS closed FROM seg), win AS (SELECT session, t_peak - 12 AS w0, t_peak + 12 AS w1 FROM f WHERE over)
 SELECT w.session, round(w0, 6) AS w0, round(w1, 6) AS w1, count(*) AS n_segments FROM win w JOIN parts c ON c.session = w.session AND c.s1 >= w.w0 AND c.s0 <= w.w1 GROUP BY w.session, w.w0, w.w1 HAVING bool_and(c.closed) AND max(c.s1) >= w.w1"""
)
def stream_captures(spark, d):
    """Windows about events as they end, kept, sealed and queued once their recorded segments are closed."""
    s = samples(spark, d)
    parts = s.groupBy("session", F.floor(F.col("t") / 48).alias("k")).agg(F.min("t").alias("s0"), F.max("t").alias("s1"))
    segments = parts.withColumn("closed", F.col("k") < F.max("k").over(Window.partitionBy("session"))).drop("k")
    events = live.live_events(flows.event_stream(spark, d), 60.0, 30.0, 30.0, 6.0, 48.0, 24.0)
    windows = events.select("session", F.round(F.col("t_peak") * 3.6e9).cast("long").alias("window_id"), (F.col("t_peak") - 12).alias("w0"), (F.col("t_peak") + 12).alias("w1"))
    held = capture.Captures(spark, flows.shared_path(spark))
    held.run(windows, lambda: segments, 24.0)
    return held.read("queue").select("session", F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"), "n_segments")
