"""Queries of the exports, replays and the older tools' measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempofuse.functions import cameras as C
from tempofuse.functions import vectors as V
from tempofuse.functions.codec import expanded_format
from tempofuse.operators import align as A
from tempofuse.operators import geometry as G
from tempofuse.operators import quality as Q
from tempofuse.operators import segment as S
from tempofuse.operators import sync
from tempofuse.operators.labels import learnt_spacing
from tempofuse.plans.base import FRAMES, SAMPLES, VECTORS, query
from tempofuse.sources import sinks
from tempofuse.sources.bytestreams import stream_kinds as stream_kinds_of
from tempofuse.sources.tables import frames, poses, samples, table, vectors

#: Rows of a task of marker_table(), about: tasks grow in number with the table, not in memory.
TASK_ROWS = 200_000

POSES = (
    SAMPLES + ", p AS (SELECT session, seq, t, v, marker, cos(t / 2) AS qw, sin(t / 2) * 0.6e0 AS qx, sin(t / 2) * 0.8e0 AS qy, 0e0 AS qz, v / 100 AS knob_x, t / 1000 AS knob_y, 2.5e0 AS knob_z, cos(t) AS axis_x, sin(t) AS axis_y, 0e0 AS axis_z,"
    " v / 7 AS sweet_speed, v / 50 AS att_std_deg, marker <> 'click' AS speed_valid, min(t) OVER k + (max(t) OVER k - min(t) OVER k) / 4 AS t_onset, min(t) OVER k + (max(t) OVER k - min(t) OVER k) * 0.75e0 AS t_end FROM s WINDOW k AS (PARTITION BY session))"
)
#: frames with one row of each marker: the first in order of place.
POINTS = FRAMES + ", u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY frame, marker ORDER BY x, y, z) = 1)"


def _points(spark, d):
    f = frames(spark, d).groupBy("frame", "marker").agg(F.min(F.struct("x", "y", "z", "s")).alias("p"))
    return f.select("frame", "marker", "p.*")


_PLACE = ", ".join(f"round({c}, 5) + 0 AS {c}" for c in ("knob_x", "knob_y", "knob_z", "axis_x", "axis_y", "axis_z"))
_ATTITUDE = ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("qw", "qx", "qy", "qz"))
_ALONG = ", ".join(f"round(knob_{a} + {s}e0 * axis_{a}, 5) + 0 AS {n}_{a}" for n, s in (("tip", 0.84), ("sweet", 0.686)) for a in "xyz")


@query(f"WITH {POSES} SELECT session, seq, round(t - t_onset, 6) + 0 AS t_s, {_ATTITUDE}, {_PLACE}, {_ALONG}, round(sweet_speed, 4) AS sweet_speed_mps, round(att_std_deg, 3) AS att_std_deg, speed_valid::INT AS speed_valid, (t BETWEEN t_onset AND t_end)::INT AS in_swing FROM p")
def fused_export(spark, d):
    """The export of fused samples, with the session's and row's number before its 21 columns."""
    return sinks.fused_export(poses(spark, d), 0.84, 0.686)


@query(
    f"WITH {POSES} SELECT session, seq, round(t - t_onset, 6) + 0 AS t_s, {_ATTITUDE}, round(v / 9, 4) AS omega_x, round(t / 70, 4) AS omega_y, round(v / 30 - 1, 4) + 0 AS omega_z, round(sqrt((v/9)*(v/9) + (t/70)*(t/70) + (v/30-1)*(v/30-1)), 4) AS omega_mag_rads,"
    " round(axis_x, 5) + 0 AS axis_x, round(axis_y, 5) + 0 AS axis_y, round(axis_z, 5) + 0 AS axis_z FROM p"
)
def camera_orientation_export(spark, d):
    return sinks.camera_orientation_export(poses(spark, d).withColumns({"omega_x": F.col("v") / 9, "omega_y": F.col("t") / 70, "omega_z": F.col("v") / 30 - 1}))


_REPLAY = f"""WITH {POSES}, n AS (SELECT p.session, p.seq, min(abs(c.t - p.t)) AS camera_distance FROM p LEFT JOIN s c ON c.session = p.session AND c.marker = 'view' GROUP BY ALL),
 r AS (SELECT p.*, n.camera_distance, coalesce(n.camera_distance > 6, true) AS estimated, marker <> 'purchase' AS accel_used FROM p JOIN n USING (session, seq))"""


def _replay(spark, d):
    p = poses(spark, d)
    near = A.asof(p, samples(spark, d).where("marker = 'view'").select("session", "t", "v"))
    return near.withColumn("camera_distance", A.nearest_distance()).withColumns({"estimated": F.coalesce(F.col("camera_distance") > 6, F.lit(True)), "accel_used": F.col("marker") != "purchase"})


_SOURCE = "CASE WHEN estimated THEN 'imu_estimate' ELSE 'camera_supported' END"


@query(
    _REPLAY + f" SELECT session, seq, round(t - t_onset, 6) + 0 AS t_s, knob_x, knob_y, knob_z, round(axis_x, 9) + 0 AS axis_x, round(axis_y, 9) + 0 AS axis_y, axis_z, {_SOURCE} AS pose_source, (speed_valid AND NOT estimated)::INT AS speed_valid, (t BETWEEN t_onset AND t_end)::INT AS in_swing, round(camera_distance, 6) AS distance_to_camera_s, accel_used::INT AS accel_used FROM r"
)
def replay_export(spark, d):
    out = sinks.replay_export(_replay(spark, d))
    return out.withColumns({c: F.round(c, 9) + 0.0 for c in ("axis_x", "axis_y")})


@query(
    _REPLAY + f""" SELECT session, seq, round(t - t_onset, 6) + 0 AS t_s, round(knob_x, 5) AS knob_x, round(knob_y, 5) AS knob_y, knob_z, round(axis_x, 6) + 0 AS axis_x, round(axis_y, 6) + 0 AS axis_y, axis_z, {_SOURCE} AS source,
 CASE WHEN t BETWEEN t_onset AND t_end AND speed_valid AND NOT estimated THEN round(sweet_speed * 2.236936292e0, 2) END AS speed, round(camera_distance * 1000, 1) AS distance_to_camera_ms FROM r WHERE t BETWEEN t_onset - 0.1e0 AND t_end"""
)
def replay_samples(spark, d):
    """The rows of each session's replay that are shown."""
    return sinks.replay_frames(_replay(spark, d))


_UP = (0.1, -0.9, 0.2)
_BASIS = C.display_axes(_UP)
_OFFS = ", ".join(f"round(({b[0]!r}::DOUBLE) * (knob_x - ox) + ({b[1]!r}::DOUBLE) * (knob_y - oy) + ({b[2]!r}::DOUBLE) * (knob_z - oz), 5) + 0 AS {n}" for n, b in zip(("dx", "dy", "dz"), _BASIS, strict=True))


@query(
    _REPLAY + f", o AS (SELECT session, arg_min(knob_x, t) AS ox, arg_min(knob_y, t) AS oy, arg_min(knob_z, t) AS oz FROM r WHERE t >= t_onset - 0.1e0 GROUP BY session) SELECT r.session, r.seq, {_OFFS}, CASE WHEN t BETWEEN t_onset AND t_end THEN CASE WHEN estimated THEN 'gap' ELSE 'camera' END END AS path FROM r JOIN o USING (session) WHERE t BETWEEN t_onset - 0.1e0 AND t_end"
)
def replay_paths(spark, d):
    """Places in the display's axes from the first one shown, and which of the two paths a row is on."""
    shown = _replay(spark, d).where("t between t_onset - 0.1 and t_end")
    origin = shown.groupBy("session").agg(F.min_by(F.struct("knob_x", "knob_y", "knob_z"), "t").alias("o"))
    place = C.displayed(tuple(F.col(f"knob_{a}") for a in "xyz"), tuple(F.col(f"o.knob_{a}") for a in "xyz"), _UP)
    path = F.when(F.col("t").between(F.col("t_onset"), F.col("t_end")), F.when(F.col("estimated"), "gap").otherwise("camera"))
    return shown.join(origin, "session").select("session", "seq", *[(F.round(c, 5) + 0.0).alias(n) for n, c in zip(("dx", "dy", "dz"), place, strict=True)], path.alias("path"))


_FILLED = f"""WITH {POINTS}, g AS (SELECT frame, count(*) AS n, avg(s) AS ms, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, regr_slope(x, s) AS vx, regr_slope(y, s) AS vy, regr_slope(z, s) AS vz FROM u GROUP BY frame HAVING count(*) >= 2), h AS (SELECT *, sqrt(vx*vx + vy*vy + vz*vz) AS w FROM g),
 m AS (SELECT h.*, b.marker, b.marker * 0.1e0 AS ps FROM h, (SELECT unnest([1, 2, 3]) AS marker) b), a AS (SELECT m.frame, m.marker, coalesce(f.x, mx - ms*vx/w + ps*vx/w) AS x, coalesce(f.y, my - ms*vy/w + ps*vy/w) AS y, coalesce(f.z, mz - ms*vz/w + ps*vz/w) AS z, CASE WHEN f.x IS NOT NULL THEN 'camera' WHEN m.n >= 3 THEN 'imu_fill' ELSE 'unsupported' END AS src FROM m LEFT JOIN u f ON f.frame = m.frame AND f.marker = m.marker)"""


@query(_FILLED + " SELECT frame, frame / 1000e0 AS t_s, " + ", ".join(f"max(round({c} * 1.03170001e0, 5) + 0) FILTER (marker = {m}) AS m{m}_{c}" if c != "src" else f"max(src) FILTER (marker = {m}) AS m{m}_src" for m in (1, 2, 3) for c in ("x", "y", "z", "src")) + " FROM a GROUP BY frame")
def marker_table(spark, d):
    """Each frame's bands side by side: as seen, or where the frame's bar has them, with their source."""
    # rows are dealt by frame once, and a frame's seen bands go with its line, so that no join sorts all rows again
    f = frames(spark, d)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-f.count() // TASK_ROWS))
    dealt = f.repartition(parts, "frame").groupBy("frame", "marker").agg(F.min(F.struct("x", "y", "z", "s")).alias("p")).select("frame", "marker", "p.*")
    seen = {f"seen_{a}{m}": F.max(F.when(F.col("marker") == m, F.col(a))) for m in (1, 2, 3) for a in "xyz"}
    lines = G.bar_line(dealt, also=seen).where("n_markers >= 2")
    bands = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(m * 0.1).alias("s"), *[F.col(f"seen_{a}{m}").alias(f"seen_{a}") for a in "xyz"]) for m in (1, 2, 3)]))
    met = lines.withColumn("b", bands).select("frame", "n_markers", "b.*", *[f"{k}_{a}" for k in "uk" for a in "xyz"])
    filled = met.select("frame", (F.col("frame") / 1000.0).alias("t_s"), "marker", *[(F.coalesce(f"seen_{a}", F.col(f"k_{a}") + F.col("s") * F.col(f"u_{a}")) * 1.03170001 + 0.0).alias(a) for a in "xyz"], sinks.marker_source(F.col("seen_x").isNotNull(), F.col("n_markers") >= 3).alias("source"))
    return sinks.marker_export(filled, [1, 2, 3], ("frame", "t_s"), "marker")


@query(f"WITH {SAMPLES} SELECT session, seq, ((t_us % 4294967296 - first_value(t_us % 4294967296) OVER w + 4294967296) % 4294967296) / 1e6 AS since FROM s WINDOW w AS (PARTITION BY session ORDER BY seq)")
def relative_clock(spark, d):
    s = samples(spark, d).withColumn("tx_us", F.col("t_us") % (1 << 32))
    return s.select("session", "seq", sinks.relative_clock().alias("since"))


@query(f"WITH {SAMPLES} SELECT session, seq, round(t + 0.25e0, 6) AS t FROM s WHERE t + 0.25e0 BETWEEN 24 AND 480")
def shifted_slice(spark, d):
    """A stream moved in time and cut to a span."""
    return samples(spark, d).withColumn("t", F.col("t") + 0.25).where("t between 24 and 480").select("session", "seq", F.round("t", 6).alias("t"))


_TURN = "acos(greatest(-1, least(1, z / r)))"


@query(
    f"""WITH {FRAMES}, c AS (SELECT frame, marker, x - CASE marker % 3 WHEN 1 THEN 0.5e0 WHEN 2 THEN -0.25e0 ELSE 0 END AS x, y - CASE marker % 3 WHEN 1 THEN 1e0 WHEN 2 THEN 2e0 ELSE 0 END AS y, z - CASE marker % 3 WHEN 1 THEN 0.1e0 WHEN 2 THEN 0.2e0 ELSE 0 END AS z FROM f),
 n AS (SELECT *, sqrt(x*x + y*y + z*z) AS r, sqrt(x*x + y*y) AS h FROM c)
 SELECT frame, marker, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z, round(r, 6) AS distance, round(cos({_TURN} / 2), 6) + 0 AS qw, round(-y / h * sin({_TURN} / 2), 6) + 0 AS qx, round(x / h * sin({_TURN} / 2), 6) + 0 AS qy FROM n WHERE h / r > 1e-3"""
)
def camera_offsets(spark, d):
    """Places told from a common origin by each camera's own, their distances, and the turns of z to their directions."""
    offsets = spark.createDataFrame([(1, 0.5, 1.0, 0.1), (2, -0.25, 2.0, 0.2)], "camera_id int, dx double, dy double, dz double")
    p = C.without_offset(frames(spark, d).withColumn("camera_id", F.col("marker") % 3), offsets)
    told = C.with_direction(p)
    far = told.where(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / F.col("distance") > 1e-3)
    return far.select("frame", "marker", *[(F.round(a, 6) + 0.0).alias(a) for a in "xyz"], F.round("distance", 6).alias("distance"), *[(F.round(n, 6) + 0.0).alias(n) for n in ("qw", "qx", "qy")])


@query(f"WITH {VECTORS} SELECT vec_id, (sqrt(e0*e0 + e1*e1 + e2*e2) * 12 <= 4 AND abs(sqrt(e3*e3 + e4*e4 + e5*e5) * 40 - 9.80665e0) <= 3) AS held FROM e")
def still_end(spark, d):
    v = vectors(spark, d)
    rate, force = V.norm(tuple(F.col(f"e{k}") for k in range(3))) * 12, V.norm(tuple(F.col(f"e{k}") for k in range(3, 6))) * 40
    return v.select("vec_id", S.still_end(rate, F.abs(force - S.GRAVITY)).alias("held"))


@query(f"WITH {SAMPLES}, c AS (SELECT session, arg_max(t, (v, -seq)) AS contact FROM s GROUP BY session) SELECT session, seq, t BETWEEN contact - 5 AND contact + 50 AS rings FROM s JOIN c USING (session)")
def impact_ringing(spark, d):
    s = samples(spark, d)
    contact = s.groupBy("session").agg(F.max_by("t", F.struct("v", -F.col("seq"))).alias("contact"))
    return s.join(contact, "session").select("session", "seq", Q.ringing(F.col("t"), F.col("contact"), 5.0, 50.0).alias("rings"))


@query(
    f"""WITH {SAMPLES}, g AS (SELECT session, lag(t) OVER w AS g0, t AS g1 FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)), l AS (SELECT * FROM g WHERE g1 - g0 > 12)
 SELECT s.session, s.seq, coalesce(bool_or(s.t = l.g1), false) AS after_gap, count(l.g1) > 0 AS near_gap FROM s LEFT JOIN l ON l.session = s.session AND s.t >= l.g0 - 2 AND s.t <= l.g1 + 2 GROUP BY ALL"""
)
def gap_guard(spark, d):
    """Rows that a gap in the stream invalidates, with the guard around it."""
    return Q.gap_guarded(samples(spark, d), 12.0, 2.0).select("session", "seq", "after_gap", "near_gap")


@query(f"WITH {SAMPLES}, l AS (SELECT session, v AS a, lag(v) OVER (PARTITION BY session ORDER BY t, seq) AS b FROM s) SELECT session, round(avg(abs(a - b) / a), 6) AS mean_difference, count(*) AS n FROM l WHERE a <> 0 AND b IS NOT NULL GROUP BY session")
def percent_difference(spark, d):
    """Mean relative difference of neighbouring values; zeros are left out."""
    l = samples(spark, d).withColumn("b", F.lag("v").over(A.over_time())).withColumn("off", sync.relative_difference(F.col("v"), F.col("b")))
    return l.groupBy("session").agg(F.round(F.avg("off"), 6).alias("mean_difference"), F.count("off").alias("n")).where("n > 0")


@query(
    f"""WITH {POINTS}, b AS (SELECT frame % 20 AS session, frame, marker, x, y, z, count(*) OVER (PARTITION BY frame) AS n FROM u WHERE marker <= 3), g AS (SELECT session, frame, marker AS position, sqrt((lead(x) OVER w - x)*(lead(x) OVER w - x) + (lead(y) OVER w - y)*(lead(y) OVER w - y) + (lead(z) OVER w - z)*(lead(z) OVER w - z)) AS gap FROM b WHERE n = 3 WINDOW w AS (PARTITION BY frame ORDER BY marker)),
 k AS (SELECT *, row_number() OVER (PARTITION BY session, position ORDER BY frame DESC) AS k FROM g WHERE gap IS NOT NULL) SELECT session, position, round(median(gap), 6) AS gap, count(*) AS n FROM k WHERE k <= 200 GROUP BY ALL HAVING count(*) >= 10"""
)
def band_spacing(spark, d):
    """Distances between neighbouring bands, learnt from the last 200 full frames."""
    f = _points(spark, d).where("marker <= 3").select((F.col("frame") % 20).alias("session"), F.col("frame").alias("frame_id"), F.col("marker").alias("position"), "x", "y", "z")
    return learnt_spacing(f).select("session", "position", F.round("gap", 6).alias("gap"), "n")


@query(f"WITH {SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY v, seq) AS place FROM s) SELECT session, seq, v, place::INT AS place FROM k WHERE place <= 3")
def least_costs(spark, d):
    """The three of least cost of each session."""
    return G.least_of(samples(spark, d), "session", "v", "seq").select("session", "seq", "v", "place")


@query(f"WITH {FRAMES} SELECT frame, CASE WHEN max(z - 0.5e0) FILTER (marker = 1) > 0 THEN max(round(z - 0.5e0, 6)) FILTER (marker = 1) ELSE round(quantile_cont(z - 0.5e0, 0.5) FILTER (z - 0.5e0 > 0), 6) END AS depth FROM f GROUP BY frame")
def depth_samples(spark, d):
    """The first point's depth, or the median of what is positive around it."""
    f = frames(spark, d).withColumn("zz", F.col("z") - 0.5).groupBy("frame").agg(F.max(F.when(F.col("marker") == 1, F.col("zz"))).alias("centre"), F.collect_list("zz").alias("around"))
    return f.select("frame", F.round(C.depth_at(F.col("centre"), F.col("around")), 6).alias("depth"))


@query(
    f"""WITH {POINTS}, t AS (SELECT a.frame, a.marker AS a, b.marker AS b, c.marker AS c, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS vx, c.y-a.y AS vy, c.z-a.z AS vz FROM u a JOIN u b ON a.frame = b.frame AND a.marker < b.marker JOIN u c ON b.frame = c.frame AND b.marker < c.marker),
 m AS (SELECT *, (ux*ux+uy*uy+uz*uz + vx*vx+vy*vy+vz*vz + (vx-ux)*(vx-ux)+(vy-uy)*(vy-uy)+(vz-uz)*(vz-uz)) / 3 AS tr, ((uy*vz-uz*vy)*(uy*vz-uz*vy) + (uz*vx-ux*vz)*(uz*vx-ux*vz) + (ux*vy-uy*vx)*(ux*vy-uy*vx)) / 3 AS mi FROM t),
 o AS (SELECT frame, a, b, c, round(sqrt(greatest((tr - sqrt(greatest(tr*tr - 4*mi, 0))) / 2, 0)), 6) AS off FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY off, a, b, c) AS k FROM o) SELECT frame, off FROM k WHERE k = 1"""
)
def collinear_three(spark, d):
    """How far the straightest three points of a frame are from a line."""
    return G.most_collinear_three(_points(spark, d)).select("frame", "off")


@query("SELECT p_partkey, repeat('h', p_size % 9) || repeat('B', (p_partkey % 5)::INT) || 'H' AS letters, (p_size % 9 + p_partkey % 5 + 1)::INT AS n FROM part")
def struct_letters(spark, d):
    """Struct codes made of each part's numbers, written out letter by letter."""
    code = F.concat(F.lit(">"), (F.col("p_size") % 9).cast("string"), F.lit("h"), (F.col("p_partkey") % 5).cast("string"), F.lit("BH"))
    letters = expanded_format(code)
    return table(spark, d, "part").select("p_partkey", F.array_join(letters, "").alias("letters"), F.size(letters).alias("n"))


@query(
    f"WITH {SAMPLES}, h AS (SELECT session, string_agg(CASE WHEN session % 2 = 0 THEN 'A55A' || rpad(hex(seq), 80, '0') ELSE rpad(hex(seq), 60, '7') END, '' ORDER BY seq) AS h FROM s GROUP BY session) SELECT session, CASE WHEN regexp_matches(h, '^(?:..)*?A55A.{{80}}A55A.{{80}}A55A.{{80}}') THEN 'v2' WHEN length(h) >= 1200 THEN 'v1' END AS kind FROM h"
)
def stream_kinds(spark, d):
    """What each session's stream of bytes holds, told from its bytes."""
    piece = F.when(F.col("session") % 2 == 0, F.concat(F.lit("A55A"), F.rpad(F.hex("seq"), 80, "0"))).otherwise(F.rpad(F.hex("seq"), 60, "7"))
    return stream_kinds_of(samples(spark, d).select("session", "seq", F.unhex(piece).alias("data")))


_N1, _N2 = "sqrt(e0*e0 + e1*e1 + e2*e2 + e3*e3)", "sqrt(e4*e4 + e5*e5 + e6*e6 + e7*e7)"
_L = [f"(e{k}/{_N1} + (e{k + 4}/{_N2} - e{k}/{_N1}) * 0.3e0)" for k in range(4)]


@query(f"WITH {VECTORS} SELECT vec_id, " + ", ".join(f"round({c} / sqrt({' + '.join(f'{x}*{x}' for x in _L)}), 6) + 0 AS {n}" for n, c in zip(("qw", "qx", "qy", "qz"), _L, strict=True)) + " FROM e")
def quat_lerp(spark, d):
    v = vectors(spark, d)
    p, q = (V.unit(tuple(F.col(f"e{k + j}") for k in range(4))) for j in (0, 4))
    return v.select("vec_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in zip(("qw", "qx", "qy", "qz"), V.lerped(p, q, F.lit(0.3)), strict=True)])


@query(f"WITH {FRAMES} SELECT frame, marker, round(x * 1.37e0, 3) AS disparity_px, round(y / 7, 3) AS row_err_px, round(x * 3.3333e0, 2) AS u_left, round(z * 77.777e0, 2) AS v_left FROM f")
def point_entries(spark, d):
    f = frames(spark, d).select("frame", "marker", (F.col("x") * 1.37).alias("disparity_px"), (F.col("y") / 7).alias("row_err_px"), (F.col("x") * 3.3333).alias("u_left"), (F.col("z") * 77.777).alias("v_left"))
    return sinks.point_entry(f)


@query(
    f"""WITH {FRAMES}, b AS (SELECT frame, x AS u, y AS v, z AS area, CASE WHEN frame % 2 = 0 THEN (x - 3)*(x - 3) + (y - 2.5e0)*(y - 2.5e0) ELSE -z END AS rank FROM f WHERE (x * 40) % 180 BETWEEN 0 AND 20 OR (x * 40) % 180 BETWEEN 30 AND 60 OR (x * 40) % 180 BETWEEN 170 AND 179), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY rank, u, v) AS k FROM b) SELECT frame, u, v, area FROM k WHERE k = 1"""
)
def blob_choice(spark, d):
    """Of each frame's blobs in a colour's hues the one nearest to where it is expected, or the largest."""
    f = frames(spark, d).select("frame", F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("area"), F.when(F.col("frame") % 2 == 0, 3.0).alias("eu"), F.when(F.col("frame") % 2 == 0, 2.5).alias("ev"))
    return C.best_blobs(f.where(C.in_hues((F.col("u") * 40) % 180, [5.0, 45.0], 15.0)), ["frame"])


@query(
    f"""WITH {SAMPLES}, o AS (SELECT *, CASE WHEN t - lag(t) OVER w > 18 THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY session ORDER BY t, seq)), i AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY t, seq) AS id FROM o), e AS (SELECT session, min(t) AS t_onset, max(t) AS t_end, max(v) AS peak FROM i GROUP BY session, id),
 c AS (SELECT session, min(t) AS a, max(t) AS b FROM s WHERE marker = 'view' GROUP BY session), g AS (SELECT session, min(t) AS at FROM s WHERE marker = 'purchase' GROUP BY session),
 n AS (SELECT e.*, CASE WHEN g.at BETWEEN t_onset AND t_end THEN 0 ELSE least(abs(g.at - t_onset), abs(g.at - t_end)) END AS far FROM e JOIN c ON c.session = e.session AND t_end >= a - 1 AND t_onset <= b + 1 LEFT JOIN g ON g.session = e.session), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY far NULLS LAST, peak DESC, t_onset) AS k FROM n)
 SELECT session, t_onset, t_end, peak FROM k WHERE k = 1"""
)
def saved_event(spark, d):
    """The event that each session's capture is saved for."""
    s = samples(spark, d)
    events = A.islands(s, 18.0).groupBy("session", "island").agg(F.min("t").alias("t_onset"), F.max("t").alias("t_end"), F.max("v").alias("peak")).drop("island")
    triggers = s.where("marker = 'purchase'").groupBy("session").agg(F.min("t").alias("t"))
    return S.events_in_view(events, s.where("marker = 'view'"), 1.0, triggers)


@query(f"WITH {SAMPLES}, c AS (SELECT session, count(*) AS n, max(v) AS peak FROM s GROUP BY session) SELECT session, n, peak FROM c WHERE session NOT IN (SELECT user_id FROM events WHERE value > 100 AND event_type = 'error')")
def kept_sessions(spark, d):
    """The catalogue without the sessions that were deleted."""
    s = samples(spark, d)
    catalog = s.groupBy("session").agg(F.count("*").alias("n"), F.max("v").alias("peak"))
    return catalog.join(s.where("v > 100 and marker = 'error'").select("session").distinct(), "session", "left_anti")


_SIDE = "SELECT g.session, g.i, CASE WHEN n.t > p.t THEN p.v + (n.v - p.v) * (g.t - p.t) / (n.t - p.t) ELSE p.v END AS v FROM g ASOF JOIN {0} p ON p.session = g.session AND g.t >= p.t ASOF LEFT JOIN {0} n ON n.session = g.session AND g.t <= n.t"


@query(
    f"""WITH {SAMPLES}, a AS (SELECT session, t, v FROM s WHERE marker = 'view'), b AS (SELECT session, t, v FROM s WHERE marker = 'click'),
 da AS (SELECT session, median(h) AS h, min(t) AS t0, max(t) AS t1 FROM (SELECT session, t, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS h FROM a) GROUP BY session HAVING count(*) > 1), db AS (SELECT session, median(h) AS h, min(t) AS t0, max(t) AS t1 FROM (SELECT session, t, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS h FROM b) GROUP BY session HAVING count(*) > 1),
 k AS (SELECT session, least(da.h, db.h) AS step, greatest(da.t0, db.t0) AS low, least(da.t1, db.t1) AS high FROM da JOIN db USING (session)), g AS (SELECT session, i, low + i * step AS t FROM k, unnest(range(0, ceil((high - low) / step)::BIGINT)) u(i) WHERE high > low),
 p AS ({_SIDE.format("a")}), q AS ({_SIDE.format("b")}), m AS (SELECT session, i, p.v - avg(p.v) OVER (PARTITION BY session) AS x, q.v - avg(q.v) OVER (PARTITION BY session) AS y FROM p JOIN q USING (session, i)),
 c AS (SELECT x.session, x.i - y.i AS lag, round(sum(x.x * y.y), 6) AS r FROM m x JOIN m y ON x.session = y.session GROUP BY ALL), n AS (SELECT session, count(*) AS n FROM m GROUP BY session)
 SELECT session, round(lag * step, 6) + 0 AS "offset", round(step, 6) AS step, n FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY r DESC, lag) = 1) JOIN k USING (session) JOIN n USING (session)"""
)
def full_cross_correlation(spark, d):
    """Offset of two kinds of events by full cross-correlation."""
    s = samples(spark, d)
    return sync.full_lag(s.where("marker = 'view'"), s.where("marker = 'click'")).withColumns({"offset": F.round("offset", 6) + 0.0, "step": F.round("step", 6)})


@query()
def frame_poses(spark, d):
    """Pose of each frame's points against a model of four; held against numpy in the tests."""
    f = frames(spark, d).select((F.col("frame") % 50).alias("session"), F.col("frame").alias("frame_id"), "marker", "x", "y", "z")
    model = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 1.0)], "marker int, mx double, my double, mz double")
    return G.posed_frames(f, model, ["session", "frame_id"], "frame_id")
