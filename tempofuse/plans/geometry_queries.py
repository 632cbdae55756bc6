"""Queries on vectors, quaternions, cameras, frames of bytes and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempofuse.functions import cameras as C
from tempofuse.functions import vectors as V
from tempofuse.functions.codec import FrameFormat, crc16, decode_frame, encode_frame
from tempofuse.functions.notes import notes, signed
from tempofuse.operators import geometry as G
from tempofuse.operators import segment as S
from tempofuse.plans.base import FRAMES, SAMPLES, VECTORS, query
from tempofuse.sources.tables import frames, samples, table, vectors


def _e(a: int, b: int):
    return tuple(F.col(f"e{k}") for k in range(a, b))


_UNIT = f"WITH {VECTORS}, q AS (SELECT *, sqrt(e0*e0+e1*e1+e2*e2+e3*e3) AS n, sqrt(e4*e4+e5*e5+e6*e6+e7*e7) AS m FROM e), u AS (SELECT vec_id, e0/n AS w, e1/n AS x, e2/n AS y, e3/n AS z, e4/m AS w2, e5/m AS x2, e6/m AS y2, e7/m AS z2, e8 AS a, e9 AS b, e10 AS c, e11 AS f, e12 AS g, e13 AS h FROM q)"


def _rounded(df, named: dict, digits: int = 6, *keys: str):
    # adding 0 makes -0 a plain 0
    return df.select(*(keys or ("vec_id",)), *[(F.round(c, digits) + 0.0).alias(k) for k, c in named.items()])


@query(f"WITH {VECTORS} SELECT vec_id, round(e0*e4-e1*e5-e2*e6-e3*e7, 6) AS w, round(e0*e5+e1*e4+e2*e7-e3*e6, 6) AS x, round(e0*e6-e1*e7+e2*e4+e3*e5, 6) AS y, round(e0*e7+e1*e6-e2*e5+e3*e4, 6) AS z FROM e")
def quat_multiply(spark, d):
    return _rounded(vectors(spark, d), dict(zip("wxyz", V.multiply(_e(0, 4), _e(4, 8)), strict=True)))


@query(_UNIT + " SELECT vec_id, round(w, 6) AS w, round(-x, 6) AS x, round(-y, 6) AS y, round(-z, 6) AS z FROM u")
def quat_conjugate(spark, d):
    return _rounded(vectors(spark, d), dict(zip("wxyz", V.conjugate(V.unit(_e(0, 4))), strict=True)))


@query(_UNIT + " SELECT vec_id, round((1-2*(y*y+z*z))*a + 2*(x*y-w*z)*b + 2*(x*z+w*y)*c, 6) AS x, round(2*(x*y+w*z)*a + (1-2*(x*x+z*z))*b + 2*(y*z-w*x)*c, 6) AS y, round(2*(x*z-w*y)*a + 2*(y*z+w*x)*b + (1-2*(x*x+y*y))*c, 6) AS z FROM u")
def quat_rotate(spark, d):
    return _rounded(vectors(spark, d), dict(zip("xyz", V.rotate(_e(0, 4), _e(8, 11)), strict=True)))


@query(_UNIT + " SELECT vec_id, round(1-2*(y*y+z*z), 6) AS m00, round(2*(x*y-w*z), 6) AS m01, round(2*(x*z+w*y), 6) AS m02, round(2*(x*y+w*z), 6) AS m10, round(1-2*(x*x+z*z), 6) AS m11, round(2*(y*z-w*x), 6) AS m12, round(2*(x*z-w*y), 6) AS m20, round(2*(y*z+w*x), 6) AS m21, round(1-2*(x*x+y*y), 6) AS m22 FROM u")
def quat_matrix(spark, d):
    return _rounded(vectors(spark, d), {f"m{i}{j}": c for i, row in enumerate(V.to_matrix(_e(0, 4))) for j, c in enumerate(row)})


@query(_UNIT + " SELECT vec_id, round(w * s, 6) AS w, round(x * s, 6) AS x, round(y * s, 6) AS y, round(z * s, 6) AS z FROM (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS s FROM u)")
def quat_from_matrix(spark, d):
    """There and back: the quaternion of its matrix, of positive w."""
    m = V.to_matrix(_e(0, 4))
    df = vectors(spark, d).withColumns({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)})
    return _rounded(df, dict(zip("wxyz", V.from_matrix([tuple(F.col(f"m{i}{j}") for j in range(3)) for i in range(3)]), strict=True)))


@query(f"WITH {VECTORS}, k AS (SELECT vec_id, e8 AS x, e9 AS y, e10 AS z, sqrt(e8*e8+e9*e9+e10*e10) AS n FROM e) SELECT vec_id, round(cos(n/2), 6) AS w, round(sin(n/2)/n*x, 6) AS x, round(sin(n/2)/n*y, 6) AS y, round(sin(n/2)/n*z, 6) AS z FROM k")
def quat_exp(spark, d):
    return _rounded(vectors(spark, d), dict(zip("wxyz", V.from_rotation_vector(_e(8, 11)), strict=True)))


@query(_UNIT + ", k AS (SELECT vec_id, abs(w) AS w, x*sg AS x, y*sg AS y, z*sg AS z FROM (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS sg FROM u)), n AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM k) SELECT vec_id, round(2*atan2(n, w)/n*x, 6) AS x, round(2*atan2(n, w)/n*y, 6) AS y, round(2*atan2(n, w)/n*z, 6) AS z FROM n")
def quat_log(spark, d):
    return _rounded(vectors(spark, d), dict(zip("xyz", V.to_rotation_vector(_e(0, 4)), strict=True)))


@query(_UNIT + " SELECT vec_id, round(2 * acos(least(1, abs(w*w2+x*x2+y*y2+z*z2))), 6) AS angle FROM u")
def quat_angle(spark, d):
    return _rounded(vectors(spark, d), {"angle": V.angle_between(_e(0, 4), _e(4, 8))})


@query(
    _UNIT
    + """, k AS (SELECT vec_id, a/l AS a, b/l AS b, c/l AS c, f/r AS f, g/r AS g, h/r AS h FROM (SELECT *, sqrt(a*a+b*b+c*c) AS l, sqrt(f*f+g*g+h*h) AS r FROM u)), p AS (SELECT vec_id, 1+a*f+b*g+c*h AS w, b*h-c*g AS x, c*f-a*h AS y, a*g-b*f AS z FROM k), n AS (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS n FROM p)
 SELECT vec_id, round(w/n, 6) AS w, round(x/n, 6) AS x, round(y/n, 6) AS y, round(z/n, 6) AS z FROM n"""
)
def quat_arc(spark, d):
    return _rounded(vectors(spark, d), dict(zip("wxyz", V.shortest_arc(_e(8, 11), _e(11, 14)), strict=True)))


@query(f"WITH {VECTORS} SELECT vec_id, round(2*(e0*e5-e1*e4-e2*e7+e3*e6), 6) AS x, round(2*(e0*e6+e1*e7-e2*e4-e3*e5), 6) AS y, round(2*(e0*e7-e1*e6+e2*e5-e3*e4), 6) AS z FROM e")
def quat_rate(spark, d):
    """Body rate of a quaternion and its derivative."""
    return _rounded(vectors(spark, d), dict(zip("xyz", V.body_rate(_e(0, 4), _e(4, 8)), strict=True)))


@query(f"WITH {VECTORS} SELECT vec_id, round(e9*e13-e10*e12, 6) AS cx, round(e10*e11-e8*e13, 6) AS cy, round(e8*e12-e9*e11, 6) AS cz, round(e8*e11+e9*e12+e10*e13, 6) AS dotted, round(degrees(asin(greatest(-1, least(1, e9 / sqrt(e8*e8+e9*e9+e10*e10))))), 4) AS elevation FROM e")
def vector_products(spark, d):
    c = V.cross(_e(8, 11), _e(11, 14))
    zero, one = F.lit(0.0), F.lit(1.0)
    return vectors(spark, d).select("vec_id", *[F.round(x, 6).alias(n) for n, x in zip(("cx", "cy", "cz"), c, strict=True)], F.round(V.dot(_e(8, 11), _e(11, 14)), 6).alias("dotted"), F.round(V.angle_to_horizontal(_e(8, 11), (zero, one, zero)), 4).alias("elevation"))


@query(f"WITH {VECTORS}, k AS (SELECT vec_id, e0 + 0.686e0*e8 AS px, e1 + 0.686e0*e9 AS py, e2 + 0.686e0*e10 AS pz, e3 + 0.686e0*e11 AS vx, e4 + 0.686e0*e12 AS vy, e5 + 0.686e0*e13 AS vz FROM e) SELECT vec_id, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, round(sqrt(vx*vx+vy*vy+vz*vz), 6) AS speed FROM k")
def point_and_speed(spark, d):
    """Place and speed at a distance along the axis."""
    p = V.point_at(_e(0, 4)[:3], _e(8, 11), 0.686)
    v = V.point_at((F.col("e3"), F.col("e4"), F.col("e5")), _e(11, 14), 0.686)
    return _rounded(vectors(spark, d), dict(zip(("px", "py", "pz"), p, strict=True)) | {"speed": V.norm(v)})


@query(f"""WITH {VECTORS}, k AS (SELECT vec_id, e0 AS ax, e1 AS ay, e2 AS az, e3 AS wx, e4 AS wy, e5 AS wz, e6 AS lx, e7 AS ly, e8 AS lz, e9 AS rx, e10 AS ry, e11 AS rz FROM e), i AS (SELECT *, wy*rz-wz*ry AS ix, wz*rx-wx*rz AS iy, wx*ry-wy*rx AS iz FROM k)
 SELECT vec_id, round(ax - (ly*rz-lz*ry) - (wy*iz-wz*iy), 6) AS x, round(ay - (lz*rx-lx*rz) - (wz*ix-wx*iz), 6) AS y, round(az - (lx*ry-ly*rx) - (wx*iy-wy*ix), 6) AS z FROM i""")
def lever_arm(spark, d):
    c = [F.col(f"e{k}") for k in range(12)]
    return _rounded(vectors(spark, d), dict(zip("xyz", V.lever_acceleration(tuple(c[:3]), tuple(c[3:6]), tuple(c[6:9]), tuple(c[9:])), strict=True)))


@query(f"WITH {FRAMES}, k AS (SELECT frame, marker, x * 100 AS ul, x * 100 - (y - 1) * 10 AS ur, z AS v FROM f) SELECT frame, marker, round(CASE WHEN ul > ur THEN (ul - 480) * (84e0 / (ul - ur)) / 700 END, 10) AS px, round(CASE WHEN ul > ur THEN (v - 300) * (84e0 / (ul - ur)) / 700 END, 10) AS py, round(CASE WHEN ul > ur THEN 84e0 / (ul - ur) END, 10) AS pz FROM k")
def triangulate(spark, d):
    ul = F.col("x") * 100
    p = C.triangulate(ul, ul - (F.col("y") - 1) * 10, F.col("z"), 700.0, 700.0, 480.0, 300.0, 0.12)
    return _rounded(frames(spark, d), dict(zip(("px", "py", "pz"), p, strict=True)), 10, "frame", "marker")


@query(f"WITH {FRAMES}, z AS (SELECT DISTINCT marker + 1e0 AS z FROM f), k AS (SELECT unnest([0.25e0, 0.5e0, 1e0]) AS error) SELECT z, error, round(z * z / 84e0 * error, 6) AS depth_error FROM z, k")
def depth_budget(spark, d):
    """Depth error on a grid of distances and disparity errors."""
    z = frames(spark, d).select((F.col("marker") + 1.0).alias("z")).distinct()
    grid = z.withColumn("error", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))))
    return grid.select("z", "error", F.round(C.depth_error(F.col("z"), 700.0, 0.12, F.col("error")), 6).alias("depth_error"))


@query(
    f"""WITH {FRAMES}, l AS (SELECT frame, marker, x * 100 AS u, y AS v FROM f WHERE marker <= 4), r AS (SELECT frame, marker, x * 99 - 2 AS u, y + z / 4 AS v FROM f WHERE marker >= 2)
 SELECT frame, marker, round(84e0 / (l.u - r.u), 5) AS depth, round((l.v + r.v) / 2, 5) AS row_px FROM l JOIN r USING (frame, marker) WHERE abs(l.v - r.v) <= 1.5 AND l.u > r.u AND 84e0 / (l.u - r.u) BETWEEN 0.5 AND 10"""
)
def stereo_match(spark, d):
    """Named points of both cameras on equal rows, in the range of depth."""
    f = frames(spark, d)
    l = f.where("marker <= 4").select("frame", "marker", (F.col("x") * 100).alias("ul"), F.col("y").alias("vl"))
    r = f.where("marker >= 2").select("frame", "marker", (F.col("x") * 99 - 2).alias("ur"), (F.col("y") + F.col("z") / 4).alias("vr"))
    p = l.join(r, ["frame", "marker"]).where((F.abs(F.col("vl") - F.col("vr")) <= 1.5) & (F.col("ul") > F.col("ur")))
    p = p.withColumn("depth", 84.0 / (F.col("ul") - F.col("ur"))).where("depth between 0.5 and 10")
    return p.select("frame", "marker", F.round("depth", 5).alias("depth"), F.round((F.col("vl") + F.col("vr")) / 2, 5).alias("row_px"))


_PERMUTED = ", ".join(f"({n}, {a}, {b}, {c})" for n, (a, b, c) in enumerate([(1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)]))


@query(
    f"""WITH {FRAMES}, a AS (SELECT frame, marker AS place, x * 100 AS u, y AS v FROM f WHERE marker <= 3 QUALIFY row_number() OVER (PARTITION BY frame, marker ORDER BY x, y) = 1), b AS (SELECT frame, marker AS place, x * 90 - 3 AS u, y + 0.3e0 AS v FROM f WHERE marker <= 3 QUALIFY row_number() OVER (PARTITION BY frame, marker ORDER BY x, y) = 1), p(n, a1, a2, a3) AS (VALUES {_PERMUTED}),
 m AS (SELECT n, 1 AS l, a1 AS r FROM p UNION ALL SELECT n, 2, a2 FROM p UNION ALL SELECT n, 3, a3 FROM p),
 o AS (SELECT a.frame, a.place AS l, b.place AS r, abs(a.v - b.v) AS off FROM a JOIN b ON b.frame = a.frame WHERE abs(a.v - b.v) <= 2 AND a.u - b.u > 0), c AS (SELECT o.frame, m.n, o.l, o.r, o.off FROM o JOIN m ON m.l = o.l AND m.r = o.r),
 t AS (SELECT x.frame, x.n, count(*) AS turned FROM c x JOIN c y ON x.frame = y.frame AND x.n = y.n AND x.l < y.l AND x.r > y.r GROUP BY ALL),
 g AS (SELECT c.frame, c.n, count(*) AS pairs, coalesce(any_value(t.turned), 0) AS turned, sum(off) AS off FROM c LEFT JOIN t ON t.frame = c.frame AND t.n = c.n GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY pairs DESC, turned, round(off, 6), n) AS k FROM g)
 SELECT c.frame, c.l AS left_place, c.r AS right_place FROM c JOIN w ON w.frame = c.frame AND w.n = c.n AND w.k = 1"""
)
def stereo_assign(spark, d):
    """Unnamed points paired one to one, by the best of the fixed permutations."""
    f = frames(spark, d).where("marker <= 3")
    l = f.select("frame", F.col("marker").alias("place"), (F.col("x") * 100).alias("u"), F.col("y").alias("v"))
    r = f.select("frame", F.col("marker").alias("place"), (F.col("x") * 90 - 3).alias("u"), (F.col("y") + 0.3).alias("v"))
    return G.assigned_pairs(l, r, "frame", 2.0)


_STEP = """s{i} AS (SELECT frame, mask, pairs, turned, off, codes FROM (
  SELECT frame, mask, pairs, turned, off, codes * 10 + 9 AS codes FROM s{h} UNION ALL
  SELECT s.frame, s.mask | (1 << (o.r - 1)), s.pairs + 1, s.turned + bit_count(s.mask >> o.r), s.off + o.off, s.codes * 10 + o.r FROM s{h} s JOIN o ON o.frame = s.frame AND o.l = {i} AND s.mask & (1 << (o.r - 1)) = 0)
  QUALIFY row_number() OVER (PARTITION BY frame, mask ORDER BY pairs DESC, turned, off, codes) = 1)"""


@query(
    f"""WITH {FRAMES}, a AS (SELECT frame, marker AS place, x * 100 AS u, y AS v FROM f QUALIFY row_number() OVER (PARTITION BY frame, marker ORDER BY x, y) = 1), b AS (SELECT frame, marker AS place, x * 90 - 3 AS u, y + 0.3e0 AS v FROM f QUALIFY row_number() OVER (PARTITION BY frame, marker ORDER BY x, y) = 1),
 o AS (SELECT a.frame, a.place AS l, b.place AS r, round(abs(a.v - b.v) * 1e6)::BIGINT AS off FROM a JOIN b ON b.frame = a.frame WHERE abs(a.v - b.v) <= 2 AND a.u > b.u),
 s0 AS (SELECT DISTINCT frame, 0 AS mask, 0 AS pairs, 0 AS turned, 0::BIGINT AS off, 0::BIGINT AS codes FROM f), """
    + ", ".join(_STEP.format(i=i, h=i - 1) for i in range(1, 8))
    + """, best AS (SELECT frame, codes FROM s7 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY pairs DESC, turned, off, codes) = 1)
 SELECT frame, l AS left_place, ((codes // (10 ** (7 - l))::BIGINT) % 10)::INT AS right_place FROM best, (SELECT unnest(range(1, 8))::INT AS l) WHERE (codes // (10 ** (7 - l))::BIGINT) % 10 <> 9"""
)
def stereo_assign_sets(spark, d):
    """Unnamed points of a frame paired one to one, up to seven a side, by the best of each set of taken points."""
    f = frames(spark, d)
    l = f.select("frame", F.col("marker").alias("place"), (F.col("x") * 100).alias("u"), F.col("y").alias("v"))
    r = f.select("frame", F.col("marker").alias("place"), (F.col("x") * 90 - 3).alias("u"), (F.col("y") + 0.3).alias("v"))
    return G.assigned_sets(l, r, "frame", 2.0, 7)


@query(
    f"""WITH {SAMPLES}, m AS (SELECT session, seq % 3 AS marker, seq, CASE WHEN marker <> 'error' THEN v END AS u, CASE WHEN marker <> 'error' THEN t END AS v FROM s), k AS (SELECT *, lag(u) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(v) OVER w AS v1, lag(v, 2) OVER w AS v2 FROM m WINDOW w AS (PARTITION BY session, marker ORDER BY seq))
 SELECT session, marker, seq, u1 IS NULL AS lost, round(u1 + coalesce(u1 - u2, 0), 5) AS pred_u, round(v1 + coalesce(v1 - v2, 0), 5) AS pred_v FROM k"""
)
def marker_prediction(spark, d):
    """Where each of three markers should be, by its last sights; lost ones start anew."""
    seen = F.col("marker") != "error"
    s = samples(spark, d).withColumns({"u": F.when(seen, F.col("v")), "v": F.when(seen, F.col("t")), "marker": F.col("seq") % 3})
    return G.predicted(s).select("session", "marker", "seq", "lost", F.round("pred_u", 5).alias("pred_u"), F.round("pred_v", 5).alias("pred_v"))


_LINE = f"""WITH {FRAMES}, g AS (SELECT frame, count(*) AS n_markers, avg(s) AS ms, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, regr_slope(x, s) AS vx, regr_slope(y, s) AS vy, regr_slope(z, s) AS vz FROM f GROUP BY frame),
 h AS (SELECT *, CASE WHEN sqrt(vx*vx+vy*vy+vz*vz) >= 1e-6 THEN sqrt(vx*vx+vy*vy+vz*vz) END AS n FROM g), b AS (SELECT frame, vx/n AS ux, vy/n AS uy, vz/n AS uz, mx - ms*vx/n AS kx, my - ms*vy/n AS ky, mz - ms*vz/n AS kz, n_markers FROM h)"""


@query(_LINE + " SELECT frame, round(ux, 5) + 0 AS u_x, round(uy, 5) + 0 AS u_y, round(uz, 5) + 0 AS u_z, round(kx, 5) + 0 AS k_x, round(ky, 5) + 0 AS k_y, round(kz, 5) + 0 AS k_z, n_markers FROM b WHERE n_markers >= 2")
def bat_line(spark, d):
    b = G.bar_line(frames(spark, d)).where("n_markers >= 2")
    return b.select("frame", *[(F.round(f"{k}_{a}", 5) + 0.0).alias(f"{k}_{a}") for k in "uk" for a in "xyz"], "n_markers")


@query(_LINE + " SELECT frame, round(avg(x - s * ux), 5) AS end_x, round(avg(y - s * uy), 5) AS end_y, round(avg(z - s * uz), 5) AS end_z, count(*) AS n_markers FROM f JOIN b USING (frame) WHERE b.n_markers >= 2 GROUP BY frame")
def knob_mean(spark, d):
    f = frames(spark, d)
    k = G.end_from_markers(f, G.bar_line(f).where("n_markers >= 2"))
    return k.select("frame", *[F.round(f"end_{a}", 5).alias(f"end_{a}") for a in "xyz"], "n_markers")


@query(_LINE + " SELECT frame, marker, round(sqrt((x-kx-s*ux)*(x-kx-s*ux) + (y-ky-s*uy)*(y-ky-s*uy) + (z-kz-s*uz)*(z-kz-s*uz)), 5) AS residual FROM f JOIN b USING (frame) WHERE n_markers >= 2")
def marker_fill(spark, d):
    f = frames(spark, d)
    return G.filled_markers(f, G.bar_line(f).where("n_markers >= 2")).select("frame", "marker", F.round("residual", 5).alias("residual"))


def _sensor(spark, d):
    s = samples(spark, d).select("session", "seq", "t_us", "v")
    v = F.col("v")
    channels = {n: (v - 10 * k) * f for k, (n, f) in enumerate([("ax", 0.5), ("ay", 0.4), ("az", 0.3), ("gx", 0.1), ("gy", 0.05), ("gz", -0.1), ("hx", 9.0), ("hy", -8.0), ("hz", 7.0)])}
    return s.withColumn("frame", encode_frame(F.col("t_us"), channels | {"hf1": F.col("seq") % 70000, "hf2": F.lit(1), "hf3": F.lit(65535)}, FrameFormat()))


_CODE = "greatest(-32768, least(32767, round_even((v - {k}) * {f} / {s}, 0)::BIGINT))"
_CODES = {"ax": _CODE.format(k=0, f="0.5e0", s="0.009576806641e0"), "gy": _CODE.format(k=40, f="0.05e0", s="0.002130528872e0"), "hz": _CODE.format(k=80, f="7e0", s="0.4788403320e0")}


@query(f"WITH {SAMPLES} SELECT session, seq, t_us % 4294967296 AS tx_us, round({_CODES['ax']} * 0.009576806641e0, 6) AS ax, round({_CODES['gy']} * 0.002130528872e0, 6) AS gy, round({_CODES['hz']} * 0.4788403320e0, 5) AS hz, least(65535, seq % 70000) AS hf1 FROM s")
def frame_decode(spark, d):
    """Frames of bytes, encoded from the stream and decoded again."""
    f = _sensor(spark, d)
    got = decode_frame(F.col("frame"), FrameFormat())
    return f.select("session", "seq", got["tx_us"].alias("tx_us"), F.round(got["ax"], 6).alias("ax"), F.round(got["gy"], 6).alias("gy"), F.round(got["hz"], 5).alias("hz"), got["hf1"].alias("hf1"))


@query(f"WITH {SAMPLES} SELECT session, seq, 30 AS n_bytes, lpad(hex(t_us % 4294967296), 8, '0') AS clock, lpad(hex(({_CODES['ax']} + 65536) % 65536), 4, '0') AS ax FROM s")
def frame_encode(spark, d):
    return _sensor(spark, d).select("session", "seq", F.octet_length("frame").alias("n_bytes"), F.hex(F.substring("frame", 1, 4)).alias("clock"), F.hex(F.substring("frame", 5, 2)).alias("ax"))


_SCALES = {"a": "0.009576806641e0", "g": "0.002130528872e0", "h": "0.4788403320e0"}
_SIGNED = [("ax", 0.5), ("ay", 0.4), ("az", 0.3), ("gx", 0.1), ("gy", 0.05), ("gz", -0.1), ("hx", 9.0), ("hy", -8.0), ("hz", 7.0)]
_WORDS = " || ".join(f"lpad(hex(({_CODE.format(k=10 * k, f=f'({f!r}::DOUBLE)', s=_SCALES[n[0]])} + 65536) % 65536), 4, '0')" for k, (n, f) in enumerate(_SIGNED))
_TABLE = "t0(b, c, k) AS (SELECT b, (b << 8)::INT, 0 FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, CASE WHEN c & 32768 <> 0 THEN xor((c << 1) & 65535, 4129) ELSE (c << 1) & 65535 END, k + 1 FROM t0 WHERE k < 8), crc AS (SELECT b, c FROM t0 WHERE k = 8)"


@query(
    f"""WITH RECURSIVE {SAMPLES}, {_TABLE}, h AS (SELECT session, seq, lpad(hex(t_us % 4294967296), 8, '0') || {_WORDS} || lpad(hex(least(65535, seq % 70000)), 4, '0') || '0001' || 'FFFF' || '0FFF' AS h FROM s),
 r(session, seq, h, c, i) AS (SELECT session, seq, h, 65535, 0 FROM h UNION ALL SELECT r.session, r.seq, r.h, xor((r.c << 8) & 65535, crc.c), r.i + 1 FROM r JOIN crc ON crc.b = xor(r.c >> 8, ('0x' || substr(r.h, 2 * r.i + 1, 2))::INT) WHERE r.i < 30)
 SELECT session, seq, c AS crc FROM r WHERE i = 30"""
)
def frame_crc(spark, d):
    """Check sums of the frames; held against a plain loop in the tests."""
    return _sensor(spark, d).select("session", "seq", crc16(F.col("frame")).alias("crc"))


_HUE = """WITH k AS (SELECT p_partkey, (p_partkey * 7919 + 12345) % 16777216 AS c FROM part), x AS (SELECT p_partkey, c // 65536 AS r, (c // 256) % 256 AS g, c % 256 AS b FROM k),
 h AS (SELECT p_partkey, CASE WHEN greatest(r, g, b) = least(r, g, b) THEN NULL WHEN r = greatest(r, g, b) THEN 30e0 * (((g - b) / (greatest(r, g, b) - least(r, g, b)) + 6) % 6) WHEN g = greatest(r, g, b) THEN 30e0 * ((b - r) / (greatest(r, g, b) - least(r, g, b)) + 2) ELSE 30e0 * ((r - g) / (greatest(r, g, b) - least(r, g, b)) + 4) END AS hue FROM x)"""


@query(_HUE + " SELECT p_partkey, round(hue, 5) AS hue, CASE WHEN hue - 7 < 0 OR hue + 7 > 180 THEN 2 ELSE 1 END AS n_ranges, round(CASE WHEN hue - 7 < 0 THEN 0 ELSE hue - 7 END, 5) AS low FROM h WHERE hue IS NOT NULL")
def hue_ranges(spark, d):
    c = (F.col("p_partkey") * 7919 + 12345) % 16777216
    h = table(spark, d, "part").select("p_partkey", C.hex_hue(F.concat(F.lit("#"), F.lpad(F.hex(c), 6, "0"))).alias("hue")).where("hue is not null")
    r = C.hue_ranges(F.col("hue"), 7.0)
    return h.select("p_partkey", F.round("hue", 5).alias("hue"), F.size(r).alias("n_ranges"), F.round(r[0][0], 5).alias("low"))


@query(
    """WITH k AS (SELECT o_orderkey, 60 + (o_custkey % 30) AS speed, 60 + (o_custkey % 30) + (o_orderkey % 9) AS peak, (o_orderkey % 41) - 10 AS path, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_custkey % 50) - 50 END AS bar, 0.1e0 + (o_orderkey % 15) / 100e0 AS tm FROM orders),
 r AS (SELECT o_orderkey, path, list_filter([CASE WHEN path < 1 THEN 'path_steep_down' WHEN path < 6 THEN 'path_flat' WHEN path > 19 THEN 'path_uphill' END, CASE WHEN tm > 0.2e0 THEN 'slow_to_contact' END, CASE WHEN speed < 65 THEN CASE WHEN peak - speed > 5 THEN 'early_release' ELSE 'low_speed' END END, CASE WHEN bar > -13 THEN 'bar_flat' END], lambda x: x IS NOT NULL) AS said FROM k)
 SELECT o_orderkey, CASE WHEN len(said) = 0 THEN 'solid' ELSE array_to_string(said[1:3], ',') END AS notes, printf('%+.0f°', path::DOUBLE) AS shown FROM r"""
)
def coaching_notes(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    k = table(spark, d, "orders").select("o_orderkey", (60.0 + cust % 30).alias("speed"), (60.0 + cust % 30 + key % 9).alias("peak"), (key % 41 - 10).cast("double").alias("path"), F.when(key % 11 != 0, (cust % 50 - 50).cast("double")).alias("bar"), (0.1 + (key % 15) / 100.0).alias("tm"))
    said = notes(F.col("speed"), F.col("peak"), F.col("path"), F.col("bar"), F.col("tm"))
    return k.select("o_orderkey", F.array_join(said, ",").alias("notes"), signed(F.col("path")).alias("shown"))


@query(f"WITH {SAMPLES} SELECT session, seq, round(-(v - 9), 6) + 0 AS minus_y, round(abs(sqrt(v*v + (v-9)*(v-9) + 4) - 9.80665e0), 6) AS magnitude, round(sqrt(v*v + (v-9)*(v-9)), 6) AS planar FROM s")
def trigger_signals(spark, d):
    v = F.col("v")
    a, g = (v, v - 9, F.lit(2.0)), (v, v, v)
    return samples(spark, d).select("session", "seq", *[(F.round(S.trigger_signal(k, g, a), 6) + 0.0).alias(n) for k, n in (("accel_-y", "minus_y"), ("accel_mag", "magnitude"), ("accel_xy", "planar"))])


@query(f"WITH {FRAMES} SELECT frame, array_to_string(list('band_' || marker ORDER BY marker), '|') AS markers, count(*) FILTER (WHERE marker NOT IN (1, 2, 3)) AS n_unknown FROM f GROUP BY frame HAVING count(*) >= 2")
def frame_labels(spark, d):
    """Names of a frame's markers, those unknown, for frames of two or more."""
    g = frames(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list("marker")).alias("m")).where(F.size("m") >= 2)
    return g.select("frame", F.array_join(F.transform("m", lambda x: F.concat(F.lit("band_"), x.cast("string"))), "|").alias("markers"), F.size(F.filter("m", lambda x: ~x.isin(1, 2, 3))).cast("long").alias("n_unknown"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, strftime(ts, '%Y%m%d_%H%M%S') AS name FROM events")
def payload_fields(spark, d):
    """Fields of JSON payloads, and names by time."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("name"))
