"""Queries that write the given tables in the formats of captures, and read them again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempofuse.functions import vectors as V
from tempofuse.operators import curves, geometry
from tempofuse.plans import motion_queries  # noqa: F401
from tempofuse.plans.base import FRAMES, SAMPLES, SQL, VECTORS, query
from tempofuse.sources import files, sinks
from tempofuse.sources.catalogue import Catalogue
from tempofuse.sources.tables import frames, samples, vectors
from tempofuse.streaming.flows import shared_path

_K = f"{SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS k FROM s)"


def _numbered(spark, d):
    return samples(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1)


def _written(rows, names):
    """rows as CSV files with a header, each of many sessions, which a column names; their path."""
    path = shared_path(rows.sparkSession)
    sinks.write_csv(rows.select(F.concat(F.lit("session="), F.col("session").cast("string")).alias("session_name"), *names), path)
    return path


def _capture(rows, host):
    value = {"tx_time_stamp": F.pmod(F.lit(4294960000) + F.col("k") * 2500, F.lit(1 << 32)), "imu_meas_time": F.col("t"), "system_time": F.col("t"), "status_var_value": F.lit(4095), "ts_ns_host": host, "impact_flag": (F.col("seq") % 5 == 0).cast("int")}
    value |= {c: F.col("v") * (n + 1) for n, c in enumerate(("accel_x", "accel_y", "accel_z", "omega_x", "omega_y", "omega_z"))}
    return rows.withColumns(value), list(value)


@query(f"WITH {_K} SELECT 'session=' || session AS session, row_number() OVER (PARTITION BY session ORDER BY t, k) - 1 AS seq, (4294960000 + k * 2500) % 4294967296 AS tx_us, round(t, 6) AS t, round(v * 4, 6) AS gx, round(v, 6) AS ax, 0e0 AS hx, seq % 5 = 0 AS impact_flag, false AS has_host_clock FROM k")
def imu_csv_rows(spark, d):
    """A capture without host times and high-range columns, written as CSV and read again."""
    path = _written(*_capture(_numbered(spark, d), F.lit(0)))
    got = files.read_imu_csv(spark, path)
    return got.select("session", "seq", "tx_us", *[F.round(c, 6).alias(c) for c in ("t", "gx", "ax")], "hx", "impact_flag", "has_host_clock")


_HOST = "1700000000000000000 + k * 2500050 + (seq % 7) * 100000"
_LINE = f"""WITH {_K}, c AS (SELECT session, seq, k, k * 0.0025e0 AS d, ({_HOST})::BIGINT AS ns FROM k), h AS (SELECT *, (ns - min(ns) OVER (PARTITION BY session)) / 1e9 AS h, min(ns) OVER (PARTITION BY session) AS n0, count(*) OVER (PARTITION BY session) AS n FROM c),
 r AS (SELECT session, regr_slope(h, d) AS b, regr_intercept(h, d) AS a FROM h GROUP BY session), l AS (SELECT h.session, quantile_cont(h - (a + b * d), 0.05) AS lift FROM h JOIN r USING (session) GROUP BY h.session)"""


@query(_LINE + " SELECT 'session=' || session AS session, k AS seq, round(n0 / 1e9 + a + b * d + lift - 1700000000, 4) + 0 AS t FROM h JOIN r USING (session) JOIN l USING (session) WHERE n > 1")
def imu_csv_host_times(spark, d):
    """A capture with host times: its device clock, which starts over, is mapped on them. Sessions of one row have no line."""
    host = F.lit(1_700_000_000_000_000_000) + F.col("k") * 2_500_050 + (F.col("seq") % 7) * 100_000
    rows, names = _capture(_numbered(spark, d), host)
    got = files.read_imu_csv(spark, _written(rows.withColumn("imu_meas_time", F.col("k") * 0.0025), names))
    return got.where("t is not null").select("session", "seq", (F.round(F.col("t") - 1_700_000_000, 4) + 0.0).alias("t"))


@query(_LINE + " SELECT session, seq, round(CASE WHEN n > 10 THEN n0 / 1e9 + a + b * d + lift ELSE ns / 1e9 END - 1700000000, 4) + 0 AS t, v * 2 AS gx FROM h JOIN r USING (session) JOIN l USING (session) JOIN (SELECT session, seq, v FROM s) USING (session, seq)")
def batch_sample_times(spark, d):
    """Samples in JSON batches of a session's rows, read again, with times on the host's clock."""
    rows = _numbered(spark, d).withColumn("host", F.lit(1_700_000_000_000_000_000) + F.col("k") * 2_500_050 + (F.col("seq") % 7) * 100_000)
    sample = F.struct(F.pmod(F.lit(4294960000) + F.col("k") * 2500, F.lit(1 << 32)).alias("tx_us"), (F.col("v") * 2).alias("gx"), F.col("host").alias("ts_ns_host"))
    message = F.to_json(F.struct(F.lit("imu").alias("type"), F.array(sample).alias("samples")))
    got = files.mapped_samples(files.batch_samples(rows.select("session", "seq", message.alias("value"))))
    return got.select("session", "seq", (F.round(F.col("t") - 1_700_000_000, 4) + 0.0).alias("t"), "gx")


_U = FRAMES + ", u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY frame, marker ORDER BY x, y, z) = 1)"


@query(f"WITH {_U} SELECT 'session=' || frame % 5 AS session, frame AS frame_id, round(frame / 128e0, 6) AS t, 'm' || marker AS marker_id, x, y, z FROM u WHERE marker <> 7")
def camera_json_points(spark, d):
    """Marker frames written as JSON lines and read again: the points of six of the seven names."""
    p = frames(spark, d).groupBy("frame", "marker").agg(F.min(F.struct("x", "y", "z")).alias("p"))
    rows = p.select((F.col("frame") % 5).alias("session"), F.col("frame").alias("frame_id"), (F.col("frame") / 128).alias("t"), F.concat(F.lit("m"), F.col("marker").cast("string")).alias("marker_id"), "p.x", "p.y", "p.z", F.lit("camera").alias("source"))
    path = shared_path(spark)
    sinks.marker_frames(rows).select("session", "value").write.partitionBy("session").text(path)
    got = files.marker_observations(files.read_camera_jsonl(spark, path), [f"m{k}" for k in range(1, 7)])
    return got.select("session", "frame_id", F.round("t", 6).alias("t"), "marker_id", "x", "y", "z")


_TURNED = [f"-(e{3 * k} * 8 * e9 + e{3 * k + 1} * 8 * e10 + e{3 * k + 2} * 8 * e11)" for k in range(3)]


@query(f"WITH {VECTORS}, g AS (SELECT vec_id, " + ", ".join(f"{c} * 12 AS g{k}" for k, c in enumerate(_TURNED)) + " FROM e), n AS (SELECT *, sqrt(g0*g0 + g1*g1 + g2*g2) AS n FROM g) SELECT vec_id, " + ", ".join(f"round(CASE WHEN n BETWEEN 0.8e0 * 9.80665e0 AND 1.2e0 * 9.80665e0 THEN g{k} * 9.80665e0 / n END, 5) + 0 AS g{k}" for k in range(3)) + " FROM n")
def camera_gravity(spark, d):
    """Gravity of captures by their metadata, null where its length is far from that of gravity."""
    e = vectors(spark, d)
    row = lambda k: F.array(*[F.col(f"e{3 * k + j}") * 8 for j in range(3)], F.lit(0.0))
    meta = e.select("vec_id", F.array(*[F.col(f"e{k}") * 12 for k in (9, 10, 11)]).alias("accel_mean"), F.array(row(0), row(1), row(2), F.array(*[F.lit(0.0)] * 3, F.lit(1.0))).alias("transform"))
    got = files.camera_gravity(meta)
    return got.select("vec_id", *[(F.round(F.col("gravity")[k], 5) + 0.0).alias(f"g{k}") for k in range(3)])


@query(f"WITH {SAMPLES}, n AS (SELECT DISTINCT session, t_us * 1000 AS ns FROM s WHERE t_us % 3 <> 0 OR t_us % 2 <> 0) SELECT session, row_number() OVER (PARTITION BY session ORDER BY ns) AS frame_id, ns AS ts_ns_image FROM n WHERE ns >= 1704067200000000000 + 86400000000000 AND ns <= 1704067200000000000 + 2000000000000000")
def segment_rows(spark, d):
    """Frames of two recorded segments that overlap, as one sequence between two times."""
    ns = samples(spark, d).select("session", (F.col("t_us") * 1000).alias("ts_ns_image"), "t_us")
    both = ns.where("t_us % 3 <> 0").unionByName(ns.where("t_us % 2 <> 0"))
    start = F.lit(1_704_067_200_000_000_000)
    return files.segment_frames(both, start + 86_400_000_000_000, start + 2_000_000_000_000_000).select("session", "frame_id", "ts_ns_image")


@query(f"WITH {SAMPLES} SELECT session, seq, marker, v FROM s")
def written_tables(spark, d):
    """Rows as Parquet by session; half of the sessions are written after the others, and one of them twice, which
    replaces only them."""
    path, rows = shared_path(spark), samples(spark, d).select("session", "seq", "marker", "v")
    sinks.write_sessions(rows.where("session % 2 = 1").unionByName(rows.where("session % 2 = 0").limit(1)), path)
    sinks.write_sessions(rows.where("session % 2 = 0"), path)
    return spark.read.schema(rows.schema).parquet(path).select("session", "seq", "marker", "v")


@query(f"WITH {SAMPLES} SELECT session, seq, marker, v FROM s")
def written_csv(spark, d):
    path, rows = shared_path(spark), samples(spark, d).select("session", "seq", "marker", "v")
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query(f"WITH {SAMPLES} SELECT session, seq, marker, round(v / 3, 4) AS v FROM s")
def written_documents(spark, d):
    """Measures as JSON documents, one a row, written as lines and read again."""
    path, rows = shared_path(spark), samples(spark, d).select("session", "seq", "marker", (F.col("v") / 3).alias("v"))
    sinks.measures_json(rows).write.text(path)
    return spark.read.schema(rows.schema).json(path).select("session", "seq", "marker", F.round("v", 4).alias("v"))


@query("SELECT m.session, m.seq, e.value AS v, m.value AS cam_v FROM (" + SQL["monotone_cubic"] + ") m JOIN events e ON e.event_id = m.seq")
def joined_export(spark, d):
    """Inertial rows with the camera's curve at their times, written as CSV and read again."""
    s = samples(spark, d)
    both = curves.joined_streams(s.where("marker = 'view'").select("session", "seq", "t", "v"), s.where("marker = 'click'").select("session", "t", "v"), ("v",))
    path, rows = shared_path(spark), both.select("session", "seq", "v", F.round("cam_v", 5).alias("cam_v"))
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query(f"WITH {VECTORS} SELECT vec_id, 0e0 AS own, round(-e2 * e4 + e1 * e5, 6) + 0 AS x, round(e2 * e3 - e0 * e5, 6) + 0 AS y, round(-e1 * e3 + e0 * e4, 6) + 0 AS z FROM e")
def skew_products(spark, d):
    """The skew matrix of one vector times another: their cross product; times itself nothing."""
    e = vectors(spark, d)
    a, b = tuple(F.col(f"e{k}") for k in range(3)), tuple(F.col(f"e{k}") for k in range(3, 6))
    m = V.skew_rows(a)
    return e.select("vec_id", (F.round(V.dot(m[0], a), 6) + 0.0).alias("own"), *[(F.round(V.dot(r, b), 6) + 0.0).alias(n) for r, n in zip(m, "xyz", strict=True)])


@query(f"WITH {VECTORS} SELECT vec_id, round(cos(e1) * cos(e0), 6) + 0 AS x, round(cos(e1) * sin(e0), 6) + 0 AS y, round(sin(e1), 6) + 0 AS z FROM e")
def sphere_points(spark, d):
    e = vectors(spark, d)
    return e.select("vec_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(V.spherical(F.col("e0"), F.col("e1")), "xyz", strict=True)])


@query(
    """WITH g AS (SELECT l_suppkey AS image, (l_partkey % 30)::INT AS u, l_linenumber::INT AS v, CASE WHEN l_quantity < 40 THEN l_quantity::DOUBLE END AS z FROM lineitem), d AS (SELECT image, u, v, min(z) AS z FROM g GROUP BY ALL), c AS (SELECT DISTINCT image, u AS cu, v AS cv FROM g WHERE u % 7 = 0)
 SELECT c.image, cu, cv, median(z) AS depth, count(z) AS n FROM c LEFT JOIN d ON d.image = c.image AND abs(d.u - cu) <= 2 AND abs(d.v - cv) <= 2 AND d.z IS NOT NULL GROUP BY ALL"""
)
def patch_depths(spark, d):
    """Medians of the depths about some pixels."""
    from tempofuse.sources.tables import table

    g = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 30).cast("int").alias("u"), F.col("l_linenumber").cast("int").alias("v"), F.when(F.col("l_quantity") < 40, F.col("l_quantity").cast("double")).alias("z"))
    pixels = g.groupBy("image", "u", "v").agg(F.min("z").alias("z"))
    centers = g.where("u % 7 = 0").select("image", F.col("u").alias("cu"), F.col("v").alias("cv")).distinct()
    return geometry.patch_median(pixels, centers, 2, "image")


@query(f"WITH {FRAMES}, n AS (SELECT frame, list(DISTINCT marker) AS m FROM f GROUP BY frame) SELECT frame, array_to_string(list_sort(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(m, x))), ',') AS missing, len(list_filter(m, lambda x: x > 4)) AS others FROM n")
def missing_markers(spark, d):
    """The names of the bar that a frame lacks, and how many of its names are not of the first four."""
    g = frames(spark, d).groupBy("frame").agg(F.collect_set(F.col("marker").cast("int")).alias("m"))
    lacks = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in range(1, 8)]), F.col("m")))
    others = F.array_except(F.col("m"), F.array(*[F.lit(k) for k in range(1, 5)]))
    return g.select("frame", F.array_join(lacks, ",").alias("missing"), F.size(others).cast("long").alias("others"))


@query(f"WITH {SAMPLES} SELECT 'e' || seq AS id, CASE WHEN seq % 3 = 0 THEN 'ok' WHEN seq % 3 = 1 THEN 'failed' ELSE 'processing' END AS status, marker AS meta FROM s WHERE v > 60 AND seq % 10 <> 0")
def catalogue_status(spark, d):
    """Statuses of events in a catalogue of two writers, one of which comes too late and deletes some; after a snapshot."""
    s = samples(spark, d).where("v > 60").select(F.concat(F.lit("e"), F.col("seq").cast("string")).alias("id"), "seq", F.timestamp_micros("t_us").alias("at"), F.col("marker").alias("meta"))
    path = shared_path(spark)
    one, two = Catalogue(spark, path, "one"), Catalogue(spark, path, "two")
    one.add(s)
    later = F.col("at") + F.expr("interval 1 second")
    two.finish(s.where("seq % 6 = 0").select("id", F.lit("failed").alias("status"), (later + F.expr("interval 1 second")).alias("at")))
    one.finish(s.where("seq % 3 < 2").select("id", F.when(F.col("seq") % 3 == 0, "ok").otherwise("failed").alias("status"), later.alias("at")))
    one.compact()
    two.delete(s.where("seq % 10 = 0").select("id"))
    return two.current().select("id", "status", "meta")
