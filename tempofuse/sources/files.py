"""Readers of captures: inertial CSV, camera JSON lines, metadata, recorded segments and byte streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tempofuse.operators.align import unwrapped
from tempofuse.operators.quality import clock_line, on_clock_line
from tempofuse.sources.bytestreams import CheckedFrames, SyncFrames, find_frames

GRAVITY = 9.80665
#: Header of an inertial CSV. (Fixed values of the file format.)
IMU_COLUMNS = [
    ("tx_time_stamp", LongType()), ("imu_meas_time", DoubleType()), ("system_time", DoubleType()), ("status_var_value", IntegerType()),
    ("accel_x", DoubleType()), ("accel_y", DoubleType()), ("accel_z", DoubleType()), ("omega_x", DoubleType()), ("omega_y", DoubleType()), ("omega_z", DoubleType()),
    ("accel_x2", DoubleType()), ("accel_y2", DoubleType()), ("accel_z2", DoubleType()), ("accel_hf_1", DoubleType()), ("accel_hf_2", DoubleType()), ("accel_hf_3", DoubleType()),
    ("ts_ns_host", LongType()), ("impact_flag", IntegerType()),
]
OPTIONAL = {"accel_x2", "accel_y2", "accel_z2", "accel_hf_1", "accel_hf_2", "accel_hf_3", "ts_ns_host", "impact_flag"}
POINT = "array<struct<id:string,pos:struct<x:double,y:double,z:double>,disparity_px:double,row_err_px:double,uv_left:array<double>,uv_right:array<double>,color:string,source:string>>"
FRAME_SCHEMA = f"schema_version string, coord_sys string, camera_id string, frame_id long, ts_ns_image long, ts_ns_mono long, ts_ns_wall long, depth_source string, points {POINT}"


def _session(path: Column) -> Column:
    """The name of the folder that a file is in."""
    return F.element_at(F.split(path, "/"), -2)


def read_imu_csv(spark: SparkSession, path: str) -> DataFrame:
    """imu_samples of all files under path: session, seq, tx_us, t, gx..gz, ax..az, hx..hz, impact_flag, has_host_clock.

    A session is a folder; of many small ones, whose folders would cost more than their rows, files may hold several,
    named by a column session_name.

    Columns are found by name; missing optional ones read as 0 or null. Where every row of a session has a positive
    host time, t is the device clock mapped on it; else it is the device's own measured time. Rows of one session are
    numbered in order of t, ties in order of the device clock.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    have = set(raw.columns)
    raw = raw.withColumn("session", F.col("session_name") if "session_name" in have else _session(F.input_file_name()))
    missing = [n for n, _ in IMU_COLUMNS if n not in have and n not in OPTIONAL]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    typed = raw.select("session", *[(F.col(n).cast(k) if n in have else F.lit(None).cast(k)).alias(n) for n, k in IMU_COLUMNS])
    trusted = F.bool_and(F.coalesce(F.col("ts_ns_host") > 0, F.lit(False))).over(Window.partitionBy("session"))
    typed = unwrapped(typed.withColumn("has_host_clock", trusted), "tx_time_stamp", order=("imu_meas_time", "tx_time_stamp"))
    start = F.min("ts_ns_host").over(Window.partitionBy("session"))
    clock = typed.withColumns({"device": F.col("unwrapped") / 1e6, "host": F.when(F.col("has_host_clock"), (F.col("ts_ns_host") - start) / 1e9), "start_ns": start})
    first = F.min("device").over(Window.partitionBy("session"))
    mapped = on_clock_line(clock.withColumn("since", F.col("device") - first), "device", "host")
    t = F.when(F.col("has_host_clock"), F.col("start_ns") / 1e9 + F.col("intercept") + F.col("slope") * F.col("since") + F.col("lift")).otherwise(F.col("imu_meas_time"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    out = mapped.withColumn("t", t)
    return out.select(
        "session", (F.row_number().over(Window.partitionBy("session").orderBy("t", "unwrapped")) - 1).cast("long").alias("seq"), F.col("tx_time_stamp").alias("tx_us"), "ts_ns_host", "t",
        F.col("omega_x").alias("gx"), F.col("omega_y").alias("gy"), F.col("omega_z").alias("gz"), F.col("accel_x").alias("ax"), F.col("accel_y").alias("ay"), F.col("accel_z").alias("az"),
        zero("accel_x2").alias("hx"), zero("accel_y2").alias("hy"), zero("accel_z2").alias("hz"), (F.coalesce("impact_flag", F.lit(0)) != 0).alias("impact_flag"), "has_host_clock",
    )


def read_camera_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all files under path, one JSON object a line; blank lines are passed over, extra keys are not read."""
    return spark.read.schema(FRAME_SCHEMA).json(path).withColumn("session", _session(F.input_file_name())).where("frame_id is not null or ts_ns_image is not null")


def marker_observations(frames: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """session, frame_id, t (s), marker_id, x, y, z: a row for each point with a name; of one name's points in a frame the
    last counts; names that are not in markers, if given, are dropped."""
    p = frames.select("session", "frame_id", (F.col("ts_ns_image") / 1e9).alias("t"), F.posexplode("points").alias("k", "p")).where("p.id is not null")
    if markers is not None:
        p = p.where(F.col("p.id").isin(markers))
    last = p.groupBy("session", "frame_id", "t", F.col("p.id").alias("marker_id")).agg(F.max_by("p.pos", "k").alias("pos"))
    return last.select("session", "frame_id", "t", "marker_id", "pos.x", "pos.y", "pos.z")


def wide_markers(observations: DataFrame, markers: list[str]) -> DataFrame:
    """One row a frame, with x_, y_ and z_ of each marker."""
    return observations.groupBy("session", "frame_id", "t").pivot("marker_id", markers).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))


def camera_gravity(meta: DataFrame, accel: str = "accel_mean", rotation: str = "transform") -> DataFrame:
    """meta with gravity: minus the rotated mean acceleration, of length g; null unless its length is within a fifth of g.

    accel is an array of 3 and rotation the rows of a 4 x 4 transform.
    """
    turned = F.transform(F.slice(rotation, 1, 3), lambda r: -F.aggregate(F.zip_with(F.slice(r, 1, 3), F.col(accel), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    length = F.sqrt(F.aggregate("__g", F.lit(0.0), lambda s, x: s + x * x))
    return meta.withColumn("__g", turned).withColumn("__n", length).withColumn("gravity", F.when(F.col("__n").between(0.8 * GRAVITY, 1.2 * GRAVITY), F.transform("__g", lambda x: x * GRAVITY / F.col("__n")))).drop("__g", "__n")


def segment_frames(frames: DataFrame, start_ns: Column, end_ns: Column) -> DataFrame:
    """Frames of recorded segments that overlap, as one sequence: those from start to end, each time once, numbered from 1."""
    inside = frames.where(F.col("ts_ns_image").between(start_ns, end_ns)).dropDuplicates(["session", "ts_ns_image"])
    return inside.withColumn("frame_id", F.row_number().over(Window.partitionBy("session").orderBy("ts_ns_image")).cast("long"))


SAMPLE = StructType([StructField("tx_us", LongType()), *[StructField(n, DoubleType()) for n in ("gx", "gy", "gz", "ax", "ay", "az")], StructField("ts_ns_host", LongType()), StructField("impact_flag", IntegerType())])


def batch_samples(messages: DataFrame, column: str = "value") -> DataFrame:
    """Rows of JSON batches {"type": "imu", "samples": [...]}; other messages and broken ones give none."""
    kind = StructType([StructField("type", StringType()), StructField("samples", ArrayType(SAMPLE))])
    parsed = messages.withColumn("__m", F.from_json(F.col(column).cast("string"), kind)).where("__m.type = 'imu'")
    return parsed.select(*[c for c in messages.columns if c != column], F.inline("__m.samples"))


def mapped_samples(samples: DataFrame, by: str = "session", order: str = "seq", least: int = 11) -> DataFrame:
    """batch_samples() with t: the device clock, made to go on in the order of rows and mapped on the host's by the line of
    each session, lifted as clock_line() does; the host's own time where a session has fewer rows than `least`."""
    w = Window.partitionBy(by)
    s = unwrapped(samples, "tx_us", by, (order,)).withColumns({"__n": F.count("*").over(w), "__start": F.min("ts_ns_host").over(w)})
    s = s.withColumns({"__device": F.col("unwrapped") / 1e6, "__host": (F.col("ts_ns_host") - F.col("__start")) / 1e9})
    s = s.withColumn("__since", F.col("__device") - F.min("__device").over(w)).join(clock_line(s, "__device", "__host", by), by, "left")
    on_line = F.col("__start") / 1e9 + F.col("intercept") + F.col("slope") * F.col("__since") + F.col("lift")
    return s.withColumn("t", F.when(F.col("__n") >= least, on_line).otherwise(F.col("ts_ns_host") / 1e9)).select(*samples.columns, "t")


def resync_frames(chunks: DataFrame, by: str = "session", order: str = "seq", data: str = "data", size: int = 30, sync: bytes = b"\x0f\xff") -> DataFrame:
    """Frames of fixed size found in each session's chunks of bytes: session, number, frame, skipped.

    A frame ends with the sync word, and so does the next one, if there is one; else the reader moves on by a byte. The
    bytes left at the end of a chunk go on with the next. skipped is the number of bytes passed over just before.
    """
    return find_frames(chunks, SyncFrames(size, sync), by, order, data)


def checked_frames(chunks: DataFrame, by: str = "session", order: str = "seq", data: str = "data", header: bytes = b"\xa5\x5a", size: int = 42) -> DataFrame:
    """Frames with a header and a big-endian check sum at their end: session, number, payload (between the two), skipped.

    Where the header or the sum is wrong the reader moves on by a byte. Payloads are handed on as they are: their layout
    is the sensor's own.
    """
    found = find_frames(chunks, CheckedFrames(size, header), by, order, data)
    return found.select(by, "number", F.substring("frame", len(header) + 1, size - len(header) - 2).alias("payload"), "skipped")
