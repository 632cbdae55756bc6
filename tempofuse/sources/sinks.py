"""Writers of results: tables as Parquet by session, and the export formats."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempofuse.session import stored


def finite(c: Column, digits: int) -> Column:
    """c for export: NaN and infinities as null, rounded half to even."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.bround(c, digits))


def _vector(prefix: str) -> list[str]:
    return [f"{prefix}_{a}" for a in "xyz"]


def _since_onset(digits: int = 6) -> Column:
    return F.bround(F.col("t") - F.col("t_onset"), digits).alias("t_s")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def fused_export(df: DataFrame, length: float, sweet: float) -> DataFrame:
    """Fused samples as exported, 21 columns: time from the onset, attitude, the bar's end and axis, the places of its
    tip and sweet spot, speed, deviation, and flags as 0 and 1. (Columns and digits are those of the format.)

    df has t, t_onset, t_end, qw to qz, knob_*, axis_*, sweet_speed, att_std_deg and speed_valid, and what else it has
    goes before them.
    """
    places = {f"{name}_{a}": F.col(f"knob_{a}") + s * F.col(f"axis_{a}") for name, s in (("tip", length), ("sweet", sweet)) for a in "xyz"}
    used = {"t", "t_onset", "t_peak", "t_end", "qw", "qx", "qy", "qz", *_vector("knob"), *_vector("axis"), "sweet_speed", "att_std_deg", "speed_valid"}
    return df.select(
        *[c for c in df.columns if c in ("session", "event", "seq") and c not in used], _since_onset(), *[finite(F.col(c), 6).alias(c) for c in ("qw", "qx", "qy", "qz")], *[finite(F.col(c), 5).alias(c) for c in _vector("knob") + _vector("axis")],
        *[finite(c, 5).alias(n) for n, c in places.items()], finite(F.col("sweet_speed"), 4).alias("sweet_speed_mps"), finite(F.col("att_std_deg"), 3).alias("att_std_deg"),
        _flag(F.col("speed_valid")).alias("speed_valid"), _flag(F.col("t").between(F.col("t_onset"), F.col("t_end"))).alias("in_swing"),
    )


def camera_orientation_export(df: DataFrame) -> DataFrame:
    """The camera's orientation as exported, 12 columns: time from the onset, attitude, rate, its length, and axis."""
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in ("omega_y", "omega_z")), F.col("omega_x") * F.col("omega_x")))
    return df.select(
        *[c for c in ("session", "seq") if c in df.columns], _since_onset(), *[finite(F.col(c), 6).alias(c) for c in ("qw", "qx", "qy", "qz")], *[finite(F.col(c), 4).alias(c) for c in _vector("omega")],
        finite(size, 4).alias("omega_mag_rads"), *[finite(F.col(c), 5).alias(c) for c in _vector("axis")],
    )


def pose_source(estimated: Column) -> Column:
    return F.when(estimated, "imu_estimate").otherwise("camera_supported")


def replay_export(df: DataFrame) -> DataFrame:
    """All rows of a replay, 12 columns: time from the onset, pose, its source, flags and the distance to the camera.

    df has t, t_onset, t_end, knob_*, axis_*, estimated, speed_valid, camera_distance and accel_used.
    """
    valid = F.col("speed_valid") & ~F.col("estimated")
    return df.select(
        *[c for c in ("session", "seq") if c in df.columns], _since_onset(), *_vector("knob"), *_vector("axis"), pose_source(F.col("estimated")).alias("pose_source"), _flag(valid).alias("speed_valid"),
        _flag(F.col("t").between(F.col("t_onset"), F.col("t_end"))).alias("in_swing"), F.bround("camera_distance", 6).alias("distance_to_camera_s"), _flag(F.col("accel_used")).alias("accel_used"),
    )


def replay_frames(df: DataFrame, lead: float = 0.1, scale: float = 2.236936292) -> DataFrame:
    """The rows of a replay that are shown: from `lead` before the onset to the end, of finite poses. The speed (in miles
    an hour) is null unless it is valid, within the event and finite."""
    finite_pose = F.lit(True)
    for c in _vector("knob") + _vector("axis"):
        finite_pose = finite_pose & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    shown = df.where(F.col("t").between(F.col("t_onset") - lead, F.col("t_end")) & finite_pose)
    active = F.col("t").between(F.col("t_onset"), F.col("t_end")) & F.col("speed_valid") & ~F.col("estimated")
    return shown.select(
        *[c for c in ("session", "seq") if c in df.columns], _since_onset(), *[F.bround(c, 5).alias(c) for c in _vector("knob")], *[F.bround(c, 6).alias(c) for c in _vector("axis")], pose_source(F.col("estimated")).alias("source"),
        F.when(active, finite(F.col("sweet_speed") * scale, 2)).alias("speed"), F.bround(F.col("camera_distance") * 1000, 1).alias("distance_to_camera_ms"),
    )


def replay_documents(df: DataFrame, **about) -> DataFrame:
    """One JSON document a session of its replay_frames() in order of time; an event of a second or two is one value."""
    frame = F.struct(F.col("t_s").alias("t"), F.array(*_vector("knob")).alias("knob"), F.array(*_vector("axis")).alias("axis"), "source", "speed", "distance_to_camera_ms")
    frames = df.groupBy("session").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    return frames.select("session", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in about.items()], "frames"), {"ignoreNullFields": "false"}).alias("value"))


def marker_source(seen: Column, supported: Column) -> Column:
    """Where a marker's place is from: seen by the camera, filled, or without support."""
    return F.when(seen, "camera").when(supported, "imu_fill").otherwise("unsupported")


def marker_export(df: DataFrame, markers: list, by: tuple[str, ...] = ("session", "frame_id", "t_s"), marker: str = "marker_id") -> DataFrame:
    """Places of each frame's markers side by side: (x, y, z, src) of each name, to five digits."""
    wide = df.groupBy(*by).pivot(marker, markers).agg(*[F.first(F.bround(a, 5)).alias(a) for a in "xyz"], F.first("source").alias("src"))
    return wide.select(*by, *[F.col(f"`{m}_{c}`").alias(f"m{m}_{c}") for m in markers for c in ("x", "y", "z", "src")])


def marker_frames(df: DataFrame, camera_id: str = "fused", version: str = "1.1", coord_sys: str = "left_rect_opencv_meters") -> DataFrame:
    """One JSON line a frame, of the camera's own format, with the source of each point. df: session, frame_id, t (s),
    marker_id, x, y, z, source."""
    point = F.struct(F.col("marker_id").alias("id"), F.struct("x", "y", "z").alias("pos"), "source")
    ns = F.rint(F.col("t") * 1e9).cast("long")
    frames = df.groupBy("session", "frame_id", ns.alias("ns")).agg(F.array_sort(F.collect_list(point), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("points"))
    return frames.select("session", "frame_id", F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit(coord_sys).alias("coord_sys"), F.lit(camera_id).alias("camera_id"), "frame_id", F.col("ns").alias("ts_ns_image"), F.col("ns").alias("ts_ns_mono"), "points")).alias("value"))


def point_entry(df: DataFrame) -> DataFrame:
    """Detected points as they are written: disparity and row error to three digits, pixels to two."""
    digits = {"disparity_px": 3, "row_err_px": 3, "u_left": 2, "v_left": 2, "u_right": 2, "v_right": 2}
    return df.withColumns({c: F.bround(c, n) for c, n in digits.items() if c in df.columns})


def relative_clock(tx: str = "tx_us", by: str = "session", order: str = "seq", bits: int = 32) -> Column:
    """Seconds since a session's first row by a device clock that starts over."""
    first = F.first(tx).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return F.pmod(F.col(tx) - first, F.lit(1 << bits)) / 1e6


def sample_rows(df: DataFrame) -> DataFrame:
    """Inertial rows as a recorder writes them: rates and low-range accelerations to six digits, high-range ones to four."""
    digits = dict.fromkeys(("gx", "gy", "gz", "ax", "ay", "az"), 6) | dict.fromkeys(("hx", "hy", "hz"), 4)
    return df.withColumns({c: F.bround(c, n) for c, n in digits.items() if c in df.columns})


def measures_json(df: DataFrame) -> DataFrame:
    """One JSON document a row, with nulls for what is not finite."""
    fields = [finite(F.col(c), 4).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("session",), mode: str = "overwrite") -> None:
    """Parquet in folders of the given columns; a rewritten folder replaces that folder only. Rows meet by these columns
    first, so that a folder gets few files."""
    df.repartition(*[F.col(c) for c in by]).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_sessions(df: DataFrame, path: str, by: str = "session", folders: int = 64) -> None:
    """Parquet of many sessions, dealt to a number of folders (part=0 and so on) that does not grow with theirs. Sessions
    that were written before are replaced, and only they: what else their folders hold is written again with them.
    """
    part = F.pmod(F.xxhash64(by), F.lit(folders)).cast("int")
    rows = df.withColumn("part", part)
    try:
        held = df.sparkSession.read.schema(rows.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None  # nothing was written yet
    if held is not None:
        rows = stored(rows)
        parts = [r[0] for r in rows.select("part").distinct().collect()]  # `folders` numbers at most
        others = held.where(F.col("part").isin(parts)).withColumnRenamed(by, "__by")
        new = rows.select(by).distinct()
        kept = others.join(new, others["__by"].eqNullSafe(new[by]), "left_anti").withColumnRenamed("__by", by)
        rows = rows.unionByName(stored(kept))  # read before its folders are written over
    rows.repartition(folders, "part").sortWithinPartitions("part", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines. Spark's committer moves a task's file into place when it is whole, so that no reader sees a part."""
    df.write.mode(mode).json(path)


def record_stream(stream: DataFrame, path: str, every: str = "100 milliseconds", checkpoint: str | None = None):
    """Start appending a stream of inertial rows, rounded as a recorder does, as CSV files; the running query."""
    at = checkpoint or f"{path.rstrip('/')}-checkpoint"
    return sample_rows(stream).writeStream.format("csv").option("header", True).option("checkpointLocation", at).outputMode("append").trigger(processingTime=every).start(path)
