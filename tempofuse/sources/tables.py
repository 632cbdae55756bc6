"""Adapters that read the given tables as sensor streams, vectors and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Start of the streams' clock, in microseconds.
EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream: session, seq, t_us, t (hours from the epoch), marker, v."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), us.alias("t_us"), ((us - EPOCH_US) / F.lit(3.6e9)).alias("t"), F.col("event_type").alias("marker"), F.col("value").alias("v")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as numbered doubles: vec_id, label, e0 to e15."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(16)])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as ragged marker frames: frame, marker (1 to 7), x, y, z, s."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("marker"), (F.col("l_extendedprice") / 10000.0).alias("x"), (F.col("l_quantity") / 10.0).alias("y"), (F.col("l_discount") * 10.0).alias("z"), (F.col("l_linenumber") * F.lit(0.1)).alias("s")
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as poses of a bar, one event a session: t, attitude, end and axis, speed, deviation, and the event's span."""
    t, v, whole = F.col("t"), F.col("v"), Window.partitionBy("session")
    low, high = F.min(t).over(whole), F.max(t).over(whole)
    return samples(spark, sf_dir).select(
        "session", "seq", "t", "v", "marker", F.cos(t / 2).alias("qw"), (F.sin(t / 2) * 0.6).alias("qx"), (F.sin(t / 2) * 0.8).alias("qy"), F.lit(0.0).alias("qz"), (v / 100).alias("knob_x"), (t / 1000).alias("knob_y"), F.lit(2.5).alias("knob_z"),
        F.cos(t).alias("axis_x"), F.sin(t).alias("axis_y"), F.lit(0.0).alias("axis_z"), (v / 7).alias("sweet_speed"), (v / 50).alias("att_std_deg"), (F.col("marker") != "click").alias("speed_valid"), (low + (high - low) / 4).alias("t_onset"), (low + (high - low) * 0.75).alias("t_end"),
    )


#: Rows of events that a task makes streams of, at most about: what they become is sorted in its memory.
STREAM_ROWS = 50_000


def stream_parts(spark: SparkSession, sf_dir: str) -> int:
    """To how many parts swing_streams() deals sessions: as many more as there are more events."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "events").count() // STREAM_ROWS))


def swing_streams(spark: SparkSession, sf_dir: str, upsample: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events as inertial rows and band sights of a bar that turns about one axis, and its true angle.

    Each value is a turning rate (its sign by the kind of event) held for `upsample` rows of 2.5 ms, smoothed over as
    many; the angle is the running sum. The sensor sits at the bar's end and is turned against the bar by a fixed turn;
    every third row has a sight of three bands. So a session of n events is n * upsample rows, whatever the table's size.
    Returns imu (session, seq, t, gx..gz, ax..az), markers (session, frame_id, t, marker_id, s, x, y, z) and truth
    (session, seq, t, angle, rate).
    """
    # dealt by number, as few bytes of events become many rows: what is dealt by size alone ends in one task
    goal = F.when(F.col("marker").isin("view", "click"), 0.0).when(F.col("marker") == "error", -1.0).otherwise(1.0) * F.least(F.col("v"), F.lit(100.0)) / 4
    s = samples(spark, sf_dir).select("session", "seq", goal.alias("goal")).repartition(stream_parts(spark, sf_dir), "session")
    w = Window.partitionBy("session").orderBy("seq")
    steps = s.withColumn("k", F.row_number().over(w) - 1).withColumn("from", F.coalesce(F.lag("goal").over(w), F.lit(0.0)))
    fine = steps.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(upsample - 1)))).withColumn("seq", (F.col("k") * upsample + F.col("j")).cast("long"))
    fine = fine.withColumn("rate", F.col("from") + (F.col("goal") - F.col("from")) * (1 - F.cos(F.col("j") * (3.141592653589793 / upsample))) / 2).withColumn("t", F.col("seq") * 0.0025)
    x = Window.partitionBy("session").orderBy("seq")
    fine = fine.withColumn("turned", F.sum((F.col("rate") + F.coalesce(F.lag("rate").over(x), F.lit(0.0))) / 2 * F.when(F.col("seq") > 0, 0.0025).otherwise(0.0)).over(x.rowsBetween(Window.unboundedPreceding, 0)))
    truth = fine.select("session", "seq", "t", F.col("turned").alias("angle"), "rate")
    # the bar turns about z from x; up is -y; the sensor's axes are the bar's turned by 0.6, 0.8 about x
    c, n = F.cos("angle"), F.sin("angle")
    up = (-n * 9.80665, -c * 9.80665)  # up in the bar's frame, along its length and across
    imu = truth.select("session", "seq", "t", F.lit(0.0).alias("gx"), (F.col("rate") * 0.8).alias("gy"), (F.col("rate") * 0.6).alias("gz"), up[0].alias("ax"), (up[1] * 0.6).alias("ay"), (up[1] * -0.8).alias("az"))
    bands = F.explode(F.array(*[F.struct(F.lit(m).alias("marker_id"), F.lit(s_).alias("s")) for m, s_ in (("pink_1", 0.2), ("pink_2", 0.4), ("pink_3", 0.7))]))
    seen = truth.where("seq % 3 = 0").withColumn("b", bands).select("session", (F.col("seq") / 3).cast("long").alias("frame_id"), "t", "b.marker_id", "b.s", (F.col("b.s") * c + 0.1).alias("x"), (F.col("b.s") * n + 0.2).alias("y"), F.lit(2.5).alias("z"))
    return imu, seen, truth


def rough_streams(spark: SparkSession, sf_dir: str, upsample: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """swing_streams() as devices would give them: rows and sights are missing, values jitter, and clocks differ.

    All of it is drawn by hashes of the table's own keys, so that it is the same in every run: inertial rows are lost in
    runs of 25 (one in 97), camera frames in runs of 40 (one in 20), single bands by 15 in 100; rates jitter by 0.02
    rad/s, accelerations by 0.3 m/s² and places by 3 mm at most; the camera's clock is up to 20 ms ahead of or behind
    the inertial one. Points come without names. truth has the session's clock difference as `shift`.
    """
    imu, seen, truth = swing_streams(spark, sf_dir, upsample)

    def drawn(n: int, salt: int, *keys) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(n))

    def jitter(c: str, size: float, salt: int, *keys) -> Column:
        return (F.col(c) + (drawn(2001, salt, *keys) - 1000) / 1000.0 * size).alias(c)

    shift = (drawn(41, 1, "session") - 20) / 1000.0
    kept = imu.where(drawn(97, 2, "session", F.floor(F.col("seq") / 25)) != 0)
    rough = kept.select("session", "seq", "t", *[jitter(c, 0.02, 10 + k, "session", "seq") for k, c in enumerate(("gx", "gy", "gz"))], *[jitter(c, 0.3, 20 + k, "session", "seq") for k, c in enumerate(("ax", "ay", "az"))])
    sights = seen.where((drawn(20, 3, "session", F.floor(F.col("frame_id") / 40)) != 0) & (drawn(100, 4, "session", "frame_id", "marker_id") >= 15))
    points = sights.select("session", "frame_id", (F.col("t") + shift).alias("t"), *[jitter(c, 0.003, 30 + k, "session", "frame_id", "marker_id") for k, c in enumerate(("x", "y", "z"))])
    return rough, points, truth.withColumn("shift", shift)
