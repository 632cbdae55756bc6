"""Structured Streaming flows over files of events, and the tables that they leave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempofuse.session import shared_dir
from tempofuse.sources.tables import EPOCH_US


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files: session, seq, ts, t (hours), marker, signal."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return raw.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), ((us - EPOCH_US) / F.lit(3.6e9)).alias("t"), F.col("event_type").alias("marker"), F.col("value").alias("signal"))


def shared_path(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/flow-{uuid.uuid4().hex}"


def as_stream(df: DataFrame) -> DataFrame:
    """A table, written to the shared folder and read as a stream of its files."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now; its output as a table."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession)
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out")
    return done.where(F.col("batch") == done.agg(F.max("batch")).first()[0]).drop("batch")


def rolling_counts(stream: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Tumbling windows of a stream that closes them when the watermark has passed."""
    w = stream.withWatermark("ts", late).groupBy("session", F.window("ts", width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.max("signal").alias("peak")).select("session", F.unix_micros("w.start").alias("start_us"), "n", "peak")


def sessions_of(stream: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a session's rows without a longer gap."""
    w = stream.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.max("signal").alias("peak")).select("session", F.unix_micros("w.start").alias("start_us"), "n", "peak")


def without_duplicates(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of the rows of one session and seq within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "seq"])


def interval_join(left: DataFrame, right: DataFrame, within: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Rows of two streams of one session that are near in time; either side waits as long as the watermark says."""
    a = left.withWatermark("ts", late).select("session", F.col("seq").alias("left_seq"), F.col("ts").alias("left_ts"))
    b = right.withWatermark("ts", late).select(F.col("session").alias("right_session"), F.col("seq").alias("right_seq"), F.col("ts").alias("right_ts"))
    near = F.expr(f"session = right_session and right_ts between left_ts - interval {within} and left_ts + interval {within}")
    return a.join(b, near).select("session", "left_seq", "right_seq")
