"""python -m tempofuse queries | config [FILE] | run NAME SF_DIR OUT | process IN OUT [CONFIG] | validate SF_DIR [TARGET]

process reads captures (IN/*/imu*.csv and IN/*/camera*.jsonl, a folder a session), fuses their events and writes
OUT/events and OUT/samples. validate runs the chain on the rough streams of the given tables and ends with 1 unless the
mean error of speeds is below the target (0.05).
"""

from __future__ import annotations

import sys
from pathlib import Path

from tempofuse import config
from tempofuse.plans import QUERIES


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def process(source: str, out: str, settings: config.Settings) -> None:
    """Events and fused samples of all captures under a folder."""
    from pyspark.sql import functions as F

    from tempofuse.operators import fusion, motion
    from tempofuse.session import stored
    from tempofuse.sources import files

    spark, along = session(), settings.bar.markers
    imu = stored(files.read_imu_csv(spark, f"{source}/*/imu*.csv"))
    places = F.create_map(*[F.lit(x) for pair in along.items() for x in pair])
    markers = files.marker_observations(files.read_camera_jsonl(spark, f"{source}/*/camera*.jsonl"), list(along)).withColumn("s", places[F.col("marker_id")])
    events = stored(fusion.find_swings(imu))
    fused = stored(fusion.fused_events(imu, stored(markers), events, (0.0, -1.0, 0.0), settings.event.pre_roll))
    ok = fused.where("status = 'ok'")
    moved = events.join(ok.groupBy("session", "event").agg(F.first("offset").alias("o")), ["session", "event"]).select("session", "event", *[(F.col(c) + F.col("o")).alias(c) for c in ("t_onset", "t_peak", "t_end", "t_contact")])
    measures = motion.swing_measures(ok.select("session", "event", "t", "speed", "hand_speed", "elevation", "rate", F.col("supported").alias("valid")), moved)
    status = fused.groupBy("session", "event").agg(F.first("status").alias("status"))
    events.select("session", "event", "t_onset", "t_end").join(status, ["session", "event"], "left").join(measures, ["session", "event"], "left").write.mode("errorifexists").parquet(f"{out}/events")
    ok.write.mode("errorifexists").parquet(f"{out}/samples")


def validate(sf_dir: str, target: float) -> bool:
    """Whether fused speeds are right on average, in shares of each event's peak; prints the figure."""
    from pyspark.sql import functions as F

    from tempofuse.operators.align import asof, interpolated
    from tempofuse.plans import chain_queries
    from tempofuse.sources.tables import rough_streams

    spark = session()
    fused = chain_queries.processed(spark, sf_dir)[3].where("status = 'ok' and supported")
    truth = rough_streams(spark, sf_dir)[2].select("session", (F.col("t") + F.col("shift")).alias("t"), (F.abs("rate") * chain_queries.SWEET).alias("true"))
    met = asof(fused.select("session", "piece", "t", "speed"), truth, values=("true",)).withColumn("true", interpolated("true"))
    worst = met.groupBy("piece").agg((F.avg(F.abs(F.col("speed") - F.col("true"))) / F.max("true")).alias("off"))
    row = worst.agg(F.avg("off").alias("mean"), F.percentile("off", 0.95).alias("high"), F.count("off").alias("n")).first()
    if not row.n:
        print("no event was fused")
        return False
    print(f"{row.n} events, mean error of speed {row['mean']:.4f}, 95 of 100 below {row.high:.4f}, target {target:g}")
    return row["mean"] < target


def main(args: list[str]) -> int:
    if args == ["queries"]:
        print("\n".join(sorted(QUERIES)))
    elif args[:1] == ["config"] and len(args) <= 2:
        print(config.dumps(config.loads(Path(args[1]).read_text()) if len(args) == 2 else config.Settings()))
    elif args[:1] == ["run"] and len(args) == 4 and args[1] in QUERIES:
        QUERIES[args[1]](session(), args[2]).write.mode("errorifexists").parquet(args[3])
    elif args[:1] == ["process"] and len(args) in (3, 4):
        process(args[1], args[2], config.loads(Path(args[3]).read_text()) if len(args) == 4 else config.Settings())
    elif args[:1] == ["validate"] and len(args) in (2, 3):
        return 0 if validate(args[1], float(args[2]) if len(args) == 3 else 0.05) else 1
    else:
        print(__doc__, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
