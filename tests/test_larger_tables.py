"""What larger tables hold and the small ones do not: constant streams, chance sync words, many small groups."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tempofuse.operators import curves, fusion, labels, segment, sync
from tempofuse.operators.groups import in_batches
from tempofuse.plans import QUERIES, SQL
from tempofuse.sources.tables import swing_streams


def written_events(spark, path, rows):
    """A folder with an events table of rows (session, seq, hours, marker, value)."""
    start = datetime(2024, 1, 1)
    data = [(q, start + timedelta(hours=t), s, m, float(v), "{}") for s, q, t, m, v in rows]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_a_constant_stream_has_no_lag_and_stops_no_other(spark):
    a = spark.createDataFrame([(s, g, 5.0 if s == 1 else float(g * g)) for s in (1, 2) for g in range(6)], "session long, g long, x double")
    b = spark.createDataFrame([(s, g + 1, float(g * g)) for s in (1, 2) for g in range(6)], "session long, g long, y double")
    assert [tuple(r) for r in sync.best_lag(a, b, 2, 3).collect()] == [(2, 1, 1.0)]


def test_streams_of_which_one_is_constant_are_compared(spark, tmp_path):
    rows = [(s, 100 * s + 2 * g + k, 12.0 * g + 1 + k, m, 7.0 if m == "view" and s == 1 else g + k) for s in (1, 2) for g in range(6) for k, m in enumerate(("view", "click"))]
    got = {r.session: r for r in QUERIES["compare_streams"](spark, written_events(spark, tmp_path, rows)).collect()}
    assert got[1].n == got[2].n == 6 and math.isnan(got[1].r) and got[2].r == 1.0


@pytest.mark.parametrize("rows", [1, 50, 100_000])
def test_batches_hold_whole_groups_in_order(spark, rows):
    df = spark.range(1000).selectExpr("if(id < 400, null, id * id % 37) as session", "-id as t").repartition(3)

    def run(g, bounds):
        begin = np.repeat(bounds[:-1], np.diff(bounds))
        return pd.DataFrame({"t": g["t"], "place": np.arange(len(g)) - begin, "calls": np.arange(len(g)) == 0})

    got = in_batches(df, ("session",), ("t",), run, "t long, place long, calls boolean", rows).toPandas()
    want = df.toPandas().sort_values("t")
    want["place"] = want.groupby("session", dropna=False).cumcount()
    assert got.sort_values("t")["place"].tolist() == want["place"].tolist()
    assert (got["calls"].sum() <= 4) if rows == 100_000 else True


def test_bars_of_many_frames_at_once_are_those_of_one():
    r = np.random.default_rng(4)
    along, up = np.array([0.2, 0.4, 0.7]), np.array([-1.0, 0.0, 0.0])
    points, lead = np.full((400, 6, 3), np.nan), np.full((400, 3, 3), np.nan)
    for k in range(400):
        way = r.normal(size=3)
        bar = r.normal(size=3) + along[:, None] * way / np.linalg.norm(way)
        n = r.integers(2, 7)
        points[k, :n] = np.concatenate([bar + r.normal(0, 0.01, (3, 3)), r.normal(0, 0.4, (3, 3)) + bar[0]])[r.permutation(6)[:n]]
        lead[k, r.random(3) < 0.6] = bar[0]
    got, found = labels.fit_bars(points, along, lead, up, 0.05, 0.25)
    for k in range(400):
        want = labels.fit_bar(points[k][~np.isnan(points[k, :, 0])], along, lead[k], up, 0.05, 0.25)
        assert got[k].tolist() == (want or [-1, -1, -1]) and found[k] == (want is not None)
    assert 100 < found.sum() < 400


def test_tracks_of_many_bodies_at_once_are_those_of_one():
    r = np.random.default_rng(8)
    bounds = np.append(0, np.cumsum([1, 30, 7, 2, 60, 7]))
    t = np.cumsum(r.choice([0.0, 0.01, 0.1, 5.0], bounds[-1]))
    fix = np.where(r.random(bounds[-1]) < 0.3, np.nan, r.normal(0, 3, bounds[-1]))
    fix[bounds[:-1]] = 1.0
    fix[[20, 70]] = 500.0
    place, speed, refused = curves.velocity_tracks(t, fix, bounds, 0.5, 2.0, 50.0)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        want = curves.velocity_track(t[a:b], fix[a:b], 0.5, 2.0, 50.0)
        assert np.allclose(place[a:b], want[0], atol=1e-6) and np.allclose(speed[a:b], want[1], atol=1e-6) and refused[k] == want[2]
    assert refused.sum() >= 2


def test_a_clock_that_holds_the_sync_word_ends_a_frame_for_the_sql_too(spark, tmp_path):
    import duckdb

    def hours(us):  # from the epoch, so that the clock's low 32 bits are these
        return ((us - 1704067200000000) % (1 << 32)) / 3.6e9

    last = {1: 0x0FFF1234, 2: 0x120FFF34, 3: 0x12340FFF, 4: 0x12345678}
    rows = [(s, q, hours(x), "view", 1) for s, x in last.items() for q, x in ((90 * s + 8, 5000 + s), (90 * s + 9, 6000 + s), (90 * s + 10, x))]
    path = written_events(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in QUERIES["long_frames"](spark, path).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    assert sorted(c.execute(SQL["long_frames"]).fetchall()) == got
    assert got == [(1, 0, 5001, 3), (1, 1, 0, 7), (2, 0, 5002, 3), (2, 1, 0, 8), (3, 0, 5003, 3), (3, 1, 0, 9), (4, 0, 5004, 3), (4, 1, 0x12345678, 35)]


def test_candidate_rows_are_dealt_once(spark):
    imu = swing_streams(spark, "/root/testdata/sf0.001")[0]
    text = fusion.find_swings(imu)._jdf.queryExecution().executedPlan().toString()
    # the table's events by session, and the few events that were found
    assert text.count("Exchange hashpartitioning") == 2
    assert imu.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = segment.detect_events(imu.select("session", "t", "gz"), 5.0, 2.0, 2.0, 0.1, 1.2, 0.1, v="gz").count()
    assert rows > 0
