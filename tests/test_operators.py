"""Operators without SQL, and fixtures with exact answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempofuse.functions import vectors as V
from tempofuse.functions.codec import FrameFormat, crc16, decode_frame, encode_frame
from tempofuse.operators import align as A
from tempofuse.operators import segment as S
from tempofuse.plans import QUERIES
from tempofuse.streaming import rings

SF = "/root/testdata/sf0.001"


def series(spark, t, v, session=1):
    return spark.createDataFrame([(session, i, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))], "session long, seq long, t double, v double")


def test_crc_check_value(spark):
    assert spark.range(1).select(crc16(F.lit(b"123456789"))).first()[0] == 0x29B1
    assert spark.range(1).select(crc16(F.lit(b""))).first()[0] == 0xFFFF


def test_frame_round_trip(spark):
    f = FrameFormat()
    df = spark.createDataFrame([(2**32 + 7, 1.5, -400.0)], "t long, a double, b double")
    channels = {n: F.col("a") for n in f.signed} | {"ax": F.col("b")} | {n: F.lit(9) for n in f.unsigned[:-1]}
    got = decode_frame(encode_frame(F.col("t"), channels, f), f)
    row = df.select(*[c.alias(k) for k, c in got.items()]).first()
    assert row.tx_us == 7 and row.hf1 == 9
    assert row.ay == pytest.approx(1.5, abs=f.scale["a"])
    assert row.ax == pytest.approx(-32768 * f.scale["a"])
    assert df.select(decode_frame(F.lit(b"\x00" * 30), f)["tx_us"]).first()[0] is None


def test_unwrap_goes_on(spark):
    tx = [2**32 - 2000, 2**32 - 1000, 500, 1500]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(tx)], "session long, seq long, tx long")
    got = [r.unwrapped for r in A.unwrapped(df, "tx").orderBy("seq").collect()]
    assert got == [tx[0], tx[1], 500 + 2**32, 1500 + 2**32]


def test_gradient_matches_numpy(spark):
    t, v = np.cumsum([0.1, 0.3, 0.2, 0.5, 0.4, 0.1]), np.array([1.0, 4, 2, 8, 5, 7])
    got = [r[0] for r in series(spark, t, v).select("seq", A.gradient(F.col("v"), F.col("t"), A.over_time()).alias("g")).orderBy("seq").select("g").collect()]
    assert np.allclose(got, np.gradient(v, t))
    got = [r.rate for r in A.island_rate(series(spark, t, v), 10.0).orderBy("seq").collect()]
    assert np.allclose(got, np.gradient(v, t, edge_order=2))


def test_box_mean_mirrors(spark):
    v = [1.0, 2, 4, 8, 16]
    df = series(spark, range(5), v).withColumn("i", F.col("seq")).withColumn("n", F.lit(5))
    got = [r[0] for r in df.select("seq", A.box_mean(F.col("v"), 4, A.over_time(), F.col("i"), F.col("n")).alias("b")).orderBy("seq").select("b").collect()]
    wide = [2, 1, *v, 16]
    assert got == [sum(wide[k : k + 4]) / 4 for k in range(5)]


def test_interpolation_edges_and_gaps(spark):
    left, right = series(spark, [0, 1, 2.5, 9], [0] * 4).drop("v"), series(spark, [1, 2, 8], [10, 20, 80]).drop("seq")
    met = A.asof(left, right)
    held = [r[0] for r in met.orderBy("t").select(A.interpolated()).collect()]
    assert held == [10, 10, 25, 80]
    inner = [r[0] for r in met.orderBy("t").select(A.interpolated(hold=False, most_gap=3.0)).collect()]
    assert inner == [None, 10, None, None]


def quat_matrix(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_shortest_arc_turns_one_into_the_other(spark):
    cases = [((1.0, 0.0, 0.0), (-1.0, 0.0, 0.0)), ((0.0, 1.0, 0.0), (0.0, -1.0, 0.0)), ((1.0, 2.0, 3.0), (3.0, -1.0, 0.5))]
    df = spark.createDataFrame([(k, *a, *b) for k, (a, b) in enumerate(cases)], "k long, ax double, ay double, az double, bx double, by double, bz double")
    arc = V.shortest_arc(tuple(F.col("a" + c) for c in "xyz"), tuple(F.col("b" + c) for c in "xyz"))
    for row in df.select("k", *[c.alias(n) for n, c in zip("wxyz", arc, strict=True)]).collect():
        a, b = map(np.array, cases[row.k])
        assert np.allclose(quat_matrix(row[1:]) @ (a / np.linalg.norm(a)), b / np.linalg.norm(b), atol=1e-9)


def test_exponential_and_logarithm(spark):
    cases = [(0.0, 0.0, 2.0), (1e-12, 0.0, 0.0), (0.3, -0.2, 0.9)]
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(cases)], "k long, x double, y double, z double")
    q = df.select("k", *[c.alias(n) for n, c in zip("abcd", V.from_rotation_vector((F.col("x"), F.col("y"), F.col("z"))), strict=True)])
    q = spark.createDataFrame(q.collect(), "k long, a double, b double, c double, d double")
    for row in q.select("k", *[c.alias(n) for n, c in zip("xyz", V.to_rotation_vector(tuple(F.col(c) for c in "abcd")), strict=True)]).collect():
        assert np.allclose(row[1:], cases[row.k], atol=1e-9)


def detect(spark, t, v):
    return S.detect_events(series(spark, t, v), 10.0, 4.0, 4.0, 0.1, 1.2, 1.5).orderBy("event").collect()


def test_second_event_within_the_gap_is_passed_over(spark):
    t = np.arange(0, 4, 0.0025)
    v = np.where((t >= 1) & (t < 1.4), 20.0, np.where((t >= 1.8) & (t < 2.1), 40.0, 0.0))
    got = detect(spark, t, v)
    assert len(got) == 1 and got[0].t_end < 1.45 and got[0].peak < 25


def test_short_dip_does_not_end_an_event(spark):
    t = np.arange(0, 4, 0.0025)
    v = np.where((t >= 1) & (t < 1.5) & ~((t >= 1.2) & (t < 1.23)), 20.0, 0.0)
    got = detect(spark, t, v)
    assert len(got) == 1 and 1.49 < got[0].t_end < 1.55


def test_event_without_end_is_cut(spark):
    t = np.arange(0, 4, 0.0025)
    got = detect(spark, t, np.where(t >= 1, 20.0, 0.0))
    assert got[0].t_end - got[0].t_onset < 1.25


def test_stream_of_rings_equals_batch(spark):
    live = QUERIES["stream_ring_windows"](spark, SF).toPandas().sort_values(["session", "trigger_t"]).reset_index(drop=True)
    batch = QUERIES["batch_ring_windows"](spark, SF).toPandas().sort_values(["session", "trigger_t"]).reset_index(drop=True)
    assert len(live) and live.equals(batch)


def test_ring_state_machine():
    ring = rings.Ring(1.0, 1.0, 10.0, 0.5, 0.5)
    out = [ring.push(t, x) for t, x in [(0, 0), (0.5, 20), (0.9, 0), (1.2, 20), (1.2, 99), (1.1, 99), (1.9, 20), (2.5, 0)]]
    window = out[-1]
    # the first edge comes before the time before is full; rows of no later time are dropped
    assert [w is not None for w in out] == [False] * 7 + [True]
    assert window[0] == 1.2 and window[3:6] == (2, 2, 1)
    ring.push(0.0, 0.0)
    assert ring.started == 0.0 and ring.trigger is None  # the clock fell: a reboot


def test_angle_to_horizontal_of_nothing_is_null(spark):
    z = F.lit(0.0)
    assert spark.range(1).select(V.angle_to_horizontal((z, z, z), (z, F.lit(1.0), z))).first()[0] is None
    assert math.isclose(spark.range(1).select(V.angle_to_horizontal((z, F.lit(2.0), z), (z, F.lit(1.0), z))).first()[0], 90.0)


def test_ring_of_rows():
    ring = rings.CountRing(50, 40, 10.0, 0.004)
    out = [ring.push(0.0025 * k, 20.0 if k >= 80 else 0.0) for k in range(200)]
    found = [w for w in out if w]
    assert len(found) == 1 and found[0][0] == pytest.approx(0.2) and found[0][3:5] == (50, 40)
    ring = rings.CountRing(5, 2, 10.0, 0.004)
    for k in range(60):
        ring.push(0.0025 * k, 0.0)
    ring.push(0.0025 * 59 + 0.01, 20.0)  # after a gap: no edge without a quiet row before
    assert ring.gaps == 1 and ring.trigger is None and len(ring.ts) == 1
    ring = rings.CountRing(2, 2, 10.0, 1.0)
    assert [bool(ring.push(t, x)) for t, x in [(0, 0), (0.1, 0), (0.1, 99), (0.2, 20), (0.3, float("nan")), (0.4, 20)]] == [False] * 6


def test_stream_of_row_rings_equals_batch(spark):
    live = QUERIES["stream_count_windows"](spark, SF).toPandas().sort_values(["session", "trigger_t"]).reset_index(drop=True)
    from tempofuse.sources.tables import samples

    batch = rings.ring_windows(samples(spark, SF).withColumnRenamed("v", "signal"), 3, 4, 60.0, 48.0, rows=True).toPandas().sort_values(["session", "trigger_t"]).reset_index(drop=True)
    assert live.equals(batch)
