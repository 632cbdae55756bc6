"""Streams against batches, and exports against what they are made of."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempofuse.config import Settings
from tempofuse.functions.cameras import best_blobs, depth_at, direction_quaternion, display_axes, in_hues, search_window
from tempofuse.functions.codec import FrameFormat, decode_frame, encode_frame, expanded_format, frame_kind
from tempofuse.operators import geometry, labels, motion, quality, segment, sync
from tempofuse.sources import sinks
from tempofuse.streaming import flows, live, rings


def files_of(df, path, n):
    """df as n files in order of seq, so that a stream that takes one at a time has n batches."""
    rows = df.toPandas().sort_values("seq", kind="stable")
    for k in range(n):
        part = rows.iloc[len(rows) * k // n : len(rows) * (k + 1) // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")


def streamed(spark, df, path, n=4):
    files_of(df, path, n)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def signal(spark, seed=3, n=900, sessions=3):
    r = np.random.default_rng(seed)
    frames = []
    for s in range(sessions):
        t = np.cumsum(r.uniform(0.002, 0.02, n))
        v = np.abs(np.convolve(r.normal(0, 1, n), np.ones(15) / 4, "same")) * 5
        v[r.random(n) < 0.3] *= 0.2
        v[(t % 4) > 2] *= 0.05
        frames.append(pd.DataFrame({"session": s, "seq": np.arange(n) * sessions + s, "t": t, "signal": v}))
    return spark.createDataFrame(pd.concat(frames), "session long, seq long, t double, signal double")


def test_live_events_are_those_of_the_batch(spark, tmp_path):
    df = signal(spark)
    args = (10.0, 4.0, 4.0, 0.1, 1.2, 0.5)
    want = segment.detect_events(df.withColumnRenamed("signal", "v"), *args).orderBy("session", "t_onset").drop("event").collect()
    got = flows.drained(live.live_events(streamed(spark, df, str(tmp_path / "s")), *args)).orderBy("session", "t_onset").collect()
    # events that the end of the data cuts are not over, and may be missing from the stream
    assert set(map(tuple, got)) <= set(map(tuple, want)) and len(want) - len(got) <= 3 and len(got) >= 5


def test_clock_goes_on_over_batches(spark, tmp_path):
    tx = [2**32 - 2000, 2**32 - 1000, 500, 1500, 2**32 - 10, 5]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(tx)], "session long, seq long, counter long")
    got = [r.unwrapped for r in flows.drained(live.unwrapped_clock(streamed(spark, df, str(tmp_path / "s"), 3))).orderBy("seq").collect()]
    assert got == [2**32 - 2000, 2**32 - 1000, 2**32 + 500, 2**32 + 1500, 2**33 - 10, 2**33 + 5]


def test_frames_are_found_across_batches(spark, tmp_path):
    zero = {n: F.lit(1.0) for n in FrameFormat().signed} | {n: F.lit(7) for n in FrameFormat().unsigned[:-1]}
    whole = b"\x01\x02" + b"".join(bytes(r.f) for r in spark.range(20).select(encode_frame(F.col("id") * 1000, zero, FrameFormat()).alias("f")).collect())
    cuts = [0, 17, 100, 101, 333, len(whole)]
    df = spark.createDataFrame([(1, k, bytearray(whole[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))], "session long, seq long, data binary")
    rows = flows.drained(live.parsed_frames(streamed(spark, df, str(tmp_path / "s"), 5)))
    got = rows.select("number", "skipped", decode_frame(F.col("frame"), FrameFormat())["tx_us"].alias("tx")).orderBy("number").collect()
    assert [r.tx for r in got] == [1000 * k for k in range(19)] and got[0].skipped == 2 and sum(r.skipped for r in got) == 2


def test_silence_closes_a_window(spark, tmp_path):
    df = spark.createDataFrame([(1, k, k * 0.1, 20.0 if k == 15 else 1.0) for k in range(18)], "session long, seq long, t double, signal double")
    path = str(tmp_path / "s")
    stream = streamed(spark, df, path, 1)
    out = rings.ring_windows(stream, 1.0, 5.0, 10.0, 9.0, silence_ms=300)
    query = out.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.monotonic() + 60
        while time.monotonic() < end and query.isActive and not spark.table("silent").count():
            time.sleep(0.5)
        rows = spark.table("silent").collect()
    finally:
        query.stop()
    assert [(r.session, r.complete, round(r.trigger_t, 3)) for r in rows] == [(1, False, 1.5)]


def test_rings_from_the_settings(spark):
    rows = [(1, k, k / 400, 0.0, 0.0, 20.0 if 600 <= k < 700 else 0.1, 0.0, 0.0, 9.8) for k in range(1600)]
    got = rings.configured_rings(spark.createDataFrame(rows, "session long, seq long, t double, gx double, gy double, gz double, ax double, ay double, az double"), Settings().event).collect()
    assert len(got) == 1 and got[0].trigger_t == 1.5 and got[0].n_gaps == 0


def test_a_recorder_writes_rounded_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, k, 0.1234567, 0.12345) for k in range(6)], "session long, seq long, gx double, hx double")
    query = sinks.record_stream(streamed(spark, df, str(tmp_path / "s"), 2), str(tmp_path / "out"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert len(got) == 6 and {(r.gx, r.hx) for r in got} == {("0.123457", "0.1234")}


def test_replay_documents_and_marker_frames(spark, tmp_path):
    cols = "session long, seq long, t double, t_onset double, t_end double, knob_x double, knob_y double, knob_z double, axis_x double, axis_y double, axis_z double, estimated boolean, speed_valid boolean, sweet_speed double, camera_distance double"
    rows = [(1, k, 1 + k / 10, 1.2, 1.6, 0.1, 0.2, float("nan") if k == 3 else 0.3, 1.0, 0.0, 0.0, k == 4, True, 10.0, 0.004) for k in range(10)]
    frames = sinks.replay_frames(spark.createDataFrame(rows, cols))
    assert [r.seq for r in frames.orderBy("seq").collect()] == [1, 2, 4, 5, 6]
    doc = json.loads(sinks.replay_documents(frames, length_m=0.84).first().value)
    assert doc["length_m"] == 0.84 and [f["source"] for f in doc["frames"]] == ["camera_supported"] * 2 + ["imu_estimate"] + ["camera_supported"] * 2
    assert [f["speed"] for f in doc["frames"]] == [None, 22.37, None, 22.37, 22.37] and doc["frames"][0]["distance_to_camera_ms"] == 4.0
    m = spark.createDataFrame([(1, 5, 0.25, "b", 1.0, 2.0, 3.0, "camera"), (1, 5, 0.25, "a", 1.5, 2.0, 3.0, "imu_fill")], "session long, frame_id long, t double, marker_id string, x double, y double, z double, source string")
    line = json.loads(sinks.marker_frames(m).first().value)
    assert line["ts_ns_image"] == 250_000_000 and [p["id"] for p in line["points"]] == ["a", "b"] and line["points"][0]["pos"] == {"x": 1.5, "y": 2.0, "z": 3.0}
    sinks.write_json(m, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_lags_by_blocks_and_in_full(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=400)
    a = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "session long, g long, x double")
    b = spark.createDataFrame([(1, k + 7, float(v)) for k, v in enumerate(x)], "session long, g long, y double")
    assert tuple(sync.best_lag(a, b, 10, 50).first())[1:] == (7, 1.0)
    one = spark.createDataFrame([(1, float(k) / 100, float(v)) for k, v in enumerate(x)], "session long, t double, v double")
    two = one.withColumn("t", F.col("t") - 0.12)
    got = sync.full_lag(one, two).first()
    grid = np.arange(0, 3.87, 0.01)
    assert got.offset == pytest.approx(0.12, abs=0.011) and abs(got.n - len(grid)) <= 2


def test_poses_against_numpy(spark):
    from tempofuse.operators import attitude

    r = np.random.default_rng(2)
    model = {1: (0.0, 0, 0), 2: (1.0, 0, 0), 3: (0, 1.0, 0), 4: (0, 0, 1.0)}
    rows, truth = [], {}
    for f in range(6):
        q = r.normal(size=4)
        q = q / np.linalg.norm(q) * np.sign(q[0])
        truth[f] = q
        for m in list(model)[: 2 if f == 5 else 3 + f % 2]:
            rows.append((1, f, m, *map(float, attitude.matrix(q) @ np.array(model[m]) + [3, 2, 1])))
    df = spark.createDataFrame(rows, "session long, frame long, marker int, x double, y double, z double")
    table = spark.createDataFrame([(k, *map(float, v)) for k, v in model.items()], "marker int, mx double, my double, mz double")
    got = {x.frame: x for x in geometry.posed_frames(df, table, ["session", "frame"], "frame").collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    first = np.array([v[3:] for v in rows if v[1] == 0]).mean(axis=0)
    for f, x in got.items():
        assert np.allclose([x.qw, x.qx, x.qy, x.qz], truth[f], atol=1e-6) and x.rms < 1e-6 and np.allclose([x.tx, x.ty, x.tz], np.array([3, 2, 1]) - first, atol=1e-6)


def test_spacing_is_learnt(spark):
    rows = []
    for f in range(30):
        a = f * 0.01
        for name, s in (("a", 0.0), ("b", 0.3), ("c", 0.5)):
            rows.append(("s", f, f / 120, s * np.sin(a), -s * np.cos(a), 2.0, name))
    df = spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, x)) for x in rows], "session string, frame_id long, t double, x double, y double, z double, truth string")
    got = labels.label_bands(df, ["a", "b", "c"], None).toPandas()
    assert (got.marker_id == got.truth).all()
    spaced = labels.learnt_spacing(df.withColumn("position", F.when(F.col("truth") == "a", 1).when(F.col("truth") == "b", 2).otherwise(3)))
    assert {r.position: round(r.gap, 6) for r in spaced.collect()} == {1: 0.3, 2: 0.2}
    line = np.array([[0, 0, 0], [1, 0, 0], [2, 0.01, 0], [0.5, 3, 0], [3, 0, 0]])
    assert labels.most_collinear(line, 4).tolist() == [0, 1, 2, 4]


def test_guided_replay_follows_the_camera(spark):
    t = np.arange(0, 4, 0.02)
    own = spark.createDataFrame([(1, k, float(x), float(0.5 * x * x) + 0.3, 1.0) for k, x in enumerate(t)], "session long, seq long, t double, x double, a double")
    seen = spark.createDataFrame([(1, float(x), float(0.5 * x * x)) for x in np.arange(0, 4, 0.05) if not 1.5 < x < 2.5], "session long, t double, x double")
    got = motion.guided_replay(own, seen, 0.1, 0.06).orderBy("seq").toPandas()
    inside = got[got.supported]
    assert np.abs(inside.guided - 0.5 * inside.t**2).max() < 1e-3 and (~got.supported).sum() >= 45
    assert np.abs(got.bridge - 0.5 * got.t**2)[got.t < 3.9].max() < 0.02


def test_turning_measures(spark):
    t = np.arange(0, 1, 1 / 400)
    rows = [(1, 0, k, float(x), 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, float(3 * x * x), 5.0, 7.0, True) for k, x in enumerate(t)]
    fused = spark.createDataFrame(rows, "session long, event long, seq long, t double, ux double, uy double, uz double, kx double, ky double, kz double, wx double, wy double, wz double, bar_elevation double, elevation double, supported boolean")
    events = spark.createDataFrame([(1, 0, 0.1, 0.8)], "session long, event long, t_onset double, t_contact double")
    row = motion.turning_measures(fused, events).first()
    assert row.peak_turn_accel == pytest.approx(6 * 0.795, abs=1e-6) and row.bar_angle_deg == 5.0 and row.path_angle_deg == 7.0


def test_gaps_guard_and_ringing(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate([0.0, 1.0, 2.0, 10.0, 11.0, 12.0, 13.0])], "session long, seq long, t double")
    got = {r.seq: (r.after_gap, r.near_gap) for r in quality.gap_guarded(df, 5.0, 1.0).collect()}
    assert got == {0: (False, False), 1: (False, True), 2: (False, True), 3: (True, True), 4: (False, True), 5: (False, False), 6: (False, False)}
    rung = df.select(quality.ringing(F.col("t"), F.lit(2.0), 1.0, 8.0).alias("a"), quality.ringing(F.col("t"), F.lit(None).cast("double")).alias("b")).collect()
    assert [r.a for r in rung] == [False, True, True, True, False, False, False] and not any(r.b for r in rung)


def test_small_functions(spark):
    one = spark.range(1)
    row = one.select(
        expanded_format(F.lit(">I9h4H2x")).alias("code"), frame_kind(F.lit(bytes(bytearray(b"\xa5\x5a" + b"\0" * 40) * 3))).alias("v2"), frame_kind(F.lit(b"\0" * 600)).alias("v1"), frame_kind(F.lit(b"\0" * 599)).alias("wait"),
        depth_at(F.lit(0.0), F.array(F.lit(3.0), F.lit(-1.0), F.lit(1.0))).alias("depth"), in_hues(F.lit(175.0), [4.0], 10.0).alias("hue"), F.array(*search_window(F.lit(3), F.lit(95), 10, 100, 100)).alias("window"),
        F.array(*direction_quaternion((F.lit(0.0), F.lit(0.0), F.lit(-2.0)))).alias("down"), live.complete_lines(F.lit("h,x\n1,2\n3,4,5\n6,7\n8"), 2, True).alias("lines"),
    ).first()
    assert "".join(row.code) == "I" + "h" * 9 + "H" * 4 + "xx" and (row.v2, row.v1, row.wait) == ("v2", "v1", None)
    assert row.depth == 2.0 and row.hue and row.window == [0, 85, 13, 100] and row.down == [0.0, 1.0, 0.0, 0.0] and row.lines == ["1,2", "6,7"]
    basis = np.array(display_axes((0.1, -0.9, 0.2)))
    assert np.allclose(basis @ basis.T, np.eye(3))
    blobs = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 5.0, 5.0), (1, 4.0, 4.0, 1.0, 5.0, 5.0), (2, 0.0, 0.0, 9.0, None, None), (2, 1.0, 1.0, 10.0, None, None)], "frame long, u double, v double, area double, eu double, ev double")
    assert {r.frame: r.area for r in best_blobs(blobs, ["frame"]).collect()} == {1: 1.0, 2: 10.0}


def test_detection_cut_at_pauses_is_that_of_a_loop(spark):
    pdf = signal(spark, 11, 1500, 4).toPandas().rename(columns={"signal": "v"}).sort_values(["session", "t"])

    def plain(g, trigger, onset, quiet, hold, most, gap):
        t, m, out, i = g.t.to_numpy(), g.v.to_numpy(), [], 0
        while i < len(t):
            if m[i] <= trigger:
                i += 1
                continue
            j, q = i, None
            while j < len(t) and t[j] < t[i] + most:
                q = (j if q is None else q) if m[j] <= quiet else None
                if q is not None and t[j] - t[q] >= hold:
                    break
                j += 1
            e = q if q is not None else min(j, len(t) - 1)
            p = i + int(np.argmax(m[i : e + 1]))
            k = i
            while k > 0 and m[k] > onset:
                k -= 1
            if not out or t[k] - out[-1][2] >= gap:
                out.append((t[k], t[p], t[e], m[p]))
            i = j + 1
        return out

    for args in ((10, 4, 4, 0.1, 1.2, 1.5), (12, 3, 5, 0.02, 0.5, 0.3)):
        got = segment.detect_events(spark.createDataFrame(pdf), *map(float, args)).orderBy("session", "event").toPandas()
        want = [(s, *x) for s, g in pdf.groupby("session") for x in plain(g, *args)]
        assert len(want) > 2 and np.allclose(got[["session", "t_onset", "t_peak", "t_end", "peak"]].to_numpy(float), np.array(want))


def test_fused_events_of_known_motion(spark):
    from tempofuse.plans.fusion_queries import UP
    from tempofuse.operators import fusion
    from tempofuse.sources.tables import swing_streams

    imu, markers, truth = (x.where("session < 6") for x in swing_streams(spark, "/root/testdata/sf0.001"))
    events = fusion.find_swings(imu)
    fused = fusion.fused_events(imu, markers, events, UP).where("status = 'ok'").toPandas()
    assert fused.groupby(["session", "event"]).ngroups >= 2
    met = fused.merge(truth.toPandas(), on=["session", "seq"], suffixes=("", "_true"))
    good = met[met.supported]
    angle = np.degrees(np.abs(np.arctan2(good.uy, good.ux) - good.angle + np.pi) % (2 * np.pi) - np.pi)
    assert np.median(np.abs(angle)) < 2 and np.abs(good.rate_true.abs() - good.rate).median() < 0.1 and fused.offset.abs().max() < 0.005


def test_swing_events_have_their_sql(spark):
    import duckdb

    from tempofuse.plans.fusion_queries import SWING_EVENTS_SQL, swing_events

    con = duckdb.connect()
    con.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    columns = "session, event, round(t_onset, 6), round(t_peak, 6), round(t_end, 6), peak"
    want = con.execute(f"select {columns} from ({SWING_EVENTS_SQL}) order by 1, 2").fetchall()
    got = swing_events(spark, "/root/testdata/sf0.001").selectExpr(*columns.split(", ", 2)[:2], "round(t_onset, 6)", "round(t_peak, 6)", "round(t_end, 6)", "peak").orderBy("session", "event").collect()
    assert len(want) > 10 and [tuple(r) for r in got] == want
