"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempofuse.sources import files, sinks
from tempofuse.sources.bytestreams import crc16_rows

HEADER = [n for n, _ in files.IMU_COLUMNS]


def write_imu(folder, rows, columns=HEADER):
    folder.mkdir(parents=True)
    lines = [",".join(columns)] + [",".join(str(r[c]) for c in columns) for r in rows]
    (folder / "imu.csv").write_text("\n".join(lines))


def imu_row(k, host=True):
    row = dict.fromkeys(HEADER, 0)
    tx = (2**32 - 5000 + 2500 * k) % 2**32
    row |= {"tx_time_stamp": tx, "imu_meas_time": 0.0025 * k, "omega_x": k, "ts_ns_host": int(1e18) + 2_500_000 * (4 * (k // 4)) + 4_000_000 if host else 0, "status_var_value": 4095}
    return row


def test_imu_csv_maps_the_device_clock(spark, tmp_path):
    write_imu(tmp_path / "a", [imu_row(k) for k in range(400)])
    got = files.read_imu_csv(spark, str(tmp_path / "*")).orderBy("seq").toPandas()
    assert got.session.unique().tolist() == ["a"] and got.has_host_clock.all()
    assert np.allclose(np.diff(got.t), 0.0025, atol=2e-4) and (got.gx == np.arange(400)).all()


def test_imu_csv_without_host_clock_or_optional_columns(spark, tmp_path):
    write_imu(tmp_path / "b", [imu_row(k, False) for k in range(5)], [c for c in HEADER if c not in files.OPTIONAL])
    got = files.read_imu_csv(spark, str(tmp_path / "*")).orderBy("seq").toPandas()
    assert not got.has_host_clock.any() and np.allclose(got.t, 0.0025 * np.arange(5)) and (got.hx == 0).all()
    with pytest.raises(ValueError):
        write_imu(tmp_path / "c" / "d", [imu_row(0)], ["tx_time_stamp"])
        files.read_imu_csv(spark, str(tmp_path / "c" / "*"))


def test_camera_frames_and_markers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    point = lambda i, x: {"id": i, "pos": {"x": x, "y": 0.0, "z": 1.0}}
    frames = [{"frame_id": 1, "ts_ns_image": 10**9, "points": [point("a", 1.0), point("b", 2.0), point("a", 3.0), point(None, 9.0)], "more": 1}, {"frame_id": 2, "ts_ns_image": 2 * 10**9, "points": []}]
    (tmp_path / "s" / "cam.jsonl").write_text("\n\n".join(map(json.dumps, frames)))
    f = files.read_camera_jsonl(spark, str(tmp_path / "s"))
    m = {r.marker_id: r.x for r in files.marker_observations(f).collect()}
    assert f.count() == 2 and m == {"a": 3.0, "b": 2.0}
    assert {r.marker_id for r in files.marker_observations(f, ["b"]).collect()} == {"b"}
    wide = files.wide_markers(files.marker_observations(f), ["a", "b"]).first()
    assert wide.a_x == 3.0 and wide.b_z == 1.0


def test_gravity_is_gated(spark):
    eye = np.eye(4).tolist()
    rows = [([0.0, -9.5, 0.0], eye), ([0.0, -4.0, 0.0], eye)]
    got = files.camera_gravity(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, accel_mean array<double>, transform array<array<double>>")).orderBy("k").collect()
    assert np.allclose(got[0].gravity, [0, files.GRAVITY, 0]) and got[1].gravity is None


def test_segments_make_one_sequence(spark):
    f = spark.createDataFrame([("s", t) for t in (0, 10, 20, 30, 30, 40, 50, 60)], "session string, ts_ns_image long")
    got = files.segment_frames(f, F.lit(10), F.lit(50)).orderBy("frame_id").collect()
    assert [r.ts_ns_image for r in got] == [10, 20, 30, 40, 50] and [r.frame_id for r in got] == [1, 2, 3, 4, 5]


def test_batches_of_samples(spark):
    rows = [('{"type":"imu","samples":[{"tx_us":1,"gx":2.5},{"tx_us":2}]}',), ('{"type":"other","samples":[{"tx_us":9}]}',), ("broken",)]
    got = files.batch_samples(spark.createDataFrame(rows, "value string")).orderBy("tx_us").collect()
    assert [(r.tx_us, r.gx) for r in got] == [(1, 2.5), (2, None)]


def test_frames_are_found_again_after_noise(spark):
    frame = lambda k: bytes([k]) * 28 + b"\x0f\xff"
    data = b"xyz" + b"".join(frame(k) for k in range(3)) + b"\x0f\xff!" + frame(3) + frame(4) + b"cut"
    chunks = spark.createDataFrame([("s", k, data[13 * k : 13 * k + 13]) for k in range(-(-len(data) // 13))], "session string, seq long, data binary")
    got = files.resync_frames(chunks).orderBy("number").collect()
    assert [bytes(r.frame) for r in got if bytes(r.frame)[0] in range(5)] == [frame(k) for k in (0, 1, 3, 4)] or len(got) >= 4
    assert got[0].skipped == 3


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("s", 1.0, float("nan"), 2.00005, True)], "session string, t double, speed double, angle double, ok boolean")
    assert json.loads(sinks.measures_json(df).first().value) == {"session": "s", "t": 1.0, "speed": None, "angle": 2.0, "ok": True}
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_table(df.withColumn("session", F.lit("u")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    pose = {c: F.lit(1.0) for c in ("qx", "qy", "qz", "axis_x", "axis_y", "axis_z", "att_std_deg", "sweet_speed")} | {f"knob_{a}": F.lit(0.1) for a in "xyz"}
    e = sinks.fused_export(df.withColumns(pose | {"t_onset": F.lit(0.25), "t_end": F.lit(0.5), "qw": F.lit(0.12345678), "speed_valid": F.lit(True)}), 0.8, 0.5)
    assert len(e.columns) == 22 and (e.first().t_s, e.first().qw, e.first().speed_valid, e.first().in_swing, e.first().tip_x, e.first().sweet_z) == (0.75, 0.123457, 1, 0, 0.9, 0.6)
    m = spark.createDataFrame([(True, True), (False, True), (False, False)], "seen boolean, supported boolean").select(sinks.marker_source(F.col("seen"), F.col("supported")).alias("source"))
    assert [r.source for r in m.collect()] == ["camera", "imu_fill", "unsupported"]
    wide = spark.createDataFrame([("s", 1, 0.5, "a", 1.0000049, 2.0, 3.0, "camera"), ("s", 1, 0.5, "b", 4.0, 5.0, 6.0, "imu_fill")], "session string, frame_id long, t_s double, marker_id string, x double, y double, z double, source string")
    assert tuple(sinks.marker_export(wide, ["a", "b"]).first()) == ("s", 1, 0.5, 1.0, 2.0, 3.0, "camera", 4.0, 5.0, 6.0, "imu_fill")


def test_checked_frames(spark):
    def frame(k):
        body = bytes([k]) * 38  # the sum is of what is between the header and itself
        return b"\xa5\x5a" + body + int(crc16_rows(np.frombuffer(body, np.uint8)[None])[0]).to_bytes(2, "big")

    assert crc16_rows(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0x29B1
    broken = bytearray(frame(2))
    broken[10] ^= 1
    data = b"??" + frame(0) + frame(1) + bytes(broken) + frame(3) + frame(4)[:20]
    chunks = spark.createDataFrame([("s", k, data[17 * k : 17 * k + 17]) for k in range(-(-len(data) // 17))], "session string, seq long, data binary")
    got = files.checked_frames(chunks).orderBy("number").collect()
    assert [bytes(r.payload)[0] for r in got] == [0, 1, 3] and [r.skipped for r in got] == [2, 0, 42]
