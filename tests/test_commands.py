"""The command line, on captures written to disk and on the given tables."""

import json

import pytest

from tempofuse import config
from tempofuse.__main__ import main
from tempofuse.sources import simulate, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def captures(spark, tmp_path):
    """Two made-up sessions as the files of captures: the inertial rows as CSV, the sights as JSON lines."""
    imu, markers = (simulate.sessions(spark, 2, k).toPandas() for k in (0, 1))
    for s in imu.session.unique():
        folder = tmp_path / "in" / f"cap{s}"
        folder.mkdir(parents=True)
        rows = imu[imu.session == s].sort_values("t").reset_index(drop=True)
        named = {"accel_x": "ax", "accel_y": "ay", "accel_z": "az", "omega_x": "gx", "omega_y": "gy", "omega_z": "gz"}
        out = rows[list(named.values())].set_axis(list(named), axis=1)
        out.insert(0, "tx_time_stamp", (rows.t * 1e6).round().astype("int64"))
        out.insert(1, "imu_meas_time", rows.t)
        out.insert(2, "system_time", rows.t)
        out.insert(3, "status_var_value", 4095)
        out.to_csv(folder / "imu.csv", index=False)
        sights = spark.createDataFrame(markers[markers.session == s]).select("session", "frame_id", "t", "marker_id", "x", "y", "z", sinks.F.lit("camera").alias("source"))
        (folder / "camera.jsonl").write_text("\n".join(r.value for r in sinks.marker_frames(sights).collect()))
    return str(tmp_path / "in")


def test_process(spark, captures, tmp_path, capsys):
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({"event": {"pre_roll": 0.9}}))
    assert main(["process", captures, str(tmp_path / "out"), str(settings)]) == 0
    events = spark.read.parquet(str(tmp_path / "out/events")).collect()
    assert {r.session for r in events} == {"cap0", "cap1"} and all(r.status == "ok" and r.peak_speed_mph > 10 for r in events)
    assert spark.read.parquet(str(tmp_path / "out/samples")).count() > 500


def test_validate_ends_by_its_target(spark, capsys):
    assert main(["validate", SF]) == 0 and "mean error" in capsys.readouterr().out
    assert main(["validate", SF, "0.0001"]) == 1


def test_config_and_wrong_commands(spark, tmp_path, capsys):
    file = tmp_path / "c.json"
    file.write_text('{"bar": {"length": 0.9}}')
    assert main(["config", str(file)]) == 0 and config.loads(capsys.readouterr().out).bar.length == 0.9
    assert main([]) == main(["run", "no_such_query", SF, "x"]) == main(["process", "only"]) == 2
