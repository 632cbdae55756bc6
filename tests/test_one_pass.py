"""The chain of events in one pass over rows that are dealt by session once."""

import numpy as np
import pandas as pd
import pytest
import test_replay as R
from pyspark.sql import functions as F

from tempofuse.operators import fusion, measures, motion
from tempofuse.operators.geometry import bar_line
from tempofuse.plans import chain_queries as C
from tempofuse.plans import fusion_queries
from tempofuse.session import stored
from tempofuse.sources import sinks
from tempofuse.sources.tables import stream_parts, swing_streams

SF = "/root/testdata/sf0.001"
UP = (0.0, -1.0, 0.0)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large_joins(spark):
    """Joins as they are on large tables: none is by broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def streams(spark):
    imu, markers, _ = (stored(x.where("session < 4")) for x in swing_streams(spark, SF))
    return imu, markers, stored(fusion.find_swings(imu))


def same(a: pd.DataFrame, b: pd.DataFrame, keys=("session", "event", "seq")) -> None:
    a, b = (x.sort_values(list(keys)).reset_index(drop=True) for x in (a, b))
    assert len(a) and len(a) == len(b)
    for c in a:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], atol=1e-6, equal_nan=True), c
        else:
            assert (a[c].isna() == b[c].isna()).all() and (a[c].dropna() == b[c].dropna()).all(), c


def test_inertial_rows_are_not_dealt_again_for_their_windows(spark, large_joins):
    found = plan(fusion_queries.fused_events(spark, SF))
    assert found.count("Exchange") == found.count("REPARTITION_BY_NUM") == 3 and "Join" not in found


def test_events_go_when_their_window_is_past(streams):
    """Few rows are held at a time, and windows that overlap share rows: events are those of whole sessions."""
    imu, markers, events = streams
    both = stored(events.unionByName(events.selectExpr("session", "event + 1000 as event", "t_onset + 0.1 as t_onset", "t_peak", "t_end + 0.1 as t_end", "t_contact", "peak")))
    want = fusion.fused_events(imu, markers, both, UP)
    rows = fusion.dealt(imu, bar_line(markers, ["session", "frame_id", "t"]), "frame_id", fusion.LINE, both, 1.0, 0.3, 0.2, None)

    def run(pairs):
        return [fusion.Fused(pairs, np.array(UP)).whole()]

    got = fusion.in_windows(rows, run, fusion.seen_lines, 0.2, fusion.FUSED, whole=False, size=200)
    same(got.toPandas().drop(columns="elevation"), want.toPandas().drop(columns="elevation"))
    each = want.groupBy("session", "event").count().toPandas()
    assert len(each) == both.count() and each["count"].min() > 100


def test_parts_follow_the_number_of_events(spark, monkeypatch):
    monkeypatch.setattr("tempofuse.sources.tables.STREAM_ROWS", 100)
    assert stream_parts(spark, SF) > 8 and f", {stream_parts(spark, SF)})" in plan(swing_streams(spark, SF)[0])


# --- replays -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain(spark):
    """The chain step by step, as DataFrames."""
    return C.processed(spark, SF)


def test_replays_leave_the_pass_that_fuses(spark, large_joins):
    found = plan(C.processed_replay(spark, SF))
    assert found.count("Exchange") == found.count("REPARTITION_BY_NUM") == 3 and "Join" not in found


def test_replays_are_those_of_the_dataframes(spark, chain):
    want = sinks.replay_export(C.replay_of(*chain).where("knob_x is not null").drop("event"))
    same(C.processed_replay(spark, SF).toPandas(), want.toPandas(), ("session", "seq"))


@pytest.mark.parametrize("case", ["gap", "no accelerations", "at samples", "one sight", "no sight", "opposite", "doubled"])
def test_poses_of_one_event_are_those_of_the_dataframes(spark, case):
    k, v, a = R.curve(R.T)
    tc = R.T[[3, 10, 11, 30, 100, 120, 121]] if case == "at samples" else R.TC[:1] if case == "one sight" else R.TC + 9 if case == "no sight" else np.sort(np.append(R.TC, R.TC[4])) if case == "doubled" else R.TC
    a = np.where((R.T > 0.4)[:, None] & (case == "no accelerations"), np.nan, a)
    seen, axis = R.curve(tc)[0] + np.where(tc > 0.5, 0.2, 0.0)[:, None] * [1, 0, 0], R.about_z(tc + np.where(tc > 0.5, np.pi, 0.3) * (case == "opposite"))
    seen[4:5] -= 0.01
    u = R.about_z(R.T)
    want = motion.camera_guided(*R.frames(spark, R.T, tc, k, v, u, a, seen, axis)).toPandas().sort_values("seq")
    got = measures.guided_poses(R.T, k, v, u, a, tc, seen, axis)
    for n, x in zip(("rk", "rv", "ru"), got[:3], strict=True):
        assert np.allclose(x, want[[f"{n}{c}" for c in "xyz"]].to_numpy(float), atol=1e-9, equal_nan=True), n
    assert (got[3] == want.estimated).all() and (got[5] == want.replay_accel).all()
    assert np.allclose(got[4], want.camera_distance.to_numpy(float), atol=1e-12, equal_nan=True)


# --- exports and measures ------------------------------------------------------------------------------------------


def test_samples_leave_the_pass_that_fuses(spark, chain, large_joins):
    df = C.processed_samples(spark, SF)
    assert plan(df).count("Exchange") == plan(df).count("REPARTITION_BY_NUM") == 3 and "Join" not in plan(df)
    _, _, events, fused = chain
    rows = fused.where("status = 'ok'").join(C.on_camera_time(events, fused).drop("session", "event"), "piece")
    names = {f"knob_{a}": F.col(f"k{a}") for a in "xyz"} | {f"axis_{a}": F.col(f"u{a}") for a in "xyz"} | {"sweet_speed": F.col("speed"), "speed_valid": F.col("supported")}
    want, got = (x.toPandas().sort_values(["session", "event", "seq"]).reset_index(drop=True) for x in (sinks.fused_export(rows.withColumns(names), C.LENGTH, C.SWEET), df))
    assert list(got) == list(want) and len(got) == len(want)
    for c in want:
        assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1.1e-3 if c == "att_std_deg" else 1.1e-4 if "speed" in c else 1.1e-5, equal_nan=True), c


def old_measures(spark, imu, markers, events, fused):
    """fused_measures() from windows and joins over the fused samples."""
    ok = stored(fused.where("status = 'ok'"))
    offset = ok.groupBy("session", "event").agg(F.first("offset").alias("o"))
    moved = events.join(offset, ["session", "event"]).select("session", "event", *[(F.col(c) + F.col("o")).alias(c) for c in measures.SAMPLE_TIMES])
    plain = motion.swing_measures(ok.select("session", "event", "t", "speed", "hand_speed", "elevation", "rate", F.col("supported").alias("valid")), moved)
    known = moved.withColumn("t_contact", F.coalesce("t_contact", "t_peak"))
    turning = motion.turning_measures(ok, known).drop("path_angle_deg")
    camera = motion.camera_angles(bar_line(markers, ["session", "frame_id", "t"]), known, UP).withColumnsRenamed({"bar_angle_deg": "camera_bar_angle_deg", "path_angle_deg": "camera_path_angle_deg"})
    return plain.join(turning, ["session", "event"], "left").join(camera, ["session", "event"], "left")


def test_measures_leave_the_pass_that_fuses(spark, streams, large_joins):
    found = plan(fusion_queries.fused_measures(spark, SF))
    assert found.count("Exchange") == found.count("REPARTITION_BY_NUM") == 3 and "Join" not in found
    imu, markers, events = streams
    sensed = events.withColumn("t_contact", F.when(F.col("event") % 2 == 0, F.col("t_peak") + 0.01))  # some are felt, some not
    markers = markers.where("session != 1 or frame_id % 5 != 0")  # and some have little support
    for e in (events, sensed):
        want = old_measures(spark, imu, markers, e, fusion.fused_events(imu, markers, e, UP))
        schema = f"session long, event long, {measures.MEASURES}, {measures.TURNING}, {measures.CAMERA}"
        got = fusion.each_event(imu, markers, e, UP, measures.all_measures, schema)
        same(got.toPandas(), want.toPandas(), ("session", "event"))


def test_measures_of_an_event_without_support_or_length():
    t = np.arange(3) / 400
    at = dict.fromkeys(measures.SAMPLE_TIMES, 0.001) | {"t_contact": np.nan}
    out = measures.swing_measures(t, *np.ones((4, 3)), np.zeros(3, bool), at)
    assert out == (None, None, None, None, 0.0, None, 0.001, False, False, False, 0.0)
    assert np.isnan(measures.parabola_rates(np.ones((6, 3)), 3)).all() and np.allclose(measures.parabola_rates(np.arange(8.0)[:, None] ** 2, 3)[:, 0], 2 * np.arange(8))


def test_states_and_measures_leave_the_pass_that_fuses(spark, chain, large_joins):
    df = C.processed_events(spark, SF)
    found = plan(df)
    # three of streams and windows by session, and two of a row for each event
    assert found.count("REPARTITION_BY_NUM") == 3 and found.count("Exchange") == 5 and found.count("ENSURE_REQUIREMENTS") == 2
    _, _, events, fused = chain
    ok = fused.where("status = 'ok'")
    want = motion.swing_measures(ok.select("session", "event", "t", "speed", "hand_speed", "elevation", "rate", F.col("supported").alias("valid")), C.on_camera_time(events, fused))
    state = fused.groupBy("session", "event").agg(F.first("status").alias("status"), F.count("seq").alias("n_samples"), F.count_if("supported").alias("n_supported"), F.first("n_used").alias("n_used"), F.first("n_refused").alias("n_refused"), F.first("offset").alias("offset"))
    want = events.select("session", "event", "t_onset", "t_end").join(state, ["session", "event"], "left").join(want, ["session", "event"], "left").withColumn("status", F.coalesce("status", F.lit("no_samples")))
    same(df.toPandas(), want.toPandas(), ("session", "event"))


def test_events_that_are_not_fused_keep_their_state(spark, streams):
    """One event with few sights, and one without inertial rows, which has no state here."""
    imu, markers, events = (x.where("session = 0") for x in streams)
    far = events.unionByName(events.limit(1).selectExpr("session", "99 as event", "t_onset + 1000 as t_onset", "t_peak", "t_end + 1000 as t_end", "t_contact", "peak"))
    then = lambda fused, _: measures.states_and_measures(fused)
    got = fusion.each_event(imu, markers.where("frame_id < 3"), far, UP, then, f"session long, event long, {measures.STATE}, {measures.MEASURES}").toPandas().set_index("event")
    assert got.status[0] == "too_few_camera" and got.n_samples[0] == got.n_supported[0] == 0 and np.isnan(got.n_used[0]) and 99 not in got.index
