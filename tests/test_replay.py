"""Replays that follow the camera, against motions with closed forms."""

import numpy as np
import pandas as pd
import pytest

from tempofuse.operators import motion

SAMPLES = ["session", "seq", "t", *[f"{n}{a}" for n in "kvua" for a in "xyz"]]
SIGHTS = ["session", "t", *[f"{n}{a}" for n in "pd" for a in "xyz"]]


def about_z(angle):
    return np.stack([np.cos(angle), np.sin(angle), np.zeros_like(angle)], axis=1)


def curve(t):
    """Place, velocity and acceleration of a motion of constant acceleration."""
    a = np.array([2.0, -1.0, 0.5])
    return 0.1 + t[:, None] * [0.3, 0.2, -0.4] + a * t[:, None] ** 2 / 2, [0.3, 0.2, -0.4] + a * t[:, None], np.broadcast_to(a, (len(t), 3))


def frames(spark, t, tc, k, v, u, a, p, d):
    rows = np.column_stack([np.ones(len(t)), np.arange(len(t)), t, k, v, u, a])
    samples = pd.DataFrame(rows, columns=SAMPLES).astype({"session": int, "seq": int})
    sights = pd.DataFrame(np.column_stack([np.ones(len(tc)), tc, p, d]), columns=SIGHTS).astype({"session": int})
    plain = lambda df: [tuple(None if x != x else x for x in row) for row in df.astype(object).itertuples(index=False)]
    kind = lambda names: ", ".join(f"{c} {'long' if c in ('session', 'seq') else 'double'}" for c in names)
    return spark.createDataFrame(plain(samples), kind(SAMPLES)), spark.createDataFrame(plain(sights), kind(SIGHTS))


def guided(*args, **kw):
    out = motion.camera_guided(*args, **kw).toPandas().sort_values("seq")
    pick = lambda n: out[[f"{n}{a}" for a in "xyz"]].to_numpy(float)
    return out, pick("rk"), pick("rv"), pick("ru")


T = np.arange(0, 1.0001, 0.005)
TC = np.concatenate([np.arange(0.002, 0.3, 0.01), np.arange(0.703, 0.98, 0.01)])


def test_a_gap_is_bridged_by_accelerations(spark):
    """The samples' own place and velocity are far off in the gap, as after a reset; sights and accelerations bridge it."""
    k, v, a = curve(T)
    off = (T > 0.32) & (T < 0.68)
    k, v = k + np.where(off, 100.0, 0.0)[:, None], v + np.where(off, -50.0, 0.0)[:, None]
    out, place, speed, axis = guided(*frames(spark, T, TC, k, v, about_z(T), a, curve(TC)[0], about_z(TC)))
    inside = (T > TC[0]) & (T < TC[-1])
    # slopes over sights at a gap's ends are those of the middle of what they cover: the bridge is near, not equal
    assert np.abs(place - curve(T)[0])[inside].max() < 0.01 and np.abs(axis - about_z(T)).max() < 2e-5
    gap = (T > TC[29] + 0.003) & (T < TC[30] - 0.003)
    assert (out.estimated.to_numpy() == (gap | (T > TC[-1] + 0.0025) | (T < 0))).sum() >= len(T) - 2
    assert (out.replay_accel == out.estimated).all() and out.camera_distance.max() == pytest.approx(0.2, abs=0.01)
    assert np.linalg.norm(np.diff(place, axis=0), axis=1).max() < 0.03


def test_without_accelerations_ends_still_meet(spark):
    k, v, _ = curve(T)
    seen = curve(TC)[0] + np.where(TC > 0.5, 0.2, 0.0)[:, None] * [1, 0, 0]  # the camera comes back elsewhere
    out, place, _, _ = guided(*frames(spark, T, TC, k, v, about_z(T), np.full((len(T), 3), np.nan), seen, about_z(TC)))
    assert np.isfinite(place).all() and not out.replay_accel.any()
    assert np.linalg.norm(np.diff(place, axis=0), axis=1).max() < 0.04  # the step is spread over the gap
    at = np.searchsorted(T, 0.85)
    assert place[at, 0] == pytest.approx(curve(T)[0][at, 0] + 0.2, abs=1e-3)


def test_the_axis_is_turned_by_a_field_that_meets_the_sights(spark):
    """The samples' axis is off by an angle that grows with time: the field between sights is a straight line too."""
    k, v, a = curve(T)
    wrong = about_z(3 * T + 0.1 + 0.2 * T)
    _, _, _, axis = guided(*frames(spark, T, TC, k, v, wrong, a, curve(TC)[0], about_z(3 * TC)))
    gap = (T > TC[29]) & (T < TC[30])
    assert np.abs(axis - about_z(3 * T))[gap].max() < 1e-4
    before = T < TC[0]
    assert np.abs(axis - about_z(3 * T + 0.2 * (T - TC[0])))[before].max() < 1e-3  # the first difference is held


def test_between_near_sights_it_goes_straight_and_turns_evenly(spark):
    k, v, a = curve(T)
    tc = np.array([0.2, 0.24, 0.28, 0.6])
    p = np.array([[0.0, 0, 0], [1, 2, 3], [2, 2, 2], [5, 5, 5]])
    d = about_z(np.array([0.0, 1.0, 1.5, 0.2]))
    out, place, speed, axis = guided(*frames(spark, T, tc, k, v, about_z(T), a, p, d))
    half = np.argmin(np.abs(T - 0.22))
    assert np.allclose(place[half], [0.5, 1, 1.5], atol=1e-9) and np.allclose(speed[half], np.array([1, 2, 3]) / 0.04, atol=1e-6)
    assert np.allclose(axis[half], about_z(np.array([0.5]))[0], atol=1e-9)
    at = np.argmin(np.abs(T - 0.24))
    assert np.allclose(place[at], [1, 2, 3]) and np.allclose(speed[at], np.array([1, 0, -1]) / 0.04, atol=1e-6)
    end = np.argmin(np.abs(T - 0.28))
    assert np.allclose(speed[end], np.array([1, 0, -1]) / 0.04, atol=1e-6) and np.allclose(axis[end], d[2], atol=1e-9)
    supported = ~out.estimated.to_numpy()
    assert np.allclose(T[supported], [*T[(T > 0.199) & (T < 0.281)], 0.6])
    alone = np.argmin(np.abs(T - 0.6))
    assert np.allclose(place[alone], [5, 5, 5]) and np.allclose(speed[alone], v[alone])  # its velocity is the samples'


def test_without_sights_there_is_no_replay(spark):
    k, v, a = curve(T)
    samples, sights = frames(spark, T, TC, k, v, about_z(T), a, curve(TC)[0], about_z(TC))
    for none in (sights.where("t > 5"), sights.selectExpr("session + 7 as session", *SIGHTS[1:]), sights.selectExpr("session", "t", "px", "py", "cast(null as double) as pz", "dx", "dy", "dz")):
        out = motion.camera_guided(samples, none).toPandas()
        assert len(out) == len(T) and out[["rkx", "rvx", "rux", "camera_distance"]].isna().all().all()
