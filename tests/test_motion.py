"""Kernels of curves, attitude and motion against dense solutions and closed forms."""

import numpy as np
import pytest

from tempofuse.operators import attitude, curves, motion


def natural_spline_system(t):
    """Dense roughness matrix K of the natural cubic spline through values at t: integral f''^2 = f' K f."""
    n, h = len(t), np.diff(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for k in range(n - 2):
        q[k : k + 3, k] = [1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]]
        r[k, k] = (h[k] + h[k + 1]) / 3
        if k + 1 < n - 2:
            r[k, k + 1] = r[k + 1, k] = h[k + 1] / 6
    return q @ np.linalg.solve(r, q.T)


@pytest.mark.parametrize("penalty", [1e-6, 0.1, 100.0])
def test_spline_equals_the_dense_solution(penalty):
    r = np.random.default_rng(1)
    t, y = np.cumsum(r.uniform(0.1, 1, 40)), r.normal(size=40)
    fit, slope = curves.smoothing_spline(t, y, penalty)
    assert np.allclose(fit, np.linalg.solve(np.eye(40) + penalty * natural_spline_system(t), y), atol=1e-7)
    line = 3 * t - 2
    fit, slope = curves.smoothing_spline(t, line, penalty)
    assert np.allclose(fit, line) and np.allclose(slope, 3)


@pytest.mark.parametrize("n", [3, 4, 5, 60])
def test_freedom_is_the_dense_trace(n):
    r = np.random.default_rng(n)
    t = np.cumsum(r.uniform(0.1, 1, n))
    penalties = np.array([1e-6, 1e-2, 1.0, 300.0])
    dense = [n - np.trace(np.linalg.inv(np.eye(n) + p * natural_spline_system(t))) for p in penalties]
    assert np.allclose(curves._Spline(t, penalties).freedom_left(), dense, rtol=1e-9, atol=1e-12)


def test_penalty_is_that_of_the_dense_score():
    r = np.random.default_rng(7)
    t = np.cumsum(r.uniform(0.01, 0.03, 80))
    y = np.sin(6 * t) + r.normal(0, 0.1, 80)
    tries = np.logspace(-9, 0, 25)
    scores = []
    for p in tries:
        smoother = np.linalg.inv(np.eye(80) + p * natural_spline_system(t))
        scores.append(80 * ((y - smoother @ y) ** 2).sum() / (80 - np.trace(smoother)) ** 2)
    assert curves.best_penalty(t, y, tries) == tries[np.argmin(scores)]


def test_columns_share_a_spline():
    r = np.random.default_rng(9)
    t, y = np.cumsum(r.uniform(0.1, 1, 30)), r.normal(size=(30, 3))
    fit, slope = curves.smoothing_spline(t, y, 0.2)
    for k in range(3):
        one, rate = curves.smoothing_spline(t, y[:, k], 0.2)
        assert np.allclose(fit[:, k], one) and np.allclose(slope[:, k], rate)


def test_track_equals_least_squares():
    r = np.random.default_rng(2)
    n, spread, jolt = 25, 0.1, 2.0
    t = np.cumsum(r.uniform(0.01, 0.05, n))
    y = np.sin(5 * t) + r.normal(0, spread, n)
    y[5:9] = np.nan
    place, speed, refused = curves.velocity_track(t, y, spread, jolt, 1e9)
    # the same posterior by one dense solve over (place, speed) of all times; the process has rank one, so it is damped
    rows, rhs = [], []
    base = np.zeros((n, 2 * n))
    first = np.diag([spread**2, (jolt * 0.5) ** 2 + 1])
    for k, v in enumerate((y[0], 0.0)):
        e = np.zeros(2 * n)
        e[k] = 1 / np.sqrt(first[k, k])
        rows.append(e), rhs.append(v / np.sqrt(first[k, k]))
    for k in range(n):
        if not np.isnan(y[k]):
            e = np.zeros(2 * n)
            e[2 * k] = 1 / spread
            rows.append(e), rhs.append(y[k] / spread)
        if k:
            dt = t[k] - t[k - 1]
            lever = np.array([dt * dt / 2, dt]) * jolt
            across = np.array([-lever[1], lever[0]])
            for direction, weight in ((lever / (lever @ lever), 1.0), (across / (across @ across) * np.linalg.norm(across), 1e6)):
                e = np.zeros(2 * n)
                e[2 * k : 2 * k + 2] = direction * weight
                e[2 * k - 2 : 2 * k] = -(direction @ np.array([[1, dt], [0, 1]])) * weight
                rows.append(e), rhs.append(0.0)
    del base
    x = np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0].reshape(n, 2)
    assert refused == 0 and np.allclose(place, x[:, 0], atol=1e-3) and np.allclose(speed, x[:, 1], atol=5e-2)


def test_constant_rate_turns_by_its_angle():
    t = np.linspace(0, 1, 101)
    q = attitude.integrate_rates(t, np.tile([0, 0, 2.0], (101, 1)))
    assert np.allclose(q[-1], [np.cos(1), 0, 0, np.sin(1)], atol=1e-9)


def test_filter_finds_attitude_and_bias():
    r = np.random.default_rng(3)
    n = 4000
    t = np.arange(n) / 400
    true_rate = np.stack([np.sin(3 * t), 0.5 * np.cos(2 * t), 1 + 0 * t], axis=1) * 3
    truth = attitude.integrate_rates(t, true_rate)
    bias = np.array([0.012, -0.01, 0.008])
    grip, up = np.array([1.0, 0, 0]), np.array([0, 0, 9.80665])
    axis = np.full((n, 3), np.nan)
    for k in range(0, n, 4):
        axis[k] = attitude.matrix(truth[k]) @ grip + r.normal(0, 0.01, 3)
    down = np.array([attitude.matrix(q).T @ up for q in truth]) + r.normal(0, 0.2, (n, 3))
    q, b, deviation, used, refused = attitude.smooth_attitude(t, true_rate + bias + r.normal(0, 0.02, (n, 3)), down, axis, grip, up, attitude.turn(truth[0], np.array([0.02, 0.02, -0.02])), axis_spread=0.02)
    off = [2 * np.arccos(min(1, abs(x @ y))) for x, y in zip(q, truth, strict=True)]
    assert np.degrees(np.median(off)) < 1.0 and np.linalg.norm(b[-1] - bias) < 0.7 * np.linalg.norm(bias)
    assert used > 4500 and refused < 10 and (deviation < 3).all()


def test_point_sets_give_back_their_turn(spark):
    r = np.random.default_rng(4)
    rows, turns = [], {}
    for frame in range(5):
        q = r.normal(size=4)
        q = q / np.linalg.norm(q) * np.sign(q[0])
        turns[frame] = q
        for p in r.normal(size=(6, 3)):
            rows.append((frame, *map(float, p), *map(float, attitude.matrix(q) @ p + [1, 2, 3])))
    df = spark.createDataFrame(rows, "frame long, a double, b double, c double, x double, y double, z double")
    for row in attitude.point_set_rotation(df, "frame", ("a", "b", "c"), ("x", "y", "z")).collect():
        assert np.allclose([row.qw, row.qx, row.qy, row.qz], turns[row.frame], atol=1e-6) and row.rms < 1e-6


def test_accelerated_motion_is_bridged_exactly(spark):
    t = np.linspace(0, 1, 41)
    rows = [(1, k, float(u), float(u * u), float(2 * u), 2.0, not 0.3 < u < 0.7) for k, u in enumerate(t)]
    df = spark.createDataFrame(rows, "session long, seq long, t double, x double, v double, a double, supported boolean")
    got = motion.bridged(df).orderBy("seq").toPandas()
    assert np.allclose(got.bridge, t * t, atol=1e-10) and got.estimated.sum() == sum(not x[-1] for x in rows)
    edges = spark.createDataFrame([(*x[:-1], 0.3 <= x[2] <= 0.7) for x in rows], df.schema)
    assert np.allclose(motion.bridged(edges).orderBy("seq").toPandas().bridge, t * t, atol=1e-10)
    none = spark.createDataFrame([(*x[:-1], False) for x in rows], df.schema)
    assert motion.bridged(none).toPandas().bridge.isna().all()
