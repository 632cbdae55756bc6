"""Made-up sessions with known truth, for the tests of fusion and for Monte Carlo runs over many seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

GRAVITY = 9.80665
UP = np.array([0.0, -1.0, 0.0])
MARKERS = {"pink_1": 0.20, "pink_2": 0.40, "pink_3": 0.70}
SWEET, HANDS = 0.686, 0.152


def _about(axis: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Rotation matrices about a unit axis, (n, 3, 3)."""
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)


def motion(t: np.ndarray, peak: float, speed: float, width: float, tilt: float, rest: np.ndarray):
    """Truth at t: axis, its matrix, rate in the world, place and velocity of the bar's end."""
    normal = np.array([np.sin(tilt), -np.cos(tilt), 0.2])
    normal /= np.linalg.norm(normal)
    x = (t - peak) / width
    rate = speed * np.exp(-x * x)
    grid = np.linspace(t[0] - 1, t[-1] + 1, 20001)
    angle = np.interp(t, grid, np.concatenate([[0], np.cumsum(speed * np.exp(-(((grid[1:] + grid[:-1]) / 2 - peak) / width) ** 2) * np.diff(grid))]))
    wobble = 0.15 * np.sin(0.7 * t)
    turn = _about(normal, angle) @ _about(np.array([1.0, 0, 0]), wobble)
    wobble_rate = np.einsum("nij,j->ni", _about(normal, angle), np.array([1.0, 0, 0])) * (0.15 * 0.7 * np.cos(0.7 * t))[:, None]
    world_rate = rate[:, None] * normal + wobble_rate
    centre = np.array([0.1, 0.2, 2.5])
    arm = np.einsum("nij,j->ni", _about(normal, angle), np.array([0.35, 0.0, 0.1]))
    velocity = np.cross(rate[:, None] * normal, arm)
    return np.einsum("nij,j->ni", turn, rest), turn, world_rate, centre + arm, velocity


def session(seed: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Inertial rows, marker rows and one row of truth. Noise: 0.02 rad/s and a bias, 0.3 m/s², 3 mm, a tenth of the
    marker sights lost, and the camera's clock off by up to 50 ms."""
    r = np.random.default_rng(seed)
    peak, speed, width, tilt = 2.2 + r.uniform(-0.1, 0.1), r.uniform(24, 32), r.uniform(0.06, 0.09), r.uniform(-0.4, 0.4)
    rest = np.array([0.2, -0.5, 0.8]) / np.linalg.norm([0.2, -0.5, 0.8])
    offset = r.uniform(-0.05, 0.05)
    fixed = r.normal(size=4)
    mount = _quaternion_matrix(fixed / np.linalg.norm(fixed))
    t = np.arange(0, 3.2, 1 / 400)
    axis, turn, rate, end, velocity = motion(t, peak, speed, width, tilt, rest)
    body = turn @ mount
    accel = np.gradient(velocity, t, axis=0)
    bias = r.normal(0, 0.02, 3)
    gyro = np.einsum("nji,nj->ni", body, rate) + bias + r.normal(0, 0.02, (len(t), 3))
    force = np.einsum("nji,nj->ni", body, accel + GRAVITY * UP) + r.normal(0, 0.3, (len(t), 3))
    inertial = pd.DataFrame(np.column_stack([gyro, force]), columns=["gx", "gy", "gz", "ax", "ay", "az"]).assign(session=seed, seq=np.arange(len(t)), t=t - offset)
    tc = np.arange(0.2, 3.0, 1 / 120)
    u, _, _, k, _ = motion(tc, peak, speed, width, tilt, rest)
    rows = []
    for s_id, s in MARKERS.items():
        p = k + s * u + r.normal(0, 0.003, k.shape)
        seen = r.uniform(size=len(tc)) > 0.1
        rows.append(pd.DataFrame({"session": seed, "frame_id": np.arange(len(tc)), "t": tc, "marker_id": s_id, "s": s, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})[seen])
    best = np.linalg.norm(velocity + SWEET * np.cross(rate, axis), axis=1)
    at = int(best.argmax())
    v = (velocity + SWEET * np.cross(rate, axis))[at]
    truth = pd.DataFrame([{"session": seed, "offset": offset, "t_peak": t[at], "peak_speed": best[at], "path_angle": np.degrees(np.arcsin(v @ UP / best[at])), "bar_angle": np.degrees(np.arcsin(axis[at] @ UP))}])
    return inertial[["session", "seq", "t", "gx", "gy", "gz", "ax", "ay", "az"]], pd.concat(rows), truth


def _quaternion_matrix(q: np.ndarray) -> np.ndarray:
    from tempofuse.operators.attitude import matrix

    return matrix(q)


def sessions(spark: SparkSession, seeds: int, kind: int) -> DataFrame:
    """The inertial (0), marker (1) or truth (2) rows of so many seeds, each made where it is read."""
    schema = ("session long, seq long, t double, gx double, gy double, gz double, ax double, ay double, az double", "session long, frame_id long, t double, marker_id string, s double, x double, y double, z double", "session long, offset double, t_peak double, peak_speed double, path_angle double, bar_angle double")[kind]

    def run(parts):
        for part in parts:
            for seed in part["id"]:
                yield session(int(seed))[kind]

    return spark.range(seeds).repartition(min(seeds, 8)).mapInPandas(run, schema)
