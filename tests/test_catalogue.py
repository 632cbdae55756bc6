"""The catalogue of events under several writers."""

import datetime
import itertools

from tempofuse.operators import geometry
from tempofuse.sources.catalogue import Catalogue


def at(k):
    return datetime.datetime(2024, 1, 1, 0, 0, k)


def added(spark, *ids):
    return spark.createDataFrame([(i, at(0), f'{{"n": {n}}}') for n, i in enumerate(ids)], "id string, at timestamp, meta string")


def final(spark, *rows):
    return spark.createDataFrame([(i, s, at(k)) for i, s, k in rows], "id string, status string, at timestamp")


def now(c):
    return {r.id: r.status for r in c.current().collect()}


def test_statuses_of_two_writers(spark, tmp_path):
    a, b = Catalogue(spark, str(tmp_path / "c"), "a"), Catalogue(spark, str(tmp_path / "c"), "b")
    assert now(a) == {}
    a.add(added(spark, "x", "y", "z"))
    assert now(b) == dict.fromkeys("xyz", "processing")
    b.finish(final(spark, ("x", "ok", 5), ("y", "failed: too few", 2)))
    a.finish(final(spark, ("x", "failed", 4), ("y", "ok", 2)))
    # of two ends the first in time counts, and of one time the first writer's
    assert now(a) == now(b) == {"x": "failed", "y": "ok", "z": "processing"}
    b.delete(final(spark, ("x", "", 0)).select("id"))
    a.finish(final(spark, ("x", "ok", 1)))
    assert now(a) == {"y": "ok", "z": "processing"}


def test_the_order_of_writes_does_not_count(spark, tmp_path):
    found = set()
    for n, order in enumerate(itertools.permutations(range(3))):
        c = Catalogue(spark, f"{tmp_path}/{n}", "w")
        steps = [lambda c=c: c.add(added(spark, "x", "y")), lambda c=c: c.finish(final(spark, ("x", "ok", 3), ("y", "failed", 4))), lambda c=c: c.delete(final(spark, ("y", "", 0)).select("id"))]
        for k in order:
            steps[k]()
        found.add(tuple((r.id, r.status, r.meta) for r in c.current().collect()))
    assert found == {(("x", "ok", '{"n": 0}'),)}


def test_snapshots_change_nothing(spark, tmp_path):
    c, other = Catalogue(spark, str(tmp_path / "c"), "w"), Catalogue(spark, str(tmp_path / "c"), "v")
    c.add(added(spark, "x", "y", "z"))
    c.finish(final(spark, ("x", "ok", 3)))
    c.delete(final(spark, ("z", "", 0)).select("id"))
    before = now(c)
    assert c.compact() == "v=1" and now(other) == before
    other.versions = lambda: []  # a writer that looked before: it finds the version taken
    assert other.compact() is None and c.versions() == ["v=1"]
    c.finish(final(spark, ("y", "ok", 9), ("z", "ok", 9)))
    assert c.compact() == "v=2" and now(c) == {"x": "ok", "y": "ok"}


def test_details(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path / "c"), "w")
    c.add(added(spark, "x", "y"))
    c.delete(final(spark, ("y", "", 0)).select("id"))
    files = spark.createDataFrame([("x", "imu.csv", 10), ("x", "camera.jsonl", 20), ("y", "imu.csv", 1)], "id string, name string, size long")
    rows = c.detail(final(spark, ("x", "", 0), ("y", "", 0), ("q", "", 0)), files=files).collect()
    assert [(r.id, r.status, [tuple(f) for f in r.files]) for r in rows] == [("x", "processing", [("camera.jsonl", 20), ("imu.csv", 10)])]


def test_pairing_equals_all_pairings():
    import numpy as np

    r = np.random.default_rng(4)
    off = np.where(r.random((60, 5, 5)) < 0.5, -1, r.integers(0, 4, (60, 5, 5)))
    got = geometry.best_pairing(off)
    for o, lists in zip(off, got, strict=True):
        best = None
        for p in itertools.permutations([*range(1, 6), *[0] * 5], 5):
            taken = [(i, j) for i, j in enumerate(p) if j]
            if any(o[i, j - 1] < 0 for i, j in taken):
                continue
            turned = sum(a > b for (_, a), (_, b) in itertools.combinations(taken, 2))
            key = -len(taken), turned, sum(o[i, j - 1] for i, j in taken), [j or 9 for j in p]
            best = min(best or key, key)
        assert [j or 9 for j in lists.tolist()] == best[3]
