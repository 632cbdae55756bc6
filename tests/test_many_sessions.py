"""Steps whose cost is to grow with rows, not with the number of sessions, folders or places of a frame."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempofuse.functions import cameras
from tempofuse.functions.codec import crc16
from tempofuse.operators import geometry, quality, scans
from tempofuse.plans import QUERIES, format_queries
from tempofuse.sources import bytestreams, files, sinks

SF = "/root/testdata/sf0.001"


def local(path):
    return Path(path.removeprefix("file:"))


def test_captures_of_many_sessions_share_files(spark):
    rows, names = format_queries._capture(format_queries._numbered(spark, SF), F.lit(0))
    path = format_queries._written(rows, names)
    assert not [p for p in local(path).rglob("*") if p.is_dir()]
    assert len(list(local(path).rglob("*.csv"))) < rows.select("session").distinct().count()


def test_sessions_of_one_file_are_read_as_those_of_folders(spark, tmp_path):
    rows, names = format_queries._capture(format_queries._numbered(spark, SF).where("session < 4"), F.lit(1_700_000_000_000_000_000) + F.col("k") * 2_500_050 + (F.col("seq") % 7) * 100_000)
    rows.select("session", *names).repartition("session").write.partitionBy("session").option("header", True).csv(str(tmp_path / "folders"))
    a, b = (files.read_imu_csv(spark, p).orderBy("session", "seq").toPandas() for p in (str(tmp_path / "folders"), format_queries._written(rows, names)))
    assert len(a) == rows.count() and a.session.nunique() == rows.select("session").distinct().count() and a.columns.tolist() == b.columns.tolist()
    assert a.drop(columns="t").equals(b.drop(columns="t")) and a["t"].to_numpy() == pytest.approx(b["t"].to_numpy(), abs=1e-6)


def test_rows_on_their_clock_line_have_its_figures(spark):
    df = spark.createDataFrame([(s, float(k), None if s == 3 or (s == 2 and k == 0) else k * 1.5 + (k * 7 % 5) / 10 + s) for s in (1, 2, 3) for k in range(12)], "session long, device double, host double")
    want = {r.session: (r.slope, r.intercept, r.lift) for r in quality.clock_line(df.where("host is not null"), "device", "host").collect()}
    got = quality.on_clock_line(df, "device", "host").collect()
    assert len(got) == 36 and set(want) == {1, 2}
    for r in got:
        assert (r.slope, r.intercept, r.lift) == ((None,) * 3 if r.session == 3 else pytest.approx(want[r.session]))


def test_rewritten_sessions_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(1000).selectExpr("if(id < 10, null, id % 100) as session", "id as seq", "'a' as marker")
    again = spark.range(30).selectExpr("if(id < 5, null, id % 10) as session", "id as seq", "'b' as marker")
    sinks.write_sessions(first, path, folders=4)
    sinks.write_sessions(again, path, folders=4)
    sinks.write_sessions(spark.createDataFrame([(500, 1, "c")], "session long, seq long, marker string"), path, folders=4)
    got = spark.read.parquet(path)
    assert len(list(local(path).glob("part=*"))) == 4
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    kept = first.where("session >= 10").unionByName(again).collect() + [(500, 1, "c")]
    assert sorted((tuple(r) for r in got.select("session", "seq", "marker").collect()), key=key) == sorted(map(tuple, kept), key=key)


def test_written_tables_have_no_folder_for_each_session(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "t")
    monkeypatch.setattr(format_queries, "shared_path", lambda _: path)
    assert QUERIES["written_tables"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {p.name.split("=")[0] for p in Path(path).glob("*=*")} == {"part"} and len(list(Path(path).glob("*=*"))) <= 64


def test_sums_of_batches_are_those_of_the_expression(spark):
    data = [b"123456789", b"", None, b"\x00" * 38, bytes(range(38)), b"1"] * 3
    df = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in data], "data binary")
    got = df.select(bytestreams.crc16_batches(F.col("data")).alias("a"), F.when(F.col("data").isNotNull(), crc16(F.col("data"))).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a == 0x29B1 and got[2].a is None


def test_a_stream_of_checked_frames_is_not_cut_to_chunks(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("chunks of few rows grow with the table")

    monkeypatch.setattr(scans, "running", refused)
    assert QUERIES["stream_checked_frames"](spark, SF).count() > 0


def test_directions_by_steps_are_those_of_one_expression(spark):
    places = [(0.0, 0.0, 0.0), (0.0, 0.0, 2.0), (0.0, 0.0, -2.0), (1e-9, 0.0, 0.0), (1.0, -2.0, 3.0), (-4.0, 0.5, -1.0), (1e-9, 0.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(places, "x double, y double, z double")
    names = ("qw", "qx", "qy", "qz")
    got = cameras.with_direction(df).columns
    assert got == ["x", "y", "z", "distance", *names]
    want = cameras.direction_quaternion(tuple(F.col(a) for a in "xyz"))
    both = cameras.with_direction(df).select(*names, *[c.alias(f"want_{n}") for n, c in zip(names, want, strict=True)]).collect()
    for r in both:
        assert all((r[n] is None and r[f"want_{n}"] is None) or r[n] == pytest.approx(r[f"want_{n}"], abs=1e-12) for n in names)


def test_a_frame_costs_the_points_that_it_has(monkeypatch):
    r, sizes, real = np.random.default_rng(3), [], geometry._best_of_sets
    monkeypatch.setattr(geometry, "_best_of_sets", lambda off: sizes.append(off.shape[1:]) or real(off))
    small = np.where(r.random((200, 3, 3)) < 0.6, r.integers(0, 5, (200, 3, 3)), -1)
    small[:, [0, 1, 2], [0, 1, 2]] = 1
    off = np.full((200, 7, 7), -1)
    off[np.ix_(range(200), [0, 2, 5], [1, 3, 6])] = small
    got = geometry.best_pairing(off)
    assert set(sizes) == {(3, 3)}
    want = np.zeros((200, 7), dtype=int)
    want[:, [0, 2, 5]] = np.array([0, 2, 4, 7])[geometry.best_pairing(small)]
    assert got.tolist() == want.tolist() and (got > 0).any()
    assert geometry.best_pairing(np.full((2, 3, 3), -1)).tolist() == [[0] * 3] * 2


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_kinds_of_streams_are_those_of_whole_bytes(spark, rows):
    frame, r = b"\xa5\x5a" + b"\0" * 40, np.random.default_rng(6)
    whole = {0: frame * 3, 1: frame * 2 + frame[:41], 2: b"\1" * 599, 3: b"\1" * 600, 4: b"\1" * 777 + frame * 3 + b"\2", 5: b"", 6: frame * 2 + b"\0" + frame * 2 + b"\0" * 600, None: frame[:-1] * 20}
    whole |= {7: frame[:20], 8: frame[20:] + frame * 2}  # frames do not go on from one session to the next
    pieces = []
    for s, x in whole.items():
        cuts = np.sort(r.integers(0, len(x) + 1, 12))
        pieces += [(s, k, bytearray(x[a:b]) if k != 3 or a < b else None) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(x)], strict=True))]
    chunks = spark.createDataFrame(pieces, "session long, seq long, data binary").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {x.session: x.kind for x in bytestreams.stream_kinds(chunks).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {0: "v2", 1: None, 2: None, 3: "v1", 4: "v2", 5: None, 6: "v1", None: "v1", 7: None, 8: None}


def test_marker_tables_deal_rows_once(spark):
    text = QUERIES["marker_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
