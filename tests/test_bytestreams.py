"""Frames in byte streams, by blocks and over micro-batches, against one reader that goes byte by byte."""

import numpy as np
import pytest

from tempofuse.sources import bytestreams as B
from tempofuse.streaming import flows, live


def crc(data):
    """Bit by bit."""
    out = 0xFFFF
    for byte in data:
        out ^= byte << 8
        for _ in range(8):
            out = ((out << 1) ^ 0x1021 if out & 0x8000 else out << 1) & 0xFFFF
    return out


def reader(data, framing):
    """Frames and bytes passed over, byte by byte."""
    out, at, skipped, n = [], 0, 0, framing.size
    while at + n <= len(data):
        frame = data[at : at + n]
        if isinstance(framing, B.SyncFrames):
            following = data[at + 2 * n - 2 : at + 2 * n] if at + 2 * n <= len(data) else framing.sync
            good = frame.endswith(framing.sync) and following == framing.sync
        else:
            good = frame.startswith(framing.header) and crc(frame[2:-2]) == int.from_bytes(frame[-2:], "big")
        if good:
            out.append((frame, skipped))
        at, skipped = (at + n, 0) if good else (at + 1, skipped + 1)
    return out


def noisy(r, framing, frames):
    parts = []
    for k in range(frames):
        if isinstance(framing, B.SyncFrames):
            frame = r.integers(0, 256, framing.size - 2, dtype=np.uint8).tobytes() + framing.sync
        else:
            body = k.to_bytes(4, "big") + r.integers(0, 256, framing.size - 8, dtype=np.uint8).tobytes()
            frame = framing.header + body + crc(body).to_bytes(2, "big")
        if r.random() < 0.1:
            frame = frame[: r.integers(1, framing.size)]  # bytes were lost
        if r.random() < 0.1:
            frame += b"".join(r.choice([b"\x0f\xff", b"\xa5\x5a", b"\x00", b"\xa5"]) for _ in range(r.integers(1, 60)))
        parts.append(frame)
    return b"".join(parts)


def chunks_of(r, data):
    cuts = np.sort(r.integers(0, len(data) + 1, 40))
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]


@pytest.mark.parametrize("framing", [B.SyncFrames(), B.CheckedFrames(), B.SyncFrames(6)])
@pytest.mark.parametrize("block", [64, 500, 1 << 20])
def test_blocks_find_what_one_reader_finds(spark, framing, block):
    r = np.random.default_rng(block + framing.size)
    streams = {s: noisy(r, framing, n) for s, n in (("a", 300), ("b", 40), ("c", 1))} | {"d": b"", "e": b"\x0f\xff" * 100, "f": b"\xa5"}
    rows = [(s, k, c) for s, data in streams.items() for k, c in enumerate(chunks_of(r, data))] + [("a", -1, None), ("g", 0, None)]
    df = spark.createDataFrame(rows, "session string, seq long, data binary").repartition(5)
    got = {}
    for x in B.find_frames(df, framing, block=block, rows=50).orderBy("session", "number").collect():
        got.setdefault(x.session, []).append((bytes(x.frame), x.skipped))
        assert x.number == len(got[x.session]) - 1
    assert got == {s: want for s, data in streams.items() if (want := reader(data, framing))}
    assert len(got["a"]) > 150


def test_one_session_in_64_blocks(spark):
    r = np.random.default_rng(2)
    data = noisy(r, B.SyncFrames(), 2200)
    df = spark.createDataFrame([(1, k, data[k : k + 1000]) for k in range(0, len(data), 1000)], "session long, seq long, data binary")
    got = B.find_frames(df, B.SyncFrames(), block=len(data) // 64, rows=10).orderBy("number").collect()
    assert [(bytes(x.frame), x.skipped) for x in got] == reader(data, B.SyncFrames())


def test_check_sums_by_table():
    rows = np.random.default_rng(0).integers(0, 256, (50, 38), dtype=np.uint8)
    assert B.crc16_rows(rows).tolist() == [crc(r.tobytes()) for r in rows] and B.crc16_rows(rows[:0]).tolist() == []


def sent_frame(tick):
    body = tick.to_bytes(4, "big") + bytes(34)
    return b"\xa5\x5a" + body + crc(body).to_bytes(2, "big")


TICKS = [2**32 - 5, 2**32 - 5, 2**32 - 1, 3, 2**32 - 2, 3, 4, 2, 10, 9, 11]
KEPT = [2**32 - 5, 2**32 - 1, 3, 4, 10, 11]


def test_repeated_and_late_frames_are_dropped(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(TICKS)] + [(2, 0, 7)], "session long, number long, tick long")
    for rows in (3, 1000):
        got = B.newer_frames(df, df["tick"], rows=rows).orderBy("session", "number").collect()
        assert [x.tick for x in got] == [*KEPT, 7]


@pytest.mark.parametrize("batches", [1, 6])
def test_checked_frames_as_they_come(spark, tmp_path, batches):
    data = b"?\xa5" + b"".join(sent_frame(t) for t in TICKS[:6]) + sent_frame(1)[:-1] + b"!" + b"".join(sent_frame(t) for t in TICKS[6:]) + b"\xa5\x5a"
    rows = [(1, k, data[23 * k : 23 * k + 23]) for k in range(-(-len(data) // 23))]
    for k in range(batches):
        spark.createDataFrame(rows[len(rows) * k // batches : len(rows) * (k + 1) // batches], "session long, seq long, data binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema("session long, seq long, data binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = flows.drained(live.parsed_checked_frames(stream)).orderBy("number").collect()
    assert [int.from_bytes(bytes(x.payload)[:4], "big") for x in got] == KEPT and [x.skipped for x in got] == [2, 0, 0, 42, 0, 0]
