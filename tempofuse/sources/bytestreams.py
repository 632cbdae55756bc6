"""Frames in streams of bytes, however long a session's stream is.

A reader that finds no frame where it is moves on by a byte, so that what it does next depends on its place alone. A
stream is dealt to blocks, each with so many bytes of the next as a frame needs. For each of the places where the reader
may enter a block (within a frame's length of its start) the block says where it leaves, how many frames it found and
how many bytes it passed over. A pass over these summaries, in order, tells where each block is entered; then all
blocks give their frames side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempofuse.operators import scans
from tempofuse.operators.groups import in_batches
from tempofuse.session import stored

#: Bytes of a block.
BLOCK_BYTES = 1 << 20


def _crc_table() -> np.ndarray:
    """The check sum's step for each byte: polynomial 0x1021."""
    c = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        c = np.where(c & 0x8000, (c << 1) ^ 0x1021, c << 1) & 0xFFFF
    return c


CRC_TABLE = _crc_table()


def crc16_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (start 0xFFFF) of each row of a matrix of bytes: one table step for each column."""
    crc = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for column in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ column]
    return crc


def crc16_batches(data: Column) -> Column:
    """functions.codec.crc16() of many rows: Arrow batches, in which rows of one length take each step together."""

    @F.pandas_udf("int")
    def sums(values: pd.Series) -> pd.Series:
        sizes, out = values.map(len, na_action="ignore"), pd.Series(None, index=values.index, dtype="Int32")
        for n, same in values.groupby(sizes):
            out[same.index] = crc16_rows(np.frombuffer(b"".join(same), dtype=np.uint8).reshape(len(same), int(n))).astype(np.int32)
        return out

    return sums(data)


@dataclass(frozen=True)
class SyncFrames:
    """Frames of fixed size that end with a sync word. The next frame must end with it too, if all of it is there."""

    size: int = 30
    sync: bytes = b"\x0f\xff"

    @property
    def look(self) -> int:
        return 2 * self.size

    def starts(self, data: np.ndarray, rest: int, most: int | None = None) -> np.ndarray:
        """Where frames can begin before `most`; rest is the number of bytes from the first of data to the stream's end."""
        word = np.frombuffer(self.sync, dtype=np.uint8)
        ends = np.ones(max(len(data) - len(word) + 1, 0), dtype=bool)
        for k, byte in enumerate(word):
            ends &= data[k : len(data) - len(word) + 1 + k] == byte
        at = np.flatnonzero(ends) + len(word) - self.size
        at = at[(at >= 0) & (at < (rest if most is None else most))]
        following = at + 2 * self.size - len(word)
        alone = at + 2 * self.size > rest
        return at[alone | ends[np.minimum(following, len(ends) - 1)]] if len(at) else at


@dataclass(frozen=True)
class CheckedFrames:
    """Frames of fixed size with a header, and a big-endian CRC-16 of what is between the two at their end."""

    size: int = 42
    header: bytes = b"\xa5\x5a"

    @property
    def look(self) -> int:
        return self.size

    def starts(self, data: np.ndarray, rest: int, most: int | None = None) -> np.ndarray:
        n, head = len(data) - self.size + 1, len(self.header)
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        here = np.ones(min(n, n if most is None else most), dtype=bool)
        for k, byte in enumerate(self.header):
            here &= data[k : k + len(here)] == byte
        at = np.flatnonzero(here)
        if not len(at):
            return at
        frames = np.lib.stride_tricks.sliding_window_view(data, self.size)[at]
        return at[crc16_rows(frames[:, head:-2]) == (frames[:, -2].astype(np.uint32) << 8 | frames[:, -1])]


Framing = SyncFrames | CheckedFrames


def walk(starts: np.ndarray, size: int, enter: int = 0) -> list[int]:
    """The frames that a reader takes that enters at a place: each begins at or after the end of the one before."""
    follow = np.append(np.searchsorted(starts, starts + size), len(starts)).tolist()
    k, out, places = int(np.searchsorted(starts, enter)), [], starts.tolist()
    while k < len(places):
        out.append(places[k])
        k = follow[k]
    return out


def summary(starts: np.ndarray, size: int, n: int) -> tuple[np.ndarray, ...]:
    """For each place of entry of a block of n bytes: frames found, place of the exit in what follows the block, and
    bytes passed over since the last frame (all from the entry if there is none)."""
    m, enter = len(starts), np.arange(size)
    jump = np.append(np.searchsorted(starts, starts + size), m)
    count, last = np.append(np.ones(m, dtype=np.int64), 0), np.append(np.arange(m), m)
    while (jump[:m] < m).any():  # twice as many frames on in each round
        count = count + count[jump]
        last = np.where(jump < m, last[jump], last)
        jump = jump[jump]
    first = np.searchsorted(starts, enter)
    end = np.where(first < m, np.append(starts, 0)[last[first]] + size, enter)
    return count[first], np.maximum(end - n, 0), np.maximum(n - end, 0)


def _blocks(chunks: DataFrame, by: str, order: str, data: str, framing: Framing, block: int, rows: int) -> DataFrame:
    """by, block, rest (bytes from its start to the stream's end) and parts, whose bytes in order are the block's and so
    many of the next as a frame may need."""
    sized = chunks.select(by, order, F.col(data).alias("__d")).withColumn("__n", F.octet_length("__d").cast("long")).where("__n > 0")
    placed = scans.running(sized, "__n", "__end", by=by, order=(order,), rows=rows).withColumn("__at", F.col("__end") - F.col("__n"))
    first, last = F.greatest(F.floor((F.col("__at") - framing.look) / block), F.lit(0)).cast("long"), F.floor((F.col("__end") - 1) / block).cast("long")
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin, stop = F.greatest("__at", F.col("block") * block), F.least("__end", (F.col("block") + 1) * block + framing.look)
    part = F.struct(begin.alias("at"), F.substring("__d", (begin - F.col("__at") + 1).cast("int"), (stop - begin).cast("int")).alias("data"))
    total = placed.groupBy(by).agg(F.max("__end").alias("__total"))
    blocks = cut.select(by, "block", part.alias("part")).groupBy(by, "block").agg(F.array_sort(F.collect_list("part")).alias("parts")).join(total, by)
    return stored(blocks.select(by, "block", (F.col("__total") - F.col("block") * block).alias("rest"), F.transform("parts", lambda x: x["data"]).alias("parts")))


def find_frames(chunks: DataFrame, framing: Framing, by: str = "session", order: str = "seq", data: str = "data", block: int = BLOCK_BYTES, rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """session, number, frame, skipped: the frames of each session's bytes, as one reader would take them from its start
    on, numbered from 0, each with the number of bytes passed over just before it.

    Chunks may be of any sizes, empty and null ones among them; sessions must not be null.
    """
    kind = dict(chunks.dtypes)[by]
    blocks = _blocks(chunks, by, order, data, framing, block, rows)

    def read(batch) -> Iterator[tuple]:
        for row in batch.to_pylist():
            bytes_ = np.frombuffer(b"".join(row["parts"]), dtype=np.uint8)
            yield row, bytes_, min(block, row["rest"])

    def summaries(batches):
        for batch in batches:
            told = [summary(framing.starts(bytes_, row["rest"], n), framing.size, n) for row, bytes_, n in read(batch)]
            found = [pa.array([x[k].tolist() for x in told], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("block"), *found], names=[by, "block", "frames", "leave", "passed"])

    def entries(g: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        begins = set(bounds.tolist())
        enter = number = skipped = 0
        out = []
        for k, (frames, leave, passed) in enumerate(zip(g["frames"], g["leave"], g["passed"], strict=True)):
            if k in begins:
                enter = number = skipped = 0
            out.append((enter, number, skipped))
            skipped = passed[enter] if frames[enter] else skipped + passed[enter]
            number, enter = number + frames[enter], leave[enter]
        return g[[by, "block"]].assign(**dict(zip(("enter", "number", "before"), np.array(out, dtype=np.int64).T, strict=True)))

    def frames(batches):
        for batch in batches:
            sessions, numbers, cut, passed = [], [], [], []
            for row, bytes_, n in read(batch):
                at = walk(framing.starts(bytes_, row["rest"], n), framing.size, row["enter"])
                if not at:
                    continue
                skipped = np.diff(at, prepend=row["enter"]) - np.append(0, np.full(len(at) - 1, framing.size))
                skipped[0] += row["before"]
                sessions += [row[by]] * len(at)
                numbers.append(row["number"] + np.arange(len(at)))
                cut += [bytes_[a : a + framing.size].tobytes() for a in at]
                passed.append(skipped)
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(sessions, batch.schema.field(by).type), pa.array(np.concatenate(numbers)), pa.array(cut, pa.binary()), pa.array(np.concatenate(passed))], names=[by, "number", "frame", "skipped"])

    told = blocks.mapInArrow(summaries, f"`{by}` {kind}, block long, frames array<long>, leave array<long>, passed array<long>")
    begin = in_batches(told, (by,), ("block",), entries, f"`{by}` {kind}, block long, enter long, number long, before long", rows=10_000)
    return blocks.join(begin, [by, "block"]).mapInArrow(frames, f"`{by}` {kind}, number long, frame binary, skipped long")


def stream_kinds(chunks: DataFrame, by: str = "session", order: str = "seq", data: str = "data", size: int = 42, header: bytes = b"\xa5\x5a", least: int = 3, patience: int = 600) -> DataFrame:
    """by and kind, which is functions.codec.frame_kind() of each session's bytes: "v2" where `least` whole frames of
    `size` bytes that begin with the header follow each other, else "v1" of at least `patience` bytes, else null.

    Rows go by in order; of a session that is not whole yet a task keeps its last bytes (under `least` frames), their
    number so far and what was found, so that memory does not grow with a stream.
    """
    kind, look = dict(chunks.dtypes)[by], least * size
    marked = chunks.select(by, F.col(data).alias("__data"), F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("__row"))

    def run(batches):
        name, tail, n, found, told = None, b"", 0, False, None  # of the session that is not whole yet

        def rows(names, sizes, hits):
            kinds = np.where(hits, "v2", np.where(np.asarray(sizes) >= patience, "v1", None)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(names, told), pa.array(kinds, pa.string())], names=[by, "kind"])

        for batch in batches:
            if not len(batch):
                continue
            values, names = [x or b"" for x in batch.column("__data").to_pylist()], batch.column(by)
            begins = np.flatnonzero(batch.column("__row").to_numpy() == 1)
            if told is not None and (not len(begins) or begins[0]):  # the first rows go on with it
                begins = np.append(0, begins)
            elif told is not None:
                yield rows([name], [n], [found])
                tail, n, found = b"", 0, False
            told = names.type
            ends = np.cumsum([len(x) for x in values])
            bounds = np.append(np.append(0, ends)[begins], ends[-1]) + len(tail)
            fresh = np.diff(bounds)
            bounds[0] = 0
            a = np.frombuffer(tail + b"".join(values), dtype=np.uint8)
            places = np.arange(max(len(a) - look + 1, 0))
            here = np.ones(len(places), dtype=bool)
            for k in range(least):
                for j, byte in enumerate(header):
                    here &= a[places + (k * size + j)] == byte
            at = np.flatnonzero(here)
            of = np.searchsorted(bounds, at, side="right") - 1
            hits = np.zeros(len(fresh), dtype=bool)
            hits[of[at + look <= bounds[of + 1]]] = True
            fresh[0] += n
            hits[0] |= found
            yield rows(names.take(pa.array(begins[:-1])), fresh[:-1], hits[:-1])
            name, n, found = names[int(begins[-1])].as_py(), int(fresh[-1]), bool(hits[-1])
            tail = a[max(int(bounds[-2]), len(a) - look + 1) :].tobytes()
        if told is not None:
            yield rows([name], [n], [found])

    return marked.mapInArrow(run, f"`{by}` {kind}, kind string")


def newer_frames(frames: DataFrame, clock, by: str = "session", order: str = "number", bits: int = 32, rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """The frames whose device clock (a column that starts over) is ahead of all before it: repeated frames and those
    that come late are dropped. A step of up to half the clock's range either way is taken as it is."""
    half, whole = 1 << (bits - 1), 1 << bits
    ticks = frames.withColumn("__tick", clock)
    chunks = scans.chunked(ticks, by, (order,), rows)
    last = scans.previous(chunks, "__tick", by, (order,)).drop("__chunk")
    steps = last.withColumn("__step", F.coalesce(F.pmod(F.col("__tick") - F.col("__previous") + half, F.lit(whole)) - half, F.lit(0)))
    placed = scans.running(steps, "__step", "__place", by=by, order=(order,), rows=rows)
    best = scans.running(placed, "__place", "__best", F.max, by, (order,), rows)
    ahead = scans.previous(scans.chunked(best, by, (order,), rows), "__best", by, (order,))
    return ahead.where(F.col("__previous").isNull() | (F.col("__place") > F.col("__previous"))).select(*frames.columns)
