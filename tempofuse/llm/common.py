"""Byte-level helpers that the Arrow operators of this subpackage share.

Texts are handled as one UTF-8 buffer per chunk of rows, so that word splitting, hashing and counting are
numpy operations over the buffer and not Python loops over words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, for arrays of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return splitmix(np.arange(n, dtype=np.uint64) + np.uint64((salt * 0x632BE59BD9B4E019) & _MASK))


BYTE_CODE = seeds(256, 11) | np.uint64(1)
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word separators: space and the five control characters from tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, at least; kept for the next call."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up = np.full(size, BASE, dtype=np.uint64)
        down = np.full(size, BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 8 * CHUNK_BYTES:
            _powers[0] = have
    return have


def prefix_hash(buf: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Running polynomial sums; span_hash() reads the hash of any span from them."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(code[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], which depend on the bytes only and not on the place."""
    return splitmix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


class Texts:
    """Rows of texts as one buffer. off has len+1 entries; null is the empty text, and is_null tells."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.is_null = np.asarray(column.is_null())
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        first, last = int(off[0]), int(off[-1])
        self.buf = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
        self.off = off - first
        self.n = len(column)

    def bytes(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and row of each maximal run of bytes other than separators; no run crosses rows."""
        return word_spans(self.buf, self.off, IS_SPACE)


def word_spans(buf: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of each maximal run of bytes other than separators, in rows that begin at off."""
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = ~separators[buf]
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = inside[:-1]
    cut = off[:-1][off[:-1] < len(buf)]
    starts = inside & ~before
    starts[cut] |= inside[cut]
    ends = before & ~inside
    cut = off[1:][off[1:] > 0]
    ends[cut] |= before[cut]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(off, start, side="right") - 1


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes of text each; a longer text is alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(text))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; an own one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext.getCheckpointDir()
        base = at.rsplit("/", 1)[0] if at else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tempofuse-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, options: dict | None = None) -> DataFrame:
    """df, written to the shared folder and read again: it cuts the lineage, and a lost executor costs nothing.

    An empty result has a schema too, as it is given to the reader. Options are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tempofuse-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that hold more than one in so many rows are hot; there are at most as many.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with keys on the columns `on`, where keys (distinct, stored) has the number of rows of each as c.

    The rows of hot keys stay where they are: these keys are few whatever the input, as each has a given share of all
    rows, and are broadcast. All other rows meet their keys by a shuffle.
    """
    hot = keys.where(F.col("c") > max(rows.count() // HOT_KEYS, 1))
    if hot.isEmpty():
        return rows.join(keys, on)
    hot = stored(hot)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def release() -> None:
    """Give memory back at the end of a task. Idle workers keep what they hold, and tasks take turns among them, so that
    what each keeps counts as often as there are workers."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
