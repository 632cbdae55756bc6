"""Balanced range shards from sampled splitters (operator 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempofuse.llm.common import stored

SHARDS = 8
#: Bytes of a key range, about, before overfull ones are subdivided. The driver holds a total and SAMPLES keys of each
#: range: for 100 TB, 400,000 totals and 3 million keys of 16 bytes.
RANGE_BYTES = 256 << 20
#: Ranges for each shard at least, so that a small table has balanced tasks too.
LEAST_RANGES = 8
SAMPLES = 8
#: A range of over this multiple of its share is subdivided.
OVERFULL = 2.0
_LEAST = -(1 << 63)


def _places(splitters: np.recarray, h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Number of splitters, which are sorted, at or below each key (h, i)."""
    low, high = np.searchsorted(splitters.h, h, "left"), np.searchsorted(splitters.h, h, "right")
    out = high.astype(np.int32)
    one = high - low == 1
    out[one] = low[one] + (splitters.i[low[one]] <= i[one])
    many = np.flatnonzero(high - low > 1)  # splitters that share this hash: a text with many copies
    for a in np.unique(low[many]):
        mine = many[low[many] == a]
        out[mine] = a + np.searchsorted(splitters.i[a : high[mine[0]]], i[mine], "right")
    return out


def _range_of(splitters: np.recarray):
    """Column function (hash, id) -> the range between splitters."""

    @F.pandas_udf("int")
    def find(h: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(_places(splitters, h.to_numpy(), i.to_numpy()))

    return find


def _sample(slim: DataFrame, where, per_range: float, share: float, salt: int) -> np.recarray:
    """(keys, 3): hash, id and weight of rows drawn in proportion to size, in key order, about per_range of each range."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "__tf_h", "__tf_i"), 11) / float(1 << 53)
    # a row that was sure to be drawn stands for all its bytes, and any other for one step
    weight = F.greatest(F.lit(1.0), F.col("size") * F.lit(per_range / share))
    got = slim.where(where & (u < F.col("size") * F.lit(per_range / share))).select("__tf_h", "__tf_i", weight.alias("w")).toArrow()
    h, i, w = (got.column(k).to_numpy() for k in range(3))
    order = np.lexsort((i, h))
    return np.rec.fromarrays([h[order], i[order], w[order]], names="h,i,w")


def _quantiles(drawn: np.recarray, n: int) -> np.recarray:
    """n - 1 keys that part the drawn ones into stretches of equal weight."""
    if not len(drawn) or n < 2:
        return drawn[:0]
    run = np.cumsum(drawn.w)
    return drawn[np.unique(np.minimum(np.searchsorted(run, run[-1] * np.arange(1, n) / n), len(drawn) - 1))]


def _join(parts: list[np.recarray]) -> np.recarray:
    """All splitters, sorted, each key once."""
    h, i = np.concatenate([x.h for x in parts]), np.concatenate([x.i for x in parts])
    order = np.lexsort((i, h))
    h, i = h[order], i[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (np.diff(h) != 0) | (np.diff(i) != 0)
    return np.rec.fromarrays([h[new], i[new], np.ones(int(new.sum()))], names="h,i,w")


def _splitters(slim: DataFrame, total: int, rows: int, n_shards: int, range_bytes: int):
    """Splitters, and bytes and rows of each range between them (DataFrame columns r, b, n, on the driver as arrays)."""
    ranges = max(1, min(max(LEAST_RANGES * n_shards, total // range_bytes), rows))
    share = max(1.0, total / ranges)
    splitters, salt = _quantiles(_sample(slim, F.lit(True), SAMPLES, share, 1), ranges), 1
    while True:
        find = _range_of(splitters)
        got = slim.groupBy(find("__tf_h", "__tf_i").alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("r").toArrow()
        r, b, n = (got.column(k).to_numpy() for k in range(3))
        full = np.flatnonzero((b > OVERFULL * share) & (n > 1))
        if not len(full):
            return find, r, b, n
        salt += 1
        keys = slim.sparkSession.createDataFrame(pd.DataFrame({"r": r[full]}), "r int")
        marked = slim.withColumn("r", find("__tf_h", "__tf_i")).join(F.broadcast(keys), "r", "left_semi")
        drawn = _sample(marked, F.lit(True), 4 * SAMPLES, share, salt)
        place = np.searchsorted(r, _places(splitters, drawn.h, drawn.i))
        grown = _join([splitters, *(_quantiles(drawn[place == k], int(np.ceil(b[k] / share))) for k in full)])
        if len(grown) == len(splitters):  # what is left over is rows of one key
            return find, r, b, n
        splitters = grown


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard added, under the law "bytes".

    The key of a row is (hash of its text, id), so equal texts lie side by side, and a group of copies is cut only
    where a shard is full. Splitters are quantiles of a sample of keys drawn in proportion to size; rows are dealt to
    the ranges between them, and ranges that came out overfull get splitters of their own until none is, or what is
    overfull is rows of one key. Within a range, running sums place each row exactly: a row goes to the shard in which
    its first byte falls when all rows are laid in key order over n_shards equal stretches. So a shard's bytes differ
    from its share by the size of the largest row at most, and those of two shards by twice that. slot counts a shard's
    rows from 0. Null ids come first; null text has size 1, as the empty text; repeated rows take slots of their own.
    Columns named like the added ones are replaced. grown_shard is null under this law. Without with_text the text is
    left out of the result, and only keys and sizes are shuffled.
    """
    docs = docs.drop("size", "law", "shard", "slot", "grown_shard", "text_crc32")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    keyed = docs.withColumns({"size": size, "text_crc32": F.crc32(text.cast("binary")), "__tf_h": F.xxhash64(text), "__tf_i": F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))})
    names = docs.columns if with_text else [c for c in docs.columns if c != text_col]
    if not with_text:
        keyed = stored(keyed.drop(text_col))
    slim = keyed.select("__tf_h", "__tf_i", "size")
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    find, r, b, n = _splitters(slim, total, rows, n_shards, range_bytes)
    before = docs.sparkSession.createDataFrame(pd.DataFrame({"__tf_r": r, "__tf_b": np.cumsum(b) - b, "__tf_n": np.cumsum(n) - n}), "__tf_r int, __tf_b long, __tf_n long")
    order = Window.partitionBy("__tf_r").orderBy("__tf_h", "__tf_i")
    placed = (
        keyed.withColumn("__tf_r", find("__tf_h", "__tf_i"))
        .withColumn("__tf_at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("__tf_row", F.row_number().over(order) - 1)
        .join(F.broadcast(before), "__tf_r")  # a row of 20 bytes for each range
        .withColumn("__tf_at", F.col("__tf_at") + F.col("__tf_b"))
        .withColumn("__tf_row", F.col("__tf_row") + F.col("__tf_n"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(F.col("__tf_at").cast("decimal(38,0)") * n_shards / F.lit(max(total, 1)))).cast("int"))
        .select(*names, "size", "text_crc32", "shard", "__tf_row")
    )
    placed = stored(placed)
    first = {x[0]: x[1] for x in placed.groupBy("shard").agg(F.min("__tf_row")).collect()}  # one row for each shard
    base = F.element_at(F.create_map(*[x for k in range(n_shards) for x in (F.lit(k), F.lit(first.get(k, 0)).cast("long"))]), F.col("shard"))
    return placed.select(
        *names,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__tf_row") - base).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs, with_text=False).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
