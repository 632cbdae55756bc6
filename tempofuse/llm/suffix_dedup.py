"""Removal of long byte strings that occur twice, by suffix arrays of shards (operator 10).

A string of LENGTH bytes holds at least one anchor: the gram of GRAM bytes of least hash in it. Equal strings have
equal anchors at equal places, so all copies of a string meet in the shard of their anchor, and shards need no merging
with each other. The steps:

1. Anchors of every text, with the run of string starts that each governs; only anchors whose gram occurs twice go on.
2. Equal runs (the bytes of all their strings are equal) are told by hash. Where all runs of a gram are equal, every
   start is a repeat, and so are those of any run that occurs twice; no bytes are moved for them.
3. Of other grams, one run of each kind goes to a shard. A gram with too many kinds is split: the starts are halved by
   their distance to the anchor, and each half is dealt again by the longer core of bytes that its strings share.
4. Each shard has a suffix array of its runs, by Larsson-Sadakane refinement in numpy, and common prefixes of
   neighbours in it: found by binary search where they cannot be told from the suffix before, else one less than there
   (Kasai's invariant). Starts with a common prefix of LENGTH repeat.
5. Repeated starts come back to their documents as ranges, and the bytes that they cover go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempofuse.llm.common import Texts, chunks, join_counted, prefix_hash, span_hash, splitmix, stored

LENGTH = 400
GRAM = 64
#: Kinds of runs of one core that one task sorts; a core with more is split.
CORE_KINDS = 1500
#: Bytes of runs in a shard, about.
SHARD_BYTES = 1 << 20
#: Words of 64 bits in the filter that tells which runs' bytes are wanted; it is of fixed size, 8 MB.
FILTER_WORDS = 1 << 20
#: Bytes that one pass over a long text takes; passes overlap.
PASS_BYTES = 4 << 20
_PLACE_BITS = 24


def governed(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """row, lo (start in buf), count, anchor (place in buf), gram hash and hash of all bytes, of each run of starts."""
    out = []
    for at in range(0, max(len(buf) - length + 1, 0), PASS_BYTES):
        part = buf[at : at + PASS_BYTES + length - 1]
        prefix = prefix_hash(part)
        here = np.arange(len(part) - gram + 1)
        g = span_hash(prefix, here, here + gram)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        key = (g & ~low) | here.astype(np.uint64)
        w = length - gram + 1
        pad = -len(key) % w
        blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
        row = np.searchsorted(off, at + np.arange(n), side="right") - 1
        start = np.flatnonzero(at + np.arange(n) + length <= off[row + 1])
        if not len(start):
            continue
        new = np.ones(len(start), dtype=bool)
        new[1:] = (np.diff(start) > 1) | (np.diff(anchor[start]) != 0) | (np.diff(row[start]) != 0)
        head = np.flatnonzero(new)
        lo = start[head]
        count = np.diff(np.append(head, len(start)))
        out.append((row[lo], at + lo, count, at + anchor[lo], g[anchor[lo]], span_hash(prefix, lo, lo + count - 1 + length)))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _place_hash(ids: np.ndarray, h: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return splitmix(splitmix(splitmix(ids.view(np.uint64)) ^ h.view(np.uint64)) + lo.astype(np.uint64))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _runs(keyed: DataFrame, length: int, gram: int, wanted: np.ndarray | None = None) -> DataFrame:
    """The runs of all texts; with a filter, the bytes of those it lets through, and none of the rest."""
    ddl = "id long, h long, lo long, n int, rel int, gram long, kind long" + (", bytes binary" if wanted is not None else "")

    def run(batches):
        for batch in chunks(batches, "text"):
            t = Texts(batch.column(2))
            row, lo, count, anchor, g, kind = governed(t.buf, t.off, length, gram)
            ids, h = (np.asarray(batch.column(k))[row] for k in (0, 1))
            data = [ids, h, lo - t.off[row], count.astype(np.int32), (anchor - lo).astype(np.int32), _signed(g), _signed(kind)]
            if wanted is not None:
                bit = _place_hash(ids, h, lo - t.off[row])
                word = (bit >> np.uint64(8)).astype(np.int64) % len(wanted)
                keep = np.flatnonzero((wanted[word] >> (bit & np.uint64(63))) & np.uint64(1))
                data = [x[keep] for x in data]
                bytes_ = [t.buf[a : a + c - 1 + length].tobytes() for a, c in zip(lo[keep].tolist(), count[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, data), pa.array(bytes_, pa.binary())], names=[x.split()[0] for x in ddl.split(", ")])
            else:
                yield pa.RecordBatch.from_arrays([*map(pa.array, data)], names=[x.split()[0] for x in ddl.split(", ")])

    return keyed.mapInArrow(run, ddl)


def _filter_of(places: DataFrame) -> np.ndarray:
    """A Bloom filter of one bit for each (id, h, lo): FILTER_WORDS words at most reach the driver."""

    @F.pandas_udf("long")
    def code(i: pd.Series, h: pd.Series, lo: pd.Series) -> pd.Series:
        return pd.Series(_place_hash(i.to_numpy(np.int64), h.to_numpy(np.int64), lo.to_numpy(np.int64)).view(np.int64))

    bits = places.select(code("id", "h", "lo").alias("b")).select(
        F.pmod(F.shiftrightunsigned("b", 8), F.lit(FILTER_WORDS)).cast("int").alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("bit")
    )
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, dtype=np.uint64)
    if got.num_rows:
        out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def refine(buf: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, 32, ... bytes up to depth: each step sorts, within groups that are
    still equal, by the rank of the suffix that many bytes on (Larsson-Sadakane). Suffixes are cut at the end of buf."""
    n = len(buf)
    wide = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n]
    order = np.argsort(key, kind="stable")
    head = np.ones(n, dtype=bool)
    head[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # the place of its group's first
    h, ranks = 8, {8: rank.copy()}
    while 2 * h <= depth:
        size = np.diff(np.append(np.flatnonzero(head), n))
        open_ = np.repeat(size > 1, size)  # places in the order whose groups are still equal
        at = np.flatnonzero(open_)
        if len(at):
            s = order[at]
            after = np.where(s + h < n, rank[np.minimum(s + h, n - 1)] + 1, 0)
            both = (rank[s].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
            again = np.argsort(both, kind="stable")
            order[at] = s[again]
            both = both[again]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = both[1:] != both[:-1]
            head[at] |= fresh
            place = np.where(fresh, at, 0)
            rank = rank.copy()
            rank[order[at]] = np.maximum.accumulate(place)
        h *= 2
        ranks[h] = rank
    return ranks


def repeated_starts(runs: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each run, whether each of its string starts has an equal string at any other start of the runs."""
    size = np.array([len(r) for r in runs])
    first = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(runs), dtype=np.uint8)
    h = 8
    while 2 * h <= length:
        h *= 2
    ranks = refine(buf, h)[h]
    starts = np.concatenate([np.arange(a, a + n - length + 1) for a, n in zip(first, size, strict=True)])
    # two overlapping prefixes of h bytes make up one of length bytes; no start reaches over the end of its run
    key = (ranks[starts].astype(np.uint64) << np.uint64(32)) | ranks[starts + length - h].astype(np.uint64)
    array = starts[np.argsort(key, kind="stable")]
    common = common_prefixes(buf, array, length)
    same = np.zeros(len(buf), dtype=bool)
    same[array[1:][common >= length]] = True
    same[array[:-1][common >= length]] = True
    return [same[a : a + n - length + 1] for a, n in zip(first, size, strict=True)]


def common_prefixes(buf: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Bytes, most at the most, that each suffix of the array shares with the one before it."""
    if len(array) < 2:
        return np.zeros(0, dtype=np.int64)
    before = np.full(len(buf) + 1, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    text = np.sort(array[1:])
    # a suffix whose neighbour follows the neighbour of the suffix before it in the text shares one byte less than that,
    # if that one shares a byte at all: after a byte that differs the common prefix is searched anew
    derived = np.zeros(len(text), dtype=bool)
    derived[1:] = (np.diff(text) == 1) & (before[text[1:]] == before[text[:-1]] + 1) & (buf[text[:-1]] == buf[before[text[:-1]]])
    heads = np.flatnonzero(~derived)
    p, q = text[heads], before[text[heads]]
    prefix = prefix_hash(buf)
    # enough for the suffixes that are derived from each head too
    reach = np.diff(np.append(heads, len(text))) - 1 + most
    reach = np.minimum(reach, len(buf) - np.maximum(p, q))
    low, high = np.zeros(len(p), np.int64), reach
    while (low < high).any():
        mid = (low + high + 1) // 2
        equal = span_hash(prefix, p, p + mid) == span_hash(prefix, q, q + mid)
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    at = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(text))))
    value = np.minimum(np.maximum(low[at] - (np.arange(len(text)) - heads[at]), 0), most)
    out = np.zeros(len(buf) + 1, dtype=np.int64)
    out[text] = value
    return out[array[1:]]


def _split(rows: DataFrame, length: int) -> DataFrame:
    """Rows (core, kind, id, h, lo, n, rel, bytes, alone, low, high) of strings that start low to high bytes before the
    anchor, each halved by that distance; a half's core is the bytes that all its strings share."""

    def run(batches):
        for batch in batches:
            got = batch.to_pydict()
            out = {k: [] for k in got}
            for i in range(batch.num_rows):
                middle = (got["low"][i] + got["high"][i]) // 2
                for low, high in ((got["low"][i], middle), (middle + 1, got["high"][i])):
                    first, last = max(got["rel"][i] - high, 0), min(got["rel"][i] - low, got["n"][i] - 1)
                    if first > last:
                        continue
                    data = got["bytes"][i]
                    core = data[got["rel"][i] - low : got["rel"][i] - high + length]
                    cut = data[first : last + length]
                    code = [int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=f"{low}-{high}".encode()).digest(), "little", signed=True) for x in (core, cut)]
                    row = (code[0], code[1], got["id"][i], got["h"][i], got["lo"][i] + first, last - first + 1, got["rel"][i] - first, cut, got["alone"][i], low, high)
                    for k, v in zip(_ROW, row, strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


_ROW = ("core", "kind", "id", "h", "lo", "n", "rel", "bytes", "alone", "low", "high")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, core_kinds: int = CORE_KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, first, last): ranges of starts in bytes, of strings that also start elsewhere; h is the text's hash."""
    keyed = _keyed(docs, id_col, text_col)
    runs = stored(_runs(keyed, length, gram))
    grams = stored(runs.groupBy("gram").agg(F.count("*").alias("c"), (F.min("kind") == F.max("kind")).alias("same")).where("c > 1"))
    met = stored(join_counted(runs, grams, ["gram"]).drop("c"))
    found = [met.where("same").select("id", "h", "lo", "n")]
    mixed = met.where(~F.col("same")).drop("same")
    kinds = stored(mixed.groupBy("gram", "kind").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "lo")).alias("at")))
    if not kinds.isEmpty():
        found.append(join_counted(mixed, kinds.where("c > 1").select("gram", "kind", "c"), ["gram", "kind"]).select("id", "h", "lo", "n"))
        places = kinds.select("at.id", "at.h", "at.lo", (F.col("c") == 1).alias("alone"))
        fetched = _runs(keyed, length, gram, _filter_of(places)).join(places, ["id", "h", "lo"]).dropDuplicates(["id", "h", "lo"])
        rows = stored(fetched.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - gram)).withColumnRenamed("gram", "core").select(*_ROW))
        leaves = []
        while True:
            # cores with too many kinds are halved, all together, until each fits; those with one kind repeat throughout
            per = stored(rows.groupBy("core").agg(F.count("*").alias("c"), (F.min("kind") == F.max("kind")).alias("same")).where("c > 1"))
            heavy = (F.col("c") > core_kinds) & ~F.col("same")
            if per.where(heavy).isEmpty():
                leaves.append(rows)
                break
            told = stored(join_counted(rows, per, ["core"]))
            found.append(told.where("same and alone").select("id", "h", "lo", "n"))
            leaves.append(told.where((F.col("c") <= core_kinds) & ~F.col("same")).select(*_ROW))
            rows = stored(_split(told.where(heavy).select(*_ROW), length))
        sorted_ = leaves[0]
        for x in leaves[1:]:
            sorted_ = sorted_.unionByName(x)
        total = sorted_.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
        shards = max(1, total // SHARD_BYTES)

        def sort_shard(group: pd.DataFrame) -> pd.DataFrame:
            out = []
            for (i, h, lo, alone), same in zip(group[["id", "h", "lo", "alone"]].itertuples(index=False), repeated_starts(group["bytes"].tolist(), length), strict=True):
                if alone and same.any():  # kinds that occur twice are known to repeat throughout
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
                    out += [(i, h, lo + a, b - a) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            return pd.DataFrame(out, columns=["id", "h", "lo", "n"]).astype({"id": "int64", "h": "int64", "lo": "int64", "n": "int32"})

        dealt = sorted_.withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(shards)))
        found.append(dealt.groupBy("shard").applyInPandas(sort_shard, "id long, h long, lo long, n int"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("id", "h", F.col("lo").alias("first"), (F.col("lo") + F.col("n") - 1).alias("last"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, core_kinds: int = CORE_KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept (binary: the text's remaining bytes), n_bytes, n_removed, n_spans and repeats (n_removed > 0) added.

    Every byte covered by a string of length bytes that also starts elsewhere goes, whichever copy it is in. Null text
    is the empty text. Texts under length bytes stay whole. Repeated rows are copies of each other and lose all such
    bytes. Null ids are rows like any other. Columns named like the added ones are replaced.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "repeats")
    ranges = repeated_ranges(docs, length, gram, core_kinds, id_col, text_col)
    by_doc = ranges.groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("__tf_ranges")).select(F.col("id").alias("__tf_id"), F.col("h").alias("__tf_h"), "__tf_ranges")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__tf_i": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "__tf_x": F.xxhash64(text)})
    joined = keyed.join(by_doc, (F.col("__tf_i") == F.col("__tf_id")) & (F.col("__tf_x") == F.col("__tf_h")), "left").select(*docs.columns, "__tf_ranges")
    ddl = "kept binary, n_bytes long, n_removed long, n_spans long"
    schema = StructType(docs.schema.fields + StructType.fromDDL(ddl).fields)

    def run(batches):
        for batch in chunks(batches, text_col):
            t = Texts(batch.column(batch.schema.names.index(text_col)))
            column = batch.column(batch.schema.names.index("__tf_ranges"))
            row = np.repeat(np.arange(t.n), np.diff(np.asarray(column.offsets)))
            flat = column.flatten()
            edge = np.zeros(len(t.buf) + t.n + 1, dtype=np.int32)  # a gap after each text keeps spans apart
            base = t.off[:-1] + np.arange(t.n)
            if len(row):
                first, last = (np.asarray(flat.field(k)) for k in (0, 1))
                np.add.at(edge, base[row] + first, 1)
                np.add.at(edge, base[row] + last + length, -1)
            gone = np.cumsum(edge) > 0
            kept, sums = [], np.zeros((3, t.n), np.int64)
            for i in range(t.n):
                mine = gone[base[i] : base[i] + t.off[i + 1] - t.off[i]]
                removed = int(mine.sum())
                sums[:, i] = len(mine), removed, int((np.diff(mine.astype(np.int8), prepend=0) == 1).sum()) if removed else 0
                kept.append(t.buf[t.off[i] : t.off[i + 1]][~mine].tobytes() if removed else t.bytes(i))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary()), *map(pa.array, sums)], names=schema.names)

    return joined.mapInArrow(run, schema).withColumn("repeats", F.col("n_removed") > 0)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "repeats")
