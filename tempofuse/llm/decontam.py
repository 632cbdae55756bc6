"""Benchmark decontamination by SimHash of item-sized windows (operator 7)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempofuse.llm.common import Texts, chunks, prefix_hash, span_hash, splitmix

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, and the distance up to which every pair is found: at a similarity of 0.8 the distance is 19
#: on average with a deviation of 4, so that 31 is three deviations off, and less similar windows are not wanted.
BITS = 128
RADIUS = 31
#: Blocks of 16 bits; two fingerprints within RADIUS differ by RADIUS // BLOCKS bits at most in one of the blocks.
BLOCKS = BITS // 16
NEAR = RADIUS // BLOCKS
#: Benchmark items that one pass holds; a larger benchmark is searched in as many passes.
ITEM_BLOCK = 20_000

_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[[i for i in range(128) if not chr(i).isalnum()]] = True
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: a run of letters, digits and other non-ASCII."""
    inside = np.zeros(len(t.buf) + 2, dtype=bool)
    inside[1:-1] = ~_SEPARATES[t.buf]
    starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = t.off[(t.off > 0) & (t.off < len(t.buf))]  # no word crosses texts
    both = cut[inside[cut] & inside[cut + 1]]
    starts[both] = ends[both] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return span_hash(prefix_hash(t.buf), start, end), np.searchsorted(t.off, start, side="right") - 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, of whatever texts."""
    out = np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return splitmix(out + np.uint64(k))


def signs(shingles: np.ndarray) -> np.ndarray:
    """(n, BITS) of -1 and 1."""
    wide = np.stack([splitmix(shingles + np.uint64(k)) for k in range(1, 1 + BITS // 64)], axis=1)
    return (np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _neighbours(radius: int) -> np.ndarray:
    """All 16-bit masks of at most so many bits."""
    return np.flatnonzero(_POP <= radius).astype(np.uint16)


@dataclass
class Items:
    """One block of benchmark items, indexed."""

    ids: list
    size: np.ndarray  # words
    prints: np.ndarray
    table: list  # of each block: which values occur, first place by value, and items by value
    hits: np.ndarray  # sorted shingles
    of_size: dict  # size in words -> places in hits of the shingles that items of this size have
    member: np.ndarray  # sorted (item, shingle) codes
    weight: np.ndarray
    shingles: np.ndarray  # shingles of each item
    short: dict  # words -> {hash: item}

    @staticmethod
    def build(ids: list, texts: pa.Array) -> Items:
        t = Texts(pc.utf8_lower(texts))
        h, row = words(t)
        first = np.searchsorted(row, np.arange(t.n + 1))
        size = np.diff(first)
        short: dict[int, dict[int, list[int]]] = {}
        of, shingle = [], []
        for i in range(t.n):
            own = h[first[i] : first[i + 1]]
            if 0 < len(own) < SHINGLE:
                short.setdefault(len(own), {}).setdefault(int(grams(own, len(own))[0]), []).append(i)
            elif len(own):
                s = grams(own, SHINGLE)
                of.append(np.full(len(s), i))
                shingle.append(s)
        of, shingle = (np.concatenate(of), np.concatenate(shingle)) if of else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        sums = np.zeros((t.n, BITS), dtype=np.int32)
        np.add.at(sums, of, signs(shingle))
        prints = fingerprint(sums)
        long = np.flatnonzero(size >= SHINGLE)
        table = []
        for b in range(BLOCKS):
            value = prints[long, b].astype(np.int64)
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange((1 << 16) + 1)).astype(np.int32)
            table.append((np.diff(first) > 0, first, long[order]))
        hits, which = np.unique(shingle, return_inverse=True)
        of_size = {int(z): np.unique(which[size[of] == z]) for z in np.unique(size[of])} if len(of) else {}
        code = splitmix(of.astype(np.uint64)) ^ shingle
        member, weight = np.unique(code, return_counts=True)
        return Items(list(ids), size, prints, table, hits, of_size, member, weight, np.bincount(of, minlength=t.n), short)


def search(t: Texts, items: Items, least: float) -> list[tuple[int, int, float]]:
    """(row, place of the item, similarity) of each text and item of which some window is at least that similar."""
    h, row = words(t)
    found: dict[tuple[int, int], float] = {}
    for k, by in items.short.items():  # an item of fewer words is one shingle, and only its equal is similar
        g = grams(h, k)
        whole = np.flatnonzero(row[: len(g)] == row[k - 1 :]) if len(g) else g
        known = np.array(sorted(by), dtype=np.uint64)
        for p in whole[np.isin(g[whole], known)] if len(whole) else ():
            for i in by[int(g[p])]:
                found[int(row[p]), i] = 1.0
    if len(h) >= SHINGLE and len(items.hits):
        s = grams(h, SHINGLE)
        at = np.minimum(np.searchsorted(items.hits, s), len(items.hits) - 1) if len(items.hits) < 4096 else _lookup(items.hits, s)
        hit = np.flatnonzero((items.hits[at] == s) & (row[: len(s)] == row[SHINGLE - 1 :]))
        if len(hit):
            _windows(found, items, s, row, hit, at[hit], least)
    return [(r, i, v) for (r, i), v in found.items()]


def _lookup(known: np.ndarray, s: np.ndarray) -> np.ndarray:
    """searchsorted for the few that pass a bitmap of the known."""
    bitmap = np.zeros(1 << 24, dtype=bool)
    bitmap[(known >> np.uint64(40)).astype(np.int64)] = True
    some = np.flatnonzero(bitmap[(s >> np.uint64(40)).astype(np.int64)])
    out = np.zeros(len(s), dtype=np.int64)
    out[some] = np.minimum(np.searchsorted(known, s[some]), len(known) - 1)
    return out


def _windows(found, items: Items, s: np.ndarray, row: np.ndarray, hit: np.ndarray, which: np.ndarray, least: float) -> None:
    # a window that is similar enough to an item shares a shingle with it: every window of the item's size around a hit,
    # each once however many hits it has; one size at a time, so that memory follows the text alone
    first, stop = np.searchsorted(row, row[hit]), np.searchsorted(row, row[hit], side="right")
    for size, shingles in items.of_size.items():
        mine = np.zeros(len(items.hits), dtype=bool)
        mine[shingles] = True
        at = np.flatnonzero(mine[which])
        if not len(at):
            continue
        low = np.maximum(first[at], hit[at] - (size - SHINGLE))
        high = np.maximum(np.minimum(hit[at], stop[at] - size), first[at])
        cover = np.zeros(len(s) + 1, dtype=np.int32)
        np.add.at(cover, np.minimum(low, high), 1)
        np.add.at(cover, high + 1, -1)
        start = np.flatnonzero(np.cumsum(cover) > 0)
        words_ = np.minimum(size, np.searchsorted(row, row[start], side="right") - np.searchsorted(row, row[start]))
        for k in range(0, len(start), 20_000):
            _compare(found, items, s, row, start[k : k + 20_000], words_[k : k + 20_000] - SHINGLE + 1, least)


def _compare(found, items: Items, s: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, least: float) -> None:
    # running sums of the signs of the shingles that any window has
    need = np.zeros(len(s) + 1, dtype=np.int64)
    np.add.at(need, start, 1)
    np.add.at(need, start + count, -1)
    used = np.flatnonzero(np.cumsum(need)[:-1] > 0)
    run = np.zeros((len(used) + 1, BITS), dtype=np.int32)
    np.cumsum(signs(s[used]), axis=0, out=run[1:])
    a = np.searchsorted(used, start)
    prints = fingerprint(run[a + count] - run[a])
    pairs, masks = [], _neighbours(NEAR)
    for b, (occurs, first, listed) in enumerate(items.table):
        for k in range(0, len(start), 2000):
            near = prints[k : k + 2000, b][:, None] ^ masks  # every value within NEAR bits of the window's
            w, m = np.nonzero(occurs[near])
            value = near[w, m].astype(np.int64)
            n = (first[value + 1] - first[value]).astype(np.int64)
            w = np.repeat(w + k, n)
            i = listed[np.repeat(first[value], n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
            close = _POP[prints[w] ^ items.prints[i]].sum(axis=1) <= RADIUS
            pairs.append(np.unique(w[close] * len(items.size) + i[close]))
    pair = np.unique(np.concatenate(pairs))
    w, i = pair // len(items.size), pair % len(items.size)
    for at in range(0, len(pair), 5000):  # exact weighted similarity of shingles
        ww, ii = w[at : at + 5000], i[at : at + 5000]
        n = count[ww]
        of = np.repeat(np.arange(len(ww)), n)
        shingle = s[np.repeat(start[ww], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
        code = splitmix(ii[of].astype(np.uint64)) ^ shingle
        order = np.lexsort((code, of))
        of, code = of[order], code[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (code[1:] != code[:-1])]))
        times = np.diff(np.append(new, len(of)))
        k = np.minimum(np.searchsorted(items.member, code[new]), len(items.member) - 1)
        both = np.where(items.member[k] == code[new], np.minimum(times, items.weight[k]), 0)
        inter = np.bincount(of[new], weights=both, minlength=len(ww))
        value = inter / (n + items.shingles[ii] - inter)
        for x in np.flatnonzero(value >= least - 1e-12):
            key = int(row[start[ww[x]]]), int(ii[x])
            found[key] = max(found.get(key, 0.0), float(value[x]))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, item_block: int = ITEM_BLOCK, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with contaminated, n_items, item_ids (sorted, comma-joined) and max_similarity (0 if none) added.

    A document is contaminated if some window of it, of as many words as an item, has a weighted Jaccard similarity of
    at least `least` with the item, on shingles of five words (with their numbers); a shorter document is its own
    window, and an item of fewer words must occur as it is. Words are runs of letters and digits in lower case. Null
    and empty texts, of documents and items, match nothing; repeated items all count, and null item ids are not named.
    Columns named like the added ones are replaced.
    """
    names = ["contaminated", "n_items", "item_ids", "max_similarity"]
    docs = docs.drop(*names)
    out = docs.withColumn("__tf_hits", F.array().cast("array<struct<item:long,similarity:double>>"))
    blocks = max(1, -(-benchmark.count() // item_block))
    kind = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64())]))
    for b in range(blocks):
        some = benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(blocks)) == b).select(F.col(item_col).cast("long"), item_text).toArrow()
        items = Items.build(some.column(0).to_pylist(), some.column(1).combine_chunks().cast(pa.string()))

        def run(batches, items=items):
            for batch in chunks(batches, text_col):
                at = batch.schema.names.index(text_col)
                hits = batch.column(batch.num_columns - 1).to_pylist()
                for r, i, v in search(Texts(pc.utf8_lower(batch.column(at).cast(pa.string()))), items, least):
                    hits[r].append({"item": items.ids[i], "similarity": v})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, kind)], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    hits = F.col("__tf_hits")
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(hits, lambda x: x["item"]), lambda x: x.isNotNull())))
    return out.select(
        *docs.columns,
        (F.size(hits) > 0).alias("contaminated"),
        F.size(hits).alias("n_items"),
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform(hits, lambda x: x["similarity"])), F.lit(0.0)).alias("max_similarity"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "contaminated", (~F.col("contaminated")).alias("kept"), "n_items", "item_ids", "max_similarity")
