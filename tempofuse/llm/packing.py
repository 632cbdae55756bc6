"""Token packing by swap-based local search between underfull bins (operator 5)."""

from __future__ import annotations

import os
import zlib
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempofuse.llm.common import IS_SPACE, LOWER, Texts, chunks, prefix_hash, release, span_hash, stored

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs; a longer table is packed in as many groups, whose underfull bins meet in later rounds.
GROUP_PIECES = 10_000
#: Tasks of a round at most; a task takes group after group.
MOST_TASKS = 20_000
#: Words whose ids a worker remembers, and as many parts of words; ids that it keeps for them before it starts anew.
MEMO_SLOTS = 1 << 19
MEMO_IDS = 6_000_000

_loaded: dict[str | None, _Words] = {}

# Classes of bytes: letters, digits and other signs make up the tokenizer's parts of words. Words with any other byte
# (beyond the letters of Latin-1), with an apostrophe or with the beginning of a special token are left to it whole.
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _CLASS[39] = _ODD
_CLASS[IS_SPACE] = 0


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it is seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] in all, then the same of the next."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class _Memo:
    """Place and number of ids by hash, each hash at one place of a table; a newer one takes an older one's place."""

    def __init__(self):
        self.key = np.zeros(MEMO_SLOTS, dtype=np.uint64)
        self.first, self.n = np.zeros(MEMO_SLOTS, dtype=np.int64), np.zeros(MEMO_SLOTS, dtype=np.int64)

    def clear(self) -> None:
        self.key[:] = 0

    def of(self, h: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each; learn(indexes) gives both for those that are not known, one of each."""
        slot = (h & np.uint64(MEMO_SLOTS - 1)).astype(np.int64)
        known = self.key[slot] == h
        first, n = self.first[slot], self.n[slot]
        miss = np.flatnonzero(~known)
        if len(miss):
            _, one, which = np.unique(h[miss], return_index=True, return_inverse=True)
            a, b = learn(miss[one])
            first[miss], n[miss] = a[which], b[which]
            at = slot[miss[one]]
            self.key[at], self.first[at], self.n[at] = h[miss[one]], a, b
        return first, n


class _Words:
    """Ids of words. The tokenizer lowers case, splits at white space, and splits words into runs of letters, single
    digits and runs of other signs, before all else; so a text's ids are those of the parts of its words, joined, and
    each distinct part is given to the tokenizer's model once and remembered."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _alphabet()
        self.words, self.parts = _Memo(), _Memo()
        self.pool, self.used = np.zeros(1 << 16, dtype="<u4"), 0

    def _add(self, ids: np.ndarray) -> int:
        at, need = self.used, self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, 2 * len(self.pool)) - len(self.pool), dtype="<u4")])
        self.pool[at:need] = ids
        self.used = need
        return at

    def _add_all(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in ids], dtype=np.int64)
        at = self._add(np.array([i for x in ids for i in x], dtype="<u4"))
        return at + np.cumsum(n) - n, n

    def ids(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (with the end)."""
        if self.used > MEMO_IDS:
            self.words.clear(), self.parts.clear()
            self.used = 0
        start, end, row = t.words()
        low, kind = LOWER[t.buf], _CLASS[t.buf]
        lead = np.flatnonzero(t.buf[:-1] == 0xC3)
        latin = lead[(t.buf[lead + 1] != 0x97) & (t.buf[lead + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
        low[latin[t.buf[latin + 1] < 0x9F] + 1] += 0x20
        special = np.flatnonzero((t.buf[:-1] == 60) & (t.buf[1:] == 124))
        kind[special] = _ODD
        for w in np.unique(np.searchsorted(start, special, side="right") - 1).tolist():  # special tokens keep their case
            low[start[w] : end[w]] = t.buf[start[w] : end[w]]
        odd = np.zeros(len(kind) + 1, dtype=np.int32)
        np.cumsum(kind == _ODD, out=odd[1:])
        is_odd = odd[end] > odd[start]
        prefix = prefix_hash(low)
        cut = (kind == _DIGIT) | (kind != np.concatenate([[0], kind[:-1]]).astype(np.uint8))
        cut[start] = True  # texts follow each other without white space
        cuts = np.flatnonzero(cut & (kind > 0))

        def part(indexes: np.ndarray, a: np.ndarray, b: np.ndarray):
            data, tokens = low.tobytes(), []
            for x, y in zip(a[indexes].tolist(), b[indexes].tolist(), strict=True):
                tokens.append([k.id for k in self.model.tokenize(data[x:y].decode("latin-1").translate(self.alphabet))])
            return self._add_all(tokens)

        def word(indexes: np.ndarray):
            first, n = np.zeros(len(indexes), np.int64), np.zeros(len(indexes), np.int64)
            whole = np.flatnonzero(is_odd[indexes])
            if len(whole):
                texts = [low[start[w] : end[w]].tobytes().decode("utf-8", "replace") for w in indexes[whole]]
                first[whole], n[whole] = self._add_all([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            plain = np.flatnonzero(~is_odd[indexes])
            if len(plain):
                s, e = start[indexes[plain]], end[indexes[plain]]
                one, stop = np.searchsorted(cuts, s), np.searchsorted(cuts, e)
                k = _spread(one, stop - one)  # the parts of these words; the last ends with its word
                a, b = cuts[k], cuts[np.minimum(k + 1, len(cuts) - 1)]
                last = np.cumsum(stop - one) - 1
                b[last] = e
                at, m = self.parts.of(span_hash(prefix, a, b), lambda i: part(i, a, b))
                run = np.concatenate([[0], np.cumsum(m)])
                base = self._add(self.pool[_spread(at, m)])
                first[plain] = base + run[np.concatenate([[0], last[:-1] + 1])]
                n[plain] = run[last + 1] - run[np.concatenate([[0], last[:-1] + 1])]
            return first, n

        first, n = self.words.of(span_hash(prefix, start, end), word)
        run = np.concatenate([[0], np.cumsum(n)])
        return self.pool[_spread(first, n)], run[np.searchsorted(row, np.arange(t.n + 1))]


def token_ids(t: Texts, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text (little-endian uint32, without the end id), all in a row, and where each text's begin."""
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path].ids(t)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, and its ids if asked for.

    A document is its ids and the end id; null and empty texts are the end id alone. Only documents over the capacity
    are cut, and only their last piece may be shorter. Repeated rows and null ids give pieces as any other row.
    """
    schema = StructType([docs.schema[id_col]] + StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + (", ids binary" * with_ids)).fields)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        for batch in chunks(batches, text_col):
            ids = batch.column(batch.schema.names.index(id_col))
            t = Texts(batch.column(batch.schema.names.index(text_col)))
            tokens, off = token_ids(t, tokenizer)
            row, piece, start, length, crc, data = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                for k, at in enumerate(range(0, b - a + 1, capacity)):
                    part = tokens[a + at : min(a + at + capacity, b)].tobytes() + (end if at + capacity > b - a else b"")
                    row.append(i), piece.append(k), start.append(at), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        data.append(part)
            more = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(data, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *more], names=schema.names)
        _loaded.clear()
        release()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


# --- packing ---------------------------------------------------------------------------------------------------


def best_fit(length: np.ndarray, capacity: int) -> np.ndarray:
    """A first placement: the bin of each piece. The longest goes first, each into the fullest bin that has room for it.

    Bins are kept by their room; the bits of one number tell which rooms there are.
    """
    home = np.zeros(len(length), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = bins = 0
    for i in np.argsort(-np.asarray(length), kind="stable").tolist():
        size = int(length[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, k, bins = capacity, bins, bins + 1
        home[i] = k
        if not by_room[room - size]:
            rooms |= 1 << (room - size)
        by_room[room - size].append(k)
    return home


def local_search(home: np.ndarray, length: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece after moves and one-for-one and two-for-one exchanges, each of which takes pieces from an
    emptier bin to a fuller one and so raises the sum of squared fills. The emptiest bin gives first, and its best step
    is taken, until it is empty or no step of it helps. Ends when the number of bins is the least possible, or when no
    step of any bin helps; there is no bound on steps or bins."""
    home, length = np.array(home, dtype=np.int64), np.asarray(length, dtype=np.int64)
    if not len(home):
        return home
    fill = np.bincount(home, weights=length).astype(np.int64)
    inside: list[set[int]] = [set() for _ in fill]
    for i, k in enumerate(home.tolist()):
        inside[k].add(i)
    least = -(-int(fill.sum()) // capacity)
    live = int((fill > 0).sum())
    # pieces of bins that were underfull when last looked at: all that can be given back now, and more, as no step leaves
    # a bin underfull that was full
    some: np.ndarray = np.zeros(0, dtype=np.int64)

    def step(a: int) -> int:
        """The step of bin a that raises the squares most: the bin that it fills, or -1."""
        sizes, times = np.unique(length[list(inside[a])], return_counts=True)
        two = sizes[:, None] + sizes
        two[np.diag_indices(len(sizes))] *= times > 1
        gives = np.zeros(capacity + 1, dtype=np.int64)  # the most that a can give, of one or two pieces, within a size
        gives[sizes] = sizes
        pair = two[(two > 0) & (two <= capacity)]
        gives[pair] = pair
        gives = np.maximum.accumulate(gives)
        best = -1, 0, -1, 0
        to = np.flatnonzero((fill < capacity) & (fill >= max(fill[a], 1)))
        for bins, backs in ((to, None), (home[some], some)):
            back = 0 if backs is None else length[backs]
            f = fill[bins]
            out = gives[np.minimum(capacity - f + back, capacity)]
            d = out - back
            gain = np.where((d > 0) & ((f > fill[a]) | ((f == fill[a]) & (bins > a))), d * (f - fill[a] + d), 0)
            if len(gain) and (x := int(np.argmax(gain))) is not None and gain[x] > best[1]:
                best = int(bins[x]), int(gain[x]), (-1 if backs is None else int(backs[x])), int(out[x])
        b, gain, back, out = best
        if not gain:
            return -1
        mine = sorted(inside[a], key=lambda i: (length[i], i))
        by = {int(length[i]): i for i in mine}
        if out in by:
            give = [by[out]]
        else:
            give = next([i, j] for i in mine if (j := by.get(out - int(length[i]))) is not None and j != i)
        for i in give:
            inside[a].remove(i), inside[b].add(i)
            home[i] = b
        if back >= 0:
            inside[b].remove(back), inside[a].add(back)
            home[back] = a
        d = out - (int(length[back]) if back >= 0 else 0)
        fill[a] -= d
        fill[b] += d
        return b

    while live > least:
        queue = [(int(f), k) for k, f in enumerate(fill.tolist()) if 0 < f < capacity]
        heapify(queue)
        moved, steps = False, 0
        while queue and live > least:
            f, a = heappop(queue)
            if f != fill[a]:
                continue
            while fill[a] > 0 and live > least:
                if steps % 256 == 0:
                    some = np.flatnonzero(fill[home] < capacity)
                steps += 1
                b = step(a)
                if b < 0:
                    break
                moved = True
                if fill[b] < capacity:
                    heappush(queue, (int(fill[b]), b))
            live -= fill[a] == 0
        if not moved:
            break
    return np.unique(home, return_inverse=True)[1]


def _pack_group(capacity: int, first: bool):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ids_crc32", "doc_id", "piece", "length"], kind="stable").reset_index(drop=True)
        length = group["length"].to_numpy()
        if first:
            begin = best_fit(length, capacity)
            ids = (int(group["__tf_g"].iloc[0]) << 28) + np.arange(int(begin.max()) + 1)
        else:
            ids, begin = np.unique(group["sequence_id"].to_numpy(), return_inverse=True)
        home = local_search(begin, length, capacity)
        fills = np.bincount(home, weights=length).astype(np.int64)
        order = np.argsort(home, kind="stable")
        offset = np.zeros(len(group), np.int64)
        offset[order] = np.cumsum(length[order]) - length[order] - np.repeat(np.cumsum(fills) - fills, np.bincount(home))
        return group.drop(columns="__tf_g").assign(sequence_id=ids[home], offset=offset, __tf_fill=fills[home])

    return pack


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Groups are dealt by a hash of the piece, so that each has a fair mixture of lengths, and packed by best fit and local
    search. Then all bins that are not full are dealt to groups anew, and searched on, as long as a round empties a bin
    and there are more bins than their pieces need; no bin is left out of it.
    """
    schema = StructType(parts.schema.fields + StructType.fromDDL("sequence_id long, offset long, __tf_fill long").fields)
    columns = [*parts.columns, "sequence_id", "offset"]

    def packed(rows: DataFrame, by: list[str], groups: int, number: int) -> DataFrame:
        dealt = rows.withColumn("__tf_g", F.pmod(F.xxhash64(F.lit(number), *by), F.lit(groups)).cast("long"))
        # a group is small and takes seconds, so that groups are not put together in a task by their size
        return stored(dealt.repartition(min(groups, MOST_TASKS), "__tf_g").groupBy("__tf_g").applyInPandas(_pack_group(capacity, number == 0), schema))

    groups, number, before = max(1, -(-parts.count() // group_pieces)), 0, None
    left, done = packed(parts, parts.columns, groups, 0), []
    while True:
        done.append(left.where(F.col("__tf_fill") >= capacity))
        left = left.where(F.col("__tf_fill") < capacity)
        n, tokens, bins = left.agg(F.count("*"), F.sum("length"), F.count_if(F.col("offset") == 0)).first()
        if groups == 1 or bins <= -(-(tokens or 0) // capacity) or (before is not None and bins + full >= before):
            break
        before, groups, number = bins, -(-n // group_pieces), number + 1
        left = packed(left.drop("offset", "__tf_fill"), ["sequence_id"], groups, number)
        full = left.where(F.col("__tf_fill") >= capacity).agg(F.count_if(F.col("offset") == 0)).first()[0]
    return reduce(DataFrame.unionByName, [x.select(columns) for x in [*done, left]])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents of docs in sequences of at most capacity tokens; see pieces() and pack_pieces().

    Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    parts = pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), capacity, tokenizer)
    return pack_pieces(stored(parts), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
