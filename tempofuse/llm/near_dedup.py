"""Near-duplicate documents by a chosen-path set similarity join (operator 1).

Documents of equal shingle sets are one class and stand for each other. Classes have a sketch of 64 minwise hashes, of
a byte each. In each of TREES independent trees a node selects some of the minwise positions, by a hash of its path,
and passes its rows to one child for each position and value. Small nodes are compared exhaustively by sketch, and
pairs that may be similar enough are confirmed on full sets. Nodes are dealt to tasks by path; a node with too many
rows for a task is branched across the cluster, and within its task a node is branched on until it is small or dense. A node
that is too large even at the greatest depth, as that of a group of near copies, is compared in blocks of bounded size.

A node gives a spanning forest of its candidate pairs, the most similar first, and not all of them: these are enough to
tell which documents any chain of candidates holds together (a cluster), and confirming them links most of a group
(parts). What a cluster has outside its largest part is then held against all its other parts, in blocks of bounded
size and on full sets, so that no link is lost and no pair of a group is a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofuse.llm.common import LOWER, Texts, chunks, prefix_hash, seeds, span_hash, splitmix, stored
from tempofuse.llm.components import connected_components

WORDS = 2
PERCENT = 80
POSITIONS = 64
#: At a similarity of 0.8 a pair of six trees is missed with a probability of about 1e-5.
TREES = 6
#: Positions that a node selects, by depth; one below.
BRANCHES = (2, 2)
#: Equal positions from which on a pair is a candidate (four deviations under 0.8), and surely similar.
CANDIDATE, SURE = 38, 59
SMALL_NODE = 48
MATRIX_NODE = 400
#: Rows of a node that one task takes.
NODE_ROWS = 50_000
MOST_DEPTH = 9
#: Rows of a node beyond MOST_DEPTH that all its blocks share.
PIVOTS = 64
FILTER_BITS = 1 << 26
#: Rows of a cluster that meet as many others in one task.
BLOCK = 256

_A = seeds(POSITIONS, 31) | np.uint64(1)
_B = seeds(POSITIONS, 37)


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, and where each text's begin (with the end)."""
    start, end, row = t.words()
    h = span_hash(prefix_hash(LOWER[t.buf]), start, end)
    n = max(len(h) - k + 1, 0)
    g = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    whole = np.flatnonzero(row[:n] == row[k - 1 :][:n]) if n else np.zeros(0, np.int64)
    g, rows = splitmix(g[whole]), row[whole]
    count = np.bincount(row, minlength=t.n)
    short = np.flatnonzero((count > 0) & (count < k))  # the whole sequence as one
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            live = count[short] > i
            extra[live] = extra[live] * np.uint64(0x9E3779B97F4A7C15) + h[first[live] + i] + np.uint64(i + 1)
        g, rows = np.concatenate([g, splitmix(extra + np.uint64(77))]), np.concatenate([rows, short])
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    g, rows = g[new], rows[new]
    return g, np.searchsorted(rows, np.arange(t.n + 1))


def sketches(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts with shingles, POSITIONS) bytes."""
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, POSITIONS), dtype=np.uint8)
    if len(full):
        for j in range(POSITIONS):
            least = np.minimum.reduceat(g * _A[j] + _B[j], off[:-1][full])
            out[full, j] = (splitmix(least) >> np.uint64(56)).astype(np.uint8)
    return out


def _set_key(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(g) + 1, dtype=np.uint64)
    np.cumsum(splitmix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=run[1:])
    return splitmix(run[off[1:]] - run[off[:-1]] + np.diff(off).astype(np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))


def signatures(keyed: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in chunks(batches, "text"):
            t = Texts(batch.column(1))
            g, off = shingle_sets(t, k)
            sig = sketches(g, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(_set_key(g, off))), pa.array(np.diff(off)), pa.array([s.tobytes() for s in sig], pa.binary()), batch.column(2)], names=["id", "key", "n", "sig", "text_hash"])

    return keyed.mapInArrow(run, "id long, key long, n long, sig binary, text_hash long")


# --- trees -----------------------------------------------------------------------------------------------------


def _selected(path: int, depth: int) -> list[int]:
    """Positions that the node of this path selects."""
    b = BRANCHES[depth] if depth < len(BRANCHES) else 1
    order = np.argsort(splitmix(np.uint64(path) + np.arange(1, POSITIONS + 1, dtype=np.uint64)))
    return order[:b].tolist()


def _child(path, position: int, value):
    return splitmix(np.uint64(path) * np.uint64(3) + np.uint64(position * 256 + 1) + np.asarray(value, dtype=np.uint64))


def _branch(rows: DataFrame, depth: int) -> DataFrame:
    """rows (path, key, n, sig) passed to the children of their nodes, which are depth deep."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            path = np.asarray(batch.column(0)).view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)
            at, to = [], []
            for p in np.unique(path):
                mine = np.flatnonzero(path == p) if batch.num_rows > 1 else np.zeros(1, np.int64)
                for c in _selected(int(p), depth):
                    at.append(mine), to.append(_child(p, c, sig[mine, c]))
            if at:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(to))), *(batch.column(k).take(take) for k in range(1, batch.num_columns))], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _near(sig: np.ndarray, n: np.ndarray, i: int) -> np.ndarray:
    """Equal positions of row i with each row, or 0 where the pair is no candidate."""
    equal = (sig == sig[i]).sum(axis=1)
    equal[(equal < CANDIDATE) | (100 * np.minimum(n, n[i]) < PERCENT * np.maximum(n, n[i]))] = 0
    equal[i] = 0
    return equal


def _met(n, sig, mine: np.ndarray, others: np.ndarray) -> tuple[int, int] | None:
    """Some candidate pair of a row of mine and one of others."""
    if len(mine) > len(others):
        mine, others = others, mine
    for i in mine:
        equal = (sig[others] == sig[i]).sum(axis=1)
        at = np.flatnonzero((equal >= CANDIDATE) & (100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i])))
        if len(at):
            return int(i), int(others[at[0]])
    return None


def _span_hung(key, n, sig, heads: np.ndarray, head: np.ndarray, tree: np.ndarray, out: list) -> None:
    """Join the trees of heads (tree, by head) that only rows hung on heads (head, by row) hold together.

    A row is as far from others as its head, give or take the positions in which the two differ; so that groups of a
    head and its rows meet row by row only where their heads, sizes and these positions leave a candidate possible.
    """
    far = POSITIONS - (sig == sig[heads[head]]).sum(axis=1)
    order = np.argsort(head, kind="stable")
    groups = np.split(order, np.cumsum(np.bincount(head, minlength=len(heads)))[:-1])
    most, small, big = (np.array([f(x[g]) for g in groups]) for f, x in ((np.max, far), (np.min, n), (np.max, n)))
    count = np.array([len(g) for g in groups])
    own = sig[heads]
    tree = tree.copy()
    largest = np.argmax(np.bincount(tree, weights=count))
    for i in np.flatnonzero(tree != largest):
        others = np.flatnonzero((count > 1) | (count[i] > 1))  # single rows have met each other as heads
        reach = (own[others] == own[i]).sum(axis=1) + most[others] + most[i]
        others = others[(reach >= CANDIDATE) & (100 * big[i] >= PERCENT * small[others]) & (100 * big[others] >= PERCENT * small[i])]
        for j in others:
            if tree[i] == tree[j]:
                continue
            mine = groups[i][(sig[groups[i]] == own[j]).sum(axis=1) + most[j] >= CANDIDATE]
            pair = _met(n, sig, mine, groups[j][(sig[groups[j]] == own[i]).sum(axis=1) + most[i] >= CANDIDATE])
            if pair is not None:
                out.append((key[pair[0]], key[pair[1]]))
                tree[tree == tree[j]] = tree[i]


def _forest(key: np.ndarray, n: np.ndarray, sig: np.ndarray, out: list) -> None:
    """Candidate pairs of a node that span it, the most similar first (Prim). In a large node the rows that are surely
    similar to an earlier one hang on it, the others are spanned, and what is still apart is joined by hung rows."""
    rows = np.arange(len(key))
    large = len(key) > MATRIX_NODE
    if large:
        head = np.full(len(key), -1)
        heads = []
        for i in range(len(key)):
            if head[i] < 0:
                mine = np.flatnonzero((_near(sig, n, i) >= SURE) & (head < 0))
                head[mine] = head[i] = len(heads)
                heads.append(i)
                out.extend((key[i], k) for k in key[mine])
        rows = np.array(heads)
    keys, sizes, sigs = key[rows], n[rows], sig[rows]
    left = np.ones(len(rows), dtype=bool)
    best, parent = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    tree = np.zeros(len(rows), dtype=np.int64)
    i = trees = 0
    while True:
        left[i], tree[i] = False, trees
        equal = _near(sigs, sizes, i)
        better = left & (equal > best)
        best[better], parent[better] = equal[better], i
        i = int(np.argmax(np.where(left, best, -1)))
        if not left[i]:
            break
        if best[i]:
            out.append((keys[parent[i]], keys[i]))
        else:
            trees += 1
    if large and trees and len(rows) < len(key):
        _span_hung(key, n, sig, rows, head, tree, out)


def _walk(path: int, depth: int, key, n, sig, out) -> None:
    """Compare the node's rows, or branch them on: small nodes, and those in which rows hardly part, are compared."""
    m = len(key)
    if m < 2:
        return
    if m > SMALL_NODE and depth < MOST_DEPTH:
        for c in _selected(path, depth):
            order = np.argsort(sig[:, c], kind="stable")
            value = sig[order, c]
            cut = np.flatnonzero(np.diff(value, prepend=-1, append=256) != 0)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a < 2:
                    continue
                mine = order[a:b]
                deeper = depth + 1 if len(mine) < 0.9 * m else MOST_DEPTH
                _walk(int(_child(path, c, value[a])), deeper, key[mine], n[mine], sig[mine], out)
    else:
        _forest(key, n, sig, out)


def _node(depth: int):
    """The function of one node's rows that gives its pairs."""

    def node(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(group) > 1:
            group = group.sort_values("key", kind="stable")
            sig = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(-1, POSITIONS)
            path = int(group["path"].iloc[0]) % (1 << 64)
            with np.errstate(over="ignore"):
                _walk(path, depth, group["key"].to_numpy(), group["n"].to_numpy(), sig, out)
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return node


def _columns(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return group["key"].to_numpy(), group["n"].to_numpy(), np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(-1, POSITIONS)


def _block(group: pd.DataFrame) -> pd.DataFrame:
    """A block's pairs (a, b), and as rows (a, null, n, sig) those that it does not hold together with most pivots."""
    group = group.sort_values("key", kind="stable")
    key, n, sig = _columns(group)
    pivot = group["pivot"].to_numpy()
    out: list[tuple[int, int]] = []
    _forest(key, n, sig, out)
    # which pivots most pivots are tied to is the same in every block, as it follows from the pivots alone
    ties: list[tuple[int, int]] = []
    if pivot.any():
        _forest(key[pivot], n[pivot], sig[pivot], ties)
    label = _trees(key[pivot], ties)
    main = key[pivot][label == np.argmax(np.bincount(label))] if len(label) else key[:0]
    tree = _trees(key, out + ties)
    minor = ~np.isin(tree, tree[np.isin(key, main)])
    pairs = np.array(out + ties, dtype=np.int64).reshape(-1, 2)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    some = group[minor]
    found = pd.DataFrame({"a": pairs[:, 0], "b": pd.array(pairs[:, 1], dtype="Int64"), "n": 0, "sig": None})
    rest = pd.DataFrame({"a": some["key"], "b": pd.array([None] * len(some), dtype="Int64"), "n": some["n"], "sig": some["sig"]})
    return pd.concat([found, rest]).assign(path=group["path"].iloc[0])[["path", "a", "b", "n", "sig"]]


def _trees(key: np.ndarray, pairs: list) -> np.ndarray:
    """The tree of each row, by number, that pairs of keys (sorted, distinct) make."""
    root = list(range(len(key)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ends = np.searchsorted(key, np.array(pairs, dtype=np.int64).reshape(-1, 2))
    for x, y in ends.tolist():
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(key))], dtype=np.int64)


def _meeting(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs with a minor row that span a block's rows and a block of minor rows; all others hold together already."""
    group = group.sort_values("key", kind="stable").drop_duplicates("key")
    key, n, sig = _columns(group)
    out: list[tuple[int, int]] = []
    _forest(key, n, sig, out)
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    minor = key[group["minor"].to_numpy()]
    pairs = np.unique(np.sort(pairs[np.isin(pairs, minor).any(axis=1)], axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _unparted(rows: DataFrame, heavy: DataFrame, node_rows: int) -> DataFrame:
    """(a, b) that span the candidate pairs of nodes (heavy: path, count) with too many rows for a task.

    A node's rows are dealt to blocks of half as many rows as a task takes, and each block has the node's pivots too.
    Rows that a block holds together with most of the pivots are held together in the node. All others (minor rows)
    then meet all rows of the node, block by block. In a group of near copies few rows are minor; the blocks that a row
    goes to are the node's minor rows over the size of a block.
    """
    half = max(node_rows // 2, 1)
    turn = F.xxhash64("key")
    rows = stored(rows.join(heavy, "path").withColumn("blocks", F.ceil(F.col("count") / half)).withColumn("pivot", F.pmod(F.xxhash64("key", "path"), F.col("count")) < min(PIVOTS, half)))
    own = rows.where("not pivot").withColumn("block", F.pmod(turn, "blocks"))
    shared = rows.where("pivot").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["path", "block", "pivot", "key", "n", "sig"]
    blocks = stored(own.select(columns).unionByName(shared.select(columns)).groupBy("path", "block").applyInPandas(_block, "path long, a long, b long, n long, sig binary"))
    minors = stored(blocks.where("b is null").select("path", F.col("a").alias("key"), "n", "sig").dropDuplicates(["path", "key"]))
    pairs = blocks.where("b is not null").select("a", "b")
    if minors.isEmpty():
        return pairs
    shape = minors.groupBy("path").agg(F.ceil(F.count("*") / half).alias("minors"))
    flagged = rows.join(minors.select("path", "key", F.lit(True).alias("minor")), ["path", "key"], "left").withColumn("minor", F.coalesce("minor", F.lit(False)))
    every = flagged.join(shape, "path").withColumn("x", F.pmod(turn, "blocks")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)))
    few = minors.join(shape, "path").join(heavy.select("path", F.ceil(F.col("count") / half).alias("blocks")), "path")
    few = few.withColumn("y", F.pmod(turn, "minors")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("minor", F.lit(True))
    columns = ["path", "x", "y", "minor", "key", "n", "sig"]
    return pairs.unionByName(every.select(columns).unionByName(few.select(columns)).groupBy("path", "x", "y").applyInPandas(_meeting, "a long, b long"))


def candidate_pairs(classes: DataFrame, trees: int = TREES, node_rows: int = NODE_ROWS) -> DataFrame:
    """Distinct (a, b), a < b, of classes (key, n, sig) that may be similar enough, and that span all such pairs."""
    roots = F.explode(F.array(*[F.lit(int(x)) for x in _signed(seeds(trees, 41))]))
    rows, depth, leaves, found = _branch(classes.withColumn("path", roots).select("path", "key", "n", "sig"), 0), 1, [], None
    while True:
        heavy = stored(rows.groupBy("path").count().where(F.col("count") > node_rows))
        if heavy.isEmpty():
            break
        rows = stored(rows)
        leaves.append((rows.join(heavy, "path", "left_anti"), depth))
        rows = rows.join(heavy.select("path"), "path", "left_semi")
        if depth >= MOST_DEPTH:
            found, rows = _unparted(rows, heavy, node_rows), None
            break
        rows, depth = _branch(rows, depth), depth + 1
    if rows is not None:
        leaves.append((rows, depth))
    for part, at in leaves:
        here = part.groupBy("path").applyInPandas(_node(at), "a long, b long")
        found = here if found is None else found.unionByName(here)
    return found.distinct()


# --- confirmation ----------------------------------------------------------------------------------------------


def _bit(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    return splitmix(splitmix(ids.astype(np.int64).view(np.uint64)) ^ key.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)


def _filter_of(firsts: DataFrame) -> np.ndarray:
    """A Bloom filter of one bit for each (id, key), of FILTER_BITS bits whatever the number."""

    @F.pandas_udf("long")
    def bit(i: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(_bit(i.to_numpy(np.int64), k.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    bits = firsts.select(bit("id", "key").alias("b")).select(F.shiftright("b", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("bit"))
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    if got.num_rows:
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.view(np.uint64)


def full_sets(keyed: DataFrame, firsts: DataFrame, k: int) -> DataFrame:
    """(key, grams): the sorted shingles of each class in firsts (id, key), made again from the text of its first row."""
    bloom = _filter_of(firsts)

    def run(batches):
        for batch in chunks(batches, "text"):
            t = Texts(batch.column(1))
            g, off = shingle_sets(t, k)
            ids, key = np.asarray(batch.column(0)), _set_key(g, off)
            bit = _bit(ids, key)
            keep = np.flatnonzero((bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
            sets = pa.array([g[off[i] : off[i + 1]].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(_signed(key[keep])), sets], names=["id", "key", "grams"])

    return keyed.mapInArrow(run, "id long, key long, grams binary").join(firsts, ["id", "key"]).dropDuplicates(["key"]).select("key", "grams")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
    both = with_a.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def links_between(close: DataFrame, sets: DataFrame, parts: DataFrame, clusters: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): parts of one cluster that some link joins. close has key, n and sig of all that is in a cluster.

    Rows outside their cluster's largest part (minor rows) meet all rows of the cluster, in blocks of about `block` of
    either; the blocks that a row goes to are its cluster's size over block, and never its number of partners.
    """
    rows = close.select("key", "n", "sig").join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "sig", F.coalesce("root", "key").alias("part"))
    rows = stored(rows.join(clusters.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "sig", "part", F.coalesce("root", "key").alias("cluster")))
    sizes = rows.groupBy("cluster", "part").agg(F.count("*").alias("c"))
    shape = sizes.groupBy("cluster").agg(F.sum("c").alias("all"), F.max(F.struct("c", "part")).alias("top"), F.count("*").alias("p")).where("p > 1")
    shape = shape.select("cluster", F.col("top.part").alias("largest"), F.ceil(F.col("all") / block).alias("blocks"), F.ceil((F.col("all") - F.col("top.c")) / block).alias("minors"))
    met = rows.join(shape, "cluster").join(sets, "key")
    turn = F.xxhash64("key")
    every = met.withColumn("x", F.pmod(turn, F.col("blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1))).withColumn("minor", F.lit(False))
    minor = met.where("part <> largest").withColumn("y", F.pmod(turn, F.col("minors"))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("minor", F.lit(True))
    columns = ["cluster", "x", "y", "minor", "key", "n", "sig", "part", "grams"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(-1, POSITIONS)
        n, part, minor_ = group["n"].to_numpy(), group["part"].to_numpy(), group["minor"].to_numpy()
        grams = [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]]
        found: set[tuple[int, int]] = set()
        for i in np.flatnonzero(minor_):
            near = _near(sig, n, int(i))
            for j in np.flatnonzero((near > 0) & ~minor_ & (part != part[i])):
                pair = min(part[i], part[j]), max(part[i], part[j])
                if pair in found:
                    continue
                both = np.intersect1d(grams[i], grams[j], assume_unique=True).size
                if 100 * both >= percent * (grams[i].size + grams[j].size - both):
                    found.add(pair)
        out = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return every.select(columns).unionByName(minor.select(columns)).groupBy("cluster", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trees: int = TREES, node_rows: int = NODE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash), one row for each row of docs.

    Words are runs of bytes other than white space, A-Z lowered; a document's set is its distinct shingles of so many
    words, or its whole sequence of words if that is shorter. Documents are linked if their sets' similarity is at
    least percent, and component_id is the least id that links lead to. Null, empty and blank texts have the empty
    set, are linked with nothing and kept. Null ids are the least of all ids. Repeated rows are of one class; the rows
    that share a component's least id are all kept. Other columns are not read, whatever their names.
    """
    keyed = _keyed(docs, id_col, text_col)
    rows = stored(signatures(keyed, words))
    classes = stored(rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("id").alias("id")))
    pairs = stored(candidate_pairs(classes.select("key", "n", "sig"), trees, node_rows))
    close = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    close = stored(classes.join(close, "key"))
    sets = stored(full_sets(keyed, close.select("id", "key"), words))
    links = stored(confirmed(pairs, sets, percent))
    parts = connected_components(links)
    between = stored(links_between(close, sets, parts, connected_components(pairs), percent))
    if not between.isEmpty():  # parts are named by their least key, so that links of parts are links
        parts = connected_components(links.unionByName(between))
    roots = classes.select("key", "id").join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    least = roots.groupBy("root").agg(F.min("id").alias("least"))
    of_class = roots.join(least, "root").select("key", "least")
    out = rows.where("n > 0").select("id", "key", "n", "text_hash").join(of_class, "key").select("id", "n", "least", "text_hash")
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("least"), "text_hash"))
    null = F.lit(-(1 << 63))
    return out.select(
        F.when(F.col("id") != null, F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("least") != null, F.col("least")).alias("component_id"),
        (F.col("id") == F.col("least")).alias("kept"),
        "text_hash",
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, one of each component; of rows that share id and text, one."""
    kept = near_duplicates(docs, words, percent, trees, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias("__tf_id"), F.col("text_hash").alias("__tf_h"))
    keyed = docs.withColumn("__tf_x", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    met = keyed.join(stored(kept.distinct()), (F.col(id_col).cast("long").eqNullSafe(F.col("__tf_id"))) & (F.col("__tf_x") == F.col("__tf_h")), "left_semi")
    return met.dropDuplicates([id_col, "__tf_x"]).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


#: Exact sets, all pairs that share a shingle, and what the links reach. Equal sets are one class, as in the operator.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(a) < 2 THEN a ELSE list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) END)) AS g FROM w),
k AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY g) ELSE doc_id END AS class FROM s),
e AS (SELECT s.doc_id AS class, len(s.g) AS n, unnest(s.g) AS g FROM s JOIN k ON k.doc_id = s.doc_id AND k.class = k.doc_id),
l AS (SELECT a.class AS a, b.class AS b FROM e a JOIN e b ON a.g = b.g AND a.class < b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT class AS node, class AS root FROM k UNION SELECT d.b, c.root FROM c JOIN d ON d.a = c.node WHERE c.root < d.b),
r AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT k.doc_id, k.n AS n_shingles, r.root AS component_id, k.doc_id = r.root AS kept FROM k JOIN r ON r.node = k.class
"""
