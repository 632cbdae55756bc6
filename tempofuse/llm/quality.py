"""Quality rules: base counts and a calibrated n-gram model (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempofuse.llm.common import IS_SPACE, Texts, chunks, prefix_hash, span_hash, splitmix

#: Fixed thresholds.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_AT = 0.3
#: Labelled rows that the model is fitted on, at most: those of the least hash of doc_id.
TRAIN_ROWS = 3000
BITS = 16
FEATURES = 1 << BITS
SCALE = 20.0
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end, row = t.words()
    prefix = prefix_hash(t.buf)
    n_words = np.bincount(row, minlength=t.n)
    space = IS_SPACE[t.buf]
    out = {"n_words": n_words, "word_chars": _sums(~space & ((t.buf & 0xC0) != 0x80), t.off), "n_symbols": _sums(_SYMBOL[t.buf], t.off)}

    # lines that have a word, by hash and row
    breaks = np.flatnonzero(t.buf == 10)
    line_start = np.unique(np.concatenate([t.off[:-1], breaks + 1]))
    line_start = line_start[line_start < len(t.buf)]
    line_end = np.append(line_start[1:], len(t.buf))
    ends_in_break = t.buf[line_end - 1] == 10 if len(line_end) else np.zeros(0, bool)
    stop = line_end - ends_in_break
    inside = np.zeros(len(t.buf) + 1, dtype=np.int64)
    np.cumsum(~space, out=inside[1:])
    has = inside[stop] > inside[line_start]
    s, e = line_start[has], stop[has]
    line_row = np.searchsorted(t.off, s, side="right") - 1
    key = span_hash(prefix, s, e) ^ splitmix(line_row.astype(np.uint64))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=t.n) - np.bincount(line_row[first], minlength=t.n)

    # words in windows of eight that the text has twice or more
    repeat = np.zeros(t.n, dtype=np.int64)
    if len(start) >= 8:
        h = span_hash(prefix, start, end)
        m = len(h) - 7
        win = np.zeros(m, dtype=np.uint64)
        for k in range(8):
            win = win * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        at = np.flatnonzero(row[:m] == row[7:])
        keys = splitmix(win[at]) ^ splitmix(row[at].astype(np.uint64))
        order = np.argsort(keys)
        same = np.zeros(len(order) + 1, dtype=bool)
        same[1:-1] = keys[order][1:] == keys[order][:-1]
        twice = at[order[same[1:] | same[:-1]]]
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 8, -1)
        repeat = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=t.n)
    out["n_repeat_words"] = repeat
    return {k: v.astype(np.int64) for k, v in out.items()}


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket, row and weight of each hashed n-gram: words alone and in pairs, and characters in threes (of bytes)."""
    start, end, row = t.words()
    h = span_hash(prefix_hash(t.buf), start, end)
    pair = splitmix(h[:-1] * np.uint64(3) + h[1:])[row[:-1] == row[1:]] if len(h) else h
    b = t.buf.astype(np.uint64)
    tri = splitmix(b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16)) | np.uint64(1 << 40)) if len(b) > 2 else b[:0]
    at = np.searchsorted(t.off, np.arange(len(tri)), side="right") - 1 if len(tri) else np.zeros(0, np.int64)
    whole = (t.off[at + 1] - np.arange(len(tri)) >= 3) if len(tri) else np.zeros(0, bool)
    rows = [row, row[:-1][row[:-1] == row[1:]] if len(h) else row, at[whole]]
    codes = [h, pair, tri[whole]]
    weight = [1.0 / np.maximum(np.bincount(r, minlength=t.n), 1)[r] for r in rows]
    bucket = np.concatenate([(c >> np.uint64(64 - BITS)).astype(np.int64) for c in codes])
    return bucket, np.concatenate(rows), np.concatenate(weight) * SCALE


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, t: Texts) -> np.ndarray:
        bucket, row, weight = features(t)
        return self.bias + np.bincount(row, weights=self.weights[bucket] * weight, minlength=t.n)

    def probability(self, t: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(t) + self.shift, -40, 40)))


def fit(texts: pa.Array, labels: np.ndarray, steps: int = 60, l2: float = 1e-3) -> Model:
    """Logistic regression by Adam over all rows, then Platt's scale and shift on a quarter that it has not seen."""
    labels = np.asarray(labels, dtype=float)
    n = len(labels)
    if n < 8 or labels.min() == labels.max():  # nothing to learn from: the base rules decide alone
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, 40.0)
    # one entry for each row and bucket, made in chunks
    parts, first = [], 0
    for batch in chunks([pa.RecordBatch.from_arrays([texts], names=["t"])], "t", 1 << 19):
        bucket, row, weight = features(Texts(batch.column(0)))
        key, inverse = np.unique(row * FEATURES + bucket, return_inverse=True)
        parts.append(((first + key // FEATURES).astype(np.int32), (key % FEATURES).astype(np.int32), np.bincount(inverse, weights=weight).astype(np.float32)))
        first += batch.num_rows
    row, bucket, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    held = np.arange(n) % 4 == 3
    use = ~held[row]
    row_u, bucket_u, weight_u = row[use], bucket[use], weight[use]
    w, b = np.zeros(FEATURES), float(np.log((labels.mean() + 1e-3) / (1.001 - labels.mean())))
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row_u, weights=w[bucket_u] * weight_u, minlength=n)
        d = (1 / (1 + np.exp(-z)) - labels) * ~held / (~held).sum()
        g = np.append(np.bincount(bucket_u, weights=d[row_u] * weight_u, minlength=FEATURES) + l2 * w / n, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    z = (b + np.bincount(row, weights=w[bucket] * weight, minlength=n))[held]
    return Model(w.astype(np.float32), b, *platt(z, labels[held]))


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that make 1 / (1 + exp(-(slope z + shift))) likeliest, by Newton's method until it has converged.

    Labels are drawn in a little from 0 and 1, as Platt does, so that the result is finite for rows that z parts.
    """
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)

    def loss(t):
        return float(np.logaddexp(0, x @ t).sum() - target @ (x @ t))

    theta = np.array([0.0, float(np.log(target.mean() / (1 - target.mean())))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        g = x.T @ (p - target)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), g)
        step = 1.0
        while step > 1e-6 and loss(theta - step * move) > loss(theta):
            step /= 2
        theta = theta - step * move
        if np.abs(g).max() < 1e-6 * len(z):
            break
    return float(theta[0]), float(theta[1])


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, where=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most so many labelled rows, in the order of a hash of the id; the bound holds on the driver too."""
    ids = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy(id_col).agg(F.max(column).cast("int").alias("__tf_y")).orderBy(F.xxhash64(F.lit(7), id_col), id_col).limit(rows)
    got = docs.select(F.col(id_col), F.col(text_col).alias("__tf_t")).join(F.broadcast(ids), id_col).orderBy(F.xxhash64(F.lit(7), id_col), id_col).select("__tf_t", "__tf_y").limit(rows).toArrow()
    pa.default_memory_pool().release_unused()
    return got.column(0).combine_chunks(), got.column(1).to_numpy()


def score_quality(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, p_quality and kept added; columns of these names are replaced.

    Null text has no words, as the empty text, and fails the base rules. Every row is scored by itself, so repeated
    rows and rows of null ids score as any other.
    """
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, kept boolean"
    names = [x.split()[0] for x in added.split(", ")]
    docs = docs.drop(*names)
    schema = StructType(docs.schema.fields + StructType.fromDDL(added).fields)

    def run(batches):
        for batch in chunks(batches, text_col):
            t = Texts(batch.column(batch.schema.names.index(text_col)))
            c = base_counts(t)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            p = model.probability(t)
            more = [*c.values(), failed, p, ~failed & (p >= keep_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(*labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", TRAIN_ROWS))
    return score_quality(docs, model).drop("text")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_query(spark, sf_dir: str) -> DataFrame:
    """The base columns of op9_quality alone, which SQL can express."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, 40.0)).select("doc_id", *BASE, "base_failed")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
b AS (SELECT doc_id, t, a, len(a) AS n FROM w),
x AS (SELECT doc_id, i, array_to_string(a[i : i + 7], ' ') AS win FROM b, unnest(range(1, greatest(n - 6, 1))) u(i) WHERE n >= 8),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM x),
z AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM y, unnest(range(0, 8)) v(j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM b)
SELECT b.doc_id, b.n AS n_words, coalesce(list_sum(list_transform(b.a, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(b.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(l.ls) - len(list_distinct(l.ls)) AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words, (b.n < 20 OR 100 * coalesce(z.n, 0) > 30 * b.n) AS base_failed
FROM b JOIN l USING (doc_id) LEFT JOIN z USING (doc_id)
"""
