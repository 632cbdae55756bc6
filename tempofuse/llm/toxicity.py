"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempofuse.llm.common import LOWER, Texts, chunks, prefix_hash, span_hash, splitmix
from tempofuse.llm.quality import labelled

BITS = 20
BUCKETS = 1 << BITS
#: Labelled rows that the model is fitted on, at most: those of the least hash of doc_id outside the held-out fifth.
TRAIN_ROWS = 6000
REJECT_AT = 0.5
#: Bytes of a longer word's beginnings that count as features beside it.
STEMS = (4, 5)
#: A sentence is an offender from this score on.
SENTENCE_AT = 0.5
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True
#: ASCII that is neither letter nor digit is trimmed from words.
_TRIM = np.zeros(256, dtype=bool)
_TRIM[[i for i in range(128) if not chr(i).isalnum()]] = True


def sentence_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket and sentence of each word and stem; row, start and end of each sentence.

    A sentence ends with a stop or line break, or with its text; words are lowered (A-Z) and lose ASCII punctuation
    at both ends, so that neither case nor a stop hides a word.
    """
    low = LOWER[t.buf]
    sep = _TRIM[t.buf]
    inside = np.zeros(len(low) + 1, dtype=bool)
    inside[:-1] = ~sep
    before = np.zeros(len(low) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts, ends = inside & ~before, before & ~inside
    cut = t.off[:-1][t.off[:-1] < len(low)]
    starts[cut] |= inside[cut]
    cut = t.off[1:][t.off[1:] > 0]
    ends[cut] |= before[cut]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    prefix = prefix_hash(low)
    codes, of = [span_hash(prefix, start, end)], [np.arange(len(start))]
    for k in STEMS:  # beginnings of longer words, so that inflected and made-up endings share a weight
        long = np.flatnonzero(end - start > k)
        codes.append(splitmix(span_hash(prefix, start[long], start[long] + k) + np.uint64(k)))
        of.append(long)
    bucket = (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64)
    bounds = np.unique(np.concatenate([t.off[:-1], np.flatnonzero(_STOP[t.buf]) + 1]))
    bounds = bounds[bounds < len(low)]
    sentence = (np.searchsorted(bounds, start, side="right") - 1)[np.concatenate(of)]
    return bucket, sentence, np.searchsorted(t.off, bounds, side="right") - 1, bounds, np.append(bounds[1:], len(low))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: A text without words scores this: the share of label 1 among such training texts, drawn to the share of all.
    prior: float

    def sentence_scores(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        # a sentence counts a word once; most words have no weight
        hit = np.flatnonzero(self.weights[bucket])
        pair = np.unique(sentence[hit] * BUCKETS + bucket[hit])
        z = self.bias + np.bincount(pair // BUCKETS, weights=self.weights[pair % BUCKETS], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, t: Texts) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Score of each text by noisy-or over its sentences; of each sentence; and the sentences."""
        bucket, sentence, row, start, end = sentence_words(t)
        p = self.sentence_scores(bucket, sentence, len(row))
        silent = np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=t.n)
        doc = -np.expm1(silent)
        doc[np.bincount(row, minlength=t.n) == 0] = self.prior
        return doc, p, (row, start, end)


def fit(texts: pa.Array, labels: np.ndarray, steps: int = 60, l2: float = 3e-5, rare: int = 5, least: float = 0.7) -> Model:
    """Maximum likelihood of document labels under noisy-or of sentence scores, by Adam.

    Only words of at least so many training documents, and of log odds over least, get weights; these start at the odds.
    """
    y = np.asarray(labels, dtype=float)
    n = len(y)
    if n < 8 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -40.0, float(y.mean()) if n else 0.0)
    parts, first = [], 0
    for batch in chunks([pa.RecordBatch.from_arrays([texts], names=["t"])], "t", 1 << 19):
        parts.append((batch.column(0), first))
        first += batch.num_rows
    df, share = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for column, first in parts:
        bucket, sentence, row, _, _ = sentence_words(Texts(column))
        pair = np.unique(row[sentence] * BUCKETS + bucket)
        df += np.bincount(pair % BUCKETS, minlength=BUCKETS)
        share += np.bincount(pair % BUCKETS, weights=y[first + pair // BUCKETS], minlength=BUCKETS)
    rate = y.mean()
    log_odds = np.log((share + 20 * rate) / (df - share + 20 * (1 - rate))) - np.log(rate / (1 - rate))
    live = (df >= rare) & (log_odds > least)
    ids, k = np.cumsum(live) - 1, int(live.sum())
    rows, sentences, codes, before = [], [], [], 0
    for column, first in parts:
        bucket, sentence, row, _, _ = sentence_words(Texts(column))
        use = live[bucket]
        pair = np.unique(sentence[use] * BUCKETS + bucket[use])
        rows.append(first + row), codes.append(ids[pair % BUCKETS]), sentences.append(before + pair // BUCKETS)
        before += len(row)
    row, code, sentence = np.concatenate(rows), np.concatenate(codes), np.concatenate(sentences)
    w, b = 2 * log_odds[live], -7.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence, weights=w[code], minlength=len(row))
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1e-9, 1 - 1e-9)
        silent = np.bincount(row, weights=np.log1p(-p), minlength=n)
        whole = np.clip(-np.expm1(silent), 1e-6, 1 - 1e-9)
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        d = np.where(y[row] > 0, -p * (1 - whole[row]) / whole[row], p) / n
        g = np.append(np.bincount(code, weights=d[sentence], minlength=k) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[live] = w
    silent = np.ones(n, dtype=bool)
    silent[row] = False
    return Model(weights, float(b), float((y[silent].sum() + 20 * rate) / (silent.sum() + 20)))


def score_toxicity(docs: DataFrame, model: Model, reject_at: float = REJECT_AT, text_col: str = "text") -> DataFrame:
    """docs with score (double), predicted (int) and offenders added; columns of these names are replaced.

    offenders holds start and end (bytes of the UTF-8 text) and score of each sentence that scores SENTENCE_AT or
    more. Null and empty texts have no sentence and score the model's prior. Rows are scored one by one, so repeated rows and null ids
    score as any other.
    """
    names = ["score", "predicted", "offenders"]
    docs = docs.drop(*names)
    schema = StructType(docs.schema.fields + StructType.fromDDL("score double, predicted int, offenders array<struct<start:long,end:long,score:double>>").fields)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in chunks(batches, text_col):
            t = Texts(batch.column(batch.schema.names.index(text_col)))
            doc, p, (row, start, end) = model.score(t)
            hit = np.flatnonzero(p >= SENTENCE_AT)
            spans = pa.StructArray.from_arrays([pa.array(start[hit] - t.off[row[hit]]), pa.array(end[hit] - t.off[row[hit]]), pa.array(p[hit])], names=["start", "end", "score"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=t.n))]).astype(np.int32)
            offenders = pa.ListArray.from_arrays(pa.array(offsets), spans).cast(kind)
            more = [pa.array(doc), pa.array((doc >= reject_at).astype(np.int32)), offenders]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that the model never learns from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return fit(*labelled(docs, labels, "toxic", rows, ~held_out()))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
