"""Importance resampling of documents towards the words of target texts (operator 11).

A 256-byte table lower-cases A-Z and blanks separators of the UTF-8 bytes, so that bytes.split() gives the words;
n-grams extend their words' CRC by chained seeds, and Counters reduce them to buckets. Counts of all documents and of
all target texts make a gain for each bucket, a document's weight is its mean gain, and the documents of the highest
weight with Gumbel noise are drawn: sampling without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempofuse.llm.common import chunks, stored

BUCKETS = 10_000
NGRAM = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Bytes of a text that are split at once; longer texts are read in blocks that end between words.
BLOCK_BYTES = 1 << 20

#: What each byte becomes: digits, letters and all bytes of other characters stay, A-Z are lowered, the rest separates.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes, keep: int = 0, limit: int = BLOCK_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in blocks, each with the last `keep` words before it, and how many these are."""
    clean, at, before = text.translate(TABLE), 0, []
    while at < len(clean):
        to = at + limit
        if to < len(clean):
            cut = clean.rfind(b" ", at, to)
            to = cut + 1 if cut >= 0 else clean.find(b" ", to) + 1 or len(clean)
        block = before + clean[at:to].split()
        yield block, len(before)
        before, at = block[max(len(block) - keep, 0) :] if keep else [], to


def codes(text: bytes, ngram: int = NGRAM, limit: int = BLOCK_BYTES) -> Iterator[tuple[list[int], int]]:
    """CRC-32 of each run of 1 to ngram words joined by one space, in lists, and the number of new words of each list."""
    for block, old in words(text, ngram - 1, limit):
        seeds = list(map(crc32, block))
        found = seeds[old:]
        for k in range(1, ngram):
            seeds = [crc32(word, crc32(b" ", seed)) for seed, word in zip(seeds, block[k:], strict=False)]
            found += seeds[max(old - k, 0) :]
        yield found, len(block) - old


def bucket_counts(docs: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n (long): the features of all texts in each bucket that has any. Null texts have none."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in chunks(batches, text_col):
            tally: Counter[int] = Counter()
            for text in batch.column(0).cast(pa.large_binary()).fill_null(b"").to_pylist():
                for found, _ in codes(text, ngram):
                    tally.update(found)
            code = np.fromiter(tally.keys(), dtype=np.int64, count=len(tally))
            np.add.at(total, code % buckets, np.fromiter(tally.values(), dtype=np.int64, count=len(tally)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the counts of bucket_counts(): at most `buckets` rows each come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, frame in ((s, source), (t, target)):
        got = frame.toArrow()
        counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    above, below = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * above / ((a + 1) * below))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id; a null id counts as no digits."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM, seed: int = SEED, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score (long) and eligible (boolean) of each row of docs."""
    schema = StructType([docs.schema[id_col]] + StructType.fromDDL("n_features long, weight long, score long, eligible boolean").fields)
    buckets = len(gain)

    def run(batches):
        for batch in chunks(batches, text_col):
            ids, n_features, weight, score, eligible = batch.column(0), [], [], [], []
            for doc_id, text in zip(ids.to_pylist(), batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist(), strict=True):
                n = total = n_words = 0
                for found, new in codes(text, ngram):
                    total += int(gain[np.array(found, dtype=np.int64) % buckets].sum())
                    n, n_words = n + len(found), n_words + new
                n_features.append(n), eligible.append(n_words >= min_words)
                weight.append(total // n if n else 0)
                score.append(weight[-1] + noise(doc_id, seed))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_features, weight, score)), pa.array(eligible, pa.bool_())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def draw(scored: DataFrame, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """scored with rank (long): 1, 2, 3... by score for the given share of the eligible rows, null for all others.

    Scores are whole numbers within some ten thousands of zero, whatever the input, so that their counts tell the lowest
    score drawn; only rows of that score and above are sorted, in ranges, and numbered by their ranges' sizes. Equal
    scores go by the smaller id, null ids last.
    """
    scored = stored(scored.withColumn("__tf_row", F.monotonically_increasing_id()))
    counts = scored.where("eligible").groupBy("score").count()
    running = counts.select("score", F.sum("count").over(Window.orderBy(F.desc("score"))).alias("upto"), F.sum("count").over(Window.partitionBy()).alias("n"))
    first = running.where(F.col("upto") >= F.expr(f"n * {percent} div 100")).agg(F.max("score").alias("cut"), F.expr(f"max(n) * {percent} div 100").alias("k")).first()
    k = first.k or 0
    drawn = F.col("eligible") & (F.col("score") >= (first.cut if k else 0)) & F.lit(k > 0)
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("__tf_row")]
    top = scored.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order)
    top = stored(top.withColumn("__tf_p", F.spark_partition_id()).withColumn("__tf_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes, base = top.groupBy("__tf_p").count().orderBy("__tf_p").collect(), []
    for p, c in sizes:  # one row for each range
        base.append((p, base[-1][2] if base else 0, c + (base[-1][2] if base else 0)))
    starts = scored.sparkSession.createDataFrame(base, "__tf_p int, __tf_first long, __tf_end long")
    number = F.col("__tf_first") + F.col("__tf_i") + 1
    top = top.join(F.broadcast(starts), "__tf_p").withColumn("rank", F.when(number <= k, number))
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    columns = [c for c in scored.columns if c not in ("__tf_row", "rank")] + ["rank"]
    return top.select(columns).unionByName(rest.select(columns))


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, eligible and rank of each row of docs; target has a column `text` too.

    All rows count, repeated ones as often as they occur; null and empty texts have no features, weight 0 and are never
    drawn; a null id has one fixed noise. Without target texts all gains speak for rare buckets; an empty docs gives an
    empty result. Other columns are not read, whatever their names.
    """
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, "text", ngram, buckets), buckets)
    return draw(score_documents(docs, gain, ngram, seed, min_words, id_col, text_col), percent, id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 by its table of 256 values, once for each different word.
SQL = r"""
WITH tab AS (
  SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT) AS v FROM range(256) r(b))
), texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT kind, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), each_word AS (
  SELECT kind, rid, word, count(*) AS c FROM (SELECT kind, rid, unnest(ws) AS word FROM split) GROUP BY ALL
), hexed AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each_word)
), coded AS (
  SELECT word, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i : i + 1])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM hexed, tab
), counts AS (
  SELECT bucket, sum(c) FILTER (WHERE kind = 'd') AS s, sum(c) FILTER (WHERE kind = 'b') AS t FROM each_word JOIN coded USING (word) GROUP BY bucket
), whole AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM counts
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS g FROM counts, whole
), weighed AS (
  SELECT split.rid, any_value(split.doc_id) AS doc_id, coalesce(sum(c), 0)::BIGINT AS n_features, coalesce(sum(c * g), 0)::BIGINT AS total
  FROM split LEFT JOIN each_word ON each_word.kind = 'd' AND each_word.rid = split.rid LEFT JOIN coded USING (word) LEFT JOIN gain USING (bucket) WHERE split.kind = 'd' GROUP BY split.rid
), scored AS (
  SELECT rid, doc_id, n_features, CASE WHEN n_features = 0 THEN 0 ELSE (total - ((total % n_features + n_features) % n_features)) // n_features END AS weight,
   ('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT AS h FROM weighed
), final AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM final WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM final LEFT JOIN ranked USING (rid)
"""
