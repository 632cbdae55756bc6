"""Phrase collocations by set-oriented relational mining (operator 13).

The occurrences of words are a relation, persisted in the order of their places: each has a place and a word, and words
that follow each other in a piece of text have places that follow each other. Merge-joining it with itself at the next
place gives the phrases of the next length, whose groups are counted over the whole corpus; the semi-join with the
frequent groups leaves the relation that the length after is made of.

A row of the relation holds a block of about a megabyte of text, and no piece goes across blocks, so that merging needs
no shuffle: counts are what is shuffled. A word goes by a 64-bit hash of its language and bytes. The vocabulary tells
whether two words share a hash; if so, all is made again under another salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempofuse.llm.common import CHUNK_BYTES, LOWER, Texts, chunks, prefix_hash, seeds, span_hash, splitmix, stored, word_spans

LONGEST = 4
MIN_COUNT = 30
COVER_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
NO_LANG = "und"
SALTS = 8
#: Frequent groups of a length up to which the semi-join broadcasts their keys (8 bytes each); beyond it keys are shuffled.
BROADCAST_KEYS = 1 << 20
#: Candidates that one task ranks; more are ranked in parts first.
RANK_ROWS = 200_000

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_SEPARATOR = IS_BREAK.copy()
IS_SEPARATOR[list(b" \t")] = True

#: The relation: `word` are a block's different words, `code` the word of each occurrence, `gap` its place less that of
#: the one before (1 only within a piece), `begins` whether a frequent phrase of the length reached begins there.
RELATION = "word array<long>, code array<int>, gap array<tinyint>, begins array<boolean>"
_WORD = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
#: Blocks that a row group of a stored relation holds, so that no reader decodes many at once.
GROUP_ROWS = {"parquet.block.row.count.limit": 8}


def _one_row(*columns) -> list[pa.Array]:
    """Each array as the list of one row."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns]
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays]


# --- the relation of words -------------------------------------------------------------------------------------


def _blocks(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row offsets of a chunk of texts; a single long text is cut at the ends of pieces."""
    if t.n > 1 or len(t.buf) <= 2 * CHUNK_BYTES:
        yield t.buf, t.off
        return
    ends, at = np.append(np.flatnonzero(IS_BREAK[t.buf]) + 1, len(t.buf)), 0
    while at < len(t.buf):
        to = int(ends[min(np.searchsorted(ends, at + CHUNK_BYTES), len(ends) - 1)])
        yield t.buf[at:to], np.array([0, to - at])
        at = to


def occurrences(docs: DataFrame, salt: int = 0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The relation of words, and `words`: language, text and count of each of a block's different words. Every row of
    docs is a text; null texts have no words, and null languages are NO_LANG."""
    byte_code, lang_code = seeds(256, 1000 + salt) | np.uint64(1), seeds(256, 2000 + salt) | np.uint64(1)

    def run(batches):
        for batch in chunks(batches, "t"):
            names = batch.column(1).fill_null(NO_LANG)
            lang = Texts(names)
            lang_hash = span_hash(prefix_hash(lang.buf, lang_code), lang.off[:-1], lang.off[1:])
            for buf, off in _blocks(Texts(batch.column(0))):
                low = LOWER[buf]
                start, end, row = word_spans(low, off, IS_SEPARATOR)
                if not len(start):
                    continue
                breaks = np.cumsum(IS_BREAK[low])[start]
                gap = np.full(len(start), 2, dtype=np.int8)
                gap[1:] -= (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])
                h = splitmix(span_hash(prefix_hash(low, byte_code), start, end) ^ lang_hash[row])
                word, first, code = np.unique(h, return_index=True, return_inverse=True)
                data = low.tobytes()
                text = pa.array([data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
                of = pa.StructArray.from_arrays([names.take(pa.array(row[first])), text, pa.array(np.bincount(code))], fields=list(_WORD))
                yield pa.RecordBatch.from_arrays(_one_row(of, word.view(np.int64), code.astype(np.int32), gap, np.ones(len(code), dtype=bool)), names=["words", "word", "code", "gap", "begins"])

    schema = "words array<struct<lang:string,word:string,n:long>>, " + RELATION
    texts = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    return texts.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id())


def vocabulary(relation: DataFrame) -> DataFrame:
    """h, lang, word and n of each word of the corpus."""
    each = relation.select(F.explode(F.arrays_zip("word", "words")).alias("x")).select(F.col("x.word").alias("h"), "x.words.*")
    return each.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


# --- merging, counting, semi-joining ---------------------------------------------------------------------------


def phrase_key(words: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for each phrase."""
    key = words[0]
    for w in words[1:]:
        key = splitmix(key * np.uint64(3) + w)
    return key


def _rows(batches) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each row of a relation."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            yield {name: x.as_py() if name == "id" else x.values.to_numpy(zero_copy_only=False) for name, x in row.items()}


def merged(row: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Merge-join at the next place: the occurrences where phrases of k words begin, whose first and last k - 1 words
    are frequent phrases, and the words of each. For k = 1 these are all occurrences."""
    begins, m = row["begins"], max(len(row["code"]) - k + 1, 0)
    at = np.arange(m)
    if k > 1:
        place = np.cumsum(row["gap"], dtype=np.int64)
        at = np.flatnonzero(begins[:m] & begins[1 : m + 1] & (place[k - 1 :] - place[:m] == k - 1)) if m else at
    words = row["word"].view(np.uint64)[row["code"]]
    return at, [words[at + j] for j in range(k)]


def counted(words: list[np.ndarray]) -> list[np.ndarray]:
    """The different phrases, and how often each occurs."""
    _, first, group, n = np.unique(phrase_key(words), return_index=True, return_inverse=True, return_counts=True)
    odd = np.flatnonzero(np.any([w != w[first[group]] for w in words], axis=0))  # another phrase's key: each by itself
    n = n - np.bincount(group[odd], minlength=len(n))
    return [np.concatenate([w[first], w[odd]]).view(np.int64) for w in words] + [np.concatenate([n, np.ones(len(odd), np.int64)])]


def count_groups(relation: DataFrame, k: int, min_count: int = MIN_COUNT) -> DataFrame:
    """w1 ... wk and n of the frequent phrases of k words: counted by block, and by group over the corpus."""
    columns = [f"w{j + 1}" for j in range(k)]

    def run(batches):
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in counted(merged(row, k)[1])], names=[*columns, "n"])

    pairs = relation.select("word", "code", "gap", "begins").mapInArrow(run, ", ".join(f"{c} long" for c in [*columns, "n"]))
    return pairs.groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def semi_join(relation: DataFrame, groups: DataFrame, k: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The relation of length k: the words that are part of a frequent phrase of k words, and where such ones begin.

    Groups meet occurrences by a key of their words. A phrase that shares the key of a frequent one stays too; it is
    told apart when the next length is counted by its words.
    """
    columns = [f"w{j + 1}" for j in range(k)]

    def to_keys(batches):
        for batch in batches:
            key = phrase_key([batch.column(c).to_numpy().view(np.uint64) for c in columns])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    def row_keys(batches):
        for row in _rows(batches):
            key = np.unique(phrase_key(merged(row, k)[1])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row["id"])), pa.array(key)], names=["id", "key"])

    keys = stored(groups.select(columns).mapInArrow(to_keys, "key long").distinct())
    relation, known = relation.select("id", "word", "code", "gap", "begins"), None
    if keys.count() <= limit:
        known = relation.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy().view(np.uint64)))
    else:
        found = relation.mapInArrow(row_keys, "id long, key long").join(keys, "key", "left_semi")
        relation = relation.join(found.groupBy("id").agg(F.collect_list("key").alias("known")), "id")

    def run(batches):
        for row in _rows(batches):
            at, words = merged(row, k)
            at = at[_among(phrase_key(words), np.sort(row["known"].view(np.uint64)) if known is None else known.value)]
            if not len(at):
                continue
            begins = np.zeros(len(row["code"]), dtype=bool)
            begins[at] = True
            stays = np.zeros(len(begins), dtype=bool)
            for j in range(k):
                stays[at + j] = True
            used, code = np.unique(row["code"][stays], return_inverse=True)
            gap = np.diff(np.cumsum(row["gap"], dtype=np.int64)[stays], prepend=0)
            columns = _one_row(row["word"][used], code.astype(np.int32), np.minimum(gap, 2).astype(np.int8), begins[stays])
            yield pa.RecordBatch.from_arrays([pa.array([row["id"]]), *columns], names=["id", "word", "code", "gap", "begins"])

    return relation.mapInArrow(run, "id long, " + RELATION)


def mine(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang", limit: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (h, lang, word, n), and words (hashes) and n of each frequent phrase of 1 to longest words."""
    for salt in range(SALTS):
        relation = stored(occurrences(docs, salt, text_col, lang_col), GROUP_ROWS)
        known = stored(vocabulary(relation))
        if known.groupBy("h").count().where("count > 1").isEmpty():
            break
    else:
        raise ValueError("words that share their hash under every salt")
    groups = known.where(F.col("n") >= min_count).select(F.col("h").alias("w1"), "n")
    out = groups.select(F.array("w1").alias("words"), "n")
    for k in range(2, longest + 1):
        relation = stored(semi_join(relation, groups, k - 1, limit), GROUP_ROWS)
        groups = stored(count_groups(relation, k, min_count))
        out = out.unionByName(groups.select(F.array(*[f"w{j + 1}" for j in range(k)]).alias("words"), "n"))
    return known, stored(out)


# --- scores ----------------------------------------------------------------------------------------------------


def score_phrases(groups: DataFrame, cover_percent: int = COVER_PERCENT, scale: int = SCALE) -> DataFrame:
    """words, a, l, r and score of the phrases of two words and more that no longer one covers.

    groups has words and n of all frequent phrases; a part of a frequent phrase is frequent, so that both sides of each
    cut are found. Products are decimals of 38 digits.
    """
    phrases = groups.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cut = phrases.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("*", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, F.size("words")).alias("right"))
    cut = cut.join(groups.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(groups.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr(f"(cast(a as decimal(38,0)) * {scale}) div (cast(l as decimal(38,0)) + r)")
    best = cut.groupBy("words").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = phrases.where(F.size("words") > 2).select("words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    longer = longer.select("a", "m", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at"))
    longer = longer.groupBy(F.slice("words", F.col("at"), F.col("m")).alias("words")).agg(F.max("a").alias("longer"))
    covered = F.expr(f"100 * cast(longer as decimal(38,0)) >= {cover_percent} * cast(a as decimal(38,0))")
    return best.join(longer, "words", "left").where(~F.coalesce(covered, F.lit(False))).select("words", "a", "cut.l", "cut.r", "cut.score")


def find_collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, cover_percent: int = COVER_PERCENT, text_col: str = "text", lang_col: str = "lang", limit: int = BROADCAST_KEYS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `top` phrases of each language.

    Every row of docs counts, repeated ones as often as they occur; null texts are empty, null languages are NO_LANG, and
    other columns are not read, whatever their names. Equal scores and counts go by the phrase's bytes, so that there
    are no ties. An empty table, or one without a frequent phrase, gives an empty result.
    """
    known, groups = mine(docs, longest, min_count, text_col, lang_col, limit)
    scored = stored(score_phrases(groups, cover_percent))
    word = scored.select("words", F.posexplode("words").alias("pos", "h")).join(known.select("h", "lang", "word"), "h")
    named = word.groupBy("words").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = scored.join(named, "words").select("lang", "phrase", "a", "l", "r", "score", "words")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, scored.count() // rank_rows)
    first = named.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = known.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return find_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS (
  SELECT lang, k, p, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS p FROM words, range(1, 5) t(k) WHERE len(w) >= k) GROUP BY ALL
), cand AS (
  SELECT lang, k, p, f AS a FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, j, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1 : ]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), inner_parts AS (
  SELECT lang, p[i : i + m - 1] AS p, max(a) AS longer FROM cand, range(2, 4) t(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), kept AS (
  SELECT best.*, array_to_string(p, ' ') AS phrase FROM best LEFT JOIN inner_parts USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
