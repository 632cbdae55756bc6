"""Corpus-wide line deduplication with DataFrame functions alone (operator 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofuse.llm.common import stored

MIN_CHARS = 20
MIN_DOCS = 3
#: Rows of the table of repeated lines up to which it is broadcast (at most 60 bytes each); a shuffled join serves beyond it.
BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """A line without white space at both ends and with A-Z lowered."""
    # btrim with characters and translate stay in generated code; a regular expression would not
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text rebuilt from the lines kept, and n_lines, n_dropped (long) added.

    Lines whose key has at least min_chars code points and occurs in at least min_docs documents go, but for those in
    the document with the largest id that has it. A row is a document: repeated ids count as documents of their own
    and both keep their lines if they hold the largest id. Null ids count and never keep; null text is the empty text,
    and comes back empty. Columns other than the text pass through; existing n_lines and n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    # a row's identity: rows that share id and text have the same lines to drop
    row_id = [F.col(id_col).alias("__tf_id"), F.xxhash64(text).alias("__tf_h1"), F.xxhash64(F.lit(1), text).alias("__tf_h2")]
    exploded = docs.select(*row_id, F.posexplode(lines).alias("__tf_pos", "__tf_line")).withColumn("__tf_key", line_key(F.col("__tf_line"))).where(F.char_length("__tf_key") >= min_chars)
    hashed = exploded.select("__tf_id", "__tf_h1", "__tf_h2", "__tf_pos", F.xxhash64("__tf_key").alias("__tf_k1"), F.xxhash64(F.lit(1), F.col("__tf_key")).alias("__tf_k2"))

    distinct_keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars))
    repeated = (
        docs.select(F.col(id_col).alias("__tf_id"), F.explode(F.transform(distinct_keys, lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))).alias("__tf_k"))
        .groupBy(F.col("__tf_k.a").alias("__tf_k1"), F.col("__tf_k.b").alias("__tf_k2"))
        .agg(F.count(F.lit(1)).alias("__tf_n"), F.max("__tf_id").alias("__tf_keeper"))
        .where(F.col("__tf_n") >= min_docs)
        .select("__tf_k1", "__tf_k2", "__tf_keeper")
    )
    repeated = stored(repeated)
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    dropped = (
        hashed.join(side, ["__tf_k1", "__tf_k2"])
        .where(~F.col("__tf_id").eqNullSafe(F.col("__tf_keeper")))
        .groupBy("__tf_id", "__tf_h1", "__tf_h2")
        .agg(F.array_sort(F.collect_set("__tf_pos")).alias("__tf_drop"))
    )
    cuts = F.concat(F.array(F.lit(-1)), F.coalesce("__tf_drop", F.array().cast("array<int>")), F.array(F.size("__tf_lines")))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__tf_cuts") - 2), lambda i: F.slice(F.col("__tf_lines"), F.col("__tf_cuts")[i] + 2, F.col("__tf_cuts")[i + 1] - F.col("__tf_cuts")[i] - 1)))
    keyed = docs.select("*", *row_id)
    names = [c for c in docs.columns if c != text_col]
    rebuilt = (
        keyed.join(dropped.select(F.col("__tf_id").alias("__tf_id2"), F.col("__tf_h1").alias("__tf_h12"), F.col("__tf_h2").alias("__tf_h22"), "__tf_drop"), F.col("__tf_id").eqNullSafe(F.col("__tf_id2")) & (F.col("__tf_h1") == F.col("__tf_h12")) & (F.col("__tf_h2") == F.col("__tf_h22")), "left")
        .withColumn("__tf_lines", lines)
        .withColumn("__tf_cuts", cuts)
        .withColumn("n_lines", F.size("__tf_lines").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__tf_drop"), F.lit(0)).cast("long"))
        .withColumn("__tf_kept", F.when(F.col("__tf_drop").isNull(), text).otherwise(F.array_join(runs, "\n")))
    )
    return rebuilt.select(*[(F.col("__tf_kept").alias(text_col) if c == text_col else F.col(c)) for c in docs.columns], "n_lines", "n_dropped")


LINE_SQL = """
WITH l AS (
  SELECT rid, doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM {docs}))
), r AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3
), m AS (
  SELECT l.*, (r.k IS NOT NULL AND l.doc_id <> r.keeper) AS gone FROM l LEFT JOIN r ON l.k = r.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
FROM m GROUP BY rid, doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (" + LINE_SQL.format(docs="documents") + ")"
