"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tempofuse.llm import decontam, html_text, line_dedup, near_dedup, packing, pii, quality, sharding, suffix_dedup, toxicity

EXTRA = "source string, n_chars long, id long, key long, size long, kept boolean, score double, spans string, shard int, piece int, n_words long, h long, path long, `count` long"
LONG = "word " * 30_000
ROWS = [(1, "Plain words here.\nA second line of the text, long enough to count."), (2, None), (3, ""), (4, " \n\t\n "), (5, LONG), (6, "é"), (6, "é"), (None, "no id at all but words"), (7, "Plain words here.\nA second line of the text, long enough to count.")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (None, 5, 6, 7, 8, True, 0.5, "x", 1, 2, 3, 4, 5, 6)
    return spark.createDataFrame([(i, t, *extra) for i, t in ROWS], f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("1 = 0")


def quality_model():
    import pyarrow as pa

    return quality.fit(pa.array(["good words in a row"] * 8 + ["### $$$ ###"] * 8), [1] * 8 + [0] * 8, steps=10)


def toxic_model():
    import pyarrow as pa

    return toxicity.fit(pa.array(["you utter fool", "what a fool", "nice day", "good work"] * 8), [1, 1, 0, 0] * 8, steps=20)


FIELD = pii.train(pii.labelled_table(60), steps=5)
OPERATORS = {
    "near_dedup": lambda d: near_dedup.near_duplicates(d),
    "keep_one": lambda d: near_dedup.keep_one(d),
    "pii": lambda d: pii.find_pii(d, FIELD),
    "sharding": lambda d: sharding.shard_documents(d),
    "packing": lambda d: packing.pack_documents(d),
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "decontam": lambda d: decontam.find_benchmark(d, d.sparkSession.createDataFrame([(1, "A second line of the text"), (2, None), (None, "é"), (3, "")], "item_id long, text string")),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxic_model()),
    "quality": lambda d: quality.score_quality(d, quality_model()),
    "suffix_dedup": lambda d: suffix_dedup.dedup_substrings(d),
    "html": lambda d: html_text.extract_pages(d, "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    # packing cuts the long text, of 30,001 tokens with its end, into eight pieces
    assert len(rows) == {"keep_one": 7, "packing": len(ROWS) + 7}.get(name, len(ROWS))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_empty_texts_stay_alone_and_copies_meet(docs):
    rows = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(docs).collect()}
    assert all(rows[i, 0].component_id == i and rows[i, 0].kept for i in (2, 3, 4))
    assert not rows[7, 12].kept and rows[7, 12].component_id == 1


def test_a_text_of_many_equal_words_is_one_shingle(docs):
    assert near_dedup.near_duplicates(docs).where("doc_id = 5").first().n_shingles == 1


def test_null_text_gives_the_empty_digest(docs):
    row = pii.find_pii(docs, FIELD).where("doc_id = 2").first()
    assert row.base_sha256.startswith("e3b0c442") and row.spans == "" and row.n_email == 0


def test_shards_are_gapless(docs):
    rows = sharding.shard_documents(docs, 3).collect()
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.doc_id: r["size"] for r in rows}[2] == 1


def test_empty_document_is_the_end_id(docs):
    rows = packing.pack_documents(docs).where(F.col("doc_id").isin(2, 3)).collect()
    assert [(r.piece, r.start, r.length) for r in rows] == [(0, 0, 1)] * 2


def test_packing_of_odd_rows_is_whole(docs):
    rows = packing.pack_documents(docs).toPandas()
    long = rows[rows.doc_id == 5].sort_values("piece")
    assert long.piece.tolist() == list(range(8)) and long.start.tolist() == [4096 * k for k in range(8)] and long["length"].tolist() == [4096] * 7 + [30_001 - 7 * 4096]
    assert rows.doc_id.isna().sum() == 1 and (rows.doc_id == 6).sum() == 2
    assert rows.sequence_id.nunique() == -(-rows["length"].sum() // 4096)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 4096 and (g["offset"] == g["length"].cumsum() - g["length"]).all()


def test_components_of_a_star_and_a_chain(spark):
    """A node that a third of all edges have, and a chain as long as it takes many rounds to fold."""
    from tempofuse.llm.components import connected_components

    star = spark.range(1, 5_000).selectExpr("5000 as a", "id as b")
    chain = spark.range(10_000, 10_300).selectExpr("id as a", "id + 1 as b")
    got = {r.node: r.root for r in connected_components(star.unionByName(chain).unionByName(chain.selectExpr("b as a", "b as b"))).collect()}
    assert got == {k: 1 for k in range(2, 5_001)} | {k: 10_000 for k in range(10_001, 10_301)}


def test_empty_line_of_a_null_text(docs):
    row = line_dedup.dedup_lines(docs).where("doc_id = 2").first()
    assert (row.text, row.n_lines, row.n_dropped) == ("", 1, 0)


def test_short_items_must_occur_whole(docs):
    rows = {r.doc_id: r for r in OPERATORS["decontam"](docs).where("doc_id is not null").collect()}
    assert rows[6].contaminated and rows[6].item_ids == "" and rows[1].contaminated and not rows[5].contaminated
