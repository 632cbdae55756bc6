"""Resampling, byte-level BPE and collocations against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
import tiktoken

from tempofuse.llm import byte_bpe, collocations, resample

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum Dolor, sit\tamet " * 60_000
TEXTS = ["One two three. One two three; four", None, "", " \n\t ", LONG, "é É ß", "é É ß", "no id", "x" * 3000]
IDS = [1, 2, 3, 4, 5, 6, 6, None, 7]
EXTRA = "source string, n_chars long, id long, word long, words long, n long, rank long, score long, weight long, ids string, code string, keep long, bucket long, phrase string, h long"


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", "en", None, "en", "und", "fr", "fr", None, "en"]
    extra = ("x", 1, 2, 3, 4, 5, 6, 7, 8, "y", "z", 9, 10, "w", 11)
    return spark.createDataFrame([(i, t, g, *extra) for i, t, g in zip(IDS, TEXTS, langs, strict=True)], f"doc_id long, text string, lang string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(frame, duck, sql):
    got, want = frame.toArrow(), duck.sql(sql).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    key = lambda r: tuple("" if r[c] is None else str(r[c]) for c in columns)
    assert sorted(map(key, got.to_pylist())) == sorted(map(key, want.to_pylist()))


# --- resampling -------------------------------------------------------------------------------------------------


def plain_resample(texts, ids, target, ngram=1, buckets=10_000, percent=10):
    def grams(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return ws, [" ".join(ws[i : i + k]) for k in range(1, ngram + 1) for i in range(len(ws) - k + 1)]

    def tally(ts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in ts for g in grams(t)[1])

    s, t = tally(texts), tally(target)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in zip(ids, texts, strict=True):
        ws, gs = grams(text)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws) >= 20, None])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(order[: percent * len(order) // 100]):
        r[5] = n + 1
    return sorted(tuple(r) for r in out)


@pytest.mark.parametrize("ngram, percent", [(1, 10), (3, 35), (2, 100), (1, 0)])
def test_resample_equals_the_plain_version(spark, ngram, percent):
    rng = random.Random(ngram)
    texts = [" ".join(rng.choice(["Red", "blue", "über", "x9", "a-b", "İ"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    target = ["red red blue", "über x9 x9", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), ngram=ngram, percent=percent).collect()
    assert sorted(map(tuple, rows)) == plain_resample(texts, range(300), target, ngram, percent=percent)


def test_resample_equals_sql(spark, duck):
    same(resample.query(spark, SF), duck, resample.SQL)


def test_words_in_blocks_are_those_of_the_whole():
    text = "Ab cd-ef " * 500 + "x" * 300 + " end" * 40
    for ngram in (1, 2, 4):
        whole, small = list(resample.codes(text.encode(), ngram)), list(resample.codes(text.encode(), ngram, 64))
        assert Counter(c for found, _ in small for c in found) == Counter(whole[0][0]) and sum(n for _, n in small) == whole[0][1]


def test_resample_odd_rows(docs, spark):
    rows = {(r.doc_id, r.n_features): r for r in resample.resample(docs, docs, percent=100).collect()}
    assert len(rows) == len(TEXTS) - 1 and rows[2, 0].weight == rows[4, 0].weight == 0
    assert rows[5, 300_000].rank == 1 and rows[6, 3].rank is None
    assert rows[None, 2].score == rows[None, 2].weight + resample.noise(None)
    assert resample.resample(docs.where("1 = 0"), docs).collect() == []
    assert len(resample.resample(docs, docs.where("1 = 0")).collect()) == len(TEXTS)


def test_one_id_in_a_third_of_all_rows(spark):
    docs = spark.range(900).selectExpr("if(id % 3 = 0, -1, id) as doc_id", "repeat('same words here ', 10) as text")
    ranks = sorted(r.rank for r in resample.resample(docs, docs, percent=50).collect() if r.rank)
    assert ranks == list(range(1, 451))


# --- byte-level BPE ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder()


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_equals_the_library_on_made_up_texts(library, encoder):
    rng = random.Random(3)
    signs = "abcdefgh IJK  \t\n\r\x1c\x85\xa0　'sdrv12٣½!@é中文\U0001f600́՘\U00011de0\U0003d000​﻿"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(30)) if not 0xD800 <= c < 0xE000) for _ in range(1000)]
    assert encoder.encode_all(texts) == [packed(library.encode_ordinary(t)) for t in texts]


def test_bpe_equals_the_library_on_every_letter_and_number_of_newer_unicode(library, encoder):
    texts = [lead + chr(c) + "a1" for lead in ("a", "1", "!", " ") for c in range(0x110000) if encoder.newer.match(chr(c))][::7]
    assert encoder.encode_all(texts) == [packed(library.encode_ordinary(t)) for t in texts]


def test_bpe_of_a_long_text_in_blocks(library, encoder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 50)
    for text in ("one  two \n\n three " * 40, "x" * 500, "word " * 100 + "\t\t end"):
        assert encoder.encode(text) == packed(library.encode_ordinary(text)) and len(list(encoder.blocks("a b " * 100))) > 5


def test_bpe_forgets_and_goes_on(library, encoder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_UNITS", 3)
    monkeypatch.setattr(byte_bpe, "MEMO_CHARS", 4)
    for text in ("several different words stand here", "and others come after", "several different words stand here"):
        assert encoder.encode_all([text, text[::-1]]) == [packed(library.encode_ordinary(t)) for t in (text, text[::-1])]


def test_bpe_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = byte_bpe.query(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = packed(library.encode_ordinary(docs[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_bpe_odd_rows(docs, library):
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(docs)).collect()
    assert sorted((r.text or "").encode() for r in rows) == sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for t in TEXTS)
    assert all(bytes(r.ids) == packed(library.encode_ordinary(r.text or "")) and r.source == "x" for r in rows)
    assert byte_bpe.round_trip(docs.where("1 = 0")).collect() == []


def test_unknown_ids_are_an_error():
    with pytest.raises(ValueError, match="id"):
        byte_bpe.Decoder().decode(packed([1 << 30]))


# --- collocations ------------------------------------------------------------------------------------------------


def plain_phrases(rows, min_count, top, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            f.update((lang or "und", *ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = {}
    for (lang, *ws), a in cands.items():
        if any(q[0] == lang and len(q) > len(ws) + 1 and any(list(q[i : i + len(ws)]) == ws for i in range(1, len(q) - len(ws) + 1)) and 100 * b >= 80 * a for q, b in cands.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, *ws[:k]] + f[lang, *ws[k:]]), k, f[lang, *ws[:k]], f[lang, *ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def some_rows():
    rng = random.Random(8)
    words = ["new", "York", "city", "the", "of", "état", "a-b", "x", "É"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "  ", "\n", "\x0b"]) for _ in range(rng.randrange(90))) for _ in range(120)]
    return [(rng.choice(["en", "fr", None, "und"]), t) for t in texts] + [("en", None), (None, ""), ("fr", "... !!")] + [("de", "guten Tag liebe Welt")] * 7


@pytest.mark.parametrize("limit, rank_rows, top", [(1 << 20, 200_000, 2000), (0, 20, 2000), (1 << 20, 10, 5)])
def test_collocations_equal_the_plain_version(spark, limit, rank_rows, top):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = collocations.find_collocations(docs, min_count=5, top=top, limit=limit, rank_rows=rank_rows).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 5, top)


def test_collocations_equal_sql(spark, duck):
    same(collocations.query(spark, SF), duck, collocations.SQL)


def test_a_long_text_is_cut_at_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 100)
    rows = [("en", "red fish, blue fish. red fish blue " * 200)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    t = collocations.Texts(docs.toArrow().column("text"))
    assert len(list(collocations._blocks(t))) > 10 and b"".join(b.tobytes() for b, _ in collocations._blocks(t)) == rows[0][1].encode()
    assert sorted(map(tuple, collocations.find_collocations(docs).collect())) == plain_phrases(rows, 30, 2000)


def test_words_that_share_a_key_are_told_apart():
    import numpy as np

    words = [np.array([1, 1, 2, 1], np.uint64), np.array([5, 5, 6, 5], np.uint64)]
    assert sorted(zip(*[x.tolist() for x in collocations.counted(words)], strict=True)) == [(1, 5, 3), (2, 6, 1)]
    real, collocations.phrase_key = collocations.phrase_key, lambda ws: np.zeros(len(ws[0]), np.uint64)
    try:
        a, b, n = collocations.counted(words)
    finally:
        collocations.phrase_key = real
    assert Counter({(1, 5): 3, (2, 6): 1}) == sum((Counter({(x, y): z}) for x, y, z in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)), Counter())


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    groups = spark.createDataFrame([([1], 3 * big), ([2], 2 * big), ([1, 2], big)], "words array<long>, n long")
    row = collocations.score_phrases(groups).first()
    assert (row.a, row.l, row.r, row.score) == (big, 3 * big, 2 * big, 2_000_000 * big // (5 * big))


def test_collocations_odd_rows(docs):
    got = sorted(map(tuple, collocations.find_collocations(docs).collect()))
    langs = ["en", "en", None, "en", "und", "fr", "fr", None, "en"]
    assert got == plain_phrases(list(zip(langs, TEXTS, strict=True)), 30, 2000) and got[0][0] == "und"
    assert collocations.find_collocations(docs.where("1 = 0")).collect() == []
