"""The stages of the pipeline, each against a plain version on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempofuse.llm import decontam

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(900)]
    line = "This very line is found in many of the documents."
    out = []
    base = [r.choice(words) for _ in range(60)]
    item = [r.choice(words) for _ in range(40)]
    for k in range(60):
        kind = k % 6
        if kind == 0:
            w = list(base)
            w[r.randrange(60)] = f"x{k}"
            out.append(" ".join(w))
        elif kind == 1:
            out.append(" ".join(r.choice(words) for _ in range(30)) + f"\n{line}\n" + " ".join(r.choice(words) for _ in range(9)))
        elif kind == 2:
            out.append(" ".join([r.choice(words) for _ in range(20)] + item + [r.choice(words) for _ in range(5)]))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randint(5, 80))))
    return out, " ".join(item)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    t, item = texts()
    bad = {k: x + " you utter fool" for k, x in enumerate(t) if k % 10 == 3}
    rows = [(k, bad.get(k, x), "en", "web", len(bad.get(k, x))) for k, x in enumerate(t)] + [(60, None, "en", "web", 0), (61, "", None, "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in bad)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows, bad, item


def test_the_stages_are_those_of_the_task():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, world):
    sf, rows, bad, _ = world
    got = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert got.columns == COLUMNS
    kept = {r.doc_id for r in got.collect()}
    assert kept == {r[0] for r in rows} - set(bad)


def test_repeated_lines_go(spark, world):
    sf, rows, _, _ = world
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, docs, sf).collect()}
    holders = {}
    for i, t, *_ in rows:
        for k in {x.strip().lower() for x in (t or "").split("\n") if len(x.strip()) >= 20}:
            holders.setdefault(k, []).append(i)
    for i, t, *_ in rows:
        want = "\n".join(x for x in (t or "").split("\n") if not (len(h := holders.get(x.strip().lower(), [])) >= 3 and i != max(h)))
        assert got[i].text == want and got[i].n_chars == len(want)


def test_one_of_each_group_stays(spark, world):
    sf, rows, _, _ = world
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert kept == {i for i in sets if find(i) == i}


def test_leaks_go(spark, world):
    sf, rows, _, item = world
    got = corpus_pipeline.drop_leaks(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert got.columns == COLUMNS and {r.doc_id for r in got.collect()} == {r[0] for r in rows if item not in (r[1] or "")}


def test_the_whole_pipeline(spark, world):
    sf, rows, bad, item = world
    out = corpus_pipeline.run(spark, sf).toPandas()
    left = set(out.doc_id)
    assert not left & set(bad) and {60, 61} <= left
    assert not any(item in (t or "") for i, t, *_ in rows if i in left)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 4096 and (g["offset"] == g["length"].cumsum() - g["length"]).all()


def test_stages_on_nothing(spark, world):
    sf, *_ = world
    nothing = spark.read.parquet(f"{sf}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).collect() == []


def test_search_loses_few_of_the_windows_of_an_exact_search(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(4000)]
    items = [[r.choice(words) for _ in range(r.randint(12, 70))] for _ in range(25)]
    docs = []
    for k in range(120):
        w = list(r.choice(items))
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append([r.choice(words) for _ in range(r.randint(0, 90))] + w + [r.choice(words) for _ in range(r.randint(0, 90))])

    def grams(w):
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    def similar(a, b):
        from collections import Counter

        x, y = Counter(grams(a)), Counter(grams(b))
        both = sum((x & y).values())
        return both / (sum(x.values()) + sum(y.values()) - both)

    want = set()
    for d, w in enumerate(docs):
        have = set(grams(w))
        for i, item in enumerate(items):
            if have & set(grams(item)) and any(similar(w[a : a + len(item)], item) >= 0.8 for a in range(max(1, len(w) - len(item) + 1))):
                want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontam.find_benchmark(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string"), bench).where("contaminated")
    found = {(x.doc_id, int(i)) for x in got.select("doc_id", F.explode(F.split("item_ids", ",")).alias("i")).collect() for i in [x.i]}
    assert found <= want and len(want) > 60 and len(found) >= 0.98 * len(want)
