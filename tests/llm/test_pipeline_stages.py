"""Each stage of the corpus pipeline against a brute-force version, on odd rows and clashing columns."""

import random

import pytest
from test_operators import WORD, aligned, prose, removed

import corpus_pipeline
from tessera.llm import decontamination

DDL = "doc_id long, text string, lang string, source string, n_chars long, _key string, _row string, topic string, hits string, __weight string"
TABLES = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def make(spark, rows):
    """Rows of (doc_id, text), in three languages and two sources, null ones among them."""
    full = [(i, t, (None, "en", "fr")[n % 3], (None, "a")[n % 2], len(t or ""), "x", "x", "x", "x", "x") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DDL)


@pytest.fixture
def tables(spark, tmp_path):
    def write(**rows):
        for name, ddl in TABLES.items():
            spark.createDataFrame(rows.get(name, []), ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))


def test_toxic_documents_go(spark, tables):
    docs = [(i, f"vile words here w{i}" if i % 4 == 0 else f"calm words there w{i} z{i}") for i in range(200)]
    odd = [(None, "calm words there"), (None, None), (900, ""), (901, "calm " * 100_000), (902, "vile " * 100_000), (3, docs[3][1])]
    got = corpus_pipeline.drop_toxic(spark, make(spark, docs + odd), tables(labels=[(i, 1, int(i % 4 == 0)) for i in range(200)])).collect()
    assert ids(got) == sorted([i for i in range(200) if i % 4] + [3, 900, 901]) + [None, None] and got[0].asDict().keys() == set(corpus_pipeline.COLUMNS)


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_keep_one_of_each_group(spark, tables):
    rng = random.Random(2)
    texts = []
    for _ in range(6):
        words = prose(rng, 60).split()
        for changed in (0, 0, 1, 3, 9, 25):  # from copies to texts that share too little
            other = list(words)
            for i in range(changed):
                other[i * 60 // max(1, changed)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    texts += [None, "", " \n", "one", "ONE", "two words", prose(rng, 20_000)]
    rows = list(enumerate(texts)) + [(0, "another text of the same id"), (0, texts[0]), (7, texts[7])]
    rng.shuffle(rows)
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (x == y or 10 * len(x & y) >= 8 * len(x | y)) and label[i] != label[j]:
                label = [label[j] if k == label[i] else k for k in label]
    expected = sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label))
    got = corpus_pipeline.drop_near_duplicates(spark, make(spark, rows), "").collect()
    assert ids(got) == expected
    assert {(r.doc_id, r.text) for r in got} <= set(rows) and (0, "another text of the same id") in {(r.doc_id, r.text) for r in got}
    unnamed = corpus_pipeline.drop_near_duplicates(spark, make(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l")]), "").collect()
    assert sorted(r.text for r in unnamed) == ["a b c d e f", "g h i j k l"]


def test_repeats_are_cut(spark, tables):
    rng = random.Random(3)
    shared = prose(rng, 50)
    texts = [shared + " " + prose(rng, 30), prose(rng, 30) + "\n" + shared, shared, "as\tit\nwas  " + prose(rng, 40), None, "", prose(rng, 25_000)]
    rows = [*enumerate(texts), (None, "no id at all")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeats(spark, make(spark, rows), "").collect()}
    cut = removed([t for _, t in rows])
    assert set(got) == {i for (i, _), (n, gone, _) in zip(rows, cut, strict=True) if not gone or gone < n} == {0, 1, 3, 4, 5, 6, None}
    assert got[3][0] == texts[3] and got[0][0] == texts[0][len(shared) + 1 :] and got[4] == ("", 0) and got[1][0] == texts[1].split("\n")[0]


def test_leaks_go(spark, tables):
    rng = random.Random(5)
    items = [prose(rng, n, 300) for n in (30, 20)]
    edited = " ".join("zz" if i % 9 == 4 else w for i, w in enumerate(items[0].split()))
    texts = [prose(rng, 60, 300), "x " + items[0], edited, items[1].upper() + ".", None, "", prose(rng, 9000, 300), items[1]]
    rows = [*enumerate(texts), (None, "free of leaks"), (None, items[0])]
    score = lambda t: max(aligned(decontamination.tokens(b), decontamination.tokens(t)) / (2 * len(decontamination.tokens(b))) for b in items)
    got = corpus_pipeline.drop_leaks(spark, make(spark, rows), tables(benchmark=[*enumerate(items), (None, "x"), (9, None)])).collect()
    assert sorted((r.text or "") for r in got) == sorted((t or "") for _, t in rows if score(t) < 0.5)


def test_the_mix_draws_from_what_is_there(spark, tables):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(5, 60), 200)) for i in range(300)] + [(None, "no id"), (300, None), (301, ""), (302, "long " * 100_000), (0, "same id")]
    docs = make(spark, rows)
    got = corpus_pipeline.mix(spark, docs, "").collect()
    known = {(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()}
    assert 0 < len(got) < len(rows) and all((r.doc_id, r.text, r.lang, r.source) in known and 0 < r.probability <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.mix(spark, docs.repartition(7), "").collect()))
    assert {300, 301}.isdisjoint({r.doc_id for r in got})
