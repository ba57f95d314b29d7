"""The near-duplicates stage against brute force over all pairs."""

import random

import pytest
from test_operators import make, prose

import corpus_pipeline
from tessera.llm import shingle_dedup


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(rng, words, edits, tag):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"{tag}{rng.randrange(1000)}"
    return " ".join(out)


def corpus(rng):
    base, line = prose(rng, 300).split(), prose(rng, 12)
    texts = [None, "", "one", "ONE", "a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i"]
    texts += [edited(rng, base, rng.randrange(1, 12), f"n{i}_") for i in range(60)]
    texts += [line + " " + prose(rng, rng.randrange(2, 12)) for _ in range(60)]
    for n in range(40, 240, 10):  # pairs on either side of the limit
        words = prose(rng, n).split()
        texts += [" ".join(words), edited(rng, words, max(1, n // 50), "x").upper(), " ".join(words[: int(n * 0.81)])]
    return texts


@pytest.mark.parametrize(("crowd", "hubs"), [(32, 8), (2, 1), (10_000, 1)])
def test_links_are_all_pairs_from_the_limit_on(spark, crowd, hubs):
    texts = corpus(random.Random(4))
    got = shingle_dedup.near_duplicates(make(spark, texts), crowd, hubs).collect()
    low = {}
    for r in sorted(got):
        low.setdefault(r.root, r.doc_id)
    assert [low[r.root] for r in sorted(got)] == brute(texts) and len(got) == len(texts)
    assert shingle_dedup.near_duplicates(make(spark, texts).limit(0)).count() == 0


def test_stage_drops_copies_with_several_edits(spark, sf):
    rng = random.Random(7)
    words = prose(rng, 400).split()
    spaced = list(words)
    for i in range(20, 400, 50):
        spaced[i] = f"new{i}"
    texts = [" ".join(words), " ".join(spaced), prose(rng, 400)]
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, make(spark, texts), sf).orderBy("doc_id").collect()] == [0, 2]


def test_stage_keeps_different_texts_of_one_id(spark, sf):
    rng = random.Random(8)
    texts = [prose(rng, 60), prose(rng, 60), prose(rng, 60)]
    docs = make(spark, [*texts, texts[1]]).withColumn("doc_id", corpus_pipeline.F.expr("CASE doc_id WHEN 3 THEN 9 WHEN 2 THEN 1 ELSE 1 END"))
    got = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs), sf).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((1, t) for t in texts)


def test_covering_proposes_before_the_prefix_filter(spark, monkeypatch):
    rng = random.Random(9)
    words = prose(rng, 400).split()
    bits = lambda t: shingle_dedup.fingerprint(shingle_dedup.shingle_set(t.encode()))
    apart = lambda t: ((bits(t) ^ bits(" ".join(words))) & (2**64 - 1)).bit_count()
    edits = [" ".join([*words[:i], "new", *words[i + 1 :]]) for i in range(len(words))]
    close, far = next(t for t in edits if 0 < apart(t) <= 3), next(t for t in edits if apart(t) > 3)
    texts = [" ".join(words), close, close.upper(), far, prose(rng, 400), "", None]
    docs, met = make(spark, texts), shingle_dedup._met
    monkeypatch.setattr(shingle_dedup, "_met", lambda rows, *_: met(rows.limit(0), 1, 1))
    roots = [r.root for r in sorted(shingle_dedup.near_duplicates(docs).collect())]
    assert roots[0] == roots[1] == roots[2] and roots[5] == roots[6] and len(set(roots)) == 4
    monkeypatch.undo()
    roots = [r.root for r in sorted(shingle_dedup.near_duplicates(docs).collect())]
    assert roots[0] == roots[1] == roots[2] == roots[3] and len(set(roots)) == 3


def test_proposals_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    rng = random.Random(11)
    base, size = prose(rng, 100).split(), 200
    texts = []
    for i in range(size):  # most are apart from most others, and many are linked over a few
        words = list(base)
        for k in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"n{i}_{k}"
        texts.append(" ".join(words))
    proposed, confirmed = [], shingle_dedup._confirmed
    monkeypatch.setattr(shingle_dedup, "_confirmed", lambda pairs, *rest: proposed.append(pairs.count()) or confirmed(pairs, *rest))
    low = {}
    got = sorted(shingle_dedup.near_duplicates(make(spark, texts)).collect())
    for r in got:
        low.setdefault(r.root, r.doc_id)
    assert [low[r.root] for r in got] == brute(texts) and sum(proposed) < 10 * size
