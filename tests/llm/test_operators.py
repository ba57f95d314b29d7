"""Each operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, decontamination, language_id, license_scan, mixing, quality_rules, simhash, substring_dedup, topics, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, hits string, k string, score string, given string"


def make(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    shared = prose(rng, 60)
    texts = [None, "", " \n\t ", "one", "Two words", prose(rng, 34), prose(rng, 35)]
    texts += [prose(rng, 30) + "\n" + shared + " " + prose(rng, 20) for _ in range(4)]
    texts += [prose(rng, 90)] * 3 + [shared + " tail " + shared, "é ü " * 40, "same " * 200]
    texts += [prose(rng, 30000), texts[7].upper(), texts[8] + " x"]
    return texts


def removed(texts):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        out.append((len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep, strict=True) if y).encode()).hexdigest()))
    return out


def test_cover_meets_every_shift():
    for d in range(substring_dedup.PERIOD):
        assert any((c + d) % substring_dedup.PERIOD in substring_dedup.COVER for c in substring_dedup.COVER)


@pytest.mark.parametrize("flush", [64, 1_000_000])
def test_substring_dedup(spark, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "_FLUSH", flush)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 20_000)
    texts = corpus()
    docs = make(spark, texts)
    both = docs.unionByName(docs.where("doc_id = 6")).unionByName(docs.where("doc_id = 5").selectExpr("cast(null AS long) AS doc_id", "text", "lang", "source", "n_chars", "hits", "k", "score", "given"))
    expected = removed([*texts, texts[6], texts[5]])
    got = substring_dedup.remove_repeats(both, ("lang", "hits")).collect()
    ids = [*range(len(texts)), 6, None]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(((i, *e) for i, e in zip(ids, expected, strict=True)), key=str)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def near(texts):
    def mark(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), seed=42)
            for b in range(64):
                counts[b] += h >> b & 1
        return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))

    marks, label = [mark(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(i, f"{m:016x}", c) for i, (m, c) in enumerate(zip(marks, label, strict=True))]


def test_crowded_groups_split_without_loss(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 1, dtype=np.int64)[0]
    near_one = {int(base)}
    while len(near_one) < 300:  # many fingerprints within a few bits of one
        near_one.add(int(base) ^ int(np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 62, int(rng.integers(1, 5))))))
    marks = sorted(near_one)
    got = simhash.links(spark.createDataFrame([(m,) for m in marks], "fp long"), 5).collect()
    label = {m: m for m in marks}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    assert all((r.a ^ r.b).bit_count() <= 3 for r in got)
    for r in got:
        label[find(r.a)] = find(r.b)
    mine = {m: find(m) for m in marks}
    label = {m: m for m in marks}
    for i, x in enumerate(marks):
        for y in marks[:i]:
            if (x ^ y).bit_count() <= 3:
                label[find(x)] = find(y)
    assert len(set(mine.values())) == len({find(m) for m in marks}) and all((mine[x] == mine[y]) == (find(x) == find(y)) for x in marks for y in marks)


@pytest.mark.parametrize("crowd", [2, 4000])
def test_simhash(spark, crowd):
    rng = random.Random(3)
    base = prose(rng, 400).split()
    copies = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(400)] = f"new{i}"
        copies.append(" ".join(w))
    texts = corpus()[:-4] + copies
    got = simhash.near_duplicates(make(spark, texts), crowd)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == near(texts)
    assert simhash.near_duplicates(make(spark, texts).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "other words are here"), (None, None), (None, "e f g h")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd, crowd).collect()), key=str)
    assert rows == [(5, 5), (5, 5), (None, 5), (None, None), (None, None)]


def test_anchor_covering_is_complete():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 31, 300, dtype=np.uint32)
    index, anchor, home = simhash.anchors_of(points)
    assert set(simhash._syndromes(anchor).tolist()) == {0} and (np.bincount(index[home], minlength=300) == 1).all()
    by = [set(anchor[index == i].tolist()) for i in range(300)]
    for i in range(300):
        other = points[i] ^ np.uint32(1 << int(rng.integers(31)))
        theirs = simhash.anchors_of(np.array([other], dtype=np.uint32))
        assert set(theirs[1][theirs[2]].tolist()) <= by[i]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 50)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "a long, b long")
    roots = {r.v: r.root for r in components.connected_components(edges).collect()}
    assert len({roots[i] for i in range(100, 161)}) == 1 and len({roots[i] for i in range(50)}) == 1 and len(set(roots.values())) == 2
    assert components.connected_components(edges.limit(0)).count() == 0


def languages(rng, n):
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "wer"], "cc": ["eau", "oi", "que", "ai"]}
    texts, langs = [], []
    for i in range(n):
        lang = list(syllables)[i % 3]
        texts.append(" ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 80))))
        langs.append(lang)
    return texts, langs


def test_language_id(spark):
    texts, langs = languages(random.Random(2), 240)
    docs = make(spark, [*texts, None, "", "123 ...", "ka " * 50000], [*langs, None, "aa", "aa", "aa"])
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [i for i in range(240) if got[i].held_out]
    assert 30 < len(held) < 100 and np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.97
    assert all(got[i].lang_pred == "und" for i in (240, 241, 242)) and got[243].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs.where("doc_id >= 240 AND doc_id < 243")).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_language_scores_by_brute_force(spark):
    """Every kernel value from sets, a dense solve for the ridge, and the mean over segments."""
    texts, langs = languages(random.Random(4), 60)
    rows = np.stack([language_id.presence(t) for t in texts])
    model = language_id.fit(rows, langs, landmarks=60)

    def kernel(a, b):
        at, total = 0, 0.0
        for width in language_id.WIDTHS:
            x, y = {i for i in range(at, at + width) if a[i]}, {i for i in range(at, at + width) if b[i]}
            total += len(x & y) / (len(x) * len(y)) ** 0.5 / len(language_id.WIDTHS) if x and y else 0.0
            at += width
        return total

    k = np.array([[kernel(a, b) for b in rows] for a in rows])
    targets = np.array([[float(x == y) for y in sorted(set(langs))] for x in langs])
    weights = 1 / np.array([langs.count(x) for x in langs])
    weights *= len(langs) / weights.sum()
    # weighted kernel ridge with every row a landmark: (K W K + n ridge K) a = K W y
    alpha = np.linalg.lstsq(k @ np.diag(weights) @ k + language_id.RIDGE * len(langs) * k, k @ np.diag(weights) @ targets, rcond=1e-10)[0]
    assert np.abs(k @ alpha - model.scores(rows)).max() < 1e-2
    long = " ".join(texts[:3] * 60)
    pieces = language_id.segments(long)
    assert len(pieces) > 1 and max(map(len, pieces)) <= language_id.SEGMENT + 3
    got = language_id.predict(make(spark, [long]), model).first()
    wanted = np.mean([model.scores(language_id.presence(p)[None])[0] for p in pieces], axis=0)
    assert got.lang_pred == model.languages[int(wanted.argmax())] and abs(got.score - wanted.max()) < 1e-5


def test_every_language_can_be_predicted(spark):
    rng = random.Random(11)
    names = [f"l{i:03d}" for i in range(300)]
    alphabet = [chr(0x4E00 + i) for i in range(3000)]
    texts, langs = [], []
    for i, name in enumerate(names):  # each has ten letters of its own
        for _ in range(6):
            texts.append(" ".join("".join(rng.choices(alphabet[10 * i : 10 * i + 10], k=4)) for _ in range(12)))
            langs.append(name)
    docs = make(spark, texts, langs).withColumn("_text", F.lit("clash"))
    got = language_id.identify(docs).collect()
    assert {r.lang_pred for r in got} == set(names)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97


def test_kernel_products_are_cosines():
    a, b = language_id.presence("abc abd"), language_id.presence("abc xyz")
    x = language_id.scaled(np.stack([a, b]))
    assert abs(float(x[0] @ x[0]) - 1) < 1e-5 and 0 < float(x[0] @ x[1]) < 1


def test_toxicity(spark):
    rng = random.Random(4)
    texts, toxic = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = prose(rng, rng.randrange(20, 200), 300).split()
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "rotten"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = make(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, toxic[i], "e") for i in range(900) if i % 3 != 1] + [(5000, 1, 1, "e"), (3, 1, None, "e")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert got[900].predicted == 0 and got[901].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_risk_by_brute_force():
    """The gradient that a step follows is that of the risk, or of its negated bracket, by differences."""
    rng = np.random.default_rng(5)
    p, u, prior = rng.integers(0, 2, (30, 3)).astype(float), rng.integers(0, 2, (80, 3)).astype(float), 0.3

    def parts(theta):
        loss = lambda x, y: np.log1p(np.exp(-y * (x @ theta[:-1] + theta[-1]))).mean()
        return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

    for start in (np.array([0.5, -1.0, 0.2, -0.4]), np.array([4.0, 4.0, 4.0, -6.0])):
        first, bracket = parts(start)
        value = (lambda t: sum(parts(t))) if bracket >= 0 else (lambda t: -parts(t)[1])
        slope = np.array([(value(start + 1e-6 * e) - value(start - 1e-6 * e)) / 2e-6 for e in np.eye(4)])
        assert np.abs(toxicity.gradient(p, u, prior, start, 0.0) - slope).max() < 1e-6


def test_toxicity_handles_odd_rows(spark):
    texts = ["vile words here " + f"w{i}" if i % 4 == 0 else f"calm words there w{i} z{i}" for i in range(200)] + ["x " * 200_000, None, ""]
    docs = make(spark, texts)
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] * 2 + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 203 + 20 + 1 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert {(r.doc_id, r.predicted) for r in got if r.doc_id is not None and r.doc_id < 200} == {(i, int(i % 4 == 0)) for i in range(200)}


def test_risk_ignores_positives_in_the_unlabelled():
    rng = np.random.default_rng(0)
    p, u = np.zeros((200, 4), np.float32), np.zeros((1000, 4), np.float32)
    p[:, 0], u[:300, 0] = 1, 1
    p[:, 1:], u[:, 1:] = rng.integers(0, 2, (200, 3)), rng.integers(0, 2, (1000, 3))
    w, b = toxicity.fit(p, u, 0.3)
    assert w[0] + b > 0.5 > b


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    texts = [*corpus(), "a b c d e f a b c d e a b c d e", "x#y |z| " * 9, "l\nl\n \nl\nm", "SHOUT LOUD! " * 20]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        r, q = got[i], quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == q, i
        assert r.base_failed == (q[0] < 10 or 100 * q[4] > 20 * q[0])
        assert not (r.base_failed and r.kept)
    again = quality_rules.judge(docs, list(reversed(quality_rules.default_rules()))).collect()
    assert {r.doc_id: r.kept for r in again} == {i: r.kept for i, r in got.items()}
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    docs = make(spark, corpus())
    rules = [quality_rules.Rule("never", quality_rules.F.lit(False)), quality_rules.Rule("always", quality_rules.F.lit(True))]
    assert [r.name for r, _, _ in quality_rules.order_rules(docs, rules)] == ["always", "never"]


FILES = [
    ("LICENSE", "Licensed under the Apache License, Version 2.0"), ("a/x.py", "code"), ("a/b/LICENSE.txt", "Released under the MIT License."), ("a/b/y.py", "code"),
    ("a/b/c/z.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), ("a/b/c/d/w.py", None), ("a/licensed.py", "the work of the day"), (None, "MIT"), ("q.py", ""),
]


def test_license_scan(spark):
    files = spark.createDataFrame([(p, t, "e", "e") for p, t in [*FILES, FILES[4]]], "path string, text string, given string, license string")
    rows = license_scan.scan(files).collect()
    assert len(rows) == len(FILES) + 1 and rows[0].asDict().keys() == {"path", "given", "license", "score", "origin", "license_dir"}
    got = {r.path: (r.license, r.origin, r.license_dir) for r in rows}
    assert got["LICENSE"] == ("Apache-2.0", "own", "") and got["a/x.py"] == ("Apache-2.0", "inherited", "")
    assert got["a/b/y.py"] == ("MIT", "inherited", "a/b") and got["a/b/c/z.py"][:2] == ("GPL-3.0", "own") and got["a/b/c/d/w.py"] == ("MIT", "inherited", "a/b")
    assert got["a/licensed.py"] == ("Apache-2.0", "inherited", "") and got[None] == (None, "none", None) and got["q.py"][1] == "inherited"
    assert license_scan.scan(files.limit(0)).count() == 0


def wrapped(text, width, lead=""):
    return "\n".join(lead + x for x in textwrap.wrap(" ".join(text.split()), width))


def test_real_licences_and_headers(spark):
    t = license_scan.TEMPLATES
    mit = "MIT License\n\nCopyright (c) 2024 Ada Example\n\n" + "\n\n".join(wrapped(x, 78) for x in (license_scan._MIT_GRANT, license_scan._MIT_REST))
    bsd = "\n\n".join(wrapped(x, 70) for x in ("Copyright 2020, The Regents", license_scan._BSD_HEAD, license_scan._BSD_NAMES, license_scan._BSD_TAIL))
    apache = "                              Apache License\n                        Version 2.0, January 2004\n                     http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n\n   1. Definitions.\n"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n\n                            Preamble\n"
    rng = random.Random(3)
    filler = [prose(rng, 300) for _ in range(1000)]
    real = [
        ("m/LICENSE", mit, "MIT"), ("b/LICENSE", bsd, "BSD-3-Clause"), ("a/LICENSE", apache, "Apache-2.0"), ("g/COPYING", gpl, "GPL-3.0"), ("s/x.c", "// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("s/y.c", "/* SPDX-License-Identifier: GPL-2.0 */\nint x;", "GPL-2.0"), ("h/two.py", wrapped(t["Apache-2.0"][1], 70, "# ") + "\n\nimport x\n", "Apache-2.0"),
        ("h/long.go", "// Copyright 2020 Ada\n//\n" + wrapped(t["Apache-2.0"][3], 60, "// ") + "\n\npackage x\n", "Apache-2.0"), ("h/gnu.c", "/*\n" + wrapped(t["GPL-3.0"][2], 64, " * ") + "\n *\n * more\n */\nint y;", "GPL-3.0"),
        ("h/mit.js", "/*\n" + wrapped(license_scan._MIT_GRANT, 60, " * ") + "\n *\n" + wrapped(license_scan._MIT_REST, 60, " * ") + "\n */\nvar z", "MIT"), ("n/plain.py", "print('no licence here, all of it is use and copy and sell')", None),
    ]
    files = spark.createDataFrame([(p, x) for p, x, _ in real] + [(f"f/{i}.txt", x) for i, x in enumerate(filler)], "path string, text string")
    got = {r.path: r.license for r in license_scan.scan(files).collect()}
    assert {p: got[p] for p, _, _ in real} == {p: name for p, _, name in real} and {got[f"f/{i}.txt"] for i in range(1000)} == {None}


def test_license_scores_and_the_prefilter(spark):
    n, df = license_scan.document_frequencies(spark.createDataFrame([(t,) for _, t in FILES], "text string"), ["license", "mit"])
    assert (n, df) == (9, {"license": 3, "mit": 2})
    known, other, vectors = license_scan._weights(license_scan.all_templates(license_scan.TEMPLATES), 1000, {"the": 900})
    rng = random.Random(8)
    chosen = {t for _, v in vectors for t in license_scan.heaviest_terms(v, 0.8)}
    for _ in range(300):  # a text without a chosen term never reaches the threshold
        words = Counter(rng.choices([*known, "zz"], k=6))
        weights = {t: c * known.get(t, other) for t, c in words.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        best = max(sum(w * v.get(t, 0) for t, w in weights.items()) / norm for _, v in vectors)
        assert best < 0.8 or chosen & words.keys()


URLS = [None, "", "no scheme", "http://A.B.Net/x", "http://net", "http://net/", "https://x.example.net/en/1", "https://x.example.net/en", "http://example.com/de/q?z", "http://badexample.com/de/", "ftp://o.org/fr/#a", "http://o.org/de/fr/", "http://h/a://net/", "http://net?x"]


def verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = (None, "allow")
    for v, r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(r) > len(best[0] or ""):
            best = (r, v)
    return host, path, *best


def test_url_filter(spark):
    rows = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "r")], "page_id long, url string, html string, rule string")
    rules = url_filter.rule_table(spark, (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(rows, rules).collect()), key=str)
    assert got == sorted([*[(i, *verdict(u)) for i, u in enumerate(URLS)], (3, *verdict(URLS[3]))], key=str)
    assert url_filter.judge_urls(rows.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(rows, rules.limit(0)).collect()} == {"allow"}
    part = url_filter.judge_urls(rows, spark.createDataFrame([("block", "net", "/x")], "verdict string, host string, path string"))
    assert {r.page_id for r in part.where("verdict = 'block'").collect()} == {3}


def test_raking_meets_its_targets():
    rng = np.random.default_rng(2)
    cells = [(s, lang, t) for s in "ab" for lang in "xy" for t in "pq"]
    targets = [{"a": 0.7, "b": 0.3}, {"x": 0.4, "y": 0.6}, {"p": 0.5, "q": 0.5}]
    w = mixing.rake(rng.uniform(1, 9, 8), cells, targets)
    for axis, target in enumerate(targets):
        for value, share in target.items():
            assert abs(sum(x for x, c in zip(w, cells, strict=True) if c[axis] == value) - share) < 1e-8
    tokens = rng.uniform(1, 9, 8)
    p = mixing.probabilities(w, tokens, 0.6 * tokens.sum())
    assert abs((p * tokens).sum() - 0.6 * tokens.sum()) < 1e-8 and p.max() <= 1


def test_mixing(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(5, 60)) for _ in range(600)] + [None, ""]
    docs = make(spark, texts, [rng.choice(["en", "fr", None]) for _ in texts]).withColumn("topic", F.lit("t"))
    counted = mixing.token_counts(docs.withColumn("n_tokens", mixing.n_tokens(F.col("text"))))
    assert sorted((r.doc_id, r.n_tokens) for r in counted.collect()) == [(i, len(WORD.findall(t or ""))) for i, t in enumerate(texts)]
    got = mixing.mix(counted, {"lang": {"en": 0.5, "fr": 0.3, mixing.OTHER: 0.2}}, 0.4).collect()
    total = sum(r.n_tokens for r in got)
    assert len(got) == 602 and abs(sum(r.n_tokens * r.probability for r in got) - 0.4 * total) < 1e-6 * total
    kept = sum(r.n_tokens for r in got if r.sampled)
    assert abs(kept / total - 0.4) < 0.06
    assert all(r.probability == 0 and not r.sampled for r in got if r.n_tokens == 0)
    assert mixing.mix(counted.limit(0), {}, 0.5).count() == 0


def test_topics_cut_across_languages(spark):
    rng = random.Random(12)
    texts, langs, wanted = [], [], []
    for i in range(600):
        lang, topic = "xyz"[i % 3], i // 3 % 4
        own = [f"{lang}t{topic}w{rng.randrange(30)}" for _ in range(12)] + [f"shared{topic}n{rng.randrange(40)}" for _ in range(12)]
        texts.append(" ".join(own + [f"{lang}common{rng.randrange(200)}" for _ in range(20)]))
        langs.append(lang)
        wanted.append(topic)
    docs = make(spark, [*texts, None, "", "??? !", "x " * 100_000], [*langs, "x", None, "y", "z"])
    model, bags = topics.fit(docs.repartition(5), 4, ("doc_id", "lang", "k"))
    got = {r.doc_id: r.topic for r in topics.assign(bags, model).collect()}
    assert len(got) == 604 and got[600] is None and got[601] is None and got[602] is None
    for t in range(4):  # one topic for the most part, in each language
        for lang in "xyz":
            found = Counter(got[i] for i in range(600) if wanted[i] == t and langs[i] == lang)
            assert found.most_common(1)[0][1] > 0.9 * sum(found.values())
    assert len({got[i] for i in range(600)}) == 4
    again, _ = topics.fit(docs.repartition(3), 4)
    assert np.array_equal(again.centres, model.centres)
    # one round by brute force: each centre is the direction of its members' vectors less their languages' means
    dense = np.zeros((len(texts), len(model.vocabulary)))
    for i, (t, x) in enumerate(zip(texts, langs, strict=True)):
        bag = model.bag(t)
        dense[i, bag] = model.weights[bag] / np.linalg.norm(model.weights[bag])
        dense[i] -= model.means[model.group(x)]
    assert all(got[i] == f"t{int((model.centres @ dense[i]).round(9).argmax())}" for i in range(600))
    assert topics.fit(docs.limit(0)) == (None, None) and topics.with_topics(docs.where("doc_id >= 600 AND doc_id < 602"), ("doc_id",)).where("topic IS NULL").count() == 2


def test_mixing_by_brute_force(spark):
    """Weights from plain proportional fitting over dictionaries, probabilities by bisection, the draw by its hash."""
    rng = random.Random(16)
    rows = [(rng.choice([i, i, None]), rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice("pq"), rng.randrange(0, 40), "clash", "clash") for i in range(400)]
    counted = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long, weight string, _source string")
    counted = counted.withColumn("lang", F.coalesce("lang", F.lit(mixing.OTHER)))
    targets = {"source": {"a": 0.6, "b": 0.3, "c": 0.1}, "lang": {"x": 0.2, "y": 0.5, mixing.OTHER: 0.3}, "topic": {"p": 0.9, "q": 0.1}}
    got = mixing.mix(counted, targets, 0.6, keep=("_source",)).collect()
    cells = Counter()
    for _, s, lang, t, n, _, _ in rows:
        cells[s, lang or mixing.OTHER, t] += n
    w = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(500):
        for axis, target in enumerate(targets.values()):
            have = Counter()
            for c, x in w.items():
                have[c[axis]] += x
            w = {c: x * target[c[axis]] / have[c[axis]] for c, x in w.items()}
    budget, low, high = 0.6 * sum(cells.values()), 0.0, 1e9
    for _ in range(200):
        factor = (low + high) / 2
        spent = sum(n * min(1, factor * w[c] / n) for c, n in cells.items())
        low, high = (factor, high) if spent < budget else (low, factor)
    assert len(got) == 400
    draws = {(r.doc_id, r.d) for r in counted.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("d")).collect()}
    draw = dict(draws)
    for r in got:
        c = (r.source, r.lang, r.topic)
        p = min(1, high * w[c] / cells[c]) if r.n_tokens else 0
        assert abs(r.probability - p) < 1e-6 and r.sampled == (draw[r.doc_id] < r.probability) and r._source == "clash"
        assert abs(r.weight - (w[c] if r.n_tokens else 0)) < 1e-6


def aligned(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = max(0, before[j - 1] + (2 if x == y else -1), before[j] - 1, row[j - 1] - 1)
        best = max(best, *row)
    return best


@pytest.mark.parametrize("block", [500, 8_000_000])
def test_decontamination(spark, block):
    rng = random.Random(9)
    items = [prose(rng, n, 300) for n in (40, 35, 30, 20, 2)] + [None, ""]
    edited = items[0].split()
    for i in range(3, 40, 7):
        edited[i] = "edited"
    texts = [None, "", prose(rng, 80, 300), "x " + items[0].upper() + " y", prose(rng, 50, 300) + " " + " ".join(edited), " ".join(items[1].split()[:30]), items[2] + ", " + items[3], items[1] + " " + items[1]]
    texts += [prose(rng, 30, 300) + " " + items[2] for _ in range(40)] + [prose(rng, 20000, 300)]
    docs = make(spark, texts)
    bench = spark.createDataFrame([(i, t, "e") for i, t in enumerate(items)] + [(0, items[0], "e")], "item_id long, text string, score string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(docs, bench, block_bytes=block).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for i, b in enumerate(items[:4] if d == len(texts) - 1 else items):
            x, y = decontamination.tokens(t), decontamination.tokens(b)
            if x and y and (s := aligned(y, x) / (2 * len(y))) >= 0.5:
                expected[d, i] = s
    long = {k: got.pop(k) for k in list(got) if k[0] == len(texts) - 1}
    assert all(i == 4 for _, i in long)  # two common words meet by chance
    expected = {k: v for k, v in expected.items() if k[1] != 4}
    got = {k: v for k, v in got.items() if k[1] != 4}
    assert got == pytest.approx(expected)
    assert decontamination.drop_leaks(docs, bench.where("item_id < 4"), block_bytes=block).columns == docs.columns
    kept = {r.doc_id for r in decontamination.drop_leaks(docs, bench.where("item_id < 4"), block_bytes=block).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in expected}
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_revisits(spark):
    ts = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    rows = [
        ("r1", "http://www.E.com/a/?utm_source=x#f", ts(1), "response", 200, {"ETag": '"1"', "Date": "0", "Content-Type": "t"}, "d1"),
        ("r2", "https://e.com/a", ts(2, 5), "response", 200, {"ETag": '"2"', "X": "old"}, "d2"),
        ("r3", "http://e.com/a", ts(2, 6), "response", 404, {"ETag": '"9"'}, "d9"),
        ("v0", "http://e.com/a", ts(1), "revisit", 304, {"ETag": '"1"'}, None),
        ("v1", "http://e.com/a", ts(2, 5), "revisit", 304, {"etag": 'W/"1"', "date": "1", "content-type": "no"}, None),
        ("v2", "http://e.com/a", ts(9), "revisit", 304, {"etag": '"1"'}, None),
        ("v3", "http://e.com/a", ts(9), "revisit", 304, {"x": "new", "last-modified": "z"}, None),
        ("v4", None, ts(9), "revisit", 304, None, None),
    ]
    records = spark.createDataFrame([(*r, "e") for r in rows], "record_id string, url string, ts string, kind string, status int, headers map<string,string>, digest string, found string").withColumn("ts", quality_rules.F.to_timestamp("ts"))
    got = {r.record_id: (r.response_id, r.outcome, r.digest, r.headers) for r in warc.resolve_revisits(records).collect()}
    assert got["v0"][:2] == (None, "missing") and got["v4"][:2] == (None, "missing")
    assert got["v1"] == ("r1", "resolved", "d1", {"content-type": "t", "date": "1", "etag": 'W/"1"'})
    assert got["v2"] == ("r2", "mismatch", None, None) and got["v3"] == ("r2", "resolved", "d2", {"etag": '"2"', "last-modified": "z", "x": "new"})
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_revisits_with_ties_and_repeats(spark):
    at = "2024-01-01 00:00:00"
    full = [("r1", "http://e/a", at, "response", 200, {"ETag": "1"}, "d1"), ("r2", "http://e/a", at, "response", 200, {"ETag": "2"}, "d2")]
    later = ("v", "http://e/a", "2024-01-02 00:00:00", "revisit", 304, {"etag": "2"}, None)
    same = ("w", "http://e/a", at, "revisit", 304, {}, None)
    rows = [(*r, "e", "e", "e") for r in [*full, *full, later, later, same]]
    ddl = "record_id string, url string, ts string, kind string, status int, headers map<string,string>, digest string, response_id string, stored string, day string"
    got = warc.resolve_revisits(spark.createDataFrame(rows, ddl).withColumn("ts", F.to_timestamp("ts"))).collect()
    assert sorted((r.record_id, r.response_id, r.outcome, r.digest) for r in got if r.record_id == "v") == [("v", "r2", "resolved", "d2")] * 2
    assert [(r.response_id, r.outcome) for r in got if r.record_id == "w"] == [(None, "missing")] and len(got) == 3


def test_warc_members_are_read_once():
    """20,000 members, in time that follows their number."""
    one = warc.format_warc({"WARC-Type": "response"}, bytes(random.Random(1).randbytes(2000)))
    began = time.perf_counter()
    assert sum(1 for _ in warc.parse_warc(one * 20_000)) == 20_000
    assert time.perf_counter() - began < 20
    assert sum(1 for _ in warc.parse_warc(one * 3 + one[:-500])) == 3 and list(warc.parse_warc(b"")) == [] and sum(1 for _ in warc.parse_warc(one + b"rest")) == 1


def test_warc_round_trip(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\nbody"
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "http://e/", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http"}
    data = b"".join(warc.format_warc(fields, block, c) for c in (True, True))
    assert [b for _, b in warc.parse_warc(data)] == [block, block]
    assert [b for _, b in warc.parse_warc(data[:-5])] == [block] or len(list(warc.parse_warc(data[:-5]))) == 2
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(warc.format_warc(fields, block, False))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 3 and {(r.status, bytes(r.body), r.headers["ETag"]) for r in got} == {(200, b"body", '"1"')}
