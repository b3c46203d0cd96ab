"""Decontamination, licenses and quality rules against brute force, with the odd cases."""

import hashlib
import re

import numpy as np
import pytest

from rowloom.llm import decontaminate, licenses, quality_rules

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
words = lambda t: W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"

DOCS = [
    (1, f"x y {ITEM} z"), (2, None), (3, ""), (4, f"noise {ITEM[:60]}"), (5, ("word " * 3000 + ITEM + " ") * 2), (6, f"x y {ITEM} z"), (6, f"x y {ITEM} z"),
    (None, f"one {ITEM.upper()}"), (7, "Short item HERE, not there"), (8, "alpha beta gamma delta epsilon zeta eta theta iota"), (9, "é " * 40), (10, "é é é é é é é é é é"),
]
BENCH = [(11, ITEM), (12, "short item here"), (13, "é é é é é é é é é é é"), (14, None), (15, ""), (16, ITEM), (2, "alone")]


def brute(text):
    ws, hit, items = words(text), set(), set()
    for item, t in BENCH:
        iw = words(t)
        n = min(10, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items.add(str(item))
    return len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_decontaminate_equals_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(*d, "k", 1) for d in DOCS], "doc_id long, text string, k string, fp int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in decontaminate.op5_decontaminate(spark, str(tmp_path)).collect()), key=str)
    want = sorted(((i, *brute(t)) for i, t in DOCS), key=str)
    assert got == want
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in DOCS if not brute(t)[-1])


@pytest.mark.parametrize("bench", [[], [(1, None)]])
def test_nothing_to_find(spark, bench):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    out = decontaminate.summary(*decontaminate.hits(docs, spark.createDataFrame(bench, "item_id long, text string")))
    assert out.count() == len(DOCS) and out.where("contaminated").count() == 0
    none = decontaminate.summary(*decontaminate.hits(docs.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")))
    assert none.count() == 0


def test_licenses(spark, tmp_path):
    rows = [(1, "Intro.\nReleased under the MIT License.\nmore"), (2, None), (3, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU general public license v2"), (4, "nothing here " * 400 + "ALL RIGHTS RESERVED"), (4, "released under the apache")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.licenses) for r in licenses.op4_licenses(spark, str(tmp_path)).collect())
    assert got == [(1, "MIT"), (2, ""), (3, "GPL"), (4, ""), (4, "All-rights-reserved")]


def stretches(text, templates):
    """Plain code for the license scan: names of the templates found, and of all whose shingles are near enough."""
    found, ws = [], words(text)
    for name, t in templates:
        tw = words(t)
        n = min(5, len(tw))
        own = {tuple(tw[i : i + n]) for i in range(len(tw) - n + 1)} if n else set()
        hits = [(i, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in own] if n else []
        length = -(-5 * (len(tw) - n + 1) // 4)
        best = max(((len({g for j, g in hits if i <= j < i + length}), -i, max(j for j, _ in hits if i <= j < i + length)) for i, _ in hits), default=None)
        if best and best[0] >= 0.8 * len(own):
            found.append((name, best[0], -best[1], best[2] + n))
    return {a[0] for a in found if not any(b[2] <= a[2] and b[3] >= a[3] and b[1] > a[1] for b in found)}


def test_license_texts_with_edits_against_plain_code(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(300)]
    rows = []
    for k in range(150):
        name, text = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        w = text.split()
        for i in rng.choice(len(w), int(len(w) * rng.choice([0, 0.01, 0.03, 0.06])), replace=False):
            w[i] = str(rng.choice(vocab))
        rows.append((k, " ".join([*rng.choice(vocab, rng.integers(0, 90)), *w, *rng.choice(vocab, rng.integers(0, 90))]), "x", "y"))
    rows += [(900, " ".join(t for _, t in licenses.TEMPLATES), "x", "y"), (901, licenses.TEMPLATES[12][1] * 40, "x", "y"), (902, " ".join(x for i, x in enumerate(licenses.TEMPLATES[12][1].split()) for x in (x, vocab[i]) if i % 3 or x), "x", "y")]
    documents, matches = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string, template string"), licenses.templates(spark))
    per = {}
    for r in matches.join(documents, ["d", "k"]).collect():
        per.setdefault(r.doc_id, set()).add(r.license)
        assert 0.8 <= r.containment <= 1 and 0 <= r["at"] < r.end
    want = {i: stretches(t, licenses.TEMPLATES) for i, t, _, _ in rows}
    total = sum(map(len, want.values()))
    assert total > 120 and sum(len(want[i] & per.get(i, set())) for i in want) >= 0.99 * total
    assert all(per.get(i, set()) <= want[i] for i in want)


def test_licenses_of_empty_tables_and_templates(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "template int, license string, text string")
    for t in (none, spark.createDataFrame([(1, "x", None), (2, "y", "...")], none.schema)):
        documents, matches = licenses.scan(docs, t)
        assert matches.count() == 0 and documents.agg({"n_rows": "sum"}).first()[0] == 3
    documents, matches = licenses.scan(docs.limit(0), licenses.templates(spark))
    assert documents.count() == 0 and matches.count() == 0
    twice = spark.createDataFrame([(1, "a", "mit license"), (2, "b", "MIT License")], none.schema)
    assert sorted(r.license for r in licenses.scan(docs, twice)[1].collect()) == ["a", "b"]


def counts(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, rep = {}, set()
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            rep |= {i + k for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), n < 10 or 100 * len(rep) > 20 * n


TEXTS = [None, "", " \n\t ", "a b c d e f g h i j", "a b c d e a b c d e", "x\ny\nx\n\n \nx", "# $ 100% <b>&amp;</b> |", "é\xa0ü " * 30, "one two three four five six " * 50, ("w " * 9 + "\n") * 2000, "a\x0bb\x0cc\rd", "The quick brown fox jumps over the lazy dog near the bank of a river today."]


def test_quality_rules_equal_plain_code(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host int")
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(df).collect()}
    assert got == {(i, *counts(t)) for i, t in enumerate(TEXTS)}
    kept = quality_rules.stage(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t, _, _ in rows if not counts(t)[-1])
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_bad_host_is_rejected_and_small_ones_are_shrunk(spark):
    good, bad = "all of these are different words that make one proper sentence here", "few words"
    rows = [(i, bad if i < 190 else good, "http://spam.example/x") for i in range(200)] + [(1000 + i, good, f"http://h{i % 20}.example/{i}") for i in range(200)] + [(5000, bad, "http://one.example/"), (5001, good, None)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[195].kept and not got[195].base_failed and all(got[1000 + i].kept for i in range(200)) and got[5001].kept
    assert got[5000].host_rate < 0.9
