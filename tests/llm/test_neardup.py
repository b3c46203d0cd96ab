"""Near duplicates against brute force, and signatures against the similarity that they estimate."""

import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rowloom.llm import dartminhash, neardup

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sets(text):
    w = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    s = [sets(t) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
            root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    return {i: min((x for x in out[find(i)] if x is not None), default=None) if s[i] else rows[i][0] for i in range(len(rows))}


def corpus():
    rng = np.random.default_rng(4)
    vocab = np.array(["".join(rng.choice(list("abcdefghijk"), rng.integers(2, 9))) for _ in range(900)])
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    for _ in range(60):
        add(rng.choice(vocab, rng.integers(3, 300)))
    base = rng.choice(vocab, 300)
    for _ in range(40):  # copies with edits that are near to the base but hardly to each other
        w = base.copy()
        w[rng.choice(300, 6, replace=False)] = rng.choice(vocab, 6)
        add(w)
    add(base)
    chain = list(rng.choice(vocab, 200))
    for k in range(6):  # each near to the next, the ends far apart
        add(chain[12 * k : 12 * k + 140])
    short = rng.choice(vocab, 3)
    for _ in range(3):
        add(short)
    for _ in range(30):
        add(base)
    rows += [(n, None), (n + 1, ""), (n + 2, "..."), (None, rows[3][1]), (3, rows[3][1]), (3, rows[4][1] + " more words"), (n + 3, ("ho " * 5000) + rows[0][1]), (n + 4, " ".join(base).upper())]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, k string, node int")
    got = sorted(((r.doc_id, r.n_shingles, r.class_id) for r in neardup.classes(df).collect()), key=str)
    want = brute(rows)
    assert got == sorted(((d, len(sets(t)), want[i]) for i, (d, t) in enumerate(rows)), key=str)
    kept = neardup.stage(spark, df, "").collect()
    with_words = {want[i] for i, (_, t) in enumerate(rows) if sets(t)}
    # Two classes share the id 3, as two different texts do.
    assert len(kept) == len(with_words) + 1 + sum(not sets(t) for _, t in rows)
    assert {r.doc_id for r in kept if sets(r.text)} == with_words


def test_small_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(df).count() == 0 and neardup.stage(spark, df, "").count() == 0
    one = spark.createDataFrame([(5, "a single text")], "doc_id long, text string")
    assert [r.class_id for r in neardup.classes(one).collect()] == [5]


def test_blocks_find_what_hubs_do_not(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(df).collect()), key=str)
    assert got == sorted(((d, want[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 2**63, 400).astype(np.uint64)
    for share in (0.3, 0.6, 0.9):
        a, b = rng.uniform(0.5, 6, 400), rng.uniform(0.5, 6, 400)
        same = rng.random(400) < share
        b[same] = a[same]
        e, w, o = np.concatenate([ids, ids]), np.concatenate([a, b]), np.repeat([0, 1], 400)
        s = dartminhash.signatures(e, w, o, 2, 2048)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    lone = dartminhash.signatures(ids[:1], np.array([0.01]), np.zeros(1, int), 3, 96)
    assert (lone[0] > 0).all() and not lone[1:].any()


def test_a_set_has_one_signature_in_any_company():
    rng = np.random.default_rng(1)
    ids = np.sort(rng.integers(1, 2**63, 50).astype(np.uint64))
    alone = dartminhash.signatures(ids, np.ones(50), np.zeros(50, int), 1, 96)
    other = np.sort(rng.integers(1, 2**63, 5000).astype(np.uint64))
    both = dartminhash.signatures(np.concatenate([other, ids]), np.ones(5050), np.repeat([0, 1], [5000, 50]), 2, 96)
    assert (both[1] == alone[0]).all()


def repeated():
    rng = np.random.default_rng(7)
    vocab = np.array(["".join(rng.choice(list("abcdefghijk"), rng.integers(2, 9))) for _ in range(900)])
    bodies = [rng.choice(vocab, 120) for _ in range(27)]
    return [" ".join(b) for b in bodies], [" ".join(np.tile(b, 2 + k % 9)) for k, b in enumerate(bodies)]


def test_texts_with_a_repeated_body_are_near_to_it(spark):
    once, often = repeated()
    rows = list(enumerate(once + often))
    want = brute(rows)
    assert [want[i + len(once)] for i in range(len(once))] == list(range(len(once)))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((d, want[i]) for i, (d, _) in enumerate(rows))


def test_equal_sets_have_equal_signatures(spark):
    once, often = repeated()
    twice = [t + " " + t for t in once]
    signs = neardup.signed(spark.createDataFrame(list(enumerate(twice + often)), "doc_id long, text string")).collect()
    per = {}
    for r in signs:
        per.setdefault(r.node, set()).add(bytes(r.signature))
    assert len(per) == len(once) and all(len(x) == 1 for x in per.values())


def test_dense_blocks_are_checked_in_place(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "DENSE", 0)
    rows = corpus()
    want = brute(rows)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted(((d, want[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_sets_of_equal_hash_stay_apart(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    odd = neardup.apart(neardup.signed(df).withColumn("node", F.pmod("node", F.lit(5))))
    per = odd.where("node is not null").groupBy("node").agg({"proof": "count"}).count()
    assert per == len({sets(t) for _, t in rows} - {frozenset()})


def test_recall_of_edited_texts_with_repeats(spark):
    """Pairs of 0.8 and more, with edits and with own words repeated, are linked."""
    rng = np.random.default_rng(21)
    vocab = np.array(["".join(rng.choice(list("abcdefghijk"), rng.integers(3, 9))) for _ in range(3000)])
    rows, pairs = [], []
    while len(pairs) < 150:
        a = rng.choice(vocab, 300)
        b = a.copy()
        b[rng.choice(300, rng.integers(1, 8), replace=False)] = rng.choice(vocab)
        at = int(rng.integers(0, 200))
        b = np.concatenate([b, *[b[at : at + 100]] * int(rng.choice([0, 1, 3, 20]))])
        x, y = " ".join(a), " ".join(b)
        s, t = sets(x), sets(y)
        if len(s & t) >= 0.8 * len(s | t):
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), x), (len(rows) + 1, y)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def groups_of(sizes):
    """Rows of groups of one block or two, some of which agree in most of their signature values."""
    rng = np.random.default_rng(11)
    n, group = sum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(1, 1 << 32, (len(sizes), neardup.K)).astype(np.uint32)
    same = rng.random((n, neardup.K)) < rng.choice([0.3, 0.7, 0.95], n)[:, None]
    values = np.where(same, base[group], rng.integers(1, 1 << 32, (n, neardup.K)).astype(np.uint32))
    bands = rng.integers(1, 1 << 62, (n, neardup.BANDS))
    bands[:, 5] = group
    bands[::7, 2] = 1
    hi = (group % 2).astype(np.int32)
    ints = {"bucket": group, "lo": np.zeros(n, np.int32), "hi": hi, "node": rng.permutation(n), "comp": rng.integers(0, n // 2, n), "block": (rng.integers(0, 2, n) * hi).astype(np.int32)}
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * neardup.BANDS), pa.array(bands.ravel()))
    batch = pa.RecordBatch.from_arrays([*map(pa.array, ints.values()), lists, pa.array([v.tobytes() for v in values], pa.binary())], names=[*ints, "buckets", "signature"])
    return batch, ints, bands, values


def test_candidates_equal_pairs_one_by_one():
    sizes = [1, 2, 3, 40, 2, 90, 1, 5]
    batch, x, bands, values = groups_of(sizes)
    want = set()
    for i, j in combinations(range(batch.num_rows), 2):
        near = (values[i] == values[j]).sum() >= neardup.PLAUSIBLE * neardup.K
        meet = x["bucket"][i] == x["bucket"][j] and (x["lo"][i] == x["hi"][i] or x["block"][i] != x["block"][j])
        if near and meet and x["comp"][i] != x["comp"][j] and bands[i, (bands[i] == bands[j]).argmax()] == x["bucket"][i]:
            want.add(frozenset((int(x["node"][i]), int(x["node"][j]))))
    for rows in (3, 64, 1000):  # groups lie across batches
        got = pa.Table.from_batches(neardup._candidates(iter([batch.slice(k, rows) for k in range(0, batch.num_rows, rows)]))).to_pylist()
        dense = {r["bucket"] for r in got if r["dense"]}
        pairs = [frozenset((r["a"], r["b"])) for r in got if not r["dense"]]
        group = dict(zip(x["node"].tolist(), x["bucket"].tolist()))
        assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p in want if group[min(p)] not in dense} and len(want) > 20
        assert all(sum(group[min(p)] == g for p in want) > neardup.DENSE * sizes[g] for g in dense)


def test_small_groups_of_candidates_are_cheap():
    """Most buckets have two or three rows: 3,000 of them take a third of a CPU second, 3.9 with a pandas frame each."""
    batch = groups_of([2, 3, 4] * 1000)[0]
    began = time.process_time()
    list(neardup._candidates(iter([batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)])))
    assert time.process_time() - began < 2
