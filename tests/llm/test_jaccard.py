import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docskein.llm import jaccard
from docskein.llm.components import components
from tests.conftest import DATA


def brute(rows, threshold=Fraction(4, 5), words=5):
    """{row number: (class id, links)} by comparing all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    common = defaultdict(int)
    for owners in at.values():
        for a in owners:
            for b in owners:
                if a < b:
                    common[a, b] += 1
    links, root = defaultdict(int), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if Fraction(c, len(sets[a]) + len(sets[b]) - c) >= threshold:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return {i: (min((x for x in ids[find(i)] if x is not None), default=None), links[i]) for i in range(len(rows))}


def test_depth_and_signatures():
    assert jaccard.shortened_depth(0.8, 0.9999) == 6
    rng = np.random.default_rng(1)
    for shared, n in ((80, 90), (300, 400), (9, 10)):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - shared :])
            agree.append((jaccard.signature(a) == jaccard.signature(b)).mean())
        assert np.mean(agree) == pytest.approx(shared / (2 * n - shared), abs=0.03)


@pytest.mark.parametrize("common, union", [(4, 5), (5, 6), (8, 10), (12, 15), (16, 20)])
def test_trees_are_independent_on_small_sets(common, union):
    depth, rng, missed = jaccard.shortened_depth(0.8, 0.9999), np.random.default_rng(common), 0
    for _ in range(3000):
        pool = rng.integers(0, 2**63, union, dtype=np.uint64)
        own = (union - common) // 2
        a, b = (np.unique(x) for x in (pool[: common + own], np.concatenate([pool[:common], pool[common + own :]])))
        missed += not (jaccard.signature(a) == jaccard.signature(b))[:depth].all(axis=0).any()
    assert missed <= 3  # 0.2 expected


def test_signature_of_many_shingles():
    s = np.unique(np.random.default_rng(4).integers(0, 2**63, 2 * jaccard.CELLS + 5, dtype=np.uint64))
    halves = [jaccard.signature(x) for x in (s[:40_000], s[40_000:])]
    assert (jaccard.signature(s) != halves[0]).any() and np.isin(jaccard.signature(s), np.stack(halves)).all()


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    want = brute(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.query(spark, f"{DATA}/sf0.01").collect()}
    assert got == {d: want[i] for i, (d, _) in enumerate(docs)}


def test_families_of_variants(spark, docs):
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 12, 40, 150, 600]))]
        for _ in range(rng.choice([1, 3, 30])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[3][1])] * 2 + [(None, rows[4][1]), (9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "one  TWO"), (9005, "one two three four five six")]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(10_000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    rng.shuffle(rows)
    want = brute(rows)
    got = jaccard.similar_documents(docs(*rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])(doc_id=d, class_id=want[i][0], n_links=want[i][1])) for i, (d, _) in enumerate(rows))
    kept = jaccard.keep_one(docs(*rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for i, (d, _) in enumerate(rows) if d is not None and d == want[i][0]) and kept[0]["a b"] == 7
    assert jaccard.similar_documents(docs(*rows).limit(0)).count() == 0


def variants(rng, groups, members, edits, passage=0):
    """Groups of near copies of 120 words, and texts that share a passage only."""
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**7)}" for _ in range(120)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**7)}"
            rows.append((len(rows), " ".join(w)))
    shared = " ".join(f"p{i}" for i in range(70))
    return rows + [(len(rows) + i, shared + " " + " ".join(f"q{rng.randrange(10**7)}" for _ in range(45))) for i in range(passage)]


def test_large_families_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rows = variants(random.Random(3), 2, 120, 3, passage=60)
    rows += [(len(rows) + i, rows[i][1] + " and a tail of some more words" * (i % 9)) for i in range(60)]
    want = brute(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(docs(*rows)).collect()}
    assert got == {d: want[i] for i, (d, _) in enumerate(rows)} and max(n for _, n in want.values()) > 60


@pytest.mark.parametrize("threshold, edits", [(0.5, 9), (0.8, 3)])
def test_recall_of_links(spark, docs, threshold, edits):
    rows = variants(random.Random(11), 30, 25, edits, passage=200)
    want = brute(rows, Fraction(str(threshold)))
    got = {r.doc_id: r.n_links for r in jaccard.similar_documents(docs(*rows), threshold=threshold).collect()}
    links = sum(n for _, n in want.values())
    found = sum(min(got[d], want[i][1]) for i, (d, _) in enumerate(rows))
    assert links > 5000 and found >= 0.999 * links and all(got[d] <= want[i][1] for i, (d, _) in enumerate(rows))


def test_passages_do_not_chain_families(spark, docs):
    rows = variants(random.Random(5), 0, 0, 0, passage=1500)
    levels = jaccard.shortened_depth(0.8, 0.9999) + jaccard.LONGER
    base = jaccard._base(docs(*rows), "doc_id", "text", 5, levels)
    ties = jaccard._ties(base.select(F.col("no").alias("node"), "paths", "sketch"), levels, levels - jaccard.LONGER)
    near = ties.where(F.col("close") >= jaccard.closeness(0.8))
    sizes = components(near.select("u", "v"), "t").groupBy("label").count().agg(F.max("count")).first()[0]
    assert ties.count() > 50 and (sizes or 0) < 15


def test_prefixes_shorten_to_the_measured_recall(spark):
    make = lambda close, n: spark.createDataFrame([(i, i + 1, 8, close) for i in range(n)], "u bigint, v bigint, depth int, close double")
    assert jaccard.measured_depth(make(0.99, 50), 8, 6, 0.8, 0.9999) == 8
    assert jaccard.measured_depth(make(0.81, 50), 8, 6, 0.8, 0.9999) == 6
    assert jaccard.measured_depth(make(0.81, 0), 8, 6, 0.8, 0.9999) == 6


def crowd(n, pairs, words=300, pool=450, edits=33):
    """Texts of ``words`` words out of ``pool``, about half alike, and pairs of them at 0.802."""
    rng = np.random.default_rng(5)
    text = lambda ids: " ".join(f"w{x}" for x in ids)
    rows, planted = [(i, text(rng.choice(pool, words, replace=False))) for i in range(n)], []
    for j in range(pairs):
        s = rng.permutation(pool)
        rows += [(n + j, text(s[:words])), (10**6 + j, text(s[edits : words + edits]))]
        planted.append((n + j, 10**6 + j))
    return rows, planted


@pytest.mark.parametrize("cell", [jaccard.CELL, 16])
def test_pairs_in_a_crowd_are_found(spark, docs, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    rows, planted = crowd(800, 40)
    has = np.zeros((len(rows), 450), np.float32)
    for i, (_, t) in enumerate(rows):
        has[i, [int(w[1:]) for w in t.split()]] = 1
    common = has @ has.T
    near = common >= 0.8 * (600 - common)  # all sets have 300 words
    assert near.sum() == len(rows) + 2 * len(planted)
    want = {d: (d, 0) for d, _ in rows} | {d: (a, 1) for a, b in planted for d in (a, b)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(docs(*rows), words=1).collect()}
    assert got == want


def test_families_that_meet_are_all_compared():
    rng = np.random.default_rng(8)
    sketches = rng.integers(0, 256, (300, jaccard.SKETCH), dtype=np.uint8)
    families, sizes = np.arange(300) // 2, rng.integers(90, 111, 300)
    for i in range(0, 200, 4):  # families 2k and 2k + 1 have near sets, in any order of sizes
        sketches[i + 3] = np.where(rng.random(jaccard.SKETCH) < 0.85, sketches[i], sketches[i + 3])
    got = jaccard.families_that_meet(families, sizes, sketches, 0.8)
    assert sorted(tuple(sorted(e)) for e in got) == [(i // 2, i // 2 + 1) for i in range(0, 200, 4)]
    assert jaccard.families_that_meet(families[:1], sizes[:1], sketches[:1], 0.8) == []


def test_sampled_pairs_are_those_of_all_rows(spark, docs):
    rows = variants(random.Random(2), 12, 6, 4, passage=30)
    forest = jaccard._base(docs(*rows), "doc_id", "text", 5, 8).select(F.col("no").alias("node"), "paths")
    got = {(r.u, r.v): (r.depth, r.close) for r in jaccard.sampled_pairs(forest, 8, 0.8).collect()}
    paths = {r.node: np.frombuffer(bytes(r.paths), np.uint8).reshape(jaccard.TREES, 17)[:, 1:].copy().view("<u2") for r in forest.collect()}
    want = {}
    for u, a in paths.items():
        for v, b in paths.items():
            if u != v and (a == b).mean() >= 0.8:
                want[u, v] = (max(next((k for k in range(8) if x[k] != y[k]), 8) for x, y in zip(a, b)), (a == b).mean())
    assert len(paths) <= jaccard.SAMPLE and got == want and len(want) > 50


def test_blocks_do_not_change_counts():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(50) > 0.08], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(30)]
    whole = jaccard.linked(sets, sets, Fraction(4, 5))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            c = len(np.intersect1d(a, b))
            assert whole[i, j] == (Fraction(c, len(a) + len(b) - c) >= Fraction(4, 5))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (205, 203), (203, 204), (7, 7), (100, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 203: 203, 204: 203, 205: 203}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), "t").count() == 0
