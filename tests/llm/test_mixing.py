"""Mixing: targets, exact totals, permutations and the texts themselves."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docskein.llm import mixing as M

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1), repeat=3):
    """Shares filled up one after another; ``sizes`` in the order of sources."""
    w = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    total, full = sum(sizes.values()), {}
    while True:
        left, weight = total - sum(full.values()), sum(w[s] for s in sizes if s not in full)
        over = {s: repeat * sizes[s] for s in sizes if s not in full and left * w[s] / weight > repeat * sizes[s]}
        if not over:
            return {s: full[s] if s in full else left * w[s] / weight for s in sizes}
        full |= over


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def rows_of(n, sources=("a", "b", "c", None)):
    rng = np.random.default_rng(4)
    pick = ["hot" if k % 3 == 0 else sources[k % len(sources)] for k in range(n)]
    return [(k // 2, " ".join(f"w{k}x{j}" for j in range(int(rng.integers(0, 60)))) + "\t\n" * (k % 2), s) for k, s in enumerate(pick)]


def told(made):
    return made.documents.join(made.taken(), "no", "left").select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")).collect()


@pytest.mark.parametrize("block,shard", [(7, 5), (100_000, 4096)])
def test_targets_and_takes(spark, block, shard):
    rows = rows_of(240) + [(9, None, "a"), (10, "  ", "empty"), (11, "one two", "small")]
    made = M.mix(spark.createDataFrame(rows, SCHEMA).repartition(5), block_words=block, shard_slots=shard)
    got = told(made)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = targets({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))})
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(words(t))) for i, t, s in rows)
    took = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(took[s] == min(round(want[s]), 3 * sizes[s]) for s in sizes)
    slots = made.slots.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    assert all(r["slot"] < shard for r in slots)


def test_full_sources(spark):
    """Two sources stop at three times their words; what is over goes to the third."""
    rows = [(1, "a b", "p"), (2, "c " * 5, "q"), (3, "d " * 500, "r")]
    got = {r["source"]: r for r in told(M.mix(spark.createDataFrame(rows, SCHEMA), block_words=4, shard_slots=8))}
    assert (got["p"]["target"], got["q"]["target"], got["r"]["target"]) == (6, 15, 486)
    assert (got["p"]["taken"], got["q"]["taken"], got["r"]["taken"]) == (6, 15, 486)


def test_reruns_and_partitions_agree(spark):
    rows = rows_of(150)
    one = M.mix(spark.createDataFrame(rows, SCHEMA).repartition(1), block_words=8, shard_slots=16)
    two = M.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), block_words=8, shard_slots=16)
    assert sorted(map(str, told(one))) == sorted(map(str, told(two)))
    assert sorted(map(tuple, one.slots.collect())) == sorted(map(tuple, two.slots.collect()))


def test_texts(spark):
    """The mix's texts hold each document's words as often as the digest says."""
    rows = rows_of(80)
    docs = spark.createDataFrame(rows, SCHEMA)
    made = M.mix(docs, block_words=9, shard_slots=10)
    texts = made.texts(docs).collect()
    assert len(texts) == made.slots.count()
    times = Counter(w for r in texts for w in r["text"].split(" "))
    taken = defaultdict(int)
    for r in made.documents.join(made.taken(), "no").select("id", "taken").collect():
        taken[r["id"]] += r["taken"]
    owner = {w: i for i, t, _ in rows for w in words(t)}
    found = Counter()
    for w, n in times.items():
        found[owner[w]] += n
    assert found == {i: n for i, n in taken.items() if n}


def test_more_sources_than_groups(spark, monkeypatch):
    rows = [(k, "x " * (k % 5 + 1), f"s{k:03}") for k in range(300)]
    monkeypatch.setattr(M, "GROUPS", 7)
    got = told(M.mix(spark.createDataFrame(rows, SCHEMA), block_words=2, shard_slots=32))
    want = targets({s: len(words(t)) for _, t, s in rows})
    assert all(r["taken"] == min(round(want[r["source"]]), 3 * r["size"]) for r in got)


def test_permutations():
    for n in (1, 2, 3, 16, 17, 1000):
        seen = [M.permuted(np.arange(n), np.full(n, n), np.full(n, k, np.uint64)).tolist() for k in range(6)]
        assert all(sorted(s) == list(range(n)) for s in seen)
        assert n < 16 or len(set(map(tuple, seen))) == 6


def test_counts_of_shards(monkeypatch):
    totals = np.array([0, 1, 5, 300, 7000])
    for limit in (10**9, 100):
        monkeypatch.setattr(M, "EXACT_DRAWS", limit)
        n, before = int(totals.sum()), np.zeros(5, np.int64)
        for shard in range(-(-n // 64)):
            own, seen = M.shard_counts(totals, n, 64, shard, 1)
            assert (seen == before).all() and own.sum() == min(64, n - 64 * shard) and (own >= 0).all()
            before = before + own
        assert (before == totals).all()


def test_empty_and_clashing(spark):
    assert told(M.mix(spark.createDataFrame([], SCHEMA))) == []
    assert [r["taken"] for r in told(M.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)))] == [0, 0]
    df = spark.createDataFrame([(None, "a b", None, 1, 2)], "doc_id long, text string, source string, size int, no int")
    assert [(r["size"], r["target"], r["taken"]) for r in told(M.mix(df))] == [(2, 2.0, 2)]
