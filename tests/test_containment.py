"""Containment in groups of one row, and what the anchors of larger ones leave on disk."""

import os
import random

import pytest

from docskein.operators import containment
from docskein.sources.stages import Stages


def brute(rows):
    return sorted(r for r in rows if not any(o[:2] == r[:2] and len(o[3]) > len(r[3]) and r[3] in o[3] for o in rows))


def make(seed, groups, n):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        texts = set()
        while len(texts) < n:
            t = "".join(rng.choice("ab\x00\x01é\U0001f600") for _ in range(rng.choice([1, 2, 3, 7, 20, 60])))
            texts |= {t, t[rng.randrange(len(t)) :] if rng.random() < 0.5 else t}
        rows += [(g // 2, f"v{g % 2}", i, t) for i, t in enumerate(sorted(texts))]
    return rows


def on_disk(stages, name):
    folder = stages.path(name).removeprefix("file://")
    return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))


@pytest.mark.parametrize("row_chars, few", [(10**6, 100), (0, 10**6), (0, 0), (300, 0), (300, 100)])
def test_both_ways_agree_with_all_pairs(spark, row_chars, few):
    rows = make(4, 6, 14)
    got = containment.drop_contained_rows(spark.createDataFrame(rows, "doc bigint, view string, ord int, text string"), ["doc", "view"], row_chars=row_chars, few_asks=few)
    assert sorted(map(tuple, got.select("doc", "view", "ord", "text").collect())) == brute(rows)


@pytest.mark.parametrize("few", [0, 10**6])
def test_disk_is_bounded_by_the_texts(spark, monkeypatch, few):
    """Texts that contain nothing have no anchors on disk but their own."""
    made = []
    monkeypatch.setattr(containment, "Stages", lambda s: made.append(Stages(s)) or made[-1])
    rng = random.Random(7)
    words = lambda n: " ".join(f"{rng.getrandbits(20):05x}" for _ in range(n))
    rows = [(0, "v", i, words(rng.choice([2, 5, 50, 400]))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc bigint, view string, ord int, text string")
    assert containment.drop_contained_rows(df, ["doc", "view"], row_chars=0, few_asks=few).count() == 200
    anchors = spark.read.parquet(made[0].path("anchors"))
    assert anchors.count() <= 10 * len(rows) and on_disk(made[0], "anchors") < on_disk(made[0], "texts")
    assert containment.drop_contained_rows(df.where("ord < 50"), ["doc", "view"]).count() == 50
    assert not os.path.exists(made[1].path("anchors").removeprefix("file://"))
