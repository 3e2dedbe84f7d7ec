"""Spelling variants: against all pairs compared in Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from docskein.llm import variants as V

SCHEMA = "doc_id long, text string"


def words_of(rows, min_chars=6, min_count=5, every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    """Per word (n, n_near, form, form_n, root), all pairs compared."""
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if abs(len(v) - len(w)) <= 1 and near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = (n, len(close), form, counts[form] if form else None)
    told = {}
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        told[w] = (*out[w], root)
    return told


def run(spark, rows, **options):
    return {r["word"]: tuple(r)[1:] for r in V.variants(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()}


def corpus(rng, letters, size, stems):
    """Texts of words at few edits from few stems, some of them much commoner."""
    rows = []
    for i in range(size):
        out = []
        for _ in range(60):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
            out.append("".join(w))
        rows.append((i, " ".join(out)))
    return rows


@pytest.mark.parametrize("held,looked_up", [(64, 4096), (2, 5)])
def test_against_all_pairs(spark, monkeypatch, held, looked_up):
    monkeypatch.setattr(V, "HELD", held)
    monkeypatch.setattr(V, "LOOKED_UP", looked_up)
    rng = random.Random(held)
    rows = corpus(rng, "abÀé", 30, ["aaaaaa", "aabbaab", "baéÀbaabab", "Abababab", "aaaaaaaaaa"]) + [(None, None), (5, ""), (7, "short")]
    assert run(spark, rows) == brute(words_of(rows))


def test_many_words_share_a_half(spark, monkeypatch):
    """A third of all words begin alike: their keys are split, none is lost."""
    monkeypatch.setattr(V, "SHARD_ROWS", 400)
    monkeypatch.setattr(V, "HELD", 16)
    rng = random.Random(3)
    words = ["internation" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(150)] + ["".join(rng.choice("abcdef") for _ in range(7)) for _ in range(300)]
    rows = [(i, " ".join(words)) for i in range(6)]
    assert run(spark, rows) == brute(words_of(rows))


def test_long_words_and_chains(spark):
    long = "ab" * 2_000
    words = [long] * 30 + [long[:777] + long[778:]] * 6 + ["color" + "z"] * 5 + ["colour" + "z"] * 30 + ["colours" + "z"] * 200 + ["colourz" * 2] * 5
    rows = [(1, " ".join(words))]
    got = run(spark, rows, every=10**9)
    assert got == brute(words_of(rows, every=10**9))
    assert got["colorz"][4] == "coloursz" and got["colorz"][2] == "colourz"


def test_ties_and_options(spark):
    rows = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdeh " * 25)]
    got = run(spark, rows, every=10**9)
    assert got["abcdef"] == (5, 2, "abcdeg", 25, "abcdeg")  # the smaller of two that are as common
    assert run(spark, [(1, "ab ac " * 3)], min_chars=2, min_count=1, every=10**9)["ab"][1] == 1
    with pytest.raises(ValueError):
        V.variants(spark.createDataFrame(rows, SCHEMA), min_chars=1)


def test_empty_and_clashing(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "letters " * 9, 1, "x")], "doc_id long, text string, n int, word string")
    assert [tuple(r) for r in V.variants(df).collect()] == [("letters", 9, 0, None, None, "letters")]


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert V.one_edit(a, b) == near(a, b), (a, b)
