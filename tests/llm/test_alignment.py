"""Alignment of two tokenizers: against whole texts tokenised and walked in Python."""

import hashlib
from collections import Counter

import pytest

from docskein.llm.alignment import align, public_pair
from tests.conftest import DATA

SCHEMA = "doc_id long, text string"


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by the whole
    tokenizers."""
    import public_tokenizers as files
    import sentencepiece
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
    pair, counts, told = public_pair(), Counter(), []
    for text in texts:
        want = (" " + (text or "")).encode()
        ids = [byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)] if text else [[], []]
        if any(b"".join(t.bytes_of[i] for i in x) != want for t, x in zip((pair.first, pair.second), ids)):
            told.append(None)
            continue
        ends = []
        for t, x in zip((pair.first, pair.second), ids):
            at, own = 0, {}
            for k, i in enumerate(x):
                at += len(t.bytes_of[i])
                own[at] = k
            ends.append(own)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ids[0][ends[0][c]], ids[1][ends[1][c]]) for c in cuts]
        counts.update(links)
        groups, p, q = [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, ids[0][p : ends[0][c] + 1])) + "|" + ",".join(map(str, ids[1][q : ends[1][c] + 1])))
            p, q = ends[0][c] + 1, ends[1][c] + 1
        told.append((len(ids[0]), len(ids[1]), links, ";".join(groups)))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], len(x[2]), len(x[2]), sum(counts[e] == top[e[1]] for e in x[2]), sum(counts[e] for e in x[2]), x[3]) for x in told
    ]


TEXTS = [
    "The quick brown fox.\nJumps  over   the lazy dog's back!", None, "", " ", "   \n\n  ", "a\n  b \n c\t\td", "trailing  ", "\n lead", "\r\nline\r\n{\r\n", "<|endoftext|> <s> </s> <unk> <0x41>",
    "a ▁ mark", "▁", "naïve café ÀÿŸ — “quotes” …", "日本語のテキスト　全角", "emoji 👩‍👩‍👧 \U0001faf8 \U0001f9ff", "nul\x00and\x1f\x1ccontrol", "a\u0085b c d　e", "12345 67,890.12 3rd ½ ²", "x" * 5000, "ab " * 3000,
    "don't we'll I'M 'S", "؀ ͸ ", "ﬁ Å é é", "The quick brown fox.\nJumps  over   the lazy dog's back!",
]


@pytest.mark.parametrize("digest", [True, False])
def test_against_whole_texts(spark, digest):
    rows = [(i // 2, t) for i, t in enumerate(TEXTS)]  # ids repeat
    got = align(spark.createDataFrame(rows, SCHEMA).repartition(3), public_pair, digest=digest).collect()
    want = []
    for (i, _), x in zip(rows, brute([t for _, t in rows])):
        want.append((i, *x[:6], hashlib.sha256(x[6].encode()).hexdigest() if digest and x[6] else x[6]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_random_texts(spark):
    import random

    rng = random.Random(5)
    pool = ["the", "tion", "é", "ß", "ЖД", "中", " ", "  ", "\n", "\t", "\r", ".", ",", "'s", "'", "1", "20", " ", "_", "-", "(", "});", "▁", "​", "😀", "A", "　"]
    rows = [(i, "".join(rng.choice(pool[: 26 if i % 4 else 22]) for _ in range(rng.randint(1, 40)))) for i in range(600)]
    got = {r[0]: tuple(r)[1:] for r in align(spark.createDataFrame(rows, SCHEMA).repartition(4), public_pair, digest=False).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute([t for _, t in rows]))}


def test_empty_clashing_and_null_ids(spark):
    assert align(spark.createDataFrame([], SCHEMA), public_pair).count() == 0
    df = spark.createDataFrame([(None, "two words", 1, 2), (None, "two words", 3, 4)], "doc_id long, text string, no int, links int")
    got = align(df, public_pair).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["doc_id"] is None and got[0]["n_links"] == 2


def test_query(spark):
    from docskein.llm.alignment import query

    sf_dir = f"{DATA}/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (*x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[6] else "") for (i, _), x in zip(rows, brute([t for _, t in rows]))}
    assert {r["doc_id"]: tuple(r)[1:] for r in query(spark, sf_dir).collect()} == want


def test_new_units_of_many_texts_are_encoded_together():
    """In one call, by halves where a unit's bytes do not come back; values as alone."""
    tokens = public_pair()
    texts = [tokens.split(f"zq{i}word and\n zq{i}more,  ") for i in range(64)] + [[" zq", "▁b", " qz"]]
    one, calls = tokens.encode, []
    tokens.encode = lambda units: calls.append(len(units)) or one(units)
    try:
        made = tokens.learn(texts)
        assert len(calls) < 20 and max(calls) > 128 and tokens.learn(texts[:64]) == tokens.encode([" "])
    finally:
        tokens.encode = one
    assert made["▁b"] is None and all((made[u] if u in made else tokens.known[u]) == one([u])[u] for units in texts for u in units)


def test_long_units(spark):
    """Of more tokens than are searched one by one, and of just as many."""
    import random

    from docskein.llm.alignment import SEARCHED

    rng = random.Random(7)
    pool = ["the", "tion", "é", "ß", "ЖД", "q", "20", "_", "-", "(", "});", "Az", "xk"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate([400, 3000, *range(SEARCHED // 2, SEARCHED + 8, 2)])]
    got = {r[0]: tuple(r)[1:] for r in align(spark.createDataFrame(rows, SCHEMA), public_pair, digest=False).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute([t for _, t in rows]))}
