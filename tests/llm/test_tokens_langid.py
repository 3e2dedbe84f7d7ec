import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docskein.llm import langid, packing
from tests.conftest import DATA


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(packing.tokenizer_path())


def _whole(words, text):
    return words.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "a", "It's we'll DON'T 'S", "x<|endoftext|>y", "ΟΔΟΣ", "İstanbul", "é ﬁ ½ ² Ⅷ _a_ 12,3", "a\x1cb　c​d\xa0e", "日本語テキスト。", "🙂🙂 ok",
    "tab\tline\nfeed\r\n", "a" * 5000, "﻿q",
])
def test_word_ids_equal_the_tokenizer(words, text):
    assert np.frombuffer(words(text), "<u4").tolist() == _whole(words, text)


def test_word_ids_on_documents_and_random_texts(words):
    import duckdb

    texts = [r[0] for r in duckdb.connect().execute(f"select text from read_parquet('{DATA}/sf0.01/documents.parquet')").fetchall()]
    rng = random.Random(5)
    texts += ["".join(rng.choice("aZé'sſ \ńß1½-.,日ǅKΩ") for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(words(t), "<u4").tolist() == _whole(words, t), t[:80]


def test_units_seen_before_are_looked_up_whole(words):
    """Neither the word pattern nor the model is asked again, whatever else a text holds."""
    text = "Zqarl, zqarl don't (zqarl) 12,5é \n xy !"
    want, cut, asked = _whole(words, text), words.words, []
    words(text)
    words.words = lambda unit: asked.append(unit) or cut(unit)
    try:
        got = [words(text), words(text + " newqarl!")]
    finally:
        words.words = cut
    assert asked == ["newqarl!"] and np.frombuffer(got[0], "<u4").tolist() == want and got[1].startswith(got[0])
    for apart in ("a\x1cb 'S\x1f'S", "q\x1d", "\x1e\x1e r"):  # only Python takes these for white space
        assert np.frombuffer(words(apart), "<u4").tolist() == _whole(words, apart)
    assert packing.word_tokenizer(packing.tokenizer_path()) is packing.word_tokenizer(packing.tokenizer_path())


def test_sum_of_squares_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        cap = int(rng.integers(3, 14))
        sizes = rng.integers(1, cap + 1, 25)
        bins, offsets, gaps = packing.sum_of_squares(sizes, cap)
        open_gaps = {}
        for i, s in enumerate(sizes.tolist()):
            def cost(after):
                held = [g for g in after if 0 < g < cap]
                return sum(held.count(g) ** 2 for g in set(held))

            options = []
            for g in sorted(set(open_gaps.values())):
                if s <= g < cap:
                    left = sorted(open_gaps.values())
                    left.remove(g)
                    options.append((cost([*left, g - s]), g - s, g))
            options.append((cost([*open_gaps.values(), cap - s]), cap - s, cap))
            best = min(options)
            b = int(bins[i])
            assert open_gaps.get(b, cap) == best[2] and cap - open_gaps.get(b, cap) == offsets[i]
            open_gaps[b] = open_gaps.get(b, cap) - s
        assert [open_gaps[b] for b in range(len(gaps))] == gaps.tolist()


def _check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, words):
    rows = packing.query(spark, f"{DATA}/sf0.01").collect()
    n = _check_packing(rows, 4096)
    total = sum(r.length for r in rows)
    assert -(-total // 4096) <= n <= 1.01 * total / 4096 + 1
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids = _whole(words, t) + [1]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in own) == len(ids)


def test_ids_of_every_code_point():
    """Each character alone, in a word, doubled and after a digit."""
    words = packing.WordTokenizer(packing.tokenizer_path())
    texts = [f"a{c}b {c}{c} 1{c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = [t for t in texts if not words.unsettled(t)]  # the others go through the tokenizer whole
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        for t, want in zip(part, words.whole.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(words(t), "<u4").tolist() == want.ids, t
    assert len(texts) > 40_000


def test_packing_edges(spark, docs):
    df = docs((1, None), (1, ""), (None, "a b c"), (2, "a b " * 60), (2, "a b " * 60))
    pieces = packing.tokenize_pieces(df, packing.tokenizer_path(), capacity=50)
    rows = packing.pack(pieces, capacity=50, shard_pieces=4, loose=0.1).collect()
    assert sorted(r.length for r in rows) == [1, 1, 4, 21, 21, 50, 50, 50, 50]
    _check_packing(rows, 50)
    assert packing.pack(pieces.limit(0)).count() == 0


def _slow_bits(model_texts, text):
    """PPM code length by walking contexts byte by byte."""
    from collections import Counter, defaultdict
    from math import log2

    table = defaultdict(Counter)
    for t in model_texts:
        b = b"\n\n\n" + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                table[k, b[i - k : i]][b[i]] += 1
    bits, b = 0.0, b"\n\n\n" + text.encode()
    for i in range(3, len(b)):
        for k in range(3, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = table.get((k, b[i - k : i]))
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                bits += log2((n + d) / seen[b[i]])
                break
            bits += log2((n + d) / d)
    return bits


def test_code_lengths_against_brute_force(monkeypatch):
    texts = {"aa": ["the cat sat on the mat", "that hat"], "bb": ["der hund und die katze", "ein haus im garten"], "cc": ["zzzz"]}
    trees = langid.ContextTrees(texts)
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for t in ("the hat", "ein hund", "", "zzz zz", "\x00ÿé the", "quite unseen 123"):
            got = trees.code_lengths(t.encode())
            want = [_slow_bits(texts[lang], t) for lang in trees.langs]
            assert np.allclose(got, want), t


def test_language_query_accuracy(spark):
    got = {r.doc_id: r for r in langid.query(spark, f"{DATA}/sf0.01").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in lang)
    right = sum(got[i].lang_pred == lang[i] for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark, docs):
    df = docs((0, "hello there"), (1, None), (2, ""), (3, "123 !?"), (None, "hello"), (5, "x" * 100), (5, "x" * 100)).withColumn("lang", F.when(F.col("doc_id") == 0, "en"))
    rows = langid.identify_language(df).collect()
    pred = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in rows}
    assert all(r.fits == (r.lang_pred != "und") for r in rows)
    assert pred[1, None] == pred[2, ""] == pred[3, "123 !?"] == ("und", 0.0)
    assert pred[None, "hello"][0] == "en" and len(rows) == 7 and rows[0]["a b"] == 7
    none = langid.identify_language(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.identify_language(df.limit(0)).count() == 0


def test_language_of_long_documents_only(docs):
    long = {d: "grüße aus dem wald " * 2000 for d in range(1, 12)}
    rows = [(d, t, "de") for d, t in long.items()] + [(d, "what the weather will be", "en") for d in range(20, 40)]
    df = docs(*[(d, t) for d, t, _ in rows])
    lang = {d: x for d, _, x in rows}
    df = df.withColumn("lang", F.when(F.col("doc_id") < 20, "de").otherwise("en"))
    got = {r.doc_id: r.lang_pred for r in langid.identify_language(df).collect()}
    assert got == lang
    assert {r.lang_pred for r in langid.identify_language(df, max_chars=10).collect()} == {"de", "en"}


def test_sample_is_drawn_from_few_documents(docs):
    df = docs(*[(i, f"text number {i}") for i in range(6000)])
    draw = lambda n: langid.training_sample(df, id_col="doc_id", text_col="text", lang_col="lang", docs_per_lang=n, max_chars=9, max_langs=5)
    assert sorted(r["rank"] for r in draw(20).collect()) == list(range(1, 21))
    every = {r.text: r["rank"] for r in langid.training_sample(df, id_col="doc_id", text_col="text", lang_col="lang", docs_per_lang=6000, max_chars=99, max_langs=5).collect()}
    few = {r.text: r["rank"] for r in langid.training_sample(df, id_col="doc_id", text_col="text", lang_col="lang", docs_per_lang=50, max_chars=99, max_langs=5).collect()}
    assert few == {t: k for t, k in every.items() if k <= 50}


def test_numerals_are_not_letters():
    trees = langid.ContextTrees({"en": ["some words"]})
    assert [trees.predict(t)[0] for t in ("\u00bd \u00b2", "\u2167", "12_", "\u00bd a", "\u00e9")] == ["und", "und", "und", "en", "en"]


def test_labels_of_one_repeated_id_are_learned(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:8]
    rows = spark.range(3000).selectExpr("id AS n", "explode(array(" + ", ".join(map(str, ids)) + ")) AS doc_id")
    rows = rows.selectExpr("doc_id", "concat('word ', n % 40) AS text", "concat('l', doc_id) AS lang")
    drawn = langid.training_sample(rows, id_col="doc_id", text_col="text", lang_col="lang", docs_per_lang=20, max_chars=100, max_langs=200)
    assert {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()} == {f"l{i}": 20 for i in ids}
