import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from docskein.llm import pieces
from tests.conftest import DATA


@pytest.fixture(scope="module")
def v():
    return pieces.Vocabulary(pieces.model_path())


@pytest.fixture(scope="module")
def unigram():
    """The same vocabulary in the library's own unigram mode."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    proto = ModelProto.FromString(open(pieces.model_path(), "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # marks alone are scored -1e9: too much for the library's 32-bit sums
        if p.score < -1e8:
            p.score = -2e5
            p.type = 1 if len(p.piece) == 1 else 5
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def texts():
    import duckdb

    return [r[0] for r in duckdb.connect().execute(f"select text from read_parquet('{DATA}/sf0.01/documents.parquet') where length(text) < 3000").fetchall()]


def test_words_equal_the_library(v, unigram):
    words = sorted({w for t in texts() for w in t.split()})
    covered = [w for w in words if all(c in v.score for c in w)]
    assert len(covered) > 10_000
    for w in covered:
        assert ids(v.encode(w)[1]) == unigram.encode(w), w


def test_decode_equals_the_library_and_round_trips(v):
    for t in [*texts()[:300], "", " ", "  a  b ", "日本🙂\x00\n\t x", "①ﬁé"]:
        got = v.encode(t)[1]
        assert v.decode(got) == t
        assert v.lib.decode(ids(got)) == t


def brute(v, text):
    """Best score by plain recursion."""

    @lru_cache(None)
    def best(i):
        if i == len(text):
            return 0.0
        options = [v.score[text[i : i + n]][0] + best(i + n) for n in range(1, v.longest + 1) if i + n <= len(text) and text[i : i + n] in v.score]
        if text[i] not in v.score:
            options.append(v.unknown + best(i + 1))
        return max(options)

    return best(0)


def chunked(v, text, size):
    """The scan without Spark: matrices, entries, paths, choice from the end."""
    full = v.normal(text)
    parts = [(full[a : a + min(size, len(full) - a) + v.longest - 1], min(size, len(full) - a)) for a in range(0, len(full), size)]
    now = np.full(v.longest, -np.inf)
    now[0] = 0
    entries = []
    for t, n in parts:
        entries.append(now)
        now = (now[:, None] + v.matrix(t, n)).max(axis=0)
    x, out = 0, []
    for (t, n), entry in list(zip(parts, entries))[::-1]:
        shared, exits = v.paths(t, n, entry)
        x, last = exits[x]
        out.append(shared + last)
    return now[0], b"".join(out[::-1])


@pytest.mark.parametrize("breaks", [True, False])
def test_chunks_do_not_change_the_result(v, breaks):
    rng = random.Random(2)
    sample = [t[:120] for t in texts()[:12]] + ["".join(rng.choice("ab c thein é①") for _ in range(50)) for _ in range(25)] + ["aaaaaaaaaaaaaaaaaaaaaaa", "a      b", "thethethethethe"]
    old, v.breaks = v.breaks, breaks
    try:
        for t in sample:
            score, raw = v.encode(t)
            assert score == pytest.approx(brute(v, v.normal(t)), rel=1e-12)
            for size in (1, 2, 5, 16, 33):
                got = chunked(v, t, size)
                assert got[1] == raw and got[0] == pytest.approx(score, rel=1e-12), (t, size)
    finally:
        v.breaks = old


def test_max_plus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-9, 9, (4, 4)).astype(float) for _ in range(3))
    assert (pieces.max_plus(pieces.max_plus(a, b), c) == pieces.max_plus(a, pieces.max_plus(b, c))).all()


def test_frames(spark, docs, v):
    long = " ".join(texts()[:8])
    df = docs((1, None), (2, ""), (3, "a b"), (4, long), (4, long), (None, long[:5000]), (5, "x" * 9000))
    out = pieces.encode_pieces(df, pieces.model_path(), giant=2000, chunk=700)
    rows = pieces.decode_pieces(out, pieces.model_path()).collect()
    assert sorted(r.decoded for r in rows) == sorted(["", "", "a b", long, long, long[:5000], "x" * 9000])
    for r in rows:
        assert ids(r.ids) == ids(v.encode(r.decoded)[1]) and r.path_score == v.encode(r.decoded)[0]
    assert pieces.encode_pieces(df.limit(0), pieces.model_path()).count() == 0


def test_runs_of_chunks(spark, docs, v):
    """Texts of many chunks: products of several runs, odd numbers of matrices."""
    long = " ".join(texts()[:6])
    df = docs((1, long[:3000]), (2, long[:1025]), (3, "é" * 700), (4, long[:64]))
    rows = pieces.encode_pieces(df, pieces.model_path(), giant=50, chunk=16).collect()
    want = {r.doc_id: v.encode(r.text) for r in df.collect()}
    assert {r.doc_id: (r.path_score, ids(r.ids)) for r in rows} == {i: (s, ids(raw)) for i, (s, raw) in want.items()}


def test_query(spark, v):
    rows = {r.doc_id: r for r in pieces.query(spark, f"{DATA}/sf0.001").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").withColumn("sha", F.sha2("text", 256)).collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].decoded_sha256 == d.sha
        assert rows[d.doc_id].n_ids == len(ids(v.encode(d.text)[1]))
