"""Sentences, chunks and spans that are cut without looking twice."""

import random

from pyspark.sql import functions as F

from docskein.functions import text as T
from docskein.operators import views


def test_cuts_equal_the_pattern(spark):
    rng = random.Random(7)
    marks = ["a", "b", " ", ".", "!", "。", "\n", "\n\n", "\r\n", "\r", "\t", "　", "é", "\x01"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(400)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ends = T.western().split_ends
    plain = F.replace(F.coalesce("t", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    want = F.filter(F.transform(F.split(plain, f"(?<=[{ends}]){T.SPACE}*|\n{{2,}}", -1), T.strip), lambda s: s != "")
    assert df.where(T.split_sentences(F.col("t"), ends) != want).count() == 0


def test_chunks_over_blocks_equal_a_model(spark):
    rng = random.Random(8)
    lists = [["x" * rng.choice((1, 3, 9, 60)) + "." for _ in range(n)] for n in (0, 1, T.RUN - 1, T.RUN, T.RUN + 1, 700)]

    def model(sentences: list[str]) -> list[str]:
        out, cur = [], ""
        for s in sentences:
            if len(cur) + len(s) + 1 > 40:
                out, cur = out + ([cur] if cur else []), cur[-7:].lstrip()
            cur += (" " if cur else "") + s
        return out + ([cur] if cur else [])

    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, s array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", T.chunk_sentences(F.col("s"), 40, 7).alias("c")).collect()}
    assert got == {i: model(x) for i, x in enumerate(lists)}


def test_no_pattern_is_looked_for_in_vain(spark):
    """Once a chunk has its spans the rest is not matched: this pattern would overflow
    the stack on the last sentence."""
    chunk = "ac. bc. abc. " + "ab" * 100_000 + "."
    df = spark.createDataFrame([(1, 0, chunk)], "doc_id int, chunk_no int, text string")
    rows = views.view_spans(df, {"v": "^(a|b)*c"}, top=3, rules=T.western()).collect()
    assert [r["text"] for r in rows] == ["ac.", "bc.", "abc."]
