"""Line and chunk operators against small sequential models, and by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docskein.functions import text as T
from docskein.functions.iri import slug
from docskein.operators import chunks, containment, lines, views


def rows(spark, texts):
    return spark.createDataFrame([(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id int, ord int, text string")


def merged(spark, texts, op=lines.merge_lines):
    out = {}
    for r in sorted(op(rows(spark, texts)).collect()):
        out.setdefault(r[0], []).append(r.text)
    return out


BULLET, END = re.compile(r"^\s*(?:[•・–—▶*-]|\(\d+\)|\d+[.)]|[a-zA-Z][.)])\s"), re.compile(r"[。！？!?][)”\]}』」】〉》]*\s*$")


def glue(prev, cur):
    if prev.endswith("-"):
        return prev[:-1] + cur.lstrip()
    tight = cur[0] in "、。，．）」』】〉》" or prev[-1] in "（「『【〈《 " or cur[0] == " "
    return prev + ("" if tight else " ") + cur


def model(ts):
    """One line after the other: what is open, and whether it is a list item."""
    out, open_, item = [], None, False
    for t in ts:
        t = re.sub("[ \t]{2,}", " ", t.replace("­", "")).strip("\r")
        blank, bullet = not t.strip(), bool(BULLET.search(t))
        if open_ is not None and (blank or bullet or (not item and END.search(open_))):
            out.append(open_.rstrip())
            open_ = None
        if blank or (open_ is None and re.match(r"^\s*(?:目\s*次|別\d+-\d+)\s*$", t)):
            continue
        if open_ is None:
            open_, item = t, bullet
        else:
            open_ = glue(open_, t)
    return out + ([open_.rstrip()] if open_ is not None else [])


def test_merge_equals_a_sequential_model(spark):
    rng = random.Random(5)
    pool = ["word", " lead", "tail ", "end。", "stop!」", "re-", "", "　", "• item", "(1) one", "2) two", "a. x", "目 次", "別8-1", "「open（", "、comma", "two  \tspaces", "soft­hyphen", "・no space", "\r", "re。-", "」", " 』 ", "」-", "-"]
    texts = {d: [rng.choice(pool) for _ in range(rng.randrange(9))] for d in range(1500)}
    got = merged(spark, texts)
    for d, ts in texts.items():
        assert got.get(d, []) == model(ts), ts


def test_reflow_by_hand(spark):
    texts = {1: ["これは文", "です。次の文", "は続く", "", "・ 項目", "an exam-", "ple is here! And", "more"], 2: [], 3: ["(x) text"], 4: ["A? B！」 C"]}
    assert merged(spark, texts, lines.reflow) == {
        1: ["これは文です。", "次の文は続く", "・ 項目", "an example is here!", "And more"], 3: ["(x) text"], 4: ["A?", "B！」", "C"]
    }


CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def reflow_model(ts):
    """One buffer, flushed at ends: the sentences of a document."""
    out, buf = [], ""
    for t in [x.strip() for x in ts] + [""]:
        item = re.match(r"^(\d+[.)]|[A-Za-z]\)|[・•\-–—◇◆●■□①-⑩])", t)
        if not t or item:
            out += [buf.strip()] if buf.strip() else []
            buf = ""
            out += [t] if item else []
            continue
        if buf.endswith("-"):
            buf = buf[:-1] + t
        elif buf and CJK.match(buf[-1]) and CJK.match(t[0]):
            buf += t
        else:
            buf = f"{buf} {t}" if buf else t
        while m := re.search(r"""[。．！？!?][」』）】》"']*""", buf):
            out += [buf[: m.end()].strip()]
            buf = buf[m.end() :].lstrip()
    return out


def test_reflow_equals_a_sequential_model(spark):
    rng = random.Random(6)
    pool = ["word", "終わり。", "漢字", "かな", "re-", "end。-", "」", "stop!」 more", "", "　", "・ item", "1. x", "a) y", "A? B！", "、c", "wo-rd", "！」-", "?"]
    texts = {d: [rng.choice(pool) for _ in range(rng.randrange(8))] for d in range(1500)}
    got = merged(spark, texts, lines.reflow)
    for d, ts in texts.items():
        assert got.get(d, []) == reflow_model(ts), ts


def test_chunks(spark):
    rng = random.Random(3)
    texts = ["", None, "x" * 90, " a!  b?\n\nc", *("".join(rng.choice(["word ", "end! ", "long" * 9, "\n\n", "　", "😀"]) for _ in range(rng.randrange(120))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rules = T.TextRules(max_chars=60, overlap_chars=11)
    got = {}
    for r in sorted(chunks.char_chunks(df, rules=rules).collect()):
        got.setdefault(r.doc_id, []).append(r.text)
    for i, t in enumerate(texts):
        done, cur = [], ""
        for s in [p.strip() for p in re.split(r"(?<=[。！？!?])\s*|\n{2,}", (t or "").replace("\r\n", "\n")) if p and p.strip()]:
            if len(cur) + len(s) + 1 <= 60:
                cur = f"{cur} {s}".strip()
            else:
                done += [cur] if cur else []
                cur = f"{cur[-11:]} {s}".strip()
        assert got.get(i, []) == done + ([cur] if cur else []), t


def test_marked_slides(spark):
    df = spark.createDataFrame([("f", "[[スライド2]] b\n[[スライド10]] c\nlost\n[[スライド1]] a [[スライド1]]\n[[スライド2]]d\n[[スライド3]]")], "doc_id string, text string")
    got = chunks.slide_chunks(chunks.parse_marked_lines(df), id_col="doc_id").orderBy("slide_no").collect()
    assert [(r.slide_no, r.text) for r in got] == [(1, "a"), (2, "b d"), (3, ""), (10, "c")]


def test_view_dedup_and_nesting(spark):
    spans = [("f", 0, "value_analysis", 1, "AB"), ("f", 0, "value_analysis", 2, "A"), ("f", 1, "value_analysis", 1, "AB"), ("f", 1, "data_analysis", 1, "A"), ("g", 0, "data_analysis", 1, "A")]
    out = views.dedup_views(spark.createDataFrame(spans, "doc_id string, chunk_no int, view_type string, rank int, text string"))
    assert sorted((r.doc_id, r.view_type, r.ord, r.text) for r in out.collect()) == [("f", "data_analysis", 0, "A"), ("f", "value_analysis", 0, "AB"), ("g", "data_analysis", 0, "A")]
    nested = {r.doc_id: [(v.type, list(v.texts)) for v in r.views] for r in views.nest_views(out).collect()}
    assert nested == {"f": [("value_analysis", ["AB"]), ("data_analysis", ["A"])], "g": [("data_analysis", ["A"])]}
    told = spark.createDataFrame([(1, '{"value_analysis": [" a ", "a", "", null, "b", "c", "d"]}'), (2, "no json")], "k int, payload string")
    assert [(r.k, r.view_type, r.rank, r.text) for r in views.parse_spans(told, keys=["k"]).collect()] == [(1, "value_analysis", i + 1, t) for i, t in enumerate("abc")]


@pytest.mark.parametrize("label,want", [(" a  b/c ", "a-b-c"), ("x" * 60, "x" * 48), ("価値 A", "価値-A")])
def test_slug(spark, label, want):
    assert spark.range(1).select(slug(F.lit(label))).first()[0] == want


def test_no_character_cuts_a_text(spark):
    """Sentences are cut at their ends only, whatever control characters they hold."""
    df = spark.createDataFrame([(1, "a\x01b。c\x02d！」e\n\nf")], "doc_id int, text string")
    assert [r.text for r in chunks.sentences(df).orderBy("pos").collect()] == ["a\x01b。", "c\x02d！", "」e", "f"]
    assert [r.text for r in lines.reflow(lines.text_lines(df, keep_blank=True)).orderBy("sent_no").collect()] == ["a\x01b。", "c\x02d！」", "e", "f"]


def test_contained_texts_with_separators(spark):
    rows = [["ab", "b", "a\x02b", "xaby"], ["x", "y", "x\x02y"], ["aa", "aaa"], [], ["abc", "bcd"]]
    df = spark.createDataFrame([(r,) for r in rows], "texts array<string>")
    got = [r.t for r in df.select(T.drop_contained(F.col("texts")).alias("t")).collect()]
    assert got == [[x for x in r if not any(len(y) > len(x) and x in y for y in r)] for r in rows]


def test_many_chunks(spark):
    n = 3000
    df = spark.createDataFrame([(1, "word number one. " * n)], "doc_id int, text string")
    small = T.TextRules(split_ends=".", max_chars=40, overlap_chars=4)
    got = [r.text for r in chunks.char_chunks(df, rules=small).orderBy("chunk_no").collect()]
    done, cur = [], ""
    for s in ["word number one."] * n:
        if len(cur) + len(s) + 1 <= 40:
            cur = f"{cur} {s}".strip()
        else:
            done.append(cur)
            cur = f"{cur[-4:].lstrip()} {s}"
    assert got == [*done, cur] and len(got) > 1000


def test_giant_documents_are_spread(spark):
    """Both ways of dropping contained texts agree."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ab ", "c", "the x. ", "Y is, ", "9! ", "abc. "]) for _ in range(rng.randrange(400))) for _ in range(25)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    patterns = {"value_analysis": "a|Y", "data_analysis": "[0-9x]"}
    small = T.TextRules(split_ends=".!", max_chars=60, overlap_chars=11)
    told = lambda giant: sorted(map(tuple, views.view_texts_of_any_size(df, patterns, giant=giant, rules=small).collect()))
    want = sorted(map(tuple, views.view_texts(df, patterns, rules=small).collect()))
    assert told(10**9) == told(300) == told(0) == want and len(want) > 100


def test_containment_of_rows(spark):
    """Random groups with many overlaps against comparing all pairs, and a text of
    4 MB in linear time."""
    import time

    rng = random.Random(2)
    rows = []
    for g in range(6):
        base = "".join(rng.choice("ab" if g % 2 else "abcdefgh é𝄞") for _ in range(600))
        texts = {base[a : a + rng.randint(1, 90)] for a in (rng.randrange(599) for _ in range(60))} | {"a" * n for n in range(1, 40)} | {"ab" * n for n in range(1, 30, 3)}
        rows += [(g, i, t) for i, t in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "g int, ord int, text string")
    got = {(r["g"], r["text"]) for r in containment.drop_contained_rows(df, ["g"]).collect()}
    assert got == {(g, t) for g, _, t in rows if not any(t != u and t in u for h, _, u in rows if h == g)}
    seconds = []
    for size in (500_000, 4_000_000):
        long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size))
        parts = [long[k * 1000 : k * 1000 + 20 + k] for k in range(200)] + ["not in it " * (k + 1) for k in range(40)]
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate([long, *parts])], "g int, ord int, text string")
        began = time.time()
        assert sorted(r["ord"] for r in containment.drop_contained_rows(df, ["g"]).collect()) == [0, 240]
        seconds.append(time.time() - began)
    assert seconds[1] < 8 * seconds[0] + 30, seconds
