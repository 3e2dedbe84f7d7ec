"""Spelling variants (operator 12): words at one edit from each other.

Words that differ by one inserted, deleted or replaced code point agree in all
but one of the two halves of either word.

1. Every word holds its two halves, each the segment that is intact if the edit
   lies in the other half; every word is also looked up under the segments that
   a near word of its length, or of one more or less, could hold.
2. A key (the length of the holding word, the place of the window that may hold
   the edit, and what stands before and after it) that many words hold is split:
   its window is halved, and what is known of the word grows by a quarter.  At a
   window of one code point no more words than the alphabet has letters share a
   key, so the splitting ends, whatever the words are.
3. Keys are dealt to shards of bounded size.  A shard builds an Aho-Corasick
   automaton of its segments and scans the words that may meet one of them;
   matches count where the segment's offset and the words' lengths fit, and are
   verified by comparing the windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import materialize, need, release, skewed_join, whole_text

HELD, LOOKED_UP = 64, 4096  # a key that more words hold, or are looked up under, is split
SHARD_ROWS, SHARD_CHARS = 60_000, 4_000_000
LONGEST_SEGMENT = 64  # code points of a segment that the automaton holds; the rest is compared
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, of at least ``min_chars``
    code points and ``min_count`` occurrences.  A run whose checksum (with its
    document's id) ``every`` divides has lost one code point."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(whole_text(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    # A deletion shortens: shorter runs cannot count.
    runs = runs.where(F.length("run") >= min_chars).select(F.coalesce("id", F.lit("")).alias("id"), F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_count) & (F.length("word") >= min_chars))


def _key(word: Column, length: Column, lo: Column, hi: Column) -> list[Column]:
    """The key of the window [lo, hi) of a word of ``length``, as two longs: a word
    agrees with it if it begins and ends like the word outside the window."""
    before = F.substring(word, F.lit(1), lo)
    after = F.substring(word, F.length(word) - (length - hi) + 1, length - hi)
    return [F.xxhash64(length, lo, hi, before, after).alias("k1"), F.xxhash64(F.lit(7919), after, hi, before, lo, length).alias("k2")]


def _windows(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """``rows`` (word, n, length, holds) with each half of [lo, hi) as a window."""
    mid = F.floor((lo + hi) / 2).cast("int")
    halves = F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))
    df = rows.withColumn("w", F.explode(halves)).select("word", "n", "length", "holds", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    return df.select("*", *_key(F.col("word"), F.col("length"), F.col("lo"), F.col("hi")))


def _split(words: DataFrame) -> Iterator[DataFrame]:
    """Rows (word, n, length, holds, lo, hi, k1, k2) of settled keys, level by level.
    Keys under which no other word is looked up are left out."""
    own = F.length("word")
    lengths = F.array(F.struct(own.alias("length"), F.lit(True).alias("holds")), *[F.struct((own + d).alias("length"), F.lit(False).alias("holds")) for d in (-1, 0, 1)])
    rows = words.select("word", "n", F.explode(lengths).alias("x")).select("word", "n", "x.length", "x.holds")
    rows = _windows(rows, F.lit(0), F.col("length"))
    while True:
        keys = rows.groupBy("k1", "k2").agg(F.count_if("holds").alias("held"), F.count_if(~F.col("holds")).alias("looked_up"), F.first(F.col("hi") - F.col("lo")).alias("width"))
        many = (F.col("width") > 1) & ((F.col("held") > HELD) | (F.col("looked_up") > LOOKED_UP))
        keys = keys.where((F.col("held") > 0) & (F.col("looked_up") > 1)).select("k1", "k2", many.alias("many"), (F.col("held") + F.col("looked_up")).alias("weight"))
        keys = materialize(keys, "segments")
        told = materialize(skewed_join(rows, keys, ["k1", "k2"], "weight"), "windows")
        release(keys)
        yield told.where("NOT many").drop("many")
        if told.where("many").isEmpty():
            return
        rows = _windows(told.where("many"), F.col("lo"), F.col("hi"))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def near_in_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Per word looked up its near words held in the shard: how many, and the one
    of largest n (ties: the smallest).

    A near word's windows part it, so several may fit where the edit can stand at
    more than one place; it counts in the first of them, that is where the word
    does not already end like the near word from the window's begin on."""
    import ahocorasick

    segments: dict[str, tuple[dict, dict]] = {}
    held = shard[shard["holds"]]
    for word, n, lo, hi in zip(held["word"], held["n"].tolist(), held["lo"].tolist(), held["hi"].tolist()):
        front = lo >= len(word) - hi  # the longer part outside the window
        known = word[:lo] if front else word[hi:]
        pair = segments.setdefault(known[-LONGEST_SEGMENT:], (defaultdict(list), defaultdict(list)))
        pair[0 if front else 1][(len(word), lo if front else len(word) - hi)].append((word, n, lo, hi))
    automaton = ahocorasick.Automaton()
    for segment, pair in segments.items():
        automaton.add_word(segment, pair)
    out = []
    if segments:
        automaton.make_automaton()
        for word in shard.loc[~shard["holds"], "word"].drop_duplicates():
            size, count, best = len(word), 0, None
            for end, (fronts, backs) in automaton.iter(word):
                found = [fronts.get((length, end + 1), ()) for length in (size - 1, size, size + 1)]
                if end == size - 1:
                    found += [x for (length, _), x in backs.items() if abs(length - size) <= 1]
                for other, n, lo, hi in (x for xs in found for x in xs):
                    rest = len(other) - hi
                    if lo + rest > size or word[:lo] != other[:lo] or word[size - rest :] != other[hi:]:
                        continue
                    if one_edit(word[lo : size - rest], other[lo:hi]) and (not lo or not word.endswith(other[lo:])):
                        count += 1
                        if best is None or (-n, other) < best:
                            best = (-n, other)
            if count:
                out.append((word, count, -best[0], best[1]))
    return pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words that have near words; ``words``
    (word, n) is a written table of distinct words."""
    found = None
    for rows in _split(words):
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
        shards = max(1, -(-size["n"] // SHARD_ROWS), -(-size["chars"] // SHARD_CHARS))
        shard = F.pmod(F.xxhash64("k2", "k1"), F.lit(shards))
        # A word is scanned once in a shard, however many keys lead it there.
        held = rows.where("holds").select(shard.alias("shard"), "word", "n", "lo", "hi", "holds")
        looked = rows.where("NOT holds").select(shard.alias("shard"), "word", "n", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "holds").distinct()
        near = held.unionByName(looked).groupBy("shard").applyInPandas(near_in_shard, "word string, n_near bigint, near_n bigint, near string")
        found = near if found is None else found.unionByName(near)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")).select("word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, from (word, form): forms are followed
    to the last by doubling steps, each round written down.  A form is ``ratio``
    times as common as its word, so rounds are few and there is no circle."""
    steps = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not steps.where("open").isEmpty():
        weight = steps.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
        after = materialize(steps.select(F.col("word").alias("root"), F.col("root").alias("next")).join(weight, "root"), "next-roots")
        met = skewed_join(steps.select("word", "root"), after, ["root"], "weight", "left")
        steps_now = materialize(met.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "roots")
        release(after, steps)
        steps = steps_now
    return steps.select("word", "root")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ratio: int = 5, **options) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are what ``word_counts`` tells (its parameters are taken too).  Two are
    near if they differ by exactly one inserted, deleted or replaced code point.
    A word's form is its near word of largest n (ties: the smallest in code-point
    order), if that is at least ``ratio`` times as common, else null; its root is
    the last word that forms lead to, or the word itself.

    Null and empty texts have no words; a null id is an empty one.  Rows that
    repeat an id are rows like others, extra columns are not looked at, and a
    table without words gives an empty table.  Words of any length and any
    number of words that share a half are handled alike.
    """
    need(docs, id=id_col, text=text_col)
    if options.get("min_chars", 2) < 2:
        raise ValueError("words of one code point have no halves")
    if ratio <= 1:
        raise ValueError("a form must be commoner than its word, or forms could lead in a circle")
    words = materialize(word_counts(docs, id_col=id_col, text_col=text_col, **options), "words")
    near = words.join(near_words(words), "word", "left")
    close = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    near = materialize(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, F.col("near")).alias("form"), F.when(close, F.col("near_n")).alias("form_n")), "near-words"
    )
    told = roots(near.where("form IS NOT NULL"))
    return near.join(told, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


# --- query ------------------------------------------------------------------

NAME = "op12_variants"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(docs)


# crc32 has no function here: it is folded over the bytes of a run's distinct
# (document, run) pairs, four bits at a time.
ORACLE_SQL = r"""
WITH runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw
  FROM documents),
counted AS (
  SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(raw) >= 6 GROUP BY ALL),
nibbles AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
checked AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda b: ('0x' || b)::BIGINT)),
           lambda c, b: xor((xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4), t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1]))) AS h
  FROM counted, nibbles),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM checked),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS (
  SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: left(word, i::INT - 1) || substr(word, i::INT + 1))))) AS key
  FROM words),
pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n
  FROM gone a JOIN gone b ON a.key = b.key AND a.word <> b.word),
exact AS (
  SELECT p.* FROM pairs p
  WHERE CASE WHEN length(word) = length(near)
             THEN len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i::INT, 1) <> substr(near, i::INT, 1))) = 1
             ELSE true END),
best AS (
  SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM exact GROUP BY word, n),
told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
steps AS (
  WITH RECURSIVE walk AS (
    SELECT word, word AS here, 0 AS depth FROM told
    UNION ALL
    SELECT walk.word, told.form, depth + 1 FROM walk JOIN told ON walk.here = told.word WHERE told.form IS NOT NULL)
  SELECT word, arg_max(here, depth) AS root FROM walk GROUP BY word)
SELECT t.word, t.n, t.n_near, t.form, t.form_n, s.root FROM told t JOIN steps s ON t.word = s.word
"""
