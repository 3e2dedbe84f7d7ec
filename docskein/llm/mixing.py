"""Mixing sources to target weights (operator 13).

1. The words of a source, document after document, are cut into blocks of a fixed
   number of words (the last one may be shorter): running sums over ranges of
   documents, so that no task holds a source.
2. Targets share all words by weight; a source gives at most ``repeat`` times its
   own, and what is over is shared again.  A target is a number of slots, each of
   which takes one block (the last one of a source perhaps a part of it).
3. Output shards of a fixed number of slots draw how many each source gets: a
   multinomial draw on condition that the sources' numbers over all shards are
   theirs.  A shard finds its counts, and those of all shards before it, by going
   down a tree of halves whose draws have seeds of their own: no shard waits for
   another, and a lost task draws the same again.
4. A source's k-th slot takes the k-th block of a pseudorandom permutation of its
   blocks, another one each time it has gone through all of them.
5. Slots meet the documents' stretches of words by source and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docskein.llm.common import fresh, materialize, need, row_key, skewed_join, whole_text

WORD = r"[^ \t-\r]+"
BLOCK_WORDS, SHARD_SLOTS = 256, 4096
RANGE_ROWS = 100_000  # rows of a range whose running sum one task makes
GROUPS = 1 << 16  # sources are drawn in so many groups at most
EXACT_DRAWS = 500_000_000  # beyond, the library's hypergeometric draws end


def running_sums(df: DataFrame, order: list[Column | str], values: list[str], name: str) -> DataFrame:
    """``df`` plus, for each of ``values``, ``<value>_before``: its sum over the rows
    that come earlier in ``order``.  Rows are sorted into ranges that are written
    down; a range's own sums are a window, and the ranges' totals (a row each) are
    summed up once more."""
    n = max(1, -(-df.count() // RANGE_ROWS))
    part = fresh("part", df.columns)
    keys = [df[c] if isinstance(c, str) else c for c in order]
    ranged = materialize(df.repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()), name)
    totals = ranged.groupBy(part).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    begin = materialize(totals.select(part, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_begin") for v in values]), f"{name}-totals", rows=n)
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(begin), part)
    return out.select(*df.columns, *[(F.coalesce(F.sum(v).over(own), F.lit(0)) + F.col(f"{v}_begin")).alias(f"{v}_before") for v in values])


def _targets(sources: DataFrame, weights: tuple[float, ...], repeat: int) -> DataFrame:
    """``sources`` (source, source_size, documents) plus no, weight and target.

    With level = words a unit of weight, a target is min(repeat x size, level x weight).
    Sources are full in the order of repeat x size / weight; running sums of that
    order give for each source the level at which all before it are full and it is
    not: the smallest that does not fill it holds for all."""
    numbered = running_sums(sources.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], ["one"], "sources")
    cap = F.col("source_size") * repeat
    # Only sources with words share; an empty one has nothing to give.
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    rows = materialize(numbered.select("source", "source_size", "documents", F.col("one_before").alias("no"), given.alias("weight"), cap.alias("cap")), "weights")
    full = running_sums(rows, [F.col("cap") / F.col("weight"), F.col("no")], ["cap", "weight"], "full")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = (F.lit(float(total["words"])) - F.col("cap_before")) / (F.lit(total["weight"]) - F.col("weight_before"))
    earliest = F.struct(-F.col("cap") / F.col("weight"), -F.col("no"))
    found = full.where(level * F.col("weight") <= F.col("cap")).agg(F.max_by(level, earliest)).first()[0]
    # None fills all only where rounding hides that all are just full.
    share = F.least(F.col("cap").cast("double"), F.lit(float("inf") if found is None else float(found)) * F.col("weight"))
    return rows.select("source", "source_size", "documents", "no", "weight", share.alias("target"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of ``index`` in a pseudorandom permutation of range(size) that
    ``key`` names: four rounds of a Feistel network over the next even power of two,
    gone round until the place lies in the range."""
    half = np.maximum(1, (np.frexp((size - 1).astype(np.float64))[1] + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    while open_.any():
        left, right, m = out[open_] >> half[open_], out[open_] & mask[open_], mask[open_]
        for turn in range(4):
            left, right = right, left ^ (_mixed(right ^ key[open_] ^ np.uint64(turn << 58)) & m)
        out[open_] = (left << half[open_]) | right
        open_ = open_.copy()
        open_[open_] = out[open_] >= size[open_].astype(np.uint64)
    return out.astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` slots each group gets, if they are drawn from ``counts``
    without putting back (a multinomial draw on condition of the totals).  Totals
    beyond the library's range are shared in proportion, what is left at random."""
    total = int(counts.sum())
    if total <= EXACT_DRAWS:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    even = np.array([int(c) * n // total for c in counts.tolist()], dtype=np.int64)
    left = n - int(even.sum())
    more = rng.permutation(np.flatnonzero(counts > even))[:left]
    even[more] += 1
    return even


def shard_counts(totals: np.ndarray, slots: int, shard_slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, before): a shard's slots of each group, and those of all shards
    before it.  Halves of the shards draw from what their parent has; a draw's seed
    is its range of shards."""
    lo, hi, own, before = 0, -(-slots // shard_slots), totals, np.zeros_like(totals)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _drawn(np.random.default_rng([seed, lo, hi]), own, (mid - lo) * shard_slots)
        if shard < mid:
            hi, own = mid, first
        else:
            lo, own, before = mid, own - first, before + first
    return own, before


@dataclass
class Mix:
    """documents: no, id, k1 and k2 (key of id and text), size, source_no, source,
    source_size, target, start (place in its source's words); slots: shard, slot, source_no, block, words (taken of the
    block, from its begin); all written down."""

    documents: DataFrame
    slots: DataFrame
    block_words: int

    def stretches(self) -> DataFrame:
        """(no, source_no, block, start, length, at): each document's words block by
        block, from ``start`` on, which stand in the block from ``at`` on."""
        L = self.block_words
        docs = self.documents.where(F.col("size") > 0)
        last = F.floor((F.col("start") + F.col("size") - 1) / L)
        df = docs.select("no", "source_no", "size", F.col("start").alias("begin"), F.explode(F.sequence(F.floor(F.col("start") / L), last)).alias("block"))
        begin = F.greatest(F.col("begin"), F.col("block") * L)
        end = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * L)
        return df.select("no", "source_no", "block", (begin - F.col("begin")).alias("start"), (end - begin).alias("length"), (begin - F.col("block") * L).alias("at"))

    def taken(self) -> DataFrame:
        """(no, taken): words the mix takes of each document, repeats counted."""
        # Slots that take one block alike are one row with their number.
        times = self.slots.groupBy("source_no", "block", "words").agg(F.count(F.lit(1)).alias("times"))
        met = self.stretches().join(times, ["source_no", "block"])
        part = F.greatest(F.lit(0), F.least(F.col("words") - F.col("at"), F.col("length")))
        return met.groupBy("no").agg(F.sum(part * F.col("times")).alias("taken"))

    def texts(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(shard, slot, text): the mix itself, from the table it was made of: a
        slot's words in order, a space between them.  No row but a document's own
        holds more than a block."""
        k1, k2 = row_key(F.col(id_col), F.col(text_col))
        texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text")).dropDuplicates(["k1", "k2"])
        rows = self.documents.where(F.col("size") > 0).join(texts, ["k1", "k2"])
        L, begin, end = self.block_words, F.col("start"), F.col("start") + F.col("size")
        words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")

        def cut(own: Column, b: Column) -> Column:
            at = F.greatest(begin, b * L)
            return F.struct(b.alias("block"), at.alias("at"), F.slice(own, (at - begin + 1).cast("int"), (F.least(end, (b + 1) * L) - at).cast("int")).alias("own"))

        every = F.transform(F.array(words), lambda own: F.transform(F.sequence(F.floor(begin / L), F.floor((end - 1) / L)), lambda b: cut(own, b)))[0]
        blocks = rows.select("source_no", F.inline(every)).groupBy("source_no", "block").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"])).alias("own")
        )
        met = self.slots.join(blocks, ["source_no", "block"])
        return met.select("shard", "slot", F.array_join(F.slice("own", F.lit(1), F.col("words").cast("int")), " ").alias("text"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), repeat: int = 3,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 13,
) -> Mix:
    """The mix of ``docs``: see ``Mix``.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share
    the words of all documents; a target stops at ``repeat`` times its source's
    words and the rest is shared by weight among the others.  A source's slots take
    just its target, rounded to whole words; each time a source is gone through,
    every one of its blocks is taken once, so no document is taken more than
    ``repeat`` times.

    Null, empty and blank texts have no words and are taken 0 times.  Documents
    stand in their source by id and content, so reruns agree whatever the
    partitions; rows alike in both stand side by side.  Null ids take part.  Extra
    columns are not looked at; an empty table gives an empty mix.
    """
    need(docs, id=id_col, text=text_col, source=source_col)
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"), k1.alias("k1"), k2.alias("k2"))
    sizes = materialize(sizes.withColumn("no", F.monotonically_increasing_id()), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    sources = materialize(_targets(materialize(sources, "source-sizes"), weights, repeat), "targets")
    # Slots: whole passes over the blocks, then as many blocks as the rest asks for
    # (the short last block stands last in every pass).
    L = block_words
    goal = F.least(F.round("target").cast("long"), F.col("source_size") * repeat)
    blocks = F.ceil(F.col("source_size") / L).cast("long")
    passes = F.coalesce(F.expr("goal div nullif(source_size, 0L)"), F.lit(0)).cast("long")
    rest = F.col("goal") - F.col("passes") * F.col("source_size")
    sources = sources.withColumn("goal", goal).withColumn("blocks", blocks).withColumn("passes", passes)
    sources = sources.withColumn("rest", rest).withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / L))
    sources = running_sums(sources, ["no"], ["slots", "source_size"], "slots")
    sources = materialize(sources.withColumnsRenamed({"slots_before": "first_slot", "source_size_before": "first_word"}), "source-slots")
    # A row's place in its source: rows sorted by source, then by id and content.
    placed = running_sums(sizes, [F.col("source").asc_nulls_last(), F.col("id").asc_nulls_last(), "k1", "k2", "no"], ["size"], "documents")
    key = {"of": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()}
    own = materialize(sources.withColumns(key).select(*key, F.col("no").alias("source_no"), "source_size", "target", "first_word", "documents"), "source-keys")
    documents = skewed_join(placed.withColumns(key), own, [*key], "documents").withColumn("start", F.col("size_before") - F.col("first_word"))
    documents = materialize(documents.select("no", "id", "k1", "k2", "size", "source_no", "source", "source_size", "target", "start"), "placed")
    return Mix(documents, materialize(_slots(sources, L, shard_slots, seed), "mix"), L)


def _slots(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, source_no, block, words) of all slots."""
    spark = sources.sparkSession
    slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("sources")).first()
    n = slots["n"]
    # Every source is a group of its own, unless there are more than GROUPS: then
    # neighbours that start in the same stretch of slots are one.
    alone = slots["sources"] <= GROUPS
    group = F.col("no") if alone else F.floor(F.col("first_slot") / max(1, -(-n // GROUPS))).cast("long")
    groups = sources.where(F.col("slots") > 0).groupBy(group.alias("g")).agg(F.sum("slots").alias("slots"), F.min("first_slot").alias("first_slot")).orderBy("g").collect()  # at most GROUPS rows
    numbers, totals = np.array([r["g"] for r in groups], np.int64), np.array([r["slots"] for r in groups], np.int64)
    firsts = np.array([r["first_slot"] for r in groups], np.int64)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                counts, before = shard_counts(totals, n, shard_slots, shard, seed)
                rank = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                place = np.random.default_rng([seed, 1, shard]).permutation(len(rank))
                yield pd.DataFrame({"shard": shard, "slot": place, "g": np.repeat(numbers, counts), "number": rank + np.repeat(firsts + before, counts)})

    shards = -(-n // shard_slots)
    drawn = spark.range(0, shards, 1, max(1, min(shards, 4096))).mapInPandas(draw, "shard bigint, slot bigint, g bigint, number bigint")
    columns = [F.col("no").alias("source_no"), "first_slot", "blocks", "slots", "rest", "source_size"]
    if alone:
        drawn = drawn.withColumnRenamed("g", "source_no").join(F.broadcast(sources.select(*columns)), "source_no")
    else:  # every slot of a source by its number, which the shards' slots meet
        each = sources.where(F.col("slots") > 0).select(*columns, F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("slots") - 1)).alias("number"))
        drawn = drawn.join(each, "number")
    drawn = drawn.withColumn("k", F.col("number") - F.col("first_slot"))

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k, blocks, source, rest = (f[c].to_numpy(np.int64) for c in ("k", "blocks", "source_no", "rest"))
            turn, at = k // blocks, k % blocks
            key = _mixed(_mixed(source.astype(np.uint64) + np.uint64(seed << 32)) + turn.astype(np.uint64))
            size = f["source_size"].to_numpy(np.int64)
            whole = np.maximum(blocks - 1, 1)  # the last block keeps its place
            block = np.where(at == blocks - 1, at, permuted(np.minimum(at, whole - 1), whole, key))
            words = np.minimum(block_words, size - block * block_words)
            last = (k == f["slots"].to_numpy(np.int64) - 1) & (rest > 0)
            words = np.where(last, rest - at * block_words, words)
            yield pd.DataFrame({"shard": f["shard"], "slot": f["slot"], "source_no": source, "block": block, "words": words})

    return drawn.select("shard", "slot", "source_no", "k", "blocks", "slots", "rest", "source_size").mapInPandas(take, "shard bigint, slot bigint, source_no bigint, block bigint, words bigint")


# --- query ------------------------------------------------------------------

NAME = "op13_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    made = mix(docs)
    out = made.documents.join(made.taken(), "no", "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
