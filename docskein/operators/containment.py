"""Texts that other texts of their group contain, for texts and groups of any size.

A text x of n characters, W = 2 ** level <= n < 2 W, is covered by its first and its
last W characters.  Each window of W characters has an anchor: the gram of W / 2
characters in it with the smallest hash (the first of equals).  Anchors depend on
the window's characters alone, so where x stands in y, y has x's two anchors at the
same distance.  Texts meet by these, two joins of hashes; what is left is compared.

Gram hashes are polynomials kept as running sums, so a gram of any length costs
one subtraction and one product, and a text's work is linear in its length for
each of the levels that shorter texts of its group ask for.

There are about as many anchors as characters, so only those are written that a
text of their group asks for, and groups of at most ROW_CHARS characters need none:
such a group is one row, in which its texts are looked up.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.sources.stages import Stages

PRIME = (1 << 31) - 1
BASES = (1_000_003, 69_069_069)
ROW_CHARS = 128_000  # characters of a group that is settled as one row
FEW_ASKS = 100_000  # texts whose anchors are broadcast: at most some 20 MB in a task
SPREAD = 32  # parts over which the texts of a group meet its levels


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


@functools.lru_cache(maxsize=4)
def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, for texts up to ``n`` long."""
    return [(_powers(b, n), _powers(pow(b, -1, PRIME), n)) for b in BASES]


class Grams:
    """Hashes of a text's grams of any length."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n, p = len(codes), np.uint64(PRIME)
        self.tables = _tables(1 << max(10, self.n.bit_length()))
        # A term is below 2 ** 31, so sums of up to 2 ** 33 terms fit.
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(codes * power[: self.n] % p) % p]) for power, _ in self.tables]

    def hashes(self, g: int) -> np.ndarray:
        """Of the gram of ``g`` characters at every place, 62 bits."""
        p, out = np.uint64(PRIME), np.zeros(self.n - g + 1, np.uint64)
        for sums, (_, inverse) in zip(self.sums, self.tables):
            at = (sums[g:] + p - sums[: self.n - g + 1]) % p * inverse[: self.n - g + 1] % p
            out = (out << np.uint64(31)) | at
        return out

    def anchors(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes): of every window of 2 ** level characters its anchor's place,
        and the hashes of all grams."""
        width = 1 << level
        g = max(1, width // 2)
        hashes, m = self.hashes(g), width - g + 1
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least = ((mixed >> np.uint64(32)) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while 2 * size <= m:  # least of 2, 4, ... grams
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < m:
            least = np.minimum(least[: len(least) - (m - size)], least[m - size :])
        return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def _asks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text in frame["text"]:
            grams = Grams(text)
            level = grams.n.bit_length() - 1
            places, hashes = grams.anchors(level)
            rows.append((grams.n, level, int(hashes[places[0]]), int(places[0]), int(hashes[places[-1]]), int(places[-1])))
        told = pd.DataFrame(rows, columns=["n", "level", "h", "at", "h2", "at2"], index=frame.index)
        yield pd.concat([frame.drop(columns="text"), told], axis=1)


FLUSH = 500_000  # anchors that a frame holds at most, but for one text's level


def _anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        own = frame.drop(columns=["text", "levels"]).reset_index(drop=True)
        parts: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        held = 0
        for i, (text, levels) in enumerate(zip(frame["text"], frame["levels"])):
            asked = [x["level"] for x in levels if x["shortest"] < len(text) and 1 << x["level"] <= len(text)]
            grams = Grams(text) if asked else None
            for level in asked:
                places, hashes = grams.anchors(level)
                places = np.unique(places)
                parts.append((i, level, grams.n, places, hashes[places]))
                held += len(places)
                if held > FLUSH:
                    yield _framed(own, parts)
                    parts, held = [], 0
        if parts:
            yield _framed(own, parts)


def _framed(own: pd.DataFrame, parts: list) -> pd.DataFrame:
    rows, levels, sizes, places, hashes = zip(*parts)
    counts = [len(p) for p in places]
    out = own.iloc[np.repeat(rows, counts)].reset_index(drop=True)
    return out.assign(level=np.repeat(levels, counts), size=np.repeat(sizes, counts), pos=np.concatenate(places), h=np.concatenate(hashes).astype(np.int64))


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        own = frame.drop(columns=["text", "found"]).reset_index(drop=True)
        told = [(i, f["x"], text[f["s"] : f["s"] + f["n"]]) for i, (text, found) in enumerate(zip(frame["text"], frame["found"])) for f in found]
        if told:
            rows, x, pieces = zip(*told)
            yield own.iloc[list(rows)].reset_index(drop=True).assign(ord=x, piece=pieces)


def uncontained(texts: list[str]) -> list[bool]:
    """Of distinct texts, whether no longer one contains them: each is searched for in
    the longer ones, laid end to end with a character between that none of them has."""
    used = set().union(*texts)
    between = next(c for c in map(chr, range(0x110000)) if c not in used)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    every, keep = between.join(texts[i] for i in order), [True] * len(texts)
    end = at = size = 0
    for i in order:
        if len(texts[i]) != size:
            size, end = len(texts[i]), at
        keep[i] = every.find(texts[i], 0, end) < 0
        at += len(texts[i]) + 1
    return keep


def _settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        own = frame.drop(columns="texts").reset_index(drop=True)
        told = []
        for i, texts in enumerate(frame["texts"]):
            told += [(i, x["ord"], x["text"]) for x, keep in zip(texts, uncontained([x["text"] for x in texts])) if keep]
        if told:
            places, order, texts = zip(*told)
            yield own.iloc[list(places)].reset_index(drop=True).assign(ord=order, text=texts)


def drop_contained_rows(rows: DataFrame, keys: list[str], *, row_chars: int = ROW_CHARS, few_asks: int = FEW_ASKS) -> DataFrame:
    """``rows`` (keys, ord, text; texts of a group distinct and not empty, keys and
    ord not null) without those that a longer text of their group contains.  Groups
    of at most ``row_chars`` characters are settled as a row each, the texts of
    larger ones meet by anchors."""
    stages = Stages(rows.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    rows = stages.keep("texts", rows.select(*keys, "ord", "text"))
    sizes = rows.groupBy(*keys).agg(F.sum(F.length("text").cast("long")).alias("chars"))
    large = stages.keep("large-groups", sizes.where(F.col("chars") > row_chars).select(*keys))
    n = large.count()
    if n:
        large = F.broadcast(large) if n <= few_asks else large
        small = rows.join(large, keys, "left_anti")
    else:
        small = rows
    listed = small.groupBy(*keys).agg(F.collect_list(F.struct("ord", "text")).alias("texts"))
    out = listed.mapInPandas(_settled, f"{ddl}, ord {kind['ord']}, text string")
    return out.unionByName(_drop_by_anchors(stages, rows.join(large, keys, "left_semi"), keys, few_asks)) if n else out


def _drop_by_anchors(stages: Stages, rows: DataFrame, keys: list[str], few_asks: int) -> DataFrame:
    """The same by anchors, for groups of any size."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    order = kind["ord"]
    asks = stages.keep("asks", rows.mapInPandas(_asks, f"{ddl}, ord {order}, n int, level int, h bigint, at int, h2 bigint, at2 int"))
    # Every text learns the levels asked for in its group: at most 31, with the
    # shortest text of each.  A group is dealt to parts, so that a hot one is no task's.
    levels = asks.groupBy(*keys, "level").agg(F.min("n").alias("shortest")).groupBy(*keys).agg(F.collect_list(F.struct("level", "shortest")).alias("levels"))
    levels = levels.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    told = rows.withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(SPREAD)).cast("int")).join(levels, [*keys, "part"]).select(*keys, F.col("ord").alias("y"), "text", "levels")
    anchors = told.mapInPandas(_anchors, f"{ddl}, y {order}, level int, h bigint, pos int, size int")
    wanted = asks.select(*keys, "level", F.explode(F.array("h", "h2")).alias("h")).distinct()
    wanted = F.broadcast(wanted) if asks.count() <= few_asks else wanted
    anchors = stages.keep("anchors", anchors.join(wanted, [*keys, "level", "h"], "left_semi"))
    begin = F.col("pos") - F.col("at")
    first = (
        asks.withColumnRenamed("ord", "x").join(anchors, [*keys, "level", "h"]).where((F.col("size") > F.col("n")) & (begin >= 0) & (begin + F.col("n") <= F.col("size")))
        .select(*keys, "level", "x", "n", "y", begin.alias("s"), F.col("h2").alias("h"), (begin + F.col("at2")).alias("pos"))
    )
    both = first.join(anchors.drop("size"), [*keys, "level", "y", "h", "pos"]).select(*keys, "y", F.struct("x", "s", "n").alias("f")).distinct()
    found = both.groupBy(*keys, "y").agg(F.collect_list("f").alias("found")).withColumnRenamed("y", "ord")
    pieces = rows.join(found, [*keys, "ord"]).drop("ord").mapInPandas(_pieces, f"{ddl}, ord {order}, piece string")
    gone = pieces.join(rows, [*keys, "ord"]).where("piece = text").select(*keys, "ord").distinct()
    return rows.join(gone, [*keys, "ord"], "left_anti")
