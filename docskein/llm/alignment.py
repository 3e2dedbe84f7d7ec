"""Cross-tokenizer alignment (operator 11): where the tokens of two tokenizers meet.

Texts are tokenised twice in Arrow batches.  Neither tokenizer lets a token cross
the place where white space begins, so a text is a row of units (white space and
what follows it) that are tokenised, and later aligned, once for all texts of a
batch: per unit there are both tokenizers' ids and the byte offsets at which tokens
end, per text the numbers of its units.  All that follows is Spark's higher-order
functions: ``array_intersect`` of a unit's two arrays of ends gives the cuts; a
sorted merge of the ends with the cuts gives each cut's place among a tokenizer's
tokens; ``sequence`` and ``transform`` make groups and links of them, and a text's
are its units' in order.  Corpus-wide counts are a partial aggregation of exploded
links, and come back to the documents by a join that broadcasts only the commonest
pairs of ids.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import WordCache, materialize, need, skewed_join, slices
from docskein.llm.packing import settled_characters

BATCH_CHARS = 3_000_000  # texts that share a table of units
# Unicode's white space without the space itself: fixed values.
BLANKS = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEARCHED = 64  # ends of a unit's tokens that are searched one by one
SHIFT = 1 << 32  # a link of ids a and b is the number a * SHIFT + b


class ByteBpe:
    """Ids by a byte-level BPE file, and the bytes of each id.

    ``ranks`` is the same vocabulary for the faster library; it is used for texts
    whose characters all versions of Unicode class alike, so that both libraries
    cut the same words.  Ids are the same either way.
    """

    def __init__(self, path: str, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(table.values()) + 2)  # the last one: special tokens, which no text gives
        for token, i in table.items():
            self.bytes_of[i] = token
        self.path = path
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.unsettled = re.compile(f"[^{settled_characters()}]").search

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def settled(self, text: str) -> bool:
        return text.isascii() or not self.unsettled(text)

    def encode(self, text: str) -> list[int]:
        return self.fast(text) if self.settled(text) else self.whole.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """Ids by a SentencePiece file that puts a word mark in front of a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = type(proto.pieces[0])
        silent = (kind.CONTROL, kind.UNKNOWN)
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else b"" if p.type in silent else p.piece.replace("▁", " ").encode("utf-8") for p in proto.pieces]
        self.mark = self.lib.piece_to_id("▁")
        spec, blank = proto.normalizer_spec, re.compile(f"[{BLANKS}]").findall
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        inner = any("▁" in p.piece.lstrip("▁") for p in proto.pieces)
        joined = {c for p in proto.pieces if len(p.piece) > 1 for c in blank(p.piece)}
        # Units stand where no piece holds a mark behind another character, and the
        # text has no other white space that a piece joins to something.
        self.by_unit = re.compile(f"[{re.escape(''.join(sorted(joined)))}]" if joined else "(?!)").search if plain and not inner else None

    def splits(self, text: str) -> bool:
        return self.by_unit is not None and not self.by_unit(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; its first space is the mark that the library adds."""
        if text == " ":  # the library adds no mark to an empty text
            return [self.mark]
        ids = self.lib.encode(text.removeprefix(" "), num_threads=1)
        return ids if text[:1] == " " else ids[1:] if ids[:1] == [self.mark] else []


class Tokenizers:
    """Both tokenizers, unit by unit; units seen before are kept."""

    def __init__(self, first: ByteBpe, second: PieceBpe) -> None:
        self.first, self.second = first, second
        self.known = WordCache(96 << 20)
        self.units = re.compile(f"[ {BLANKS}]*[^ {BLANKS}]+|[ {BLANKS}]+").findall
        self.lengths = [np.array([len(b) for b in t.bytes_of], dtype=np.int64) for t in (first, second)]

    def split(self, text: str) -> list[str]:
        """The units of a space and ``text``: all of it is one where the tokenizers
        may look further than a unit."""
        full = " " + text
        return self.units(full) if self.second.splits(text) and self.first.settled(text) else [full]

    def encode(self, units: list[str]) -> dict[str, bytes | None]:
        """Of each unit the packed 32-bit numbers: how many ids the first tokenizer
        gives, these, the second one's; None where their bytes are not the unit's.
        Units of many texts (none all white space) are encoded in one call; where
        their ends are not met, by halves."""
        text = "".join(units)
        want, ends, found, counts = text.encode("utf-8"), np.fromiter(map(len, units), np.int64, len(units)), [], []
        if len(want) > len(text):
            ends = np.fromiter((len(u.encode("utf-8")) for u in units), np.int64, len(units))
        ends = np.cumsum(ends)
        for t, lengths in zip((self.first, self.second), self.lengths):
            told = t.encode(text)
            ids = np.fromiter(told, np.int32, len(told))
            places = np.cumsum(lengths[ids])
            at = np.searchsorted(places, ends)
            if not told or b"".join([t.bytes_of[i] for i in told]) != want or (places[at] != ends).any():
                half = len(units) // 2
                return self.encode(units[:half]) | self.encode(units[half:]) if half else {units[0]: None}
            found.append(ids)
            counts.append(np.diff(at, prepend=-1))
        # Each unit's numbers in a row: its count, its ids by the first, by the second.
        n_a, n_b = counts
        to = np.cumsum(1 + n_a + n_b)
        heads = to - 1 - n_a - n_b
        row = np.empty(to[-1], "<i4")
        row[heads] = n_a
        first, own = np.repeat(heads + 1 - np.cumsum(n_a) + n_a, n_a), np.repeat(to - np.cumsum(n_b), n_b)
        row[first + np.arange(len(first))] = found[0]
        row[own + np.arange(len(own))] = found[1]
        packed = row.tobytes()
        return {u: packed[i:k] for u, i, k in zip(units, (4 * heads).tolist(), (4 * to).tolist())}

    def learn(self, texts: list[list[str]]) -> dict[str, bytes | None]:
        """``encode`` of the units of all ``texts`` that were not known.  They are known
        then, but for long ones."""
        known = self.known
        known.trim()
        new = [u for u in dict.fromkeys(u for units in texts if len(units) > 1 for u in units) if u not in known]
        made = self.encode([u for u in new if not u.isspace()] or [" "])
        # What is one unit may be a text that must stay whole.
        for u in (*(u for u in new if u.isspace()), *(u for units in texts if len(units) == 1 for u in units)):
            if u not in made and u not in known:
                made |= self.encode([u])
        known.add(made)
        return made


def _lists(values: pa.Array, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), values)


class _Batch:
    """Texts with their units, numbered within the batch."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.packed: list[bytes] = []
        self.rows: list[tuple[pa.Array, np.ndarray]] = []
        self.chars = 0

    def add(self, row: pa.Array, units: list[str], made: dict[str, bytes | None], known: dict[str, bytes | None]) -> None:
        """A text without tokens has no units."""
        number = self.number
        fresh = [u for u in dict.fromkeys(units) if u not in number]
        found = [made[u] if u in made else known[u] for u in fresh]
        if None in found:
            units = []
        else:
            number.update(zip(fresh, range(len(number), len(number) + len(fresh))))
            self.packed += found
        self.rows.append((row, np.array([number[u] for u in units], np.int32)))
        self.chars += sum(map(len, units))

    def record(self, tokens: Tokenizers) -> pa.RecordBatch:
        flat, sizes = np.frombuffer(b"".join(self.packed), "<i4"), np.array([len(x) // 4 for x in self.packed], np.int64)
        heads = np.cumsum(sizes) - sizes
        ids, sizes = np.delete(flat, heads), sizes - 1
        n_a = flat[heads].astype(np.int64)
        first = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(n_a, sizes)
        fields, counts = [], []
        for lengths, own, n in zip(tokens.lengths, (ids[first], ids[~first]), (n_a, sizes - n_a)):
            ends = np.concatenate([[0], np.cumsum(lengths[own])])
            begin = np.repeat(ends[np.cumsum(n) - n], n)
            fields += [_lists(pa.array(x.astype(np.int32)), n) for x in (own, ends[1:] - begin)]
            counts.append(pa.array([int(n[u].sum()) for _, u in self.rows], pa.int64()))
        units = pa.StructArray.from_arrays(fields, names=["a", "a_ends", "b", "b_ends"])
        numbers = _lists(pa.array(np.concatenate([u for _, u in self.rows])), [len(u) for _, u in self.rows])
        texts = pa.StructArray.from_arrays([pa.concat_arrays([r for r, _ in self.rows]), *counts, numbers], names=["id", "n_a", "n_b", "units"])
        return pa.RecordBatch.from_arrays([_lists(texts, [len(texts)]), _lists(units, [len(units)])], names=["texts", "units"])


def tokenised(docs: DataFrame, tokenizers: Callable[[], Tokenizers], *, id_col: str, text_col: str) -> DataFrame:
    """A row per batch of texts: ``texts`` (id, n_a, n_b, units: numbers from 0) and
    ``units`` (a, a_ends, b, b_ends: both tokenizers' ids and the offsets, in bytes
    of the unit, at which tokens end).  Texts without tokens have no units."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, now = tokenizers(), _Batch()
        for part in slices(batches, 64):
            texts = [tokens.split(text) if text else [] for text in part.column(1).to_pylist()]
            made = tokens.learn(texts)
            for i, units in enumerate(texts):
                now.add(part.column(0).slice(i, 1), units, made, tokens.known)
                if now.chars >= BATCH_CHARS:
                    yield now.record(tokens)
                    now = _Batch()
        if now.rows:
            yield now.record(tokens)

    ids = "array<int>"
    return docs.select(id_col, text_col).mapInArrow(
        run, f"texts array<struct<id:{kind},n_a:bigint,n_b:bigint,units:{ids}>>, units array<struct<a:{ids},a_ends:{ids},b:{ids},b_ends:{ids}>>"
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def places(ends: Column, cuts: Column) -> Column:
    """For every cut (an element of ``ends``; both ascend) its place in ``ends``.

    Short lists are searched; in others both are sorted together: a cut stands
    twice, and m cuts stand before the m-th one, so work stays linear."""
    merged = let(F.sort_array(F.concat(ends, cuts)), lambda s: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda k: s[k] == s[k - 1]), lambda k, m: k - 1 - m
    ))
    return F.when(F.size(ends) <= SEARCHED, F.transform(cuts, lambda c: (F.array_position(ends, c) - 1).cast("int"))).otherwise(merged)


def _ids(tokens: Column, after: Column, to: Column) -> Column:
    """The ids (decimal) behind place ``after`` up to place ``to``."""
    return F.when(to - after == 1, tokens[to]).otherwise(F.array_join(F.slice(tokens, after + 2, to - after), ","))


def unit_links(unit: Column) -> Column:
    """Of a unit (a, a_ends, b, b_ends): groups (text) and links (a number for each
    pair of tokens that end together).

    Ends ascend strictly, so each cut ends one token of either side: a group has
    one link, that of its last tokens.  The unit's end is always a cut."""
    a, b = unit["a"], unit["b"]
    link = lambda i, k: a[i].cast("long") * SHIFT + b[k]
    text = lambda ids: ids.cast("array<string>")
    told = lambda groups, links: F.struct(groups.alias("groups"), links.alias("links"))

    def made(p: Column, q: Column, a_text: Column, b_text: Column) -> Column:
        before = lambda x, m: F.when(m == 0, F.lit(-1)).otherwise(x[m - 1])
        group = F.transform(p, lambda to, m: F.concat(_ids(a_text, before(p, m), to), F.lit("|"), _ids(b_text, before(q, m), q[m])))
        return told(F.array_join(group, ";"), F.zip_with(p, q, link))

    # Units that end their tokens at the same places, and units that are one token to
    # either side, need no merge.
    alike = told(F.array_join(F.zip_with(text(a), text(b), lambda x, y: F.concat(x, F.lit("|"), y)), ";"), F.zip_with(a, b, lambda x, y: x.cast("long") * SHIFT + y))
    single = told(F.concat(F.array_join(text(a), ","), F.lit("|"), F.array_join(text(b), ",")), F.array(link(F.size(a) - 1, F.size(b) - 1)))
    merged = let(F.array_intersect(unit["a_ends"], unit["b_ends"]), lambda c: let(places(unit["a_ends"], c), lambda p: let(places(unit["b_ends"], c), lambda q: let(
        text(a), lambda a_text: let(text(b), lambda b_text: made(p, q, a_text, b_text))
    ))))
    return F.when(unit["a_ends"] == unit["b_ends"], alike).when((F.size(a) == 1) | (F.size(b) == 1), single).otherwise(merged)


def aligned(tokens: DataFrame, groups: Callable[[Column], Column] = lambda g: g) -> DataFrame:
    """``tokens`` as a row per text: id, n_a, n_b, n_links, groups, links."""

    def of(texts: Column, units: Column) -> Column:
        # A text's units are looked up once, for both their groups and their links.
        return F.transform(texts, lambda t: let(F.transform(t["units"], lambda u: units[u]), lambda own: F.struct(
            t["id"].alias("id"), t["n_a"].alias("n_a"), t["n_b"].alias("n_b"),
            groups(F.array_join(own["groups"], ";")).alias("groups"), F.flatten(own["links"]).alias("links"),
        )))

    every = let(F.transform("units", unit_links), lambda units: of(F.col("texts"), units))
    df = tokens.select(F.inline(every))
    return df.select("id", "n_a", "n_b", F.size("links").cast("long").alias("n_links"), "groups", "links")


def align(docs: DataFrame, tokenizers: Callable[[], Tokenizers], *, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """One row per row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and
    ``groups`` (with ``digest`` groups_sha256 in its place).

    ``tokenizers`` makes both tokenizers on an executor.  A pair of ids counts how
    many links of all rows hold it; a link is among the best where no other pair
    of its second id counts more (ties included).

    Null and empty texts, and texts that either tokenizer does not give back
    byte by byte, have zeros and empty groups.  Rows that repeat an id are rows
    like others; null ids take part.  Extra columns are not looked at; an empty
    table gives an empty table.  Work is linear in a text's length.
    """
    need(docs, id=id_col, text=text_col)
    hashed = lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256))
    made = aligned(tokenised(docs, tokenizers, id_col=id_col, text_col=text_col), hashed if digest else lambda g: g)
    rows = materialize(made.withColumn("no", F.monotonically_increasing_id()), "aligned")
    links = rows.select("no", F.explode("links").alias("link"))
    counts = materialize(links.groupBy("link").agg(F.count(F.lit(1)).alias("n")), "links")
    best = counts.groupBy((F.col("link") % SHIFT).alias("b")).agg(F.max("n").alias("top"))  # as many rows as the second vocabulary has ids
    table = materialize(
        counts.withColumn("b", F.col("link") % SHIFT).join(best, "b").select("link", "n", (F.col("n") == F.col("top")).cast("long").alias("best"), F.col("n").alias("weight")), "link-counts"
    )
    met = skewed_join(links, table, ["link"], "weight")
    sums = met.groupBy("no").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.drop("links").join(sums, "no", "left")
    return out.select(
        F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256" if digest else "groups")
    )


# --- query ------------------------------------------------------------------

NAME = "op11_alignment"


@functools.cache
def public_pair() -> Tokenizers:
    """The installed files' tokenizers, made once per worker process."""
    import public_tokenizers as files

    return Tokenizers(ByteBpe(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN), PieceBpe(files.path("piece_bpe_32k.model")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_pair)
