"""Best-fit packing (operator 3): documents into sequences of fixed length.

Tokens are counted in Arrow batches; after that only lengths travel.  Pieces go
to shards of bounded size, and each shard is packed by sum-of-squares: a piece
goes where the squared counts of open bins per residual gap become smallest,
longest pieces first.  What a shard leaves badly filled is packed once more
over all shards.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
import struct
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import WordCache, fresh, materialize, need, slices

CACHE_BYTES = 192 << 20


def byte_symbols() -> str:
    """The 256 symbols of byte-level BPE: printable Latin-1 bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


@functools.cache
def settled_characters() -> str:
    """The characters whose class, normal form and lower case no version of
    Unicode in use changes, as ranges of a pattern's set: those that the oldest
    tables at hand (version 3.2) know in the same class as the newest."""
    old, new, ranges, begin = unicodedata.ucd_3_2_0.category, unicodedata.category, [], None
    for i in range(sys.maxunicode + 2):
        c = chr(i) if i <= sys.maxunicode else ""
        same = bool(c) and old(c)[0] == new(c)[0] not in ("C",) or c in ("\t", "\n", "\r", " ")
        if same and begin is None:
            begin = i
        elif not same and begin is not None:
            ranges.append((begin, i - 1))
            begin = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class WordTokenizer:
    """Token ids of a text as packed little-endian 32-bit integers.

    The tokenizer's normal form and word pattern are applied here, and its BPE
    model once per word: ids of a word depend on the word alone.  No word holds
    white space, so a text is its units between white space, and those seen before
    are looked up whole.  Texts where that could differ from the whole tokenizer
    (special tokens' strings, the one letter whose lower case depends on its place,
    separators that only Python takes for white space, and characters that the
    tokenizer's Unicode tables and Python's may class differently) go through it
    whole.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.apart = [t.content for t in self.whole.get_added_tokens_decoder().values()] + list("\x00\x1c\x1d\x1e\x1f")
        # The word pattern of the tokenizer file: a fixed value.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.unsettled = re.compile(f"[^{settled_characters()}]|Σ").search
        self.symbols = byte_symbols()
        self.known = UnitIds(self._unit, CACHE_BYTES)

    def _word(self, word: str) -> bytes:
        # Of ASCII only blanks and controls are shown as other characters.
        shown = word if word.isalpha() and word.isascii() else codecs.charmap_decode(word.encode("utf-8"), "strict", self.symbols)[0]
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        """A unit of one word is made here; others of their words, which are kept too."""
        if unit.isalpha():
            return self._word(unit)
        words = self.words(unit)
        return self._word(unit) if len(words) == 1 else b"".join(map(self.known.__getitem__, words))

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.apart) or not text.isascii() and self.unsettled(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.known.trim()
        return b"".join(map(self.known.__getitem__, unicodedata.normalize("NFC", text).lower().split()))


class UnitIds(WordCache):
    """Ids of units, made by ``make`` where they are not known."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__(most)
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        ids = self.make(unit)
        self.add({unit: ids})
        return ids


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """Made once per worker process: tasks that follow find the units known."""
    return WordTokenizer(path)


def tokenize_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32.

    A document is its token ids and then ``end_id``; null text counts as
    empty, which is the one id.  Longer ones are cut every ``capacity`` ids.
    """
    need(docs, id=id_col, text=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer)
        for part in slices(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                ids = encode(text or "") + tail
                for k, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every size, in the given order, and the gap of each bin.

    Moving a bin from gap g to g - s changes the sum of squared counts by
    (2 N[g-s] + 1) - (2 N[g] - 1); a new bin leaves no count behind and a full
    one enters none.  The smallest change wins, the tightest gap on ties.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        change = 2 * (count[: capacity - s + 1] - count[s:]) + 2
        change[0] -= 2 * count[0] + 1
        change[count[s:] == 0] = 1 << 60
        change[capacity - s] = 0 if s == capacity else 2 * count[capacity - s] + 1
        gap = int(change.argmin()) + s
        if gap == capacity:
            b = len(gaps)
            gaps.append(capacity)
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap - s
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, np.array(gaps, dtype=np.int64)


def pack(pieces: DataFrame, *, capacity: int = 4096, shard_pieces: int = 4000, loose: float = 0.02) -> DataFrame:
    """``pieces`` (column length, 1 to capacity) plus sequence_id and offset.

    Every piece keeps its row; offsets in a sequence are gapless from 0 and
    never pass ``capacity``.  Shards hold about ``shard_pieces`` pieces however
    many there are, chosen by a row number, so repeated or null ids spread
    like others.  Bins with more than ``loose`` of the capacity free after the
    first round are taken apart and packed again; the second round's bins stay.
    Equal lengths are taken in row order.  An empty table stays empty.
    """
    need(pieces, length="length")
    no = fresh("piece_no", pieces.columns)
    own = pieces.drop("sequence_id", "offset")
    base = materialize(own.withColumn(no, F.monotonically_increasing_id()), "pieces")
    sizes = base.select(F.col(no).alias("no"), "length")
    shards = max(1, -(-base.count() // shard_pieces))
    first = materialize(_round(sizes, 0, shards, capacity), "packed")
    limit = int(capacity * loose)
    again = first.where(F.col("gap") > limit).select("no", "length")
    second = _round(again, shards, max(1, -(-again.count() // shard_pieces)), capacity)
    placed = first.where(F.col("gap") <= limit).unionByName(second).select(F.col("no").alias(no), "sequence_id", "offset")
    return base.join(placed, no).drop(no)


def _round(sizes: DataFrame, first_shard: int, shards: int, capacity: int) -> DataFrame:
    """Each shard packed on its own; a bin's id tells its shard."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "no"], ascending=[False, True], kind="stable")
        bins, offsets, gaps = sum_of_squares(group["length"].to_numpy(), capacity)
        shard = int(group["shard"].iloc[0])
        return pd.DataFrame({
            "no": group["no"].to_numpy(), "length": group["length"].to_numpy(), "offset": offsets,
            "sequence_id": ((first_shard + shard) << 24) + bins, "gap": gaps[bins],
        })

    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("no"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "no bigint, length bigint, offset bigint, sequence_id bigint, gap bigint")


# --- query ------------------------------------------------------------------

NAME = "op3_packing"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(tokenize_pieces(docs, tokenizer_path()))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
