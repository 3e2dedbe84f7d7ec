"""SentencePiece encoding and decoding (operator 4): a max-plus parallel scan.

A text's encoding is the segmentation into vocabulary pieces with the greatest
sum of scores (the library's unigram rule; among equal sums the piece that
starts earliest ends each prefix).  A document of ordinary length is solved in
one piece.  A giant one is cut into chunks of fixed length:

1. each chunk gives its transfer matrix: entry = how many of its characters a
   piece from the left has taken, exit = how many characters beyond its end
   its own last piece takes, value = best score in between;
2. the matrices of a document are combined in the max-plus semiring, which is
   associative: runs of RUN consecutive chunks are multiplied side by side in
   tasks of their own, the few products of a document give every run the best
   scores with which it can be entered, and inside the runs, side by side again,
   every chunk gets its own;
3. each chunk is traced back on its own for every exit it may have, and the
   small maps from exit to entry, composed from the end, select one of them.

If no piece holds a word mark after another character (checked on the
vocabulary), paths also meet before every such mark; words between are solved
once each and cached, and a chunk's matrix is an outer sum of its first word,
the words between, and its last word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import materialize, need, row_key, slices, whole_text

MARK = "▁"
CACHE_BYTES = 128 << 20  # of words solved before; a batch's own words may go beyond
TOGETHER = 48  # as many new words of one length are solved side by side
SIDE_BY_SIDE = 32  # if they are at most this long
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN_PENALTY = 10.0
GRAIN = 2.0**-20  # scores are multiples of it, so that their sums are exact in any order
RUN = 64  # chunks whose matrices are multiplied in one task
NONE = float("-inf")


class Vocabulary:
    """Pieces, scores and the normal form of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.lib = SentencePieceProcessor(model_file=path)
        proto = ModelProto.FromString(self.lib.serialized_model_proto())
        spec = proto.normalizer_spec
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        kind = type(proto.pieces[0])
        self.text = [p.piece for p in proto.pieces]
        self.bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        exact = lambda x: round(x / GRAIN) * GRAIN
        normal = [exact(p.score) for p in proto.pieces if p.type == kind.NORMAL]
        self.unknown = min(normal) - UNKNOWN_PENALTY
        self.unknown_id = self.lib.unk_id()
        self.score: dict[str, tuple[float, int]] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kind.NORMAL:
                self.score[p.piece] = (exact(p.score), i)
            elif p.type == kind.USER_DEFINED:
                self.score[p.piece] = (exact(len(p.piece) * max(normal) - 0.1), i)
        self.hidden = {i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL}
        self.longest = max(map(len, self.score))
        self.breaks = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.texts = np.array([t if i not in self.hidden else "" for i, t in enumerate(self.text)], dtype=object)
        self.is_byte = np.array([i in self.byte_of for i in range(len(self.text))])
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self._hash_pieces()
        self.known: dict[str, tuple[float, bytes]] = {}
        self.held = 0

    # --- text and ids

    def normal(self, text: str) -> str:
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.lib.normalize(text)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def ids_of(self, char: str) -> list[int]:
        """Ids of a character that no piece covers: its bytes, or unknown."""
        if self.bytes_at:
            return [self.bytes_at[b] for b in char.encode("utf-8")]
        return [self.unknown_id]

    def decode(self, ids: bytes) -> str:
        """The normal form back as text: bytes joined, marks to spaces, and
        without the mark that encoding put in front."""
        at = np.frombuffer(ids, "<u4")
        if not self.is_byte[at].any():
            return "".join(self.texts[at].tolist()).removeprefix(MARK).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in at.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.hidden:
                out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).removeprefix(MARK).replace(MARK, " ")

    # --- words

    def _word(self, word: str) -> tuple[float, bytes]:
        """(score, packed ids) of the best segmentation of one word."""
        get, longest, n = self.score.get, self.longest, len(word)
        best, start, piece = [0.0] + [NONE] * n, [0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            top, at, own = NONE, 0, -1
            for i in range(max(0, j - longest), j):
                got = get(word[i:j])
                if got is not None:
                    total = best[i] + got[0]
                    if total > top:
                        top, at, own = total, i, got[1]
                elif i == j - 1:
                    total = best[i] + self.unknown
                    if total > top:
                        top, at, own = total, i, -1
            best[j], start[j], piece[j] = top, at, own
        ids: list[list[int]] = []
        j = n
        while j:
            i = start[j]
            ids.append([piece[j]] if piece[j] >= 0 else self.ids_of(word[i:j]))
            j = i
        return best[n], self.pack([x for part in reversed(ids) for x in part])

    def _hash_pieces(self) -> None:
        powers = [1]
        for _ in range(max(SIDE_BY_SIDE, self.longest)):
            powers.append(powers[-1] * int(BASE) % 2**64)
        self.powers = np.array(powers, dtype=np.uint64)
        pieces = list(self.score)
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for i, p in enumerate(pieces):
            hashes[i] = sum((ord(c) + 1) * powers[len(p) - 1 - k] for k, c in enumerate(p)) % 2**64
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("pieces collide under this hash base")
        self.lengths = np.array([len(t) for t in self.text])
        order = np.argsort(hashes)
        # The last entry is met by no piece; it keeps every place in range.
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        self.hash_score = np.array([self.score[pieces[i]][0] for i in order] + [NONE])
        self.hash_id = np.array([self.score[pieces[i]][1] for i in order] + [-1], dtype=np.int64)

    def _side_by_side(self, words: list[str]) -> None:
        """Many words of one length: the same recurrence as ``_word``, for all of
        them at each pair of places.  Substrings are looked up by 64-bit hashes
        (no two pieces share one), so a substring of at most ``longest``
        characters would have to meet a piece's hash by chance to mislead it."""
        m, n = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(m, n).T.astype(np.uint64) + np.uint64(1)
        h = np.zeros((n + 1, m), dtype=np.uint64)
        for j in range(n):
            h[j + 1] = h[j] * BASE + codes[j]
        best = np.full((n + 1, m), NONE)
        best[0] = 0.0
        start, piece = np.zeros((n + 1, m), dtype=np.int64), np.full((n + 1, m), -1, dtype=np.int64)

        def offer(i: int, j: int, rows: np.ndarray, scores: np.ndarray | float, ids: np.ndarray | int) -> None:
            total = best[i, rows] + scores
            good = total > best[j, rows]
            rows = rows[good]
            best[j, rows], start[j, rows] = total[good], i
            piece[j, rows] = ids if isinstance(ids, int) else ids[good]

        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                sub = h[j] - h[i] * self.powers[j - i]
                at = np.minimum(np.searchsorted(self.hashes, sub), len(self.hashes) - 1)
                hit = self.hashes[at] == sub
                rows = np.flatnonzero(hit)
                if len(rows):
                    offer(i, j, rows, self.hash_score[at[rows]], self.hash_id[at[rows]])
                if i == j - 1 and len(rows) < m:
                    offer(i, j, np.flatnonzero(~hit), self.unknown, -1)
        # Back from the ends, all words at once; words with characters that no
        # piece covers are put together one by one, from the same arrays.
        at, rows, steps, odd, wrong = np.full(m, n), np.arange(m), [], np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
        while at.any():
            p = np.where(at > 0, piece[at, rows], -2)
            odd |= p == -1
            wrong |= (p >= 0) & (self.lengths[p] != at - start[at, rows])
            steps.append(p)
            at = start[at, rows] * (at > 0)
        ids = np.array(steps[::-1], dtype="<i4").T
        width, first = 4 * len(steps), 4 * (ids == -2).sum(axis=1)
        raw, ends = ids.tobytes(), np.arange(width, (m + 1) * width, width)
        known, total = self.known, best[n].tolist()
        for word, score, a, b in zip(words, total, (ends - width + first).tolist(), ends.tolist()):
            known[word] = (score, raw[a:b])
        for r in np.flatnonzero(odd).tolist():
            word, starts, pieces, j = words[r], start[:, r].tolist(), piece[:, r].tolist(), n
            parts: list[list[int]] = []
            while j:
                i = starts[j]
                parts.append([pieces[j]] if pieces[j] >= 0 else self.ids_of(word[i:j]))
                j = i
            known[word] = (total[r], self.pack([x for part in reversed(parts) for x in part]))
        for r in np.flatnonzero(wrong).tolist():
            known[words[r]] = self._word(words[r])

    def learn(self, words: Iterable[str]) -> None:
        """Solve the words that are not known yet."""
        words = set(words)
        fresh = [w for w in words if w not in self.known]
        cost = lambda w: 320 + 6 * len(w)  # noqa: E731  (the word, a tuple, and ids of four bytes)
        more = sum(map(cost, fresh))
        if self.held + more > CACHE_BYTES:
            self.known.clear()
            self.held, fresh, more = 0, words, sum(map(cost, words))
        self.held += more
        by_length: dict[int, list[str]] = {}
        for w in fresh:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            if n <= SIDE_BY_SIDE and len(group) >= TOGETHER:
                with np.errstate(over="ignore"):
                    self._side_by_side(group)
            else:
                for w in group:
                    self.known[w] = self._word(w)

    def solve(self, words: list[str]) -> list[tuple[float, bytes]]:
        """(score, packed ids) of each word between two meeting points."""
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            self.learn(words)
        return [known[w] for w in words]

    # --- parts of chunks: all entries at once

    def forward(self, text: str, end: int, entry: np.ndarray, *, columns: bool = False) -> Part:
        """Best scores at every place of ``text``, for pieces that start before
        ``end``.  ``entry`` holds the scores with which places 0, 1, ... are
        entered; with ``columns`` each entry is followed apart (a row each)."""
        width = len(entry) if columns else 1
        best = [np.full(width, NONE) for _ in range(len(text) + 1)]
        for e, s in enumerate(entry[: len(text) + 1]):
            best[e][e if columns else 0] = s
        back: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        for i in range(end):
            b = best[i]
            if not (b > NONE).any():
                continue
            single = False
            for n in range(1, min(self.longest, len(text) - i) + 1):
                got = self.score.get(text[i : i + n])
                if got is None:
                    continue
                single = single or n == 1
                self._offer(best, back, i, i + n, b + got[0], got[1])
            if not single:
                self._offer(best, back, i, i + 1, b + self.unknown, -1)
        return Part(text, best, back)

    @staticmethod
    def _offer(best: list[np.ndarray], back: list, i: int, j: int, total: np.ndarray, piece: int) -> None:
        if len(total) == 1:
            if total[0] > best[j][0]:
                best[j], back[j] = total, (i, piece)
        else:
            best[j] = np.maximum(best[j], total)

    def trace(self, part: Part, at: int) -> tuple[int, list[int]]:
        """(entry, ids) of the best path that ends at ``at``."""
        ids: list[list[int]] = []
        while part.back[at] is not None:
            i, piece = part.back[at]
            ids.append([piece] if piece >= 0 else self.ids_of(part.text[i:at]))
            at = i
        return at, [x for part_ids in reversed(ids) for x in part_ids]

    # --- chunks

    def cut(self, text: str, size: int) -> tuple[int, list[str], int]:
        """(first meeting point, words between, last meeting point) of a chunk
        whose own characters are the first ``size``; no words: (-1, [], -1)."""
        if not self.breaks:
            return -1, [], -1
        places = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text[:size])]
        if not places:
            return -1, [], -1
        words = [text[a:b] for a, b in zip(places, places[1:])]
        return places[0], words, places[-1]

    def matrix(self, text: str, size: int) -> np.ndarray:
        """The transfer matrix: [entry, exit] -> best score."""
        n = self.longest
        entries, out = np.zeros(n), np.full((n, n), NONE)
        first, words, last = self.cut(text, size)
        if first < 0:
            part = self.forward(text, size, entries, columns=True)
            for x in range(min(n, len(text) - size + 1)):
                out[:, x] = part.best[size + x]
            return out
        head = self.forward(text[:first], first, entries, columns=True).best[first]
        tail = self.forward(text[last:], size - last, np.zeros(1))
        middle = sum(s for s, _ in self.solve(words))
        for x in range(min(n, len(text) - size + 1)):
            out[:, x] = head + middle + tail.best[size - last + x][0]
        return out

    def paths(self, text: str, size: int, entry: np.ndarray) -> tuple[bytes, dict[int, tuple[int, bytes]]]:
        """What the chunk gives for the scores it is entered with: ids that all
        its paths share, and per exit the entry of its path and its last ids."""
        first, words, last = self.cut(text, size)
        exits = range(min(self.longest, len(text) - size + 1))
        if first < 0:
            part = self.forward(text, size, entry)
            reach = [x for x in exits if part.best[size + x][0] > NONE]
            traced = {x: self.trace(part, size + x) for x in reach}
            return b"", {x: (e, self.pack(ids)) for x, (e, ids) in traced.items()}
        begin, ids = self.trace(self.forward(text[:first], first, entry), first)
        shared = self.pack(ids) + b"".join(w for _, w in self.solve(words))
        tail = self.forward(text[last:], size - last, np.zeros(1))
        reach = [x for x in exits if tail.best[size - last + x][0] > NONE]
        return shared, {x: (begin, self.pack(self.trace(tail, size - last + x)[1])) for x in reach}

    def encode_all(self, texts: list[str]) -> list[tuple[float, bytes]]:
        """``encode`` of each text, their new words solved together."""
        if not self.breaks:
            return [self.encode(t) for t in texts]
        split = [self.words(self.normal(t)) for t in texts]
        self.learn(chain.from_iterable(split))
        known = self.known
        found = ([known[w] for w in words] for words in split)
        return [(float(sum([s for s, _ in got])), b"".join([ids for _, ids in got])) for got in found]

    def encode(self, text: str) -> tuple[float, bytes]:
        """(score, packed ids) of a text, in one piece."""
        text = self.normal(text)
        if not text:
            return 0.0, b""
        if self.breaks:
            got = self.solve(self.words(text))
            return float(sum([s for s, _ in got])), b"".join([w for _, w in got])
        part = self.forward(text, len(text), np.zeros(1))
        return float(part.best[len(text)][0]), self.pack(self.trace(part, len(text))[1])


class Part:
    """Scores and back pointers of a stretch of text."""

    def __init__(self, text: str, best: list[np.ndarray], back: list) -> None:
        self.text, self.best, self.back = text, best, back


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the max-plus semiring; associative, so any grouping will do."""
    return (a[..., :, None] + b[None, :, :]).max(axis=-2)


def _square(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw)
    return m.reshape(int(len(m) ** 0.5), -1)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


# --- DataFrames ---------------------------------------------------------------


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", giant: int = 65_536, chunk: int = 65_536) -> DataFrame:
    """id, ids (binary, little-endian 32-bit) and path_score for each row.

    Null and empty texts have no ids and score 0.  Rows keep their
    multiplicity: repeated rows give repeated results.  Texts of more than
    ``giant`` characters of normal form go through the parallel scan in chunks
    of ``chunk``; the result does not depend on either: scores are multiples of
    2**-20, whose sums are exact (below 2**33) in whatever order they are taken.
    The products of RUN matrices (2 KB each) meet in one task a document, 1 MB
    at Spark's limit of 2 GB a text; its characters never do until its ids are
    put together.
    """
    need(docs, id=id_col, text=text_col)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # One mark in front is all that the normal form may add.
    small = rows.where(F.length("text") < giant)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for part in slices(batches):
            made = v.encode_all(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([m[1] for m in made], pa.binary()), pa.array([m[0] for m in made], pa.float64())], names=["id", "ids", "path_score"],
            )

    done = small.mapInArrow(whole, f"id {kind}, ids binary, path_score double")
    return done.unionByName(_scan(rows.where(F.length("text") >= giant), model, kind, chunk)).withColumnRenamed("id", id_col)


def _scan(rows: DataFrame, model: str, kind: str, chunk: int) -> DataFrame:
    k1, k2 = row_key(F.col("id"), F.col("text"))
    keyed = rows.select("id", k1.alias("k1"), k2.alias("k2"), "text")
    copies = keyed.groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).cast("int").alias("copies"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for part in slices(batches, 1):
            full = v.normal(part.column(2)[0].as_py())
            for no, at in enumerate(range(0, len(full), chunk)):
                own = min(chunk, len(full) - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([no], pa.int32()), pa.array([own], pa.int32()), pa.array([full[at : at + own + v.longest - 1]])],
                    names=["k1", "k2", "no", "size", "text"],
                )

    chunks = materialize(
        keyed.select("k1", "k2", "text").mapInArrow(split, "k1 bigint, k2 bigint, no int, size int, text string").dropDuplicates(["k1", "k2", "no"]), "chunks"
    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for part in slices(batches, 8):
            made = [v.matrix(t, n).tobytes() for t, n in zip(part.column(4).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(made, pa.binary())], names=["k1", "k2", "no", "matrix"])

    def product(group: pd.DataFrame) -> pd.DataFrame:
        """The product of a run's matrices, pairs of neighbours first."""
        made = [_square(raw) for raw in group.sort_values("no")["matrix"]]
        while len(made) > 1:
            made = [max_plus(*made[i : i + 2]) if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
        first = group.iloc[0]
        return pd.DataFrame({"k1": [first["k1"]], "k2": [first["k2"]], "run": [first["run"]], "matrix": [made[0].tobytes()]})

    def scan(group: pd.DataFrame, order: str) -> pd.DataFrame:
        """With what scores each matrix is entered: from the front of the text,
        or with ``start``, what the run is entered with."""
        group = group.sort_values(order)
        n = len(_square(group["matrix"].iloc[0]))
        now, entries = np.full(n, NONE), []
        now[0] = 0.0
        if "start" in group:
            now = np.frombuffer(group["start"].iloc[0])
        for raw in group["matrix"]:
            entries.append(now.tobytes())
            now = (now[:, None] + _square(raw)).max(axis=0)
        group["entry"] = entries
        if "start" not in group:
            group["total"] = float(now[0])
        return group

    matrix = materialize(chunks.mapInArrow(matrices, "k1 bigint, k2 bigint, no int, matrix binary").withColumn("run", F.floor(F.col("no") / RUN).cast("int")), "matrices")
    runs = matrix.groupBy("k1", "k2", "run").applyInPandas(product, "k1 bigint, k2 bigint, run int, matrix binary")
    heads = runs.groupBy("k1", "k2").applyInPandas(
        lambda g: scan(g, "run").rename(columns={"entry": "start"})[["k1", "k2", "run", "start", "total"]], "k1 bigint, k2 bigint, run int, start binary, total double"
    )
    entries = (
        matrix.join(heads, ["k1", "k2", "run"]).groupBy("k1", "k2", "run")
        .applyInPandas(lambda g: scan(g, "no")[["k1", "k2", "no", "entry", "total"]], "k1 bigint, k2 bigint, no int, entry binary, total double")
    )

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for part in slices(batches, 8):
            made = [v.paths(t, n, np.frombuffer(e)) for t, n, e in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist())]
            exits = [[{"x": x, "e": e, "ids": ids} for x, (e, ids) in m[1].items()] for m in made]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(3)), part.column(6), pa.array([m[0] for m in made], pa.binary()),
                 pa.array(exits, pa.list_(pa.struct([("x", pa.int32()), ("e", pa.int32()), ("ids", pa.binary())])))],
                names=["k1", "k2", "no", "total", "shared", "exits"],
            )

    traced = materialize(
        chunks.join(entries, ["k1", "k2", "no"]).select("k1", "k2", "no", "text", "size", "entry", "total")
        .mapInArrow(trace, "k1 bigint, k2 bigint, no int, total double, shared binary, exits array<struct<x:int,e:int,ids:binary>>"), "traced"
    )

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no", ascending=False)
        x, chosen = 0, []
        for maps in group["maps"]:
            chosen.append(x)
            x = next(m["e"] for m in maps if m["x"] == x)
        group["exit"] = chosen
        return group[["k1", "k2", "no", "exit"]]

    chosen = (
        traced.select("k1", "k2", "no", F.transform("exits", lambda m: F.struct(m["x"].alias("x"), m["e"].alias("e"))).alias("maps"))
        .groupBy("k1", "k2").applyInPandas(choose, "k1 bigint, k2 bigint, no int, exit int")
    )
    last = F.element_at(F.filter("exits", lambda m: m["x"] == F.col("exit")), 1)["ids"]
    whole = (
        traced.join(chosen, ["k1", "k2", "no"]).groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_list(F.struct("no", F.concat("shared", last).alias("ids")))).alias("parts"), F.max("total").alias("path_score"))
        .select("k1", "k2", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"), "path_score")
    )
    out = copies.join(whole, ["k1", "k2"])
    return out.select("id", "ids", "path_score", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("one")).drop("one")


def decode_pieces(df: DataFrame, model: str, *, ids_col: str = "ids") -> DataFrame:
    """``df`` plus ``decoded``: the text that packed ids stand for (null: empty).
    A column already called decoded is replaced."""
    need(df, ids=ids_col)
    own = [c for c in df.columns if c.lower() != "decoded"]
    at, keep = df.columns.index(ids_col), [df.columns.index(c) for c in own]
    schema = df.select(*[F.col(f"`{c}`") for c in own]).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for part in slices(batches):
            texts = [v.decode(x or b"") for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(texts, pa.string())], names=[*own, "decoded"])

    return df.mapInArrow(run, schema)


# --- query ------------------------------------------------------------------

NAME = "op4_pieces"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode_pieces(docs, model_path())
    back = decode_pieces(encoded, model_path())
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.col("path_score").alias("path_score"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
