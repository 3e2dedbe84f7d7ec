"""Text functions and the patterns of the line operators.

Patterns are written so that Java's and RE2's syntax agree: white space and
digits are spelled out, because ``\\s`` and ``\\d`` mean different sets there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a class body.
SPACE_CHARS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{SPACE_CHARS}]"
_RANGES = ((0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: The same characters one by one, for the trim functions.
SPACES = "".join(chr(c) for a, b in _RANGES for c in range(a, b + 1))
#: Marks the places where sentences are cut.
CUT = "\x01"
# Marks of list items; each needs white space after it.
BULLET_MARKS = [
    r"[\x{2022}\x{30FB}\x{2013}\x{2014}\x{25B6}*-]",
    r"\(\p{Nd}+\)",
    r"\p{Nd}+[.)]",
    r"[a-zA-Z][.)]",
    r"[\x{2460}-\x{2473}]",
    rf"-{SPACE}+\[{SPACE}?[xX]?{SPACE}?\]",
]
BULLET = f"^{SPACE}*(?:{'|'.join(BULLET_MARKS)}){SPACE}"
# Lines that are no content (a contents title, page marks).
EXCLUDED = rf"^{SPACE}*(?:目{SPACE}*次|別\p{{Nd}}+-\p{{Nd}}+){SPACE}*$"
# Brackets that may follow a sentence's end, and punctuation that
# takes no space before or after it.
CLOSERS = r"[)”\]}』」】〉》]"
NO_SPACE_BEFORE = "^[、。，．）」』】〉》]"
NO_SPACE_AFTER = "[（「『【〈《]$"
# Fixed values of re-flowing.
REFLOW_CLOSERS = "[」』）】》\"']"
REFLOW_BULLET = r"^(?:\p{Nd}+[.)]|[A-Za-z]\)|[・•–—◇◆●■□\x{2460}-\x{2469}-])"
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


@dataclass(frozen=True)
class TextRules:
    """Characters that end a sentence, per operator, and chunk sizes."""

    merge_ends: str = "。！？!?"
    reflow_ends: str = "。．！？!?"
    split_ends: str = "。！？!?"
    max_chars: int = 1600
    overlap_chars: int = 200


def western(rules: TextRules | None = None) -> TextRules:
    """Rules that also take the ASCII full stop as an end."""
    r = rules or TextRules()
    return TextRules(r.merge_ends + ".", r.reflow_ends + ".", r.split_ends + ".", r.max_chars, r.overlap_chars)


def strip(c: Column) -> Column:
    """Without white space at both ends (Unicode, not only U+0020)."""
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def inline_space(c: Column) -> Column:
    """Without soft hyphens and carriage returns at the ends; runs of spaces and
    tabs become one space."""
    plain = F.regexp_replace(F.translate(c, "­", ""), "[ \t]{2,}", " ")
    return F.trim(plain, F.lit("\r"))


def sentence_end(ends: str) -> str:
    return f"[{ends}]{CLOSERS}*{SPACE}*$"


def split_sentences(text: Column, ends: str) -> Column:
    """Array of sentences: cut after every end mark (white space after it goes)
    and at blank lines; stripped, without empty ones; null text gives none.

    The cuts are marked by literal replacements and split at one character, which
    costs a fraction of a pattern that looks behind at every place; what white
    space stands at a cut goes with the strip.  Texts that hold the mark's own
    character are cut by the pattern."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    marked = F.replace(t, F.lit("\n\n"), F.lit(CUT))
    for end in ends:
        marked = F.replace(marked, F.lit(end), F.lit(end + CUT))
    pieces = F.when(F.contains(t, F.lit(CUT)), F.split(t, f"(?<=[{ends}]){SPACE}*|\n{{2,}}", -1)).otherwise(F.split(marked, CUT, -1))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def cut_after_ends(text: Column, ends: str, closers: str) -> Column:
    """Array of pieces: each up to an end mark with its closing marks, then the
    rest; stripped, without empty ones."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^{ends}]*+[{ends}]{closers}*+|[^{ends}]++"), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def chunk_sentences(sentences: Column, max_chars: int, overlap: int) -> Column:
    """Array of chunks: sentences are gathered while they fit; the next chunk
    begins with the last ``overlap`` code points of the one before.  A long
    sentence is never cut, and a chunk may pass the size by its overlap."""
    none = F.array().cast("array<string>")
    # A fold copies its state at every step.  So sentences are folded in blocks, of
    # which each begins without done chunks: a step copies the chunks of its block
    # alone, and all of them are copied once a block.  The chunk under way is its
    # ``tail`` of the one before and the sentences from place ``a`` to ``i``, ``n``
    # characters in all: it is put together when it is done.
    start = F.struct(none.alias("done"), F.lit("").alias("tail"), *[F.lit(0).alias(k) for k in "ain"])
    moved = lambda acc, done: F.struct(done.alias("done"), *[acc[k].alias(k) for k in ("tail", "a", "i", "n")])

    def state(done: Column, tail: Column, a: Column, i: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), tail.alias("tail"), a.alias("a"), (i + 1).alias("i"), n.alias("n"))

    def fold(every: Column) -> Column:
        size = F.greatest(F.lit(RUN), F.ceil(F.sqrt(F.size(every))).cast("int"))
        blocks = F.when(F.size(every) > 0, F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), size)).otherwise(F.array().cast("array<int>"))

        def chunk(acc: Column) -> Column:
            return F.concat(acc["tail"], F.when(acc["tail"] == "", "").otherwise(" "), F.array_join(F.slice(every, acc["a"] + 1, acc["i"] - acc["a"]), " "))

        def done(acc: Column, cur: Column, s: Column) -> Column:
            # Sentences come stripped, so only the front of a tail can need it.
            tail = lstrip(F.right(cur, F.lit(overlap))) if overlap else F.lit("")
            own = F.concat(acc["done"], F.array(cur))
            return let(tail, lambda t: state(own, t, acc["i"], acc["i"], F.length(t) + F.when(t == "", 0).otherwise(1) + F.length(s)))

        def step(acc: Column, s: Column) -> Column:
            own, tail, a, i, n = (acc[k] for k in ("done", "tail", "a", "i", "n"))
            return (
                F.when(n == 0, state(own, tail, i, i, F.length(s))).when(n + F.length(s) + 1 <= max_chars, state(own, tail, a, i, n + F.length(s) + 1))
                .otherwise(let(chunk(acc), lambda cur: done(acc, cur, s)))
            )

        def block(acc: Column, at: Column) -> Column:
            return let(F.aggregate(F.slice(every, at, size), moved(acc, none), step), lambda x: moved(x, F.concat(acc["done"], x["done"])))

        chunks = F.aggregate(blocks, start, block, lambda acc: F.concat(acc["done"], F.when(acc["n"] == 0, none).otherwise(F.array(chunk(acc)))))
        return F.when(every.isNotNull(), chunks)

    return let(sentences, fold)


RUN = 64  # sentences of a block at least


def first_distinct(texts: Column) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(texts)


def drop_contained(texts: Column) -> Column:
    """Of distinct texts those that no other text contains.  ``texts`` should be a
    column, not an expression: it is read once per element.  One that contains
    another has more bytes, too, and bytes are not counted."""
    return F.filter(texts, lambda x: ~F.exists(texts, lambda y: (F.octet_length(y) > F.octet_length(x)) & F.contains(y, x)))
