"""Sentences and chunks.  Everything but slide chunks is one expression per
document: no shuffle, however many documents there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.functions import text as T


def sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: T.TextRules = T.TextRules()) -> DataFrame:
    """(id_col, pos, text)."""
    return docs.select(id_col, F.posexplode(T.split_sentences(F.col(text_col), rules.split_ends)).alias("pos", "text"))


def char_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: T.TextRules = T.TextRules()) -> DataFrame:
    """(id_col, chunk_no, text): overlapping chunks of about ``max_chars``."""
    chunks = T.chunk_sentences(T.split_sentences(F.col(text_col), rules.split_ends), rules.max_chars, rules.overlap_chars)
    return docs.select(id_col, F.posexplode(chunks).alias("chunk_no", "text"))


def slide_chunks(lines: DataFrame, *, id_col: str) -> DataFrame:
    """(id_col, slide_no, text) from (id_col, slide_no, ord, text): one chunk a
    slide, lines joined by a space in their order."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return lines.groupBy(id_col, "slide_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def parse_marked_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", marker: str = "スライド") -> DataFrame:
    """(id_col, slide_no, ord, text) from texts whose lines carry a slide mark
    ``[[<marker>n]]``: the first mark of a line names its slide, all copies of it
    go, lines without a mark are dropped."""
    lines = F.transform(F.split(F.col(text_col), "\n", -1), T.strip)
    df = docs.select(id_col, F.posexplode(lines).alias("ord", "line"))
    mark = F.regexp_extract("line", rf"\[\[{marker}\p{{Nd}}+\]\]", 0)
    number = F.expr(f"try_cast(regexp_extract(line, '\\\\[\\\\[{marker}([0-9]+)\\\\]\\\\]', 1) AS int)")
    return df.where(mark != "").select(id_col, number.alias("slide_no"), "ord", T.strip(F.replace("line", mark, F.lit(""))).alias("text"))


def route(files: DataFrame, *, type_col: str = "file_type") -> tuple[DataFrame, DataFrame]:
    """(slides, documents): presentations one way, everything else the other."""
    slides = F.coalesce(F.col(type_col) == "presentation", F.lit(False))
    return files.where(slides), files.where(~slides)
