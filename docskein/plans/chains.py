"""The chains between files and chunks: each a composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.functions.text import TextRules
from docskein.operators import chunks, lines, views
from docskein.operators.check import require
from docskein.sources import pages as P


def document_chain(texts: DataFrame, *, id_col: str = "file_id", text_col: str = "text", rules: TextRules = TextRules()) -> DataFrame:
    """(id_col, sent_no, text): a document's lines, merged into sentences."""
    return lines.merge_lines(lines.text_lines(require(texts, id_col, text_col), id_col=id_col, text_col=text_col), id_col=id_col, rules=rules)


def presentation_chain(slides: DataFrame, *, id_col: str = "file_id", slide_col: str = "slide_no", text_col: str = "text") -> DataFrame:
    """(id_col, slide_no, ord, text): the lines of a deck, as they are."""
    return lines.slide_lines(require(slides, id_col, slide_col, text_col), id_col=id_col, slide_col=slide_col, text_col=text_col)


def join_sentences(sentences: DataFrame, *, id_col: str = "file_id", order: str = "sent_no", separator: str = " ") -> DataFrame:
    """(id_col, text): the sentences of a document in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return sentences.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"))


def create_chunks(df: DataFrame, mode: str, *, id_col: str = "file_id", rules: TextRules = TextRules()) -> DataFrame:
    """(id_col, chunk_no, text): mode char from sentences (sent_no, text), mode
    page from slide lines (slide_no, ord, text), the slide's number as chunk_no."""
    if mode == "char":
        return chunks.char_chunks(join_sentences(df, id_col=id_col), id_col=id_col, rules=rules)
    if mode == "page":
        return chunks.slide_chunks(df, id_col=id_col).withColumnRenamed("slide_no", "chunk_no")
    raise ValueError(f"unknown chunk mode {mode!r}: char or page")


def file_chunks(pages: DataFrame, types: DataFrame, *, rules: TextRules = TextRules()) -> DataFrame:
    """(file_id, chunk_no, text) of all files: decks slide by slide, documents
    merged and cut by characters."""
    slides, docs = chunks.route(pages.join(types, "file_id", "left"))
    decks = create_chunks(presentation_chain(P.slide_texts(slides)), "page", rules=rules)
    texts = create_chunks(document_chain(P.file_text(docs), rules=rules), "char", rules=rules)
    return decks.unionByName(texts)


def merge_in_chunks(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: TextRules = TextRules()) -> DataFrame:
    """(id_col, chunk_no, sent_no, text): lines merged inside each chunk of the
    text, for texts that are too long to be merged as a whole."""
    cut = chunks.char_chunks(require(texts, id_col, text_col), id_col=id_col, text_col=text_col, rules=rules)
    keyed = cut.select(F.struct(id_col, "chunk_no").alias("key"), "text")
    merged = lines.merge_lines(lines.text_lines(keyed, id_col="key", keep_blank=True), id_col="key", rules=rules)
    return merged.select(F.col("key")[id_col].alias(id_col), F.col("key")["chunk_no"].alias("chunk_no"), "sent_no", "text")


def view_chain(answers: DataFrame, *, id_col: str = "file_id", top: int = 3) -> DataFrame:
    """(id_col, view_type, ord, text) from answers about chunks (id_col, chunk_no,
    payload): spans by view, then dedup inside a document's view."""
    return views.dedup_views(views.parse_spans(answers, keys=[id_col, "chunk_no"], top=top), id_col=id_col)
