"""Analysis views: spans of chunks per view, top spans, dedup inside a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions import text as T
from docskein.operators.containment import drop_contained_rows

# The views, in their order.
VIEWS = ["value_analysis", "business_concept", "business_requirement", "system_requirement", "system_component", "data_analysis"]


def _spans(sentences: Column, pattern: str, top: int) -> Column:
    """The first ``top`` distinct sentences of a chunk that match; once they are
    found the pattern is not looked for any more."""
    none = F.array().cast("array<string>")
    return F.aggregate(sentences, none, lambda found, s: F.when((F.size(found) < top) & s.rlike(pattern) & ~F.array_contains(found, s), F.array_append(found, s)).otherwise(found))


def view_spans(chunks: DataFrame, view_patterns: dict[str, str], *, id_col: str = "doc_id", top: int = 3, rules: T.TextRules = T.TextRules()) -> DataFrame:
    """(id_col, chunk_no, view_type, rank, text) by rules: a sentence belongs to
    every view whose pattern it matches."""
    df = chunks.select(id_col, "chunk_no", T.split_sentences(F.col("text"), rules.split_ends).alias("s"))
    views = F.array(*[F.struct(F.lit(v).alias("view_type"), _spans(F.col("s"), p, top).alias("spans")) for v, p in view_patterns.items()])
    df = df.select(id_col, "chunk_no", F.explode(views).alias("v"))
    return df.select(id_col, "chunk_no", "v.view_type", F.posexplode("v.spans").alias("pos", "text")).select(
        id_col, "chunk_no", "view_type", (F.col("pos") + 1).alias("rank"), "text"
    )


def parse_spans(decisions: DataFrame, *, keys: list[str], top: int = 3, payload: str = "payload") -> DataFrame:
    """The same rows from decisions (``keys``, JSON payload of one array per
    view): strings only, stripped, without empty ones and repeats.  A payload
    that is no JSON gives no row."""
    ddl = ", ".join(f"{v} array<string>" for v in VIEWS)
    df = decisions.withColumn("_p", F.from_json(payload, ddl))
    clean = lambda v: F.slice(T.first_distinct(F.filter(F.transform(F.col(f"_p.{v}"), T.strip), lambda s: s.isNotNull() & (s != ""))), 1, top)
    views = F.array(*[F.struct(F.lit(v).alias("view_type"), clean(v).alias("spans")) for v in VIEWS])
    df = df.select(*keys, F.explode(views).alias("v"))
    return df.select(*keys, "v.view_type", F.posexplode("v.spans").alias("pos", "text")).select(*keys, "view_type", (F.col("pos") + 1).alias("rank"), "text")


def dedup_views(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id_col, view_type, ord, text): inside a document's view equal texts stay
    once (the first), and texts that another one contains go."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "rank", "text")))
    df = spans.groupBy(id_col, "view_type").agg(F.array_distinct(F.transform(parts, lambda p: p["text"])).alias("texts"))
    return df.select(id_col, "view_type", F.posexplode(T.drop_contained(F.col("texts"))).alias("ord", "text"))


def _texts_by_view(docs: DataFrame, view_patterns: dict[str, str], id_col: str, text_col: str, top: int, rules: T.TextRules) -> DataFrame:
    """(id_col, view_type, texts): the distinct spans of a document's chunks."""
    df = docs.select(id_col, T.split_sentences(F.col(text_col), rules.split_ends).alias("s"))
    df = df.select(id_col, T.chunk_sentences(F.col("s"), rules.max_chars, rules.overlap_chars).alias("chunks"))
    # One pass over the chunks: of each its spans view by view.
    spans = lambda s: F.array(*[_spans(s, p, top) for p in view_patterns.values()])
    df = df.select(id_col, F.transform("chunks", lambda c: T.let(T.split_sentences(c, rules.split_ends), spans)).alias("parts"))
    texts = lambda i: F.array_distinct(F.flatten(F.transform("parts", lambda x: x[i])))
    views = F.array(*[F.struct(F.lit(v).alias("view_type"), texts(i).alias("texts")) for i, v in enumerate(view_patterns)])
    return df.select(id_col, F.explode(views).alias("v")).select(id_col, "v.view_type", F.col("v.texts").alias("texts"))


def view_texts(docs: DataFrame, view_patterns: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text", top: int = 3, rules: T.TextRules = T.TextRules()) -> DataFrame:
    """The result of chunking, spans and dedup in one expression per document:
    nothing is shuffled.  Dedup compares all texts of a document's view; for
    documents of many megabytes see ``view_texts_of_any_size``."""
    df = _texts_by_view(docs, view_patterns, id_col, text_col, top, rules)
    return df.select(id_col, "view_type", F.posexplode(T.drop_contained(F.col("texts"))).alias("ord", "text"))


def view_texts_of_any_size(docs: DataFrame, view_patterns: dict[str, str], *, giant: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", top: int = 3, rules: T.TextRules = T.TextRules()) -> DataFrame:
    """``view_texts``; documents of more than ``giant`` characters have their texts
    spread over tasks and met by anchors (see ``operators.containment``)."""
    size = F.coalesce(F.length(text_col), F.lit(0))
    if docs.where(size > giant).isEmpty():
        return view_texts(docs, view_patterns, id_col=id_col, text_col=text_col, top=top, rules=rules)
    small = view_texts(docs.where(size <= giant), view_patterns, id_col=id_col, text_col=text_col, top=top, rules=rules)
    rows = _texts_by_view(docs.where(size > giant), view_patterns, id_col, text_col, top, rules).select(id_col, "view_type", F.posexplode("texts").alias("ord", "text"))
    kept = drop_contained_rows(rows, [id_col, "view_type"])
    place = F.row_number().over(Window.partitionBy(id_col, "view_type").orderBy("ord")) - 1
    return small.unionByName(kept.select(id_col, "view_type", place.alias("ord"), "text"))


def nest_views(texts: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id_col, views): one row per document in the nested form, views in their
    fixed order, without empty ones."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    df = texts.groupBy(id_col, "view_type").agg(F.transform(parts, lambda p: p["text"]).alias("texts"))
    place = F.array_position(F.array(*[F.lit(v) for v in VIEWS]), F.col("view_type"))
    df = df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("view_type").alias("type"), "texts"))).alias("views"))
    return df.withColumn("views", F.transform("views", lambda v: F.struct(v["type"], v["texts"])))
