"""Files as pages of text.

A file is a row per page: (file_id, file_name, page_no from 1, text).  Pages come
from a table, or from binary files through ``parse``, a function of a file's
bytes to the texts of its pages.  ``form_feed_pages`` reads plain text;
``pdf_pages`` uses a PDF library where one is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.functions.iri import stable_id
from docskein.functions.text import strip
from docskein.operators.check import require

PAGES = "file_id string, file_name string, page_no int, text string"


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def form_feed_pages(data: bytes) -> list[str]:
    return data.decode("utf-8", "replace").split("\f")


def pdf_pages(data: bytes) -> list[str]:
    import io

    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]] = form_feed_pages, *, suffix: str = ".txt") -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of all files under ``path``; files of another suffix and
    files that ``parse`` fails on are rows (file_id, stage, message) of errors."""
    files = spark.read.format("binaryFile").load(path).select(stable_id("path").alias("file_id"), base_name(F.col("path")).alias("file_name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b.itertuples(index=False):
                try:
                    if not f.file_name.lower().endswith(suffix):
                        raise ValueError(f"not a {suffix} file: {f.file_name}")
                    texts, error = parse(f.content), None
                except Exception as e:  # a parser's errors are of any type
                    texts, error = [""], str(e) or type(e).__name__
                yield pd.DataFrame({"file_id": f.file_id, "file_name": f.file_name, "page_no": range(1, len(texts) + 1), "text": texts, "error": error})

    read = files.mapInPandas(run, f"{PAGES}, error string")
    errors = read.where("error IS NOT NULL").select("file_id", F.lit("text").alias("stage"), F.col("error").alias("message"))
    return read.where("error IS NULL").drop("error"), errors


def first_pages(pages: DataFrame, k: int = 2) -> DataFrame:
    """The first ``k`` pages of every file."""
    require(pages, "page_no")
    return pages.where(F.col("page_no") <= k)


def file_text(pages: DataFrame) -> DataFrame:
    """(file_id, text): the pages that are not empty, a line end between them,
    stripped."""
    require(pages, "file_id", "page_no", "text")
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    full = pages.where(F.coalesce("text", F.lit("")) != "").groupBy("file_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return full.select("file_id", strip(F.col("text")).alias("text"))


def slide_texts(pages: DataFrame) -> DataFrame:
    """(file_id, slide_no, text): the stripped pages that are not empty."""
    require(pages, "file_id", "page_no", "text")
    return pages.select("file_id", F.col("page_no").alias("slide_no"), strip(F.col("text")).alias("text")).where("text <> ''")


def collect_lines(rows: DataFrame, *, id_col: str = "file_id", sentences: str = "sentences") -> DataFrame:
    """(id_col, file_name, ord, text) from rows that hold their lines as an array
    of strings, or of structs with a field text.  The name is ``file_name``, else
    ``filename``, else "unknown"; line ends at the ends of lines go, nulls too."""
    require(rows, id_col, sentences)
    names = [F.col(c) for c in ("file_name", "filename") if c in rows.columns]
    element = rows.schema[sentences].dataType.elementType
    text = F.col("line")["text"] if hasattr(element, "fields") else F.col("line")
    lines = rows.select(id_col, F.coalesce(*names, F.lit("unknown")).alias("file_name"), F.posexplode(sentences).alias("ord", "line"))
    return lines.select(id_col, "file_name", "ord", F.rtrim(text.cast("string"), F.lit("\n")).alias("text")).where("text IS NOT NULL")
