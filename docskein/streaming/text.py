"""Structured Streaming over arriving document files.

Splitting, chunking and spans look at one row at a time, so they run on a
stream as they do on a table.  Dedup inside a document needs its whole text,
which one row holds; nothing keeps state between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docskein.functions.text import TextRules
from docskein.operators import chunks, views


def read_documents(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_chunks(docs: DataFrame, *, id_col: str = "doc_id", rules: TextRules = TextRules()) -> DataFrame:
    return chunks.char_chunks(docs, id_col=id_col, rules=rules)


def stream_views(docs: DataFrame, view_patterns: dict[str, str], *, id_col: str = "doc_id", rules: TextRules = TextRules()) -> DataFrame:
    return views.view_texts(docs, view_patterns, id_col=id_col, rules=rules)


def write_stream(rows: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append to Parquet with exactly-once output; ``once`` takes what is there
    and ends."""
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
