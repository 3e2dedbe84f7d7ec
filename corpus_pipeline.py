"""The corpus pipeline: raw documents to packed training sequences.

Every stage takes all that its predecessor kept, as a Parquet table, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import materialize, release, scratch
from docskein.llm.jaccard import keep_one
from docskein.llm.langid import UNDETERMINED, identify_language
from docskein.llm.line_dedup import dedup_lines
from docskein.llm.packing import pack, tokenize_pieces, tokenizer_path
from docskein.llm.secrets import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in no language: those without a letter, and those
    whose code length is far above what texts of the nearest language have
    (letter junk, languages that no label names).  The others stay, and a missing
    ``lang`` is filled with the predicted one.  Where no document has a label,
    nothing can be told and documents with a letter stay as they are."""
    told = identify_language(docs)
    letter = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    known = F.col("lang_pred") != UNDETERMINED
    lang = F.coalesce(F.col("lang"), F.when(known, F.col("lang_pred"))).cast(docs.schema["lang"].dataType)
    kept = told.where((known & F.col("fits")) | (~known & letter))
    return kept.select(*[(lang if c == "lang" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them."""
    return _measured(dedup_lines(docs).select(*docs.columns), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _measured(redact_secrets(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of at most 4096 tokens."""
    packed = pack(tokenize_pieces(docs, tokenizer_path()))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _measured(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars follows the text, in the column's own type."""
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# Language models, tokenizers and packing have no SQL form; tests/llm compares
# the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again.
    What a stage needed on the way, and its predecessor's table, goes once its own
    is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        with scratch() as tables:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            tables.remove(docs)
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
