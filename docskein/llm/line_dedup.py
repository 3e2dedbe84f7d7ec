"""Line dedup (operator 10): drop lines that many documents share.

Native: only DataFrame functions.  Lines are exploded as 128-bit hashes (never
as text), distinct documents are counted per hash in two partial aggregations,
frequent hashes are joined back (the most frequent ones by broadcast, so that no
task gets all rows of one) to give each document its list of dropped positions, and the document is reassembled by position from its own text.  The
text itself is shuffled once, in the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import materialize, need, row_key, skewed_join, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Key of a line: ASCII white space stripped at both ends, A-Z lower-cased."""
    blank = " \t\n\x0b\x0c\r"
    return F.translate(F.trim(line, F.lit(blank)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """``docs`` with ``text`` rebuilt without shared lines, and n_lines, n_dropped.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    distinct ids loses all its lines except those in the largest id holding it.
    All other columns stay (columns already called n_lines or n_dropped are
    replaced).

    Null or empty text is one empty line.  A null id counts as one document
    and as smaller than every other id.  Rows that repeat an id are one
    document to the counts; each row keeps its own text.  An empty table gives
    an empty table.  Ties cannot arise: the largest id is one value.
    """
    need(docs, id=id_col, text=text_col)
    doc, text = F.col(id_col), whole_text(text_col)
    k1, k2 = row_key(doc, F.col(text_col))

    lines = (
        docs.select(k1.alias("k1"), k2.alias("k2"), doc.alias("id"), F.posexplode(split_lines(text)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("k1", "k2", "id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(104729), "key").alias("h2"))
    )
    shared = (
        lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("one").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper", "n_docs")
    )
    shared = materialize(shared, "shared-lines")
    dropped = (
        skewed_join(lines, shared, ["h1", "h2"], "n_docs")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )

    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"),
    ).join(dropped, ["k1", "k2"], "left")
    row_text = whole_text(F.col("row").getField(text_col))
    all_lines = split_lines(row_text)
    kept = _without(F.col("all_lines"), F.col("gone"))
    out = out.withColumn("all_lines", F.when(F.col("gone").isNotNull(), all_lines))
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    new_text = F.when(F.col("gone").isNull(), row_text).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[(new_text if c == text_col else F.col("row").getField(c)).alias(c) for c in own],
        (F.octet_length(row_text) - F.octet_length(F.replace(row_text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without the positions in ``gone`` (ascending), in linear time:
    the runs between dropped positions, laid end to end."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.flatten(runs)


# --- query ------------------------------------------------------------------

NAME = "op10_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
