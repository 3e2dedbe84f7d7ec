"""Line operators: flattening, merging of wrapped lines, re-flowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions import text as T


def text_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_blank: bool = False) -> DataFrame:
    """(id_col, ord, text): stripped lines without blank ones, in order.  With
    ``keep_blank`` the raw lines.  Null text gives no line.  No shuffle."""
    lines = F.split(F.col(text_col), "\n", -1)
    if not keep_blank:
        lines = F.filter(F.transform(lines, T.strip), lambda s: s != "")
    return docs.select(id_col, F.posexplode(lines).alias("ord", "text"))


def slide_lines(slides: DataFrame, *, id_col: str, slide_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, slide_no, ord, text): the slide's number is a column."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), T.strip), lambda s: s != "")
    return slides.select(id_col, F.col(slide_col).alias("slide_no"), F.posexplode(lines).alias("ord", "text"))


def merge_lines(lines: DataFrame, *, id_col: str = "doc_id", rules: T.TextRules = T.TextRules()) -> DataFrame:
    """(id_col, sent_no, text) from (id_col, ord, text): wrapped lines joined.

    A paragraph line takes the following lines until a blank line, a list item
    or a sentence's end; a list item takes them until a blank line or the next
    item.  Excluded lines go where a sentence would begin, and are text inside
    one.  A line's last hyphen joins words; other joins follow ``_glue``.

    Gaps and islands over one window per document.
    """
    W = Window.partitionBy(id_col).orderBy("ord")
    so_far = W.rowsBetween(Window.unboundedPreceding, 0)
    df = lines.select(id_col, "ord", T.inline_space(F.col("text")).alias("t"))
    df = df.select(
        "*", (T.strip(F.col("t")) == "").alias("blank"), F.col("t").rlike(T.BULLET).alias("item"),
        F.col("t").rlike(T.sentence_end(rules.merge_ends)).alias("ends"), F.col("t").rlike(T.EXCLUDED).alias("out"),
    )
    # A line of closing brackets ends a sentence if it is joined to an end mark:
    # the line before it, or before lines of brackets and a hyphen only, is an end
    # but for its hyphen.
    through = F.col("t").rlike(f"^{T.SPACE}*{T.CLOSERS}*-$")
    df = df.select(
        "*", F.last(F.when(F.col("blank"), "B").when(F.col("item"), "L"), ignorenulls=True).over(so_far).alias("mode"),
        F.last(F.when(~through, F.col("t")), ignorenulls=True).over(so_far).alias("base"),
    )
    joined = F.col("t").rlike(f"^{T.SPACE}*{T.CLOSERS}+{T.SPACE}*$") & F.coalesce(F.lag("base").over(W).rlike(f"[{rules.merge_ends}]{T.CLOSERS}*-$"), F.lit(False)) & F.coalesce(F.lag("t").over(W).endswith("-"), F.lit(False))
    df = df.withColumn("ends", F.col("ends") | joined)
    df = df.select(
        "*", F.lag("blank").over(W).alias("p_blank"), F.lag("ends").over(W).alias("p_ends"),
        F.coalesce(F.lag("mode").over(W), F.lit("B")).alias("p_mode"), F.coalesce(F.lag("out").over(W), F.lit(False)).alias("p_out"),
    )
    begins = F.col("p_blank").isNull() | F.col("p_blank") | F.col("item") | ((F.col("p_mode") != "L") & F.col("p_ends"))
    df = df.withColumn("begins", begins)
    run = F.last(F.when(F.col("out") & ~F.col("p_out"), F.col("begins")), ignorenulls=True).over(so_far)
    df = df.withColumn("gone", F.col("out") & F.coalesce(run, F.lit(False)))
    df = df.withColumn("begins", F.col("begins") | F.coalesce(F.lag("gone").over(W), F.lit(False)))
    df = df.where(~F.col("blank") & ~F.col("gone"))
    df = df.select(
        id_col, "ord", "t", F.sum(F.col("begins").cast("int")).over(so_far).alias("g"),
        F.when(~F.col("begins"), F.lag("t").over(W)).alias("prev"), F.coalesce(F.lead("begins").over(W), F.lit(True)).alias("last"),
    )
    df = df.withColumn("piece", _glue(F.col("prev"), F.col("t"), F.col("last")))
    parts = F.array_sort(F.collect_list(F.struct("ord", "piece")))
    merged = df.groupBy(id_col, "g").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))
    return merged.select(id_col, (F.col("g") - 1).cast("int").alias("sent_no"), T.rstrip(F.col("text")).alias("text"))


def _glue(prev: Column, cur: Column, last: Column) -> Column:
    """What ``cur`` adds after ``prev`` (null: nothing before it)."""
    hyphen = F.endswith(prev, F.lit("-"))
    tight = cur.rlike(T.NO_SPACE_BEFORE) | prev.rlike(T.NO_SPACE_AFTER) | F.endswith(prev, F.lit(" ")) | F.startswith(cur, F.lit(" "))
    body = F.when(last, cur).otherwise(F.regexp_replace(cur, "-$", ""))
    return F.when(prev.isNull(), body).when(hyphen, T.lstrip(body)).when(tight, body).otherwise(F.concat(F.lit(" "), body))


def reflow(lines: DataFrame, *, id_col: str = "doc_id", rules: T.TextRules = T.TextRules()) -> DataFrame:
    """(id_col, sent_no, text) from (id_col, ord, text): breaks only at ends.

    Blank lines and list items end what is open, items stand alone; other lines
    are joined (no space between two CJK characters, hyphens join words) and
    cut after every end mark with its closing marks.  An end mark and a hyphen at
    a line's end part it from the next line, and the hyphen goes.
    """
    W = Window.partitionBy(id_col).orderBy("ord")
    df = lines.select(id_col, "ord", T.strip(F.col("text")).alias("t"))
    df = df.withColumn("blank", F.col("t") == "").withColumn("item", F.col("t").rlike(T.REFLOW_BULLET))
    apart = F.col("blank") | F.col("item")
    done = F.col("t").rlike(f"[{rules.reflow_ends}]{T.REFLOW_CLOSERS}*-$")
    df = df.withColumn("last", apart | F.coalesce(F.lead(apart).over(W), F.lit(True)))
    df = df.withColumn("begins", apart | F.coalesce(F.lag(apart | done).over(W), F.lit(True)))
    df = df.select(
        id_col, "ord", "t", "blank", "item", F.sum(F.col("begins").cast("int")).over(W.rowsBetween(Window.unboundedPreceding, 0)).alias("g"),
        F.when(~F.col("begins"), F.lag("t").over(W)).alias("prev"), "last",
    ).where(~F.col("blank"))
    body = F.when(F.col("last"), F.col("t")).otherwise(F.regexp_replace("t", "-$", ""))
    tight = F.endswith("prev", F.lit("-")) | (F.col("prev").rlike(f"{T.CJK}$") & F.col("t").rlike(f"^{T.CJK}"))
    df = df.withColumn("piece", F.when(F.col("prev").isNull() | tight, body).otherwise(F.concat(F.lit(" "), body)))
    parts = F.array_sort(F.collect_list(F.struct("ord", "piece")))
    df = df.groupBy(id_col, "g").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"), F.max("item").alias("item"))
    sentences = F.when(F.col("item"), F.array("text")).otherwise(T.cut_after_ends(F.col("text"), rules.reflow_ends, T.REFLOW_CLOSERS))
    df = df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("g", sentences.alias("s")))).alias("all"))
    return df.select(id_col, F.posexplode(F.flatten(F.transform("all", lambda a: a["s"]))).alias("sent_no", "text"))


def transform_files(lines: DataFrame, files: DataFrame, *, id_col: str = "file_id", rules: T.TextRules = T.TextRules()) -> DataFrame:
    """(id_col, file_name, sent_no, text): lines re-flowed, under their files'
    names ("unknown" where there is none)."""
    names = files.select(id_col, "file_name").dropDuplicates([id_col])
    out = reflow(lines, id_col=id_col, rules=rules).join(names, id_col, "left")
    return out.select(id_col, F.coalesce("file_name", F.lit("unknown")).alias("file_name"), "sent_no", "text")
