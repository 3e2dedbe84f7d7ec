"""Class instances: resolving, judging, the review loop, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.sources.stages import Stages

SMALL_TABLE = 100_000  # rows of a few short columns: at most some 20 MB in a task
ACCEPT, REVIEW, REJECT = "ACCEPT", "REVIEW", "REJECT"
JUDGMENT = "judgment string, justification string"
CORRECTION = "revised_label string, should_reject boolean, revision_reason string"


def resolve_classes(mentions: DataFrame, classes: DataFrame) -> DataFrame:
    """``mentions`` (view_type, class, ...) plus class_iri: the first class of
    that name in the view, else the empty string.  Mentions that lack a class,
    label or source go.  The metamodel is small and Spark may broadcast it by
    its own size limit."""
    first = classes.groupBy("view_type", F.col("name").alias("class")).agg(F.min_by("iri", "ord").alias("iri"))
    whole = mentions.where(F.col("class").isNotNull() & F.col("label").isNotNull() & F.col("source").isNotNull())
    return whole.join(first, ["view_type", "class"], "left").withColumn("class_iri", F.coalesce("iri", F.lit(""))).drop("iri")


def class_names(rows: DataFrame, classes: DataFrame, *, iri_col: str = "class_iri") -> DataFrame:
    """``rows`` plus class_name: the metamodel's, else what follows ``#``."""
    names = classes.groupBy(F.col("iri").alias(iri_col)).agg(F.min_by("name", "ord").alias("class_name"))
    return rows.join(names, iri_col, "left").withColumn("class_name", F.coalesce("class_name", F.substring_index(iri_col, "#", -1)))


def join_sizes(rows: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of ``sizes``, a count per ``keys``.  Counts per class
    or property are as many as the metamodel has: they are counted and broadcast, so
    that no class is sent to one task to learn a number.  More keys than
    SMALL_TABLE (those with a file in them) are shuffled to."""
    sizes = Stages(rows.sparkSession).keep("sizes", sizes)
    few = sizes.count() <= SMALL_TABLE
    return rows.join(F.broadcast(sizes) if few else sizes, list(keys))


def number_in_blocks(instances: DataFrame, *, block_rows: int = 1000, groups: tuple[str, ...] = ("class_iri",)) -> DataFrame:
    """``instances`` plus block and pos: places for decisions that come as lists.

    A group (by default a class) of any size is cut into blocks of about
    ``block_rows`` by a digest of the instance's id, so no window ever holds a
    whole group."""
    sizes = instances.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    digest = F.conv(F.left(F.md5(F.col("instance_id").cast("binary")), F.lit(8)), 16, 10).cast("long")
    df = join_sizes(instances, sizes, *groups).withColumn("block", F.pmod(digest, F.col("blocks")).cast("int")).drop("blocks")
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*groups, "block").orderBy("instance_id")) - 1)


def join_by_position(numbered: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows meet the element of their block's list at their place; rows beyond
    the end of the list go, as do elements beyond the rows."""
    each = decisions.select("class_iri", "block", F.posexplode("items").alias("pos", "item"))
    return numbered.join(each, ["class_iri", "block", "pos"]).select(numbered["*"], "item")


def judge(instances: DataFrame, provider, where: Column | None = None) -> DataFrame:
    """``instances`` with judgment and justification; where the provider says
    nothing (or no JSON) the judgment is REJECT.  With ``where`` only those
    rows are judged, the others keep theirs."""
    df = provider.attach("judge", instances, ["instance_id", "class_iri", "label"], where)
    told = F.from_json("payload", JUDGMENT)
    new = F.coalesce(told["judgment"], F.lit(REJECT))
    why = F.left(told["justification"], F.lit(500))
    if where is not None:
        new, why = F.when(where, new).otherwise(F.col("judgment")), F.when(where, why).otherwise(F.col("justification"))
    return df.withColumns({"judgment": new, "justification": why}).drop("payload", "cause")


def correct(instances: DataFrame, provider, round_no: int) -> DataFrame:
    """REVIEW rows get a new label, or REJECT; without a usable answer they are
    rejected, with an empty label they stay as they are."""
    review = F.col("judgment") == REVIEW
    df = provider.attach("correct", instances, ["instance_id", "class_iri", "label"], review)
    told = F.from_json("payload", CORRECTION)
    label = F.coalesce(told["revised_label"], F.lit(""))
    bad = review & (F.col("payload").isNull() | told.isNull() | F.coalesce(told["should_reject"], F.lit(False)))
    return df.withColumns({
        "label": F.when(review & ~bad & (label != ""), label).otherwise(F.col("label")),
        "judgment": F.when(bad, REJECT).otherwise(F.col("judgment")),
        "rounds": F.when(review, F.lit(round_no)).otherwise(F.col("rounds")),
    }).drop("payload", "cause")


def review_loop(instances: DataFrame, provider, *, rounds: int = 3) -> DataFrame:
    """Judged instances (plus ``rounds``, how often each was corrected).

    At most ``rounds`` corrections, each followed by a judgment of the REVIEW
    rows only; a rejection stays.  What is still REVIEW in the end is accepted
    with a note.  The rounds are one lazy plan of row expressions."""
    df = judge(instances, provider).withColumn("rounds", F.lit(0))
    for k in range(1, rounds + 1):
        df = judge(correct(df, provider, k), provider, F.col("judgment") == REVIEW)
    left = F.col("judgment") == REVIEW
    note = F.concat(F.lit(f"Accepted after {rounds} reviews. "), F.coalesce("justification", F.lit("")))
    return df.withColumns({"justification": F.when(left, note).otherwise(F.col("justification")), "judgment": F.when(left, ACCEPT).otherwise(F.col("judgment"))})


def three_way(judged: DataFrame) -> DataFrame:
    """``judged`` plus ``section``: 0 for accepted rows, 1 for rows under review, 2
    for rejected ones (no judgment is a rejection).  Sections in their order, and
    rows in theirs, give the union of the three."""
    section = F.when(F.col("judgment") == ACCEPT, 0).when(F.col("judgment") == REVIEW, 1).otherwise(2)
    return judged.withColumn("section", section)


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.coalesce("judgment", F.lit(REJECT)) != REJECT)


def consolidate(mentions: DataFrame, group: Column, *, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(instances, members).

    Mentions (instance_id, class_iri, label, source, file_id) of one class with
    the same ``group`` value become one instance, with id and label of the
    first; a null group stands alone.  ``instances`` has counts of distinct
    sources and files; ``members`` (instance_id, mention_id, source, file_id)
    holds the lists themselves, so that no row grows with a group.  A null class
    is the empty one: its mentions stay, and exports leave them out."""
    mentions = mentions.withColumn("class_iri", F.coalesce("class_iri", F.lit("")))
    key = F.coalesce(group.cast("string"), F.concat(F.lit("\x02"), F.col("instance_id")))
    df = mentions.withColumn("_g", key)
    firsts = df.groupBy("class_iri", "_g").agg(
        F.min_by("instance_id", F.struct(order, "instance_id")).alias("first_id"), F.min_by("label", F.struct(order, "instance_id")).alias("first_label")
    )
    counts = [
        df.select("class_iri", "_g", c).distinct().groupBy("class_iri", "_g").agg(F.count(c).alias(n)) for c, n in (("source", "n_sources"), ("file_id", "n_files"))
    ]
    out = firsts.join(counts[0], ["class_iri", "_g"]).join(counts[1], ["class_iri", "_g"])
    members = df.join(firsts, ["class_iri", "_g"]).select(F.col("first_id").alias("instance_id"), F.col("instance_id").alias("mention_id"), "source", "file_id")
    return out.select(F.col("first_id").alias("instance_id"), "class_iri", F.col("first_label").alias("label"), "n_sources", "n_files"), members
