"""Edges: candidate space, verdicts, acceptance, validation, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_blocks(instances: DataFrame, properties: DataFrame, *, block: int = 20) -> DataFrame:
    """(property_iri, src_block, dest_block, n_pairs): the requests in which a
    model would be asked for edges.  They follow from the classes' sizes alone;
    no pair of instances is made."""
    sizes = instances.groupBy("class_iri").agg(F.count(F.lit(1)).alias("n"))
    df = (
        properties.select(F.col("iri").alias("property_iri"), "src_class", "dest_class")
        .join(sizes.select(F.col("class_iri").alias("src_class"), F.col("n").alias("ns")), "src_class")
        .join(sizes.select(F.col("class_iri").alias("dest_class"), F.col("n").alias("nd")), "dest_class")
    )
    last = lambda n: F.floor((F.col(n) - 1) / block).cast("int")
    size = lambda n, b: F.least(F.lit(block), F.col(n) - F.col(b) * block)
    # Between the two the rows are dealt out anew, so that no task makes all
    # blocks of a property.
    df = df.withColumn("src_block", F.explode(F.sequence(F.lit(0), last("ns")))).repartition("property_iri", "src_block")
    df = df.withColumn("dest_block", F.explode(F.sequence(F.lit(0), last("nd"))))
    return df.select("property_iri", "src_block", "dest_block", (size("ns", "src_block") * size("nd", "dest_block")).cast("long").alias("n_pairs"))


def candidate_ranges(instances: DataFrame, properties: DataFrame, *, block: int = 20) -> DataFrame:
    """The rows of ``candidate_blocks`` in a form that grows with the instances,
    not with their product: per property and source block (of n_src instances)
    the destination blocks 0 to last_dest_block, all of ``block`` instances but
    the last one of n_last_dest, and the pairs of them all."""
    sizes = instances.groupBy("class_iri").agg(F.count(F.lit(1)).alias("n"))
    df = (
        properties.select(F.col("iri").alias("property_iri"), "src_class", "dest_class")
        .join(sizes.select(F.col("class_iri").alias("src_class"), F.col("n").alias("ns")), "src_class")
        .join(sizes.select(F.col("class_iri").alias("dest_class"), F.col("n").alias("nd")), "dest_class")
    )
    last = lambda n: F.floor((F.col(n) - 1) / block).cast("int")
    df = df.withColumn("last_dest_block", last("nd")).withColumn("src_block", F.explode(F.sequence(F.lit(0), last("ns"))))
    df = df.withColumn("n_src", F.least(F.lit(block), F.col("ns") - F.col("src_block") * block).cast("long"))
    return df.select(
        "property_iri", "src_block", "n_src", "last_dest_block", (F.col("nd") - F.col("last_dest_block") * block).cast("long").alias("n_last_dest"), (F.col("n_src") * F.col("nd")).alias("n_pairs")
    )


def candidates_from_links(links: DataFrame, instances: DataFrame, properties: DataFrame) -> DataFrame:
    """Distinct (property_iri, src_id, dest_id) from links (src_id, dest_id)
    between instances, for every property whose classes they have.

    Links are shuffled to their ends, and made distinct where they lie: by their
    sources, of which none is as hot as a destination may be.  The properties
    are as many as the metamodel has and are broadcast: by their classes, a few
    values, a whole property would be sent to one task."""
    of = lambda side: instances.select(F.col("instance_id").alias(f"{side}_id"), F.col("class_iri").alias(f"{side}_class"))
    known = links.select("src_id", "dest_id").join(of("dest"), "dest_id").join(of("src"), "src_id")
    wanted = properties.select(F.col("iri").alias("property_iri"), "src_class", "dest_class")
    return known.join(F.broadcast(wanted), ["src_class", "dest_class"]).select("property_iri", "src_id", "dest_id").distinct()


EDGE = ["property_iri", "src_id", "dest_id"]


def join_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with prohibited, confidence and justification of their last
    verdict (greatest ``ord``); nulls where there is none.  The three are columns of
    their own, so that one which nobody reads is neither sorted nor shuffled."""
    told = {"prohibited": F.col("prohibited"), "confidence": F.col("confidence"), "justification": F.left("justification", F.lit(500))}
    last = verdicts.groupBy(*EDGE).agg(*[F.max_by(x, "ord").alias(c) for c, x in told.items()])
    return candidates.join(last, EDGE, "left").select(*candidates.columns, *told)


def accept_edges(judged: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    return judged.where(F.col("prohibited").isNotNull() & ~F.col("prohibited") & (F.col("confidence") >= threshold))


def validate_edges(edges: DataFrame, instances: DataFrame, properties: DataFrame) -> DataFrame:
    """``edges`` plus ``reason``: the first check that fails, or null."""
    of = lambda side: instances.select(F.col("instance_id").alias(f"{side}_id"), F.col("class_iri").alias(f"_{side}"))
    wanted = properties.select(F.col("iri").alias("property_iri"), F.col("src_class").alias("_want_src"), F.col("dest_class").alias("_want_dest"))
    df = edges.join(of("src"), "src_id", "left").join(of("dest"), "dest_id", "left").join(F.broadcast(wanted), "property_iri", "left")
    reason = (
        F.when(F.col("_src").isNull(), "source missing").when(F.col("_dest").isNull(), "destination missing")
        .when(F.col("_want_src").isNull(), "property undefined").when(F.col("_src") != F.col("_want_src"), "source class differs")
        .when(F.col("_dest") != F.col("_want_dest"), "destination class differs")
    )
    return df.select(*edges.columns, reason.alias("reason"))


def enrich_labels(edges: DataFrame, instances: DataFrame) -> DataFrame:
    """``edges`` plus src_label and dest_label (the id where there is none)."""
    of = lambda side: instances.select(F.col("instance_id").alias(f"{side}_id"), F.col("label").alias(f"_{side}"))
    df = edges.join(of("src"), "src_id", "left").join(of("dest"), "dest_id", "left")
    return df.select(*edges.columns, F.coalesce("_src", "src_id").alias("src_label"), F.coalesce("_dest", "dest_id").alias("dest_label"))
