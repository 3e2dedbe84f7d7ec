"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.common import materialize, release, skewed_join


def components(edges: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v longs): label is the
    smallest node of its component.

    Each round takes the least label among neighbours and then the label of
    that label, so chains shrink by at least half; rounds end when no label
    changes.  Every round is written to the shared folder, which cuts lineage,
    in as many files as the number of edges asks for, and the round before goes.  ``rows`` is a bound on
    that number, where one is known.
    """
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.where("u <> v").select(F.explode(ways).alias("e")).select("e.u", "e.v").distinct()
    both = materialize(both, f"{name}-edges", rows=None if rows is None else 2 * rows)
    n = both.count()
    # First labels: the least neighbour or itself.
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), F.lit(True).alias("changed")), name, rows=n)
    while not labels.where("changed").isEmpty():
        near = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
            .select(F.col("u").alias("node"), "m")
        )
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # A label that many nodes have is broadcast, so that its nodes stay apart.
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = materialize(labels.select(F.col("node").alias("label"), F.col("label").alias("next")).join(sizes, "label"), f"{name}-jump", rows=n)
        after = materialize(
            skewed_join(low, jump, ["label"], "n").select("node", F.least("label", "next").alias("label"), (F.least("label", "next") < F.col("old")).alias("changed")), name, rows=n
        )
        release(jump)
        release(labels)
        labels = after
    release(both)
    return labels.select("node", "label")
