"""Joins, ranks and components for tables in which one key may have a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.sources.stages import Stages

RANGE_ROWS = 100_000
SUPPORT = 1e-4


def hot_join(rows: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``small`` (unique ``key``); ``how`` is inner or left.

    A frequent-items sketch finds, in one pass of the keys, all that more than
    SUPPORT of the rows have (fewer than 2 / SUPPORT keys, a bound that holds for any
    data).  Their rows of ``small`` are broadcast; the other rows are shuffled to
    their keys, so no task meets more than that share of a key.  Null keys meet
    nothing.  The plan does not depend on adaptive execution."""
    often = rows.select(F.col(key).alias("k")).where("k IS NOT NULL").freqItems(["k"], SUPPORT).select(F.explode("k_freqItems").alias(key)).distinct()
    fields = [c for c in small.columns if c != key]
    packed = lambda df, name: df.select(key, F.struct(F.lit(True).alias("there"), *fields).alias(name))
    hot = small.join(F.broadcast(often), key, "left_semi")
    marked = rows.join(F.broadcast(packed(hot, "_hot")), key, "left")
    unpack = lambda df, name: df.select(*rows.columns, *[F.col(name).getField(c).alias(c) for c in fields])
    others = marked.where("_hot IS NULL").drop("_hot").join(packed(small, "_rest"), key, how)
    return unpack(marked.where("_hot IS NOT NULL"), "_hot").unionByName(unpack(others, "_rest"))


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` plus its row's place (from 0) in its group, by ``order`` (which tells
    all rows apart).  Rows are sorted into ranges of bounded size, which are written
    down; a range numbers its own rows, and the ranges' and groups' counts (a row
    each) are added up: no task holds a group."""
    stages = Stages(df.sparkSession)
    keys = [*groups, *order]
    n = max(1, -(-df.count() // RANGE_ROWS))
    ranged = stages.keep("ranges", df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    counts = stages.keep("range-counts", ranged.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n")))
    # Of a group that reaches over ranges, what the ranges before hold.
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    here = F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order)) - 1
    out = ranged.withColumn("_here", here).join(begin.drop("_n"), ["_part", *groups])
    return out.select(*df.columns, (F.col("_here") + F.col("_begin")).cast("long").alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (u, v): the least node of its component.

    Each round takes the least root among a node's neighbours, then that root's
    root; rounds are written down, and end when no root changes."""
    stages = Stages(edges.sparkSession)
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = stages.keep("edges", edges.where("u <> v").select(F.explode(ways).alias("e")).select("e.u", "e.v").distinct())
    roots = stages.keep("roots-0", both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"), F.lit(True).alias("moved")))
    k = 0
    while not roots.where("moved").isEmpty():
        k += 1
        own = roots.select(F.col("node").alias("v"), "root")
        near = hot_join(both, own, "v", "inner").groupBy("u").agg(F.min("root").alias("m")).withColumnRenamed("u", "node")
        low = stages.keep(f"low-{k}", roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("low")))
        after = hot_join(low, roots.select(F.col("node").alias("low"), F.col("root").alias("next")), "low", "inner")
        roots = stages.keep(f"roots-{k}", after.select("node", F.least("low", "next").alias("root"), (F.least("low", "next") < F.col("old")).alias("moved")))
    return roots.select("node", "root")
