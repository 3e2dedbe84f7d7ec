"""A graph over the relational test tables: metamodel, instances, links and rules.

Foreign keys give exact links, so that class and property operators run at any
scale without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.operators.decide import RuleProvider
from docskein.sources.metamodel import metamodel_frames

NS = "http://example.org/shop#"


def _class(name: str, view: str, low: int, high: int, rules: list[str]) -> dict:
    return {"iri": NS + name, "name": name, "description": f"a {name} of the shop", "view_type": view, "min_length": low, "max_length": high, "extract_rules": rules, "prohibit_rules": []}


CLASSES = [
    _class("region", "business_concept", 2, 10, ["use the region's own name"]),
    _class("nation", "business_concept", 2, 30, []),
    _class("customer", "value_analysis", 5, 18, ["no personal names", "one label per customer"]),
    _class("supplier", "value_analysis", 5, 30, ["one label per supplier"]),
    _class("part-type", "system_component", 3, 12, ["name the type, not the size"]),
    _class("order", "data_analysis", 1, 20, []),
]


def _property(name: str, src: str, dest: str) -> dict:
    return {"iri": NS + name, "name": name, "description": f"{src} to {dest}", "src_class": NS + src, "dest_class": NS + dest, "prohibit_rules": []}


PROPERTIES = [
    _property("inRegion", "nation", "region"), _property("customerIn", "customer", "nation"), _property("supplierIn", "supplier", "nation"),
    _property("placedBy", "order", "customer"), _property("suppliedBy", "part-type", "supplier"),
]


def metamodel(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return metamodel_frames(spark, CLASSES, PROPERTIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(name: str, column: str) -> Column:
    return F.concat(F.lit(f"{name}:"), F.col(column).cast("string"))


#: class, table, key, label, source: how a table's rows become mentions.
MENTIONS = [
    ("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"),
    ("supplier", "supplier", "s_suppkey", "s_name"), ("part-type", "part", "p_partkey", "concat(p_name, ' ', p_type)"), ("order", "orders", "o_orderkey", "o_orderpriority"),
]


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance_id, class_iri, label, source, file_id."""
    out = None
    for name, tab, k, label in MENTIONS:
        df = table(spark, sf_dir, tab).select(
            key(name, k).alias("instance_id"), F.lit(NS + name).alias("class_iri"), F.expr(label).alias("label"), F.lit(tab).alias("source"), F.lit(f"{tab}.parquet").alias("file_id")
        )
        out = df if out is None else out.unionByName(df)
    return out


INSTANCES_SQL = "instances AS (" + " UNION ALL ".join(
    f"SELECT '{n}:' || {k} AS instance_id, '{NS}{n}' AS class_iri, {label} AS label, '{t}' AS source, '{t}.parquet' AS file_id FROM {t}" for n, t, k, label in MENTIONS
) + ")"

#: source class, its key, destination class, its key, table.
LINKS = [
    ("nation", "n_nationkey", "region", "n_regionkey", "nation"), ("customer", "c_custkey", "nation", "c_nationkey", "customer"),
    ("supplier", "s_suppkey", "nation", "s_nationkey", "supplier"), ("order", "o_orderkey", "customer", "o_custkey", "orders"),
    ("part-type", "l_partkey", "supplier", "l_suppkey", "lineitem"),
]


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_id, dest_id.  The line items' pairs, which repeat, are made distinct on their
    keys, before anything is joined; the other tables have a row per source, and
    what repeats there goes with the candidates' own distinct."""
    out = None
    for src, a, dest, b, tab in LINKS:
        pairs = table(spark, sf_dir, tab).select(a, b)
        df = (pairs.distinct() if tab == "lineitem" else pairs).select(key(src, a).alias("src_id"), key(dest, b).alias("dest_id"))
        out = df if out is None else out.unionByName(df)
    return out


LINKS_SQL = "links AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{s}:' || {a} AS src_id, '{d}:' || {b} AS dest_id FROM {t}" for s, a, d, b, t in LINKS) + ")"
PROPERTIES_SQL = "props AS (SELECT * FROM (VALUES " + ", ".join(f"('{p['iri']}', '{p['src_class']}', '{p['dest_class']}')" for p in PROPERTIES) + ") t(property_iri, src_class, dest_class))"
CANDIDATES_SQL = """candidates AS (
  SELECT DISTINCT p.property_iri, l.src_id, l.dest_id FROM links l
  JOIN instances s ON s.instance_id = l.src_id JOIN instances d ON d.instance_id = l.dest_id
  JOIN props p ON p.src_class = s.class_iri AND p.dest_class = d.class_iri)"""

#: Rule verdicts: (source class, destination class, SQL of prohibited, of confidence, table), and an
#: earlier verdict of less confidence for customers whose key ends in 0.  Customers with key mod 7 = 3 get none.
VERDICTS = [
    (*LINKS[0], "false", "1.0", "true", 1), (*LINKS[1], "false", "CASE WHEN c_acctbal < 0 THEN 0.25 ELSE 0.75 END", "c_custkey % 7 <> 3", 1),
    (*LINKS[1], "true", "0.125", "c_custkey % 10 = 0 AND c_custkey % 7 <> 3", 0), (*LINKS[2], "false", "CASE WHEN s_acctbal < 0 THEN 0.375 ELSE 0.875 END", "true", 1),
    (*LINKS[3], "o_orderstatus = 'P'", "0.5", "true", 1), (*LINKS[4], "false", "0.625", "l_linenumber = 1", 1),
]
_IRI_OF = {(p["src_class"], p["dest_class"]): p["iri"] for p in PROPERTIES}


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """property_iri, src_id, dest_id, ord, prohibited, confidence, justification."""
    out = None
    for src, a, dest, b, tab, prohibited, confidence, where, order in VERDICTS:
        df = table(spark, sf_dir, tab).where(where).select(
            F.lit(_IRI_OF[NS + src, NS + dest]).alias("property_iri"), key(src, a).alias("src_id"), key(dest, b).alias("dest_id"), F.lit(order).alias("ord"),
            F.expr(prohibited).alias("prohibited"), F.expr(confidence).cast("double").alias("confidence"), F.lit("rule").alias("justification"),
        )
        out = df if out is None else out.unionByName(df)
    return out


VERDICTS_SQL = "verdicts AS (" + " UNION ALL ".join(
    f"SELECT '{_IRI_OF[NS + s, NS + d]}' AS property_iri, '{s}:' || {a} AS src_id, '{d}:' || {b} AS dest_id, {o} AS ord, {p} AS prohibited, ({c})::DOUBLE AS confidence FROM {t} WHERE {w}"
    for s, a, d, b, t, p, c, w, o in VERDICTS
) + ")"
ACCEPTED_SQL = """last AS (
  SELECT property_iri, src_id, dest_id, arg_max(prohibited, ord) AS prohibited, arg_max(confidence, ord) AS confidence
  FROM verdicts GROUP BY ALL),
edges AS (
  SELECT c.property_iri, c.src_id, c.dest_id, v.confidence FROM candidates c JOIN last v USING (property_iri, src_id, dest_id)
  WHERE NOT v.prohibited AND v.confidence >= 0.5)"""
GRAPH_SQL = f"{INSTANCES_SQL}, {LINKS_SQL}, {PROPERTIES_SQL}, {CANDIDATES_SQL}, {VERDICTS_SQL}, {ACCEPTED_SQL}"


def _limits(which: str) -> Column:
    out = F.lit(None).cast("int")
    for c in CLASSES:
        out = F.when(F.col("class_iri") == c["iri"], c[which]).otherwise(out)
    return out


def rules() -> RuleProvider:
    """Labels too short are rejected, too long ones reviewed; a correction drops
    the last word, and rejects a label of one word."""
    n = F.length("label")
    verdict = F.when(n < _limits("min_length"), "REJECT").when(n > _limits("max_length"), "REVIEW").otherwise("ACCEPT")
    shorter = F.regexp_replace("label", " [^ ]*$", "")
    return RuleProvider({
        "judge": lambda: F.to_json(F.struct(verdict.alias("judgment"), F.lit("length").alias("justification"))),
        "correct": lambda: F.to_json(F.struct(shorter.alias("revised_label"), (~F.contains(F.col("label"), F.lit(" "))).alias("should_reject"), F.lit("shorter").alias("revision_reason"))),
    })
