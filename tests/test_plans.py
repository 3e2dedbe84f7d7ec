"""Which columns the joins of edges are shuffled by, whatever Spark would broadcast by itself."""

import re

import pytest

from docskein.operators import properties
from docskein.sources import export


@pytest.fixture
def edge_tables(spark):
    instances = spark.createDataFrame([("a", "A"), ("b", "A"), ("x", "B"), ("x", "C")], "instance_id string, class_iri string")
    props = spark.createDataFrame([("p", "A", "B"), ("p", "A", "C"), ("q", "B", "A")], "iri string, src_class string, dest_class string")
    links = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("x", "a"), ("a", "b"), ("a", "none")], "src_id string, dest_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield links, instances, props
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return [re.sub(r"#\d+", "", x) for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan(df))]


def test_properties_are_broadcast(spark, edge_tables):
    """By their classes or names, a few values, one task would get a whole property."""
    links, instances, props = edge_tables
    found = properties.candidates_from_links(links, instances, props)
    assert sorted(map(tuple, found.collect())) == [("p", "a", "x"), ("p", "b", "x"), ("q", "x", "a")]
    # Both joins, and the distinct where the second has put the rows.
    assert {s.split(", ")[0] for s in shuffles(found)} == {"dest_id", "src_id"}
    checked = properties.validate_edges(found, instances, props)
    assert not [s for s in shuffles(checked) if s.startswith("property_iri")]


def test_unread_justifications_are_not_sorted(spark, edge_tables):
    verdicts = spark.createDataFrame([("p", "a", "x", 0, True, 0.25, "no"), ("p", "a", "x", 1, False, None, "y" * 600)], "property_iri string, src_id string, dest_id string, ord int, prohibited boolean, confidence double, justification string")
    judged = properties.join_verdicts(properties.candidates_from_links(*edge_tables), verdicts)
    assert {(r.src_id, r.prohibited, r.confidence, len(r.justification or "")) for r in judged.where("property_iri = 'p'").collect()} == {("a", False, None, 500), ("b", None, None, 0)}
    assert "SortAggregate" not in plan(judged.drop("justification"))


def test_keys_of_relationships_are_not_shuffled(spark):
    edges = spark.createDataFrame([("h#p", "a", "b"), ("h#p", "a", "b"), ("h#q", "a", "b")], "property_iri string, src_id string, dest_id string")
    table = export.relationships_table(edges)
    assert sorted((r[":TYPE"], r[":START_ID"]) for r in table.collect()) == [("p", "a"), ("q", "a")]
    assert {len(s.split(", ")) for s in shuffles(table)} == {4}  # three columns and the number of partitions


def test_nodes_are_named_once(spark):
    """Slugs and digests of instances are read by all that needs them, not made again."""
    instances = spark.createDataFrame([("a", "h#A", "x y", "f"), ("b", "h#A", "z", "f")], "instance_id string, class_iri string, label string, file_id string")
    edges = spark.createDataFrame([("h#p", "a", "b"), ("h#p", "a", "b"), ("h#p", "a", "none")], "property_iri string, src_id string, dest_id string")
    rows = export.triples(instances, edges)
    assert rows.where("section = 4").count() == 1 and rows.count() == 11
    assert "sha2" not in plan(rows)
