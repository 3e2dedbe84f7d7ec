"""Synonyms of several blocks: links are followed once."""

from docskein.operators import requests
from docskein.plans import shop
from docskein.plans.catalog_graph import synonym_rules
from docskein.sources.stages import Stages


def test_no_link_is_followed_twice(spark, monkeypatch):
    labels = [f"part {a:02}{b:02}" for a in range(12) for b in range(9)]
    rows = spark.createDataFrame([(f"i{k:04}", "http://m#a", x, "s", "f") for k, x in enumerate(labels)], "instance_id string, class_iri string, label string, source string, file_id string")
    followed, components = [], requests.components

    def counted(edges):
        followed.extend(tuple(r) for r in edges.select("u", "v").distinct().collect())
        return components(edges)

    monkeypatch.setattr(requests, "components", counted)
    merged, members, _ = requests.merge_synonyms(rows, shop.metamodel(spark)[0], synonym_rules(-2), Stages(spark).keep, block_rows=16)
    assert {r["mention_id"]: r["instance_id"] for r in members.collect()} == {f"i{k:04}": f"i{k // 9 * 9:04}" for k in range(108)}
    assert sorted(r["label"] for r in merged.collect()) == [f"part {a:02}08" for a in range(12)]
    assert len(followed) == len(set(followed)) > 0
