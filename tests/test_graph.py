"""Classes, properties, decisions and exports on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from docskein.functions.iri import full_iri, stable_id, term
from docskein.operators import classes, joins, properties, requests
from docskein.operators.decide import LiveProvider, ReplayProvider, RuleProvider
from docskein.plans import shop
from docskein.plans.catalog import CATALOG
from docskein.sources import export
from docskein.sources.metamodel import read_metamodel, render_policies, render_rules
from docskein.sources.stages import Stages
from tests.conftest import DATA

N = "http://m#"


@pytest.fixture
def model(spark, tmp_path):
    data = {
        "classes": [
            {"iri": N + "a", "name": "a", "description": "first", "view_type": "v", "min_length": 2, "max_length": 4, "extract_rules": ["short"], "prohibit_rules": ["no names"]},
            {"iri": N + "b-c", "name": "b-c", "description": "second", "view_type": "v"},
        ],
        "properties": [{"iri": N + "p", "name": "p", "src_class": N + "a", "dest_class": N + "b-c"}],
    }
    (tmp_path / "m.json").write_text(json.dumps(data))
    return read_metamodel(spark, f"file://{tmp_path}/m.json")


@pytest.fixture
def things(spark):
    rows = [("i1", N + "a", "one", "s", "f1"), ("i2", N + "b-c", 'say "x"\n', "s", "f1"), ("i3", "", "lost", "s", "f1")]
    return spark.createDataFrame(rows, "instance_id string, class_iri string, label string, source string, file_id string")


def test_metamodel(model):
    known, props = model
    assert [r.src_class for r in props.collect()] == [N + "a"]
    assert render_policies(known).first().policies == "- a\n  - 文字数: 2～4字\n  - short"
    assert sorted(r.text for r in render_rules(known, empty="none").collect()) == ["- no names", "none"]


def test_resolve(spark, model):
    rows = spark.createDataFrame([("v", "a", "x", "s"), ("v", "zzz", "y", "s"), ("v", None, "z", "s")], "view_type string, class string, label string, source string")
    assert sorted((r.label, r.class_iri) for r in classes.resolve_classes(rows, model[0]).collect()) == [("x", N + "a"), ("y", "")]


def test_review_loop_and_providers(spark):
    rows = spark.createDataFrame([("1", N + "a", "ok"), ("2", N + "a", "far too long words"), ("3", N + "a", "x"), ("4", N + "a", "a b c d e f g h"), ("5", N + "a", "unbroken-and-long")], "instance_id string, class_iri string, label string")
    n = F.length("label")
    rules = RuleProvider({
        "judge": lambda: F.to_json(F.struct(F.when(n < 2, "REJECT").when(n > 8, "REVIEW").otherwise("ACCEPT").alias("judgment"), F.lit("size").alias("justification"))),
        "correct": lambda: F.to_json(F.struct(F.regexp_replace("label", " [^ ]*$", "").alias("revised_label"), (~F.contains(F.col("label"), F.lit(" "))).alias("should_reject"))),
    })
    got = {r.instance_id: (r.label, r.judgment, r.rounds) for r in classes.review_loop(rows, rules).collect()}
    assert got == {"1": ("ok", "ACCEPT", 0), "2": ("far too", "ACCEPT", 2), "3": ("x", "REJECT", 0), "4": ("a b c d e", "ACCEPT", 3), "5": ("unbroken-and-long", "REJECT", 1)}
    recorded = rows.limit(2).select(stable_id(F.lit("judge"), "instance_id", "class_iri", "label").alias("request_id"), F.lit('{"judgment": "ACCEPT"}').alias("payload"))
    told = classes.judge(rows, ReplayProvider(recorded))
    assert classes.accepted(told).count() == 2 and told.where("judgment = 'REJECT'").count() == 3

    def call(kind, row):
        if row["label"] == "x":
            raise ValueError(kind)
        return json.dumps({"judgment": "ACCEPT"})

    assert classes.accepted(classes.judge(rows, LiveProvider(call, retries=1, delay=0))).count() == 4


def test_positions(spark):
    rows = spark.createDataFrame([(str(i), N + "a") for i in range(50)], "instance_id string, class_iri string")
    numbered = classes.number_in_blocks(rows, block_rows=8)
    sizes = numbered.groupBy("class_iri", "block").agg(F.count("*").alias("n"), F.max("pos").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in sizes) and len(sizes) > 3
    lists = numbered.groupBy("class_iri", "block").agg(F.sequence(F.lit(1), F.count("*") - 1).alias("items"))
    lists = lists.where(F.size("items") > 1)
    assert classes.join_by_position(numbered, lists).count() == sum(r.n - 1 for r in sizes if r.n > 2)


def test_consolidate(spark):
    rows = spark.createDataFrame([("1", "c", "Ab", "s1", "f", 1), ("2", "c", "ab ", "s2", "f", 2), ("3", "c", "ab", "s2", "g", 3), ("4", "d", "ab", "s", "f", 4), ("5", "c", None, "s", "f", 5)],
                                 "instance_id string, class_iri string, label string, source string, file_id string, ord int")
    merged, members = classes.consolidate(rows, F.lower(F.trim("label")))
    assert sorted((r.instance_id, r.label or "", r.n_sources, r.n_files) for r in merged.collect()) == [("1", "Ab", 2, 2), ("4", "ab", 1, 1), ("5", "", 1, 1)]
    assert sorted((r.mention_id, r.instance_id) for r in members.collect()) == [("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("5", "5")]


def test_edges(spark, model, things):
    pairs = spark.createDataFrame([("i1", "i2"), ("i1", "i2"), ("i2", "i1"), ("i1", "gone")], "src_id string, dest_id string")
    candidates = properties.candidates_from_links(pairs, things, model[1])
    assert [tuple(r) for r in candidates.collect()] == [(N + "p", "i1", "i2")]
    verdicts = spark.createDataFrame([(N + "p", "i1", "i2", 0, True, 0.9, "no"), (N + "p", "i1", "i2", 1, False, 0.5, "yes")], "property_iri string, src_id string, dest_id string, ord int, prohibited boolean, confidence double, justification string")
    judged = properties.join_verdicts(candidates, verdicts)
    assert properties.accept_edges(judged).count() == 1 and properties.accept_edges(judged, threshold=0.51).count() == 0
    assert properties.accept_edges(properties.join_verdicts(candidates, verdicts.limit(0))).count() == 0
    edges = spark.createDataFrame([(N + "p", "x", "i2"), (N + "p", "i1", "x"), (N + "q", "i1", "i2"), (N + "p", "i2", "i2"), (N + "p", "i1", "i1"), (N + "p", "i1", "i2")], "property_iri string, src_id string, dest_id string")
    reasons = {(r.property_iri, r.src_id, r.dest_id): r.reason for r in properties.validate_edges(edges, things, model[1]).collect()}
    assert list(map(reasons.get, map(tuple, edges.collect()))) == ["source missing", "destination missing", "property undefined", "source class differs", "destination class differs", None]


def test_exports(spark, model, things, tmp_path):
    edges = spark.createDataFrame([(N + "p", "i1", "i2"), (N + "p", "i1", "i2"), (N + "p", "i1", "i9")], "property_iri string, src_id string, dest_id string")
    nodes, links = export.nodes_table(things), export.relationships_table(edges)
    assert sorted(tuple(r)[:3] for r in nodes.collect()) == [("i1", N + "a", "a"), ("i2", N + "b-c", "b_c")]
    assert links.count() == 2
    export.write_csv(nodes, f"file://{tmp_path}/n", one_file=True)
    text = next((tmp_path / "n").glob("*.csv")).read_text()
    assert text == f'id:ID,iri,:LABEL,label,file_id\ni1,{N}a,a,one,f1\ni2,{N}b-c,b_c,"say ""x""\n",f1\n'
    rows = export.triples(things, edges)
    got = rows.collect()
    assert {r.section for r in got} == {1, 2, 3, 4}
    declared = {r.subject for r in got if r.predicate == "rdf:type"}
    met = [r for r in got if r.predicate == f"<{N}p>"]
    assert len(met) == 1 and {met[0].subject, met[0].object} <= declared
    assert '"say \\"x\\"\\n"@ja' in {r.object for r in got}
    export.write_turtle(rows, f"file://{tmp_path}/t", one_file=True)
    text = next((tmp_path / "t").glob("*.txt")).read_text()
    head, _, body = text.partition("ex: a owl:Ontology .\n")
    assert head.count("@prefix") == 5 and "@prefix ex: <http://example.org/graph#> ." in head
    blocks = [b for b in body.strip().split(" .\n")]
    assert len(blocks) == 2 + 1 + 2 + 1 and blocks[0] == f"<{N}a> a owl:Class" and blocks[2] == f"<{N}p> a owl:ObjectProperty"
    assert blocks[3].startswith("<http://example.org/graph#instance/one-") and f' a <{N}a> ;\n    ex:classInstanceId "i1" ;\n    ex:fileId "f1" ;\n    rdfs:label "one"@ja' in blocks[3]
    export.write_turtle(rows, f"file://{tmp_path}/parts")
    lines_ = [x for f in (tmp_path / "parts").glob("*.txt") for x in f.read_text().splitlines()]
    assert len(lines_) == len(got) and all(x.endswith(" .") and x.startswith("<") for x in lines_)
    assert [tuple(r) for r in export.run_summary(things, edges.distinct()).collect()] == [(3, 2)]


def test_ranges_are_the_blocks(spark):
    sizes = {"a": 41, "b": 20, "c": 1, "d": 67}
    instances = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "class_iri string")
    props = spark.createDataFrame([("p", "a", "b"), ("q", "b", "d"), ("r", "c", "c"), ("s", "d", "a"), ("t", "a", "none")], "iri string, src_class string, dest_class string")
    blocks = sorted(tuple(r) for r in properties.candidate_blocks(instances, props).collect())
    made = []
    for r in properties.candidate_ranges(instances, props).collect():
        told = [(r.property_iri, r.src_block, k, r.n_src * (20 if k < r.last_dest_block else r.n_last_dest)) for k in range(r.last_dest_block + 1)]
        assert sum(n for *_, n in told) == r.n_pairs
        made += told
    assert sorted(made) == blocks


def test_every_property_has_its_blocks(spark):
    told = CATALOG["property_block_ranges"][0](spark, f"{DATA}/sf0.001")
    assert {r.property_iri for r in told.select("property_iri").distinct().collect()} == {p["iri"] for p in shop.PROPERTIES}


def test_iris(spark):
    df = spark.createDataFrame([(x,) for x in ("ex:a", "ex:a:b", "http://h/a b>", "rdf:type", "urn:x")], "i string")
    made = [r.t for r in df.select(term(F.col("i")).alias("t")).collect()]
    assert made == ["ex:a", "<ex:a:b>", "<http://h/a%20b%3E>", "rdf:type", "<urn:x>"]
    full = [r.t for r in df.select(full_iri(F.col("i"), {"ex": "http://e#"}).alias("t")).collect()]
    assert full[:2] == ["<http://e#a>", "<http://e#a:b>"] and full[4] == "urn:x"


def test_null_classes_stay(spark):
    rows = spark.createDataFrame([("1", None, "a", "s", "f", 1), ("2", None, "a", "s", "f", 2)], "instance_id string, class_iri string, label string, source string, file_id string, ord int")
    merged, members = classes.consolidate(rows, F.col("label"))
    assert [tuple(r)[:2] for r in merged.collect()] == [("1", "")] and members.count() == 2


def synonyms(spark, rows, groups, **options):
    """(instances, members, requests) with a provider of ``groups``: a function of the
    labels of a request."""
    known, _ = shop.metamodel(spark)
    asked = []

    class Provider:
        def attach(self, kind, requests, keys, where=None):
            told = [(r["class_iri"], r["block"], json.dumps({"groups": groups([x["label"] for x in r["items"]])})) for r in requests.collect()]
            asked.extend(r["prompt"] for r in requests.collect())
            answers = spark.createDataFrame(told, "class_iri string, block string, payload string")
            return requests.join(answers, ["class_iri", "block"])

    merged, members, errors = requests.merge_synonyms(rows, known, Provider(), Stages(spark).keep, **options)
    assert errors.count() == 0
    return merged.collect(), {r.mention_id: r.instance_id for r in members.collect()}, asked


ROW = "instance_id string, class_iri string, label string, source string, file_id string"


def test_synonym_groups(spark):
    rows = spark.createDataFrame([(f"i{k}", N + "a", x, "s", f"f{k}") for k, x in enumerate(["aa", "bb", "cc", "dd"])] + [("j", N + "b", "alone", "s", "f")], ROW)
    merged, members, asked = synonyms(spark, rows, lambda labels: [{"indices": [1, 3, 9, -1], "canonical_label": "invented"}, {"indices": [3, 0], "canonical_label": "aa"}])
    assert len(asked) == 1
    assert sorted((r.instance_id, r.label, r.n_files) for r in merged) == [("i0", "aa", 1), ("i1", "bb", 2), ("i2", "cc", 1), ("j", "alone", 1)]
    assert members == {"i0": "i0", "i1": "i1", "i2": "i2", "i3": "i1", "j": "j"}
    known, _ = shop.metamodel(spark)
    broken, _, errors = requests.merge_synonyms(rows, known, RuleProvider({"synonyms": lambda: F.lit("no json")}), Stages(spark).keep)
    assert broken.count() == 5 and [r.message for r in errors.collect()] == ["unreadable answer"]


def test_equal_labels_are_one_item(spark):
    rows = spark.range(1000).select(F.concat(F.lit("i"), F.lpad("id", 4, "0")).alias("instance_id"), F.lit("c").alias("class_iri"), F.when(F.col("id") < 700, F.when(F.col("id") % 2 == 0, "Hot").otherwise("hot ")).otherwise(F.col("id").cast("string")).alias("label"), F.lit("s").alias("source"), F.lit("f").alias("file_id"))
    seen = []
    merged, members, _ = synonyms(spark, rows, lambda labels: seen.append(labels) or [], block_rows=50)
    assert len({x for labels in seen for x in labels}) == 301 and max(map(len, seen)) <= 50
    assert len(merged) == 301 and len(members) == 1000 and next(r for r in merged if r.instance_id == "i0000").label == "Hot"


def test_synonyms_of_different_blocks(spark):
    """The same groups for any size of block: labels of a group are neighbours in
    some order, or their groups' heads are."""
    labels = [f"unit {a:02} part {b:03}" for a in range(30) for b in range(9)] + [f"part {b:03} spare {a:02}" for a in range(9, 40) for b in range(3)]
    rows = spark.createDataFrame([(f"i{k:04}", N + "a", x, "s", f"f{k}") for k, x in enumerate(labels)], ROW)
    first = lambda x: x.split(" ")[0] + (x.split(" ")[1] if x[0] == "u" else x.split(" ")[3])

    def groups(own):
        keys = dict.fromkeys(map(first, own))
        return [{"indices": [i for i, x in enumerate(own) if first(x) == k], "canonical_label": max(x for x in own if first(x) == k)} for k in keys]

    want = {}
    for k, x in enumerate(labels):
        want.setdefault(first(x), []).append((f"i{k:04}", x))
    for size in (16, 64, 1000):
        merged, members, asked = synonyms(spark, rows, groups, block_rows=size)
        assert sorted((r.instance_id, r.label, r.n_files) for r in merged) == sorted((min(g)[0], max(x for _, x in g), len(g)) for g in want.values()), size
        assert members == {i: min(g)[0] for g in want.values() for i, _ in g}
        assert len(asked) == 1 or size < 1000


def test_rules_reach_the_synonym_prompt(spark):
    known, _ = shop.metamodel(spark)
    with_rules = known.withColumn("extract_rules", F.array(F.lit("only real parts")))
    _, items = requests.label_items(spark.createDataFrame([(f"i{k}", known.first()["iri"], x, "s", "f") for k, x in enumerate("ab")], ROW))
    seen = []

    class Provider:
        def attach(self, kind, df, keys, where=None):
            seen.append(df.first()["prompt"])
            return df.withColumn("payload", F.lit("{}"))

    requests.ask_synonyms(items, with_rules, Provider())
    assert "- only real parts" in seen[0]


def test_ranks_components_and_hot_joins(spark, monkeypatch):
    monkeypatch.setattr(joins, "RANGE_ROWS", 40)
    df = spark.createDataFrame([("g" if k % 3 else "h", k * 7 % 101, k) for k in range(300)], "g string, a int, b int").repartition(5)
    got = {r["b"]: r["rank"] for r in joins.ranked(df, ["g"], ["a", "b"]).collect()}
    for g in ("g", "h"):
        own = sorted((k * 7 % 101, k) for k in range(300) if ("g" if k % 3 else "h") == g)
        assert [got[k] for _, k in own] == list(range(len(own)))
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    told = {r["node"]: r["root"] for r in joins.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert told == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}
    rows = spark.createDataFrame([("hot", k) for k in range(500)] + [(str(k), k) for k in range(300)] + [(None, 1), ("none", 2)], "k string, n int")
    small = spark.createDataFrame([("hot", 1)] + [(str(k), k) for k in range(0, 300, 2)], "k string, v int")
    for support in (0.3, 1e-4):
        monkeypatch.setattr(joins, "SUPPORT", support)
        for how in ("left", "inner"):
            assert sorted(joins.hot_join(rows, small, "k", how).collect(), key=str) == sorted(rows.join(small, "k", how).collect(), key=str)


def test_cells_of_the_candidate_space(spark, monkeypatch):
    """Every pair of blocks once, whatever the size of cells."""
    known, props = shop.metamodel(spark)
    p = props.first()
    rows = spark.createDataFrame([(f"{c[-1]}{k}", c, "x", "f") for c in {p["src_class"], p["dest_class"]} for k in range(90)], "instance_id string, class_iri string, label string, file_id string")
    told = []
    for cell in (64, 3):
        monkeypatch.setattr(requests, "CELL", cell)
        made = requests.candidate_requests(rows, props.where(F.col("iri") == p["iri"]), block=5)
        told.append(sorted(tuple(r) for r in made.select("src_block", "dest_block", F.size("src_items"), F.size("dest_items")).collect()))
    assert told[0] == told[1] and sum(a * b for *_, a, b in told[0]) == 90 * 90 and len({x[:2] for x in told[0]}) == len(told[0])


def test_upsert_of_versions(spark, tmp_path):
    rows = [("a", 2, "new", False), ("a", 1, "old", True), ("b", 1, "x", False), ("b", 3, "gone", True), ("b", 2, "y", False), ("c", 1, "p", None), ("c", 1, "q", False), ("d", None, "none", False), (None, 1, "z", False)]
    df = spark.createDataFrame(rows, "instance_id string, version int, label string, gone boolean")
    for part in (df, df.orderBy(F.rand(1)).repartition(4)):
        got = export.upsert_nodes(part, order="version", deleted="gone")
        assert got.columns == ["instance_id", "version", "label"]
        assert sorted((r.instance_id, r.label) for r in got.collect()) == [("a", "new"), ("c", "q"), ("d", "none")]
    for run, label in (("r2", "later"), ("r1", "earlier")):
        Stages(spark, f"file://{tmp_path}", run).keep("instances", spark.createDataFrame([("a", label), (run, label)], "instance_id string, label string"))
    got = export.upsert_nodes(export.runs_of(spark, f"file://{tmp_path}", "instances"), order="run")
    assert sorted((r.instance_id, r.label) for r in got.collect()) == [("a", "later"), ("r1", "earlier"), ("r2", "later")]


def test_causes_and_kinds_of_errors(spark, tmp_path):
    """Transient errors are tried again, the program's own are told at once."""
    log = str(tmp_path / "calls")

    def call(kind, row):
        with open(log, "a") as f:
            f.write(row["k"] + "\n")
        raise TimeoutError("late") if row["k"] == "net" else KeyError(row["k"])

    df = LiveProvider(call, retries=2, delay=0, attempts=2).attach("x", spark.createDataFrame([("net",), ("bug",)], "k string"), ["k"])
    told = Stages(spark).keep("told", df)
    assert sorted((r["k"], r["payload"], r["cause"]) for r in told.collect()) == [("bug", None, "KeyError: 'bug'"), ("net", None, "TimeoutError: late")]
    assert sorted(open(log).read().split()) == ["bug"] + ["net"] * 6
    said = requests.unanswered(told, "s", "a int")
    assert sorted(r["message"] for r in said.collect()) == ["no answer: KeyError: 'bug'", "no answer: TimeoutError: late"]
