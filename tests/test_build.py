import json
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from docskein import __main__ as job
from docskein.operators import chunks
from docskein.operators.decide import LiveProvider
from docskein.plans import chains
from docskein.plans.build import build_graph
from docskein.plans.catalog import RULES, VIEW_PATTERNS
from docskein.sources import pages as P
from docskein.sources.metamodel import metamodel_frames
from docskein.sources.stages import Stages, latest, log_stage
from docskein.streaming import text as stream
from tests.conftest import DATA, ROOT

N = "http://m#"
CLASSES = [
    {"iri": N + "payer", "name": "payer", "description": "who pays", "view_type": "value_analysis", "prohibit_rules": ["no firms"]},
    {"iri": N + "payee", "name": "payee", "view_type": "data_analysis"},
]
PROPERTIES = [{"iri": N + "pays", "name": "pays", "src_class": N + "payer", "dest_class": N + "payee"}]
#: Requests in the order in which they were made: kind, first line of what was asked.
ASKED = "asked.txt"


def answer(folder):
    """A model that writes down what it is asked: payers stand in one view and
    payees in another; Zed's judgment is wanted twice, broken answers come once."""

    def call(kind, row):
        with open(os.path.join(folder, ASKED), "a") as f:
            f.write(json.dumps([kind, row["prompt"]]) + "\n")
        if kind == "file_type":
            return json.dumps({"is_presentation": "slide" in row["text"]})
        if kind == "views":
            lines = [s for s in row["text"].replace("! ", ". ").split(". ") if "pays" in s]
            return "no json" if "broken" in row["text"] else json.dumps({"value_analysis": lines, "data_analysis": lines})
        if kind == "mentions":
            at, name = (0, "payer") if row["view_type"] == "value_analysis" else (2, "payee")
            return json.dumps([{"class": name if "Zed" not in s else "debtor", "label": s.split()[at].strip(".!"), "source": s} for s in row["text"].split("\n")])
        if kind == "judge":
            return json.dumps({"judgments": [{"judgment": "REVIEW" if x["label"].islower() else "ACCEPT", "justification": "case"} for x in row["items"]]})
        if kind == "correct":
            return json.dumps({"corrections": [{"revised_label": x["label"].title()} for x in row["items"]]})
        if kind == "synonyms":
            labels = [x["label"] for x in row["items"]]
            return json.dumps({"groups": [{"indices": [i for i, x in enumerate(labels) if x == n], "canonical_label": n} for n in sorted(set(labels))]})
        if kind == "edges":
            return json.dumps({"properties": [{"src_id": s["id"], "dest_id": d["id"]} for s in row["src_items"] for d in row["dest_items"]]})
        return json.dumps({"relations": [{"src_id": x["src_id"], "dest_id": x["dest_id"], "prohibited": False, "confidence": 0.8} for x in row["items"]]})

    return call


def test_graph_of_two_views_asks_once(spark, tmp_path):
    rows = [("f1", 1, "Alice pays Bob. Alice pays Carol! Nothing here."), ("f2", 1, "alice pays Bob."), ("f3", 1, None), ("f4", 1, "Zed pays Bob."), ("f5", 1, "Erin pays Bob\nslide one"), ("f5", 2, "slide two"), ("f6", 1, "broken pays text.")]
    pages = spark.createDataFrame(rows, "file_id string, page_no int, text string")
    known, props = metamodel_frames(spark, CLASSES, PROPERTIES)
    stages = Stages(spark, f"file://{tmp_path}/stages")
    graph = build_graph(pages, known, props, LiveProvider(answer(str(tmp_path)), retries=0, delay=0), stages=stages, rules=RULES)
    folder = f"file://{tmp_path}/graph"
    graph.write(folder)
    graph.write(folder)
    asked = [json.loads(x) for x in (tmp_path / ASKED).read_text().splitlines()]
    assert Counter(k for k, _ in asked) == {"file_type": 6, "views": 6, "mentions": 8, "judge": 3, "correct": 1, "synonyms": 2, "edges": 3, "verdicts": 1}
    assert max(Counter(map(tuple, asked)).values()) == 1
    prompt = next(p for k, p in asked if k == "judge" and "payer" in p)
    assert "- no firms" in prompt and "[0] " in prompt and "{" not in prompt.split("JSON")[0]
    nodes = graph.instances.collect()
    assert sorted((r.class_iri[len(N):], r.label, r.n_files) for r in nodes) == [("payee", "Bob", 3), ("payee", "Carol", 1), ("payer", "Alice", 2), ("payer", "Erin", 1)]
    name = {r.instance_id: r.label for r in nodes}
    assert sorted((name[r.src_id], name[r.dest_id]) for r in graph.edges.collect()) == [("Alice", "Bob"), ("Alice", "Carol"), ("Erin", "Bob")]
    errors = Counter((r.file_id, r.stage, r.message) for r in graph.errors.collect())
    assert errors == {("f6", "views", "unreadable answer"): 1, ("f4", "classes", "unknown class debtor"): 2}
    lines = [r.value for r in spark.read.text(f"{folder}/graph.ttl").collect()]
    assert len(lines) == 2 + 1 + 4 * 3 + 7 + 3 and sum("#fileId>" in x for x in lines) == 7
    assert [json.loads(r.value) for r in spark.read.text(f"{folder}/summary.json").collect()] == [{"classes": 4, "properties": 3, "files": 6}]
    assert spark.read.csv(f"{folder}/node_files.csv", header=True).count() == 7
    again = build_graph(pages.repartition(3), known, props, LiveProvider(answer(str(tmp_path)), delay=0), rules=RULES)
    assert {r.instance_id for r in again.instances.collect()} == set(name)


def test_failing_provider_leaves_errors(spark):
    def call(kind, row):
        if kind in ("judge", "views"):
            raise RuntimeError(kind)
        return "{}"

    known, props = metamodel_frames(spark, CLASSES, PROPERTIES)
    pages = spark.createDataFrame([("f1", 1, "Alice pays Bob.")], "file_id string, page_no int, text string")
    graph = build_graph(pages, known, props, LiveProvider(call, retries=1, delay=0, attempts=2), rules=RULES)
    assert graph.instances.count() == 0 and graph.edges.count() == 0
    assert sorted((r.stage, r.message) for r in graph.errors.collect()) == [("classify", "unreadable answer"), ("views", "no answer: RuntimeError: views")]
    empty = build_graph(pages.limit(0), known, props, LiveProvider(call, retries=0, delay=0), rules=RULES)
    assert [tuple(r) for r in empty.summary.collect()] == [(0, 0, 0)]


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\ftwo \n\f\n")
    (tmp_path / "in" / "b.doc").write_text("x")
    pages, errors = P.read_pages(spark, f"file://{tmp_path}/in")
    assert [(r.file_name, r.page_no, r.text) for r in pages.orderBy("page_no").collect()] == [("a.txt", 1, "one\n"), ("a.txt", 2, "two \n"), ("a.txt", 3, "\n")]
    assert [r.message for r in errors.collect()] == ["not a .txt file: b.doc"]
    assert [r.text for r in P.file_text(pages).collect()] == ["one\n\ntwo"] and P.first_pages(pages).count() == 2
    assert [(r.slide_no, r.text) for r in P.slide_texts(pages).orderBy("slide_no").collect()] == [(1, "one"), (2, "two")]
    bad, said = P.read_pages(spark, f"file://{tmp_path}/in/a.txt", lambda data: 1 // 0)
    assert bad.count() == 0 and [r.message for r in said.collect()] == ["division by zero"] or said.count() == 1


def test_job(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Alice pays Bob.")
    (tmp_path / "model.json").write_text(json.dumps({"classes": CLASSES, "properties": PROPERTIES}))
    (tmp_path / "my_provider.py").write_text("from tests.test_build import answer\nfrom docskein.operators.decide import LiveProvider\n" f"it = LiveProvider(answer({str(tmp_path)!r}), delay=0)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    out = f"file://{tmp_path}/out"
    args = ["--metamodel", f"file://{tmp_path}/model.json", "--provider", "my_provider:it", "--output-dir", out]
    assert job.main([f"file://{tmp_path}/in", *args], spark) == 0
    assert spark.read.json(f"{out}/summary.json").first().asDict() == {"classes": 2, "files": 1, "properties": 1}
    assert job.main([f"file://{tmp_path}/none", *args], spark) == 1


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    for run in ("20240101", "20240102"):
        Stages(spark, folder, run).keep("t", spark.createDataFrame([(run,)], "x string"))
    assert [r.x for r in latest(spark, folder, "t").collect()] == ["20240102"]
    assert [r.x for r in latest(spark, folder, "t", "x string").collect()] == ["20240102"]
    df = spark.range(2)
    assert log_stage(df, folder, "log", "r").endswith("log/run=r")
    with pytest.warns(UserWarning, match="stage log"):
        assert log_stage(df, folder, "log", "r") is None


def test_chunk_modes_and_checks(spark):
    df = spark.createDataFrame([("f", 0, "A b.")], "file_id string, sent_no int, text string")
    assert chains.create_chunks(df, "char").count() == 1
    with pytest.raises(ValueError, match="unknown chunk mode"):
        chains.create_chunks(df, "word")
    with pytest.raises(ValueError, match="lacks"):
        chains.document_chain(df.drop("text"))


def test_without_the_corpus_operators(tmp_path):
    """A copy without both folders (with and without the pipeline) still has its
    queries."""
    for name, gone in (("a", []), ("b", ["corpus_pipeline.py"])):
        copy = tmp_path / name
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *gone))
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 50 and not [k for k in q if k.startswith('op')]; print('fine')"
        run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert run.stdout.strip() == "fine", run.stderr
    whole = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert (Path(ROOT) / "docskein" / "llm").exists() <= (int(whole.stdout) > 60)


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    table.repartition(4).write.parquet(f"file://{tmp_path}/in")
    source = stream.read_documents(spark, f"file://{tmp_path}/in", "doc_id bigint, text string", files_per_batch=1)
    for name, op, batch in (
        ("chunks", stream.stream_chunks(source, rules=RULES), lambda d: chunks.char_chunks(d, rules=RULES)),
        ("views", stream.stream_views(source, VIEW_PATTERNS, rules=RULES), lambda d: stream.stream_views(d, VIEW_PATTERNS, rules=RULES)),
    ):
        stream.write_stream(op, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-c").awaitTermination()
        got = spark.read.parquet(f"file://{tmp_path}/{name}")
        want = batch(spark.read.parquet(f"file://{tmp_path}/in"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
