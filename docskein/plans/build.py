"""End to end: files to a validated graph, every stage a table of its own.

Each stage is written once, with the answers of the provider in it; what follows
reads the table, so every request is made once and one run tells one story.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.functions.text import TextRules
from docskein.operators import classes as C
from docskein.operators import properties, requests as R, views
from docskein.operators.check import require
from docskein.plans import chains
from docskein.sources import export
from docskein.sources.pages import first_pages
from docskein.sources.stages import Stages


@dataclass
class Graph:
    """Tables of a finished run (all of them written) and its stage store."""

    stages: Stages
    file_types: DataFrame
    chunks: DataFrame
    view_texts: DataFrame
    instances: DataFrame
    members: DataFrame
    edges: DataFrame
    errors: DataFrame
    summary: DataFrame

    def write(self, folder: str) -> None:
        """The graph as CSV and Turtle, and the run's summary as JSON."""
        files = self.members.groupBy("instance_id").agg(F.min("file_id").alias("file_id"))
        nodes = self.instances.join(files, "instance_id")
        export.write_csv(export.nodes_table(nodes), f"{folder}/nodes.csv")
        export.write_csv(export.relationships_table(self.edges), f"{folder}/relationships.csv")
        export.write_csv(export.node_files(self.members), f"{folder}/node_files.csv")
        export.write_turtle(export.triples(self.instances, self.edges, files=self.members.select("instance_id", "file_id")), f"{folder}/graph.ttl")
        self.errors.write.mode("overwrite").json(f"{folder}/errors.json")
        self.summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary.json")


def build_graph(
    pages: DataFrame, known: DataFrame, props: DataFrame, provider, *, stages: Stages | None = None, view_patterns: dict[str, str] | None = None, rules: TextRules = TextRules(),
    rounds: int = 3, threshold: float = 0.5, top: int = 3, block_rows: int = 200, edge_block: int = 20,
) -> Graph:
    """The whole chain over ``pages`` (file_id, page_no, text) of many files.

    The provider is asked, in this order, for ``file_type`` (a file's first two
    pages), ``views`` (a chunk; not where ``view_patterns`` tells them),
    ``mentions`` (a file's texts of a view), ``judge`` and ``correct`` (a block of
    a class), ``synonyms`` (a block of a class's labels, in several orders), ``edges`` (two blocks of instances
    of one file, for a property) and ``verdicts`` (a block of a property's
    candidates).  See ``operators.requests`` for keys and answers.

    Requests without a usable answer, mentions of unknown classes and edges that
    fail validation are rows of ``errors`` (file_id, stage, message).
    """
    require(pages, "file_id", "page_no", "text")
    require(known, "iri", "name", "view_type"), require(props, "iri", "src_class", "dest_class")
    stages = stages or Stages(pages.sparkSession)
    keep = stages.keep
    pages = pages.withColumn("file_id", F.col("file_id").cast("string"))

    typed = keep("file-type-answers", R.ask_file_types(first_pages(pages), provider))
    types = keep("file-types", R.file_types(typed))
    errors = R.unanswered(typed, "classify", "is_presentation boolean")
    chunks = keep("chunks", chains.file_chunks(pages, types, rules=rules))
    if view_patterns is None:
        seen = keep("view-answers", R.ask_views(chunks, provider))
        errors = errors.unionByName(R.unanswered(seen, "views", R.SPANS, views.VIEWS))
        texts = chains.view_chain(seen, top=top)
    else:
        texts = views.dedup_views(views.view_spans(chunks, view_patterns, id_col="file_id", top=top, rules=rules), id_col="file_id")
    texts = keep("view-texts", texts)

    told = keep("mention-answers", R.ask_mentions(texts, known, provider))
    found = keep("mentions", R.mentions(told, known))
    errors = errors.unionByName(R.unanswered(told, "classes", R.MENTIONS))
    errors = errors.unionByName(found.where("class_iri = ''").select("file_id", F.lit("classes").alias("stage"), F.concat(F.lit("unknown class "), "class").alias("message")))
    judged, bad = R.review(found.where("class_iri <> ''"), known, provider, keep, rounds=rounds, block_rows=block_rows)
    accepted = keep("accepted", C.accepted(judged).drop("judgment", "justification", "rounds"))
    instances, members, unsaid = R.merge_synonyms(accepted, known, provider, keep, block_rows=block_rows)
    instances, members = keep("instances", instances), keep("members", members)
    errors = errors.unionByName(bad).unionByName(unsaid)

    # Instances meet in every file they were found in, whatever their view.
    placed = members.select("instance_id", "file_id").distinct().join(instances.select("instance_id", "class_iri", "label"), "instance_id")
    proposed = keep("edge-answers", R.ask_edges(R.candidate_requests(placed, props, block=edge_block), provider, known))
    candidates = keep("candidates", R.proposed_edges(proposed))
    weighed = keep("verdict-answers", R.ask_verdicts(candidates, instances, props, provider))
    edges = properties.accept_edges(properties.join_verdicts(candidates, R.verdicts(weighed)), threshold=threshold)
    checked = keep("validated", properties.validate_edges(edges, instances, props))
    message = F.concat_ws(" ", "reason", *properties.EDGE)
    errors = (
        errors.unionByName(R.unanswered(proposed, "properties", R.PAIRS)).unionByName(R.unanswered(weighed, "properties", R.RELATIONS))
        .unionByName(checked.where("reason IS NOT NULL").select(F.lit(None).cast("string").alias("file_id"), F.lit("properties").alias("stage"), message.alias("message")))
    )
    edges = checked.where("reason IS NULL").drop("reason")
    summary = keep("summary", export.run_summary(instances, edges, files=pages.select("file_id").distinct()))
    return Graph(stages, types, chunks, texts, instances, members, edges, keep("errors", errors), summary)
