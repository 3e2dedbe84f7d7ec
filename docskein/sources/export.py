"""The graph as node and edge tables, CSV files and Turtle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.functions.iri import full_iri, literal, local_name, node_iri, snake_case, term
from docskein.sources.stages import Stages

BASE = "http://example.org/graph"
PREFIXES = {
    "ex": f"{BASE}#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def nodes_table(instances: DataFrame, *, order: str | None = None) -> DataFrame:
    """Columns id:ID, iri, :LABEL, label, file_id; of rows with one id the last
    (greatest ``order``) stays.  Instances without a class are left out."""
    files = F.array_join("file_ids", ",") if "file_ids" in instances.columns else F.col("file_id")
    row = F.struct(
        F.col("class_iri").alias("iri"), snake_case(local_name(F.col("class_iri"))).alias(":LABEL"), F.col("label").alias("label"),
        F.coalesce(files, F.lit("")).alias("file_id"),
    )
    df = instances.where(F.col("class_iri") != "")
    df = df.groupBy(F.col("instance_id").alias("id:ID")).agg(F.max_by(row, F.col(order) if order else F.col("label")).alias("r"))
    return df.select("id:ID", "r.*")


def upsert_nodes(versions: DataFrame, *, order: str, deleted: str | None = None, id_col: str = "instance_id") -> DataFrame:
    """The last version of every node of ``versions`` (rows of any number of runs, in
    any order): per ``id_col`` the row with the greatest ``order``, without nodes
    whose last version has ``deleted`` set.  Of rows that share both, the greatest
    in the other columns' order stays, so reruns agree; rows without an order come
    first of all, rows without an id are left out.  A version is merged where it is
    read (a partial aggregation), so a node of many versions is no task's."""
    fields = [c for c in versions.columns if c not in (id_col, order)]
    row = F.struct(order, *fields)
    last = versions.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(row).alias("last")).select(id_col, "last.*")
    last = last.select(*versions.columns)
    return last if deleted is None else last.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def runs_of(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """All runs of a stage's table (see ``sources.stages``) with their names as the
    column ``run``: names sort by time, so they serve ``upsert_nodes`` as order."""
    every = spark.read.option("basePath", f"{folder}/{stage}").option("mergeSchema", True).parquet(f"{folder}/{stage}")
    return every.withColumn("run", F.col("run").cast("string"))


def relationships_table(edges: DataFrame) -> DataFrame:
    """Columns :START_ID, :END_ID, :TYPE, property_iri, id; distinct rows (edges are
    made distinct before their keys are made: those are longer than the edges)."""
    key = F.sha2(F.concat_ws("\x02", "src_id", "property_iri", "dest_id"), 256)
    return edges.select("property_iri", "src_id", "dest_id").distinct().select(
        F.col("src_id").alias(":START_ID"), F.col("dest_id").alias(":END_ID"), local_name(F.col("property_iri")).alias(":TYPE"), "property_iri", key.alias("id")
    )


def write_csv(table: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Sorted, with a header, minimal quoting and doubled quotes.  A sort by
    range keeps files ordered; ``one_file`` is for graphs that fit a task."""
    out = table.orderBy(*[f"`{c}`" for c in table.columns])
    if one_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def node_files(members: DataFrame) -> DataFrame:
    """Columns id:ID, file_id: every file an instance was found in, a row each."""
    return members.select(F.col("instance_id").alias("id:ID"), "file_id").distinct()


def triples(instances: DataFrame, edges: DataFrame, *, base: str = BASE, files: DataFrame | None = None, language: str = "ja") -> DataFrame:
    """(section, subject, predicate, object): declarations of classes (section 1)
    and properties (2), instances (3) and edges (4).

    An instance's IRI is made once from its label and id and written down, so edges
    meet the nodes they join; edges whose ends do not both exist are left out.  ``files``
    (instance_id, file_id) names all files of an instance, a triple each; without
    it the column file_id does.  ``language`` tags labels (empty: none)."""
    own = instances.where(F.col("class_iri") != "").select("instance_id", "class_iri", "label", *(["file_id"] if files is None else []), node_iri(base, F.col("label"), F.sha2("instance_id", 256)).alias("node"))
    own = Stages(instances.sparkSession).keep("nodes", own)
    a = F.lit("rdf:type")
    section = lambda n, df: df.select(F.lit(n).alias("section"), "subject", "predicate", "object")
    declared = lambda df, column, kind: df.select(column).distinct().select(term(F.col(column)).alias("subject"), a.alias("predicate"), F.lit(kind).alias("object"))
    fact = lambda predicate, value: F.struct(F.lit(predicate).alias("predicate"), value.alias("object"))
    tag = F.lit(f"@{language}" if language else "")
    facts = [fact("rdf:type", term(F.col("class_iri"))), fact("rdfs:label", F.concat(literal(F.col("label")), tag)), fact("ex:classInstanceId", literal(F.col("instance_id")))]
    if files is None:
        facts.append(fact("ex:fileId", literal(F.when(F.col("file_id") != "", F.col("file_id")))))
    nodes = own.select(F.col("node").alias("subject"), F.explode(F.array(*facts)).alias("f")).select("subject", "f.*").where(F.col("object").isNotNull())
    if files is not None:
        found = files.where(F.coalesce("file_id", F.lit("")) != "").distinct().join(own.select("instance_id", "node"), "instance_id")
        nodes = nodes.unionByName(found.select(F.col("node").alias("subject"), F.lit("ex:fileId").alias("predicate"), literal(F.col("file_id")).alias("object")))
    end = lambda side: own.select(F.col("instance_id").alias(f"{side}_id"), F.col("node").alias(f"{side}_node"))
    met = edges.select("src_id", "property_iri", "dest_id").distinct().join(end("src"), "src_id").join(end("dest"), "dest_id")
    links = met.select(F.col("src_node").alias("subject"), term(F.col("property_iri")).alias("predicate"), F.col("dest_node").alias("object"))
    return (
        section(1, declared(own, "class_iri", "owl:Class")).unionByName(section(2, declared(edges, "property_iri", "owl:ObjectProperty")))
        .unionByName(section(3, nodes)).unionByName(section(4, links))
    )


def turtle_header(base: str = BASE) -> str:
    lines = [f"@prefix {p}: <{base}#> ." if p == "ex" else f"@prefix {p}: <{iri}> ." for p, iri in PREFIXES.items()]
    return "\n".join([*lines, "", "ex: a owl:Ontology .", ""])


def turtle_blocks(rows: DataFrame) -> DataFrame:
    """(section, subject, block): the statements of each subject as one Turtle
    block, its types first; sections in their order give a document's body."""
    order = F.when(F.col("predicate") == "rdf:type", 0).otherwise(1)
    verb = F.when(F.col("predicate") == "rdf:type", "a").otherwise(F.col("predicate"))
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), verb.alias("p"), F.col("object").alias("v"))))
    body = F.array_join(F.transform(parts, lambda x: F.concat_ws(" ", x["p"], x["v"])), " ;\n    ")
    return rows.groupBy("section", "subject").agg(body.alias("body")).select("section", "subject", F.concat("subject", F.lit(" "), "body", F.lit(" .")).alias("block"))


def write_turtle(rows: DataFrame, path: str, *, one_file: bool = False) -> None:
    """A block per subject, sections in order.  Files repeat full IRIs, so that
    every part file is a valid document by itself; ``one_file`` (for graphs that
    fit a task) writes prefixes and the ontology's line first."""
    if one_file:
        out = turtle_blocks(rows).orderBy("section", "subject").coalesce(1)
        head = rows.sparkSession.createDataFrame([(0, "", turtle_header())], "section int, subject string, block string")
        head.unionByName(out.select(F.col("section").cast("int").alias("section"), "subject", "block")).coalesce(1).sortWithinPartitions("section", "subject").select(F.col("block").alias("line")).write.mode("overwrite").text(path)
        return
    full = rows.select("section", *[full_iri(F.col(c), PREFIXES).alias(c) for c in ("subject", "predicate", "object")])
    lines = full.select("section", F.concat_ws(" ", "subject", "predicate", "object", F.lit(".")).alias("line"))
    lines.orderBy("section", "line").select("line").write.mode("overwrite").text(path)


def run_summary(instances: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: classes (instances), properties (edges) and files."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    parts = {"classes": instances, "properties": edges} | ({"files": files} if files is not None else {})
    both = None
    for name, df in parts.items():
        both = n(df, name) if both is None else both.unionByName(n(df, name))
    pick = lambda name: F.max(F.when(F.col("what") == name, F.col("n"))).alias(name)
    return both.agg(*[pick(name) for name in parts])
