"""The metamodel: classes and properties that a graph may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASS_DDL = "iri string, name string, description string, view_type string, min_length int, max_length int, extract_rules array<string>, prohibit_rules array<string>"
PROPERTY_DDL = "iri string, name string, description string, src_class string, dest_class string, prohibit_rules array<string>"


def read_metamodel(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes, properties) of a JSON file ``{"classes": [...], "properties":
    [...]}``; missing fields are null."""
    return _frames(spark.read.schema(metamodel_ddl()).option("multiLine", True).json(path))


def parse_metamodel(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """The same from the file's text, for files that only the driver sees."""
    told = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", metamodel_ddl()).alias("m"))
    return _frames(told.select("m.classes", "m.properties"))


def metamodel_ddl() -> str:
    return f"classes array<struct<{_struct(CLASS_DDL)}>>, properties array<struct<{_struct(PROPERTY_DDL)}>>"


def classes_of_view(classes: DataFrame, view: str) -> DataFrame:
    return classes.where(F.col("view_type") == view)


def _frames(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(both.select(F.posexplode(c).alias("ord", "x")).select("ord", "x.*") for c in ("classes", "properties"))


def metamodel_frames(spark: SparkSession, classes: list[dict], properties: list[dict]) -> tuple[DataFrame, DataFrame]:
    """The same from Python values."""
    frames = []
    for rows, ddl in ((classes, CLASS_DDL), (properties, PROPERTY_DDL)):
        names = [f.split()[0] for f in ddl.split(", ")]
        frames.append(spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(rows)], f"ord int, {ddl}"))
    return tuple(frames)


def _struct(ddl: str) -> str:
    return ", ".join(": ".join(f.split(" ", 1)) for f in ddl.split(", "))


def render_definitions(classes: DataFrame) -> DataFrame:
    """(view_type, definitions): a line ``- name: description`` per class."""
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("")), F.lit(": "), F.coalesce("description", F.lit("")))
    return _by_view(classes, F.array(line), "definitions")


def render_policies(classes: DataFrame) -> DataFrame:
    """(view_type, policies): per class its name, its length limits (if it has
    both) and its extraction rules; a class without any of them has no line."""
    size = F.when(
        F.col("min_length").isNotNull() & F.col("max_length").isNotNull(),
        F.array(F.concat(F.lit("  - 文字数: "), F.col("min_length").cast("string"), F.lit("～"), F.col("max_length").cast("string"), F.lit("字"))),
    ).otherwise(F.array().cast("array<string>"))
    rules = F.transform(F.coalesce("extract_rules", F.array().cast("array<string>")), lambda r: F.concat(F.lit("  - "), r))
    items = F.concat(size, rules)
    lines = F.when(F.size(items) > 0, F.concat(F.array(F.concat(F.lit("- "), F.coalesce("name", F.lit("")))), items)).otherwise(F.array().cast("array<string>"))
    return _by_view(classes, lines, "policies")


def render_rules(rows: DataFrame, *, key: str = "iri", rules: str = "prohibit_rules", empty: str = "") -> DataFrame:
    """(key, text): a line ``- rule`` for each rule, or ``empty`` without any."""
    lines = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r)), "\n")
    return rows.select(key, F.when(F.size(F.coalesce(rules, F.array().cast("array<string>"))) > 0, lines).otherwise(empty).alias("text"))


def _by_view(classes: DataFrame, lines, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("ord", lines.alias("lines"))))
    return classes.groupBy("view_type").agg(F.array_join(F.flatten(F.transform(parts, lambda p: p["lines"])), "\n").alias(name))
