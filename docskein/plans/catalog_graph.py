"""The query catalogue, part 2: files, chains, requests and whole graphs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docskein.functions.iri import long_literal
from docskein.functions.text import let
from docskein.operators import classes as C
from docskein.operators import lines, properties, requests as R, views
from docskein.operators.decide import RuleProvider
from docskein.plans import build, chains, shop
from docskein.plans.catalog_base import (
    _CLASSES_SQL, _KEPT, _LIMITS, _ORDERED, _VERDICT, BASE, CHUNK_CHAR, CLASS_LOOP, RULES, TEXT_LINES, VIEW_PATTERNS, chunk_sql, line_merge_sql, q, spans_sql, sql_strip, view_dedup,
)
from docskein.plans.shop import INSTANCES_SQL, NS, table
from docskein.sources import export, metamodel, pages as P
from docskein.sources.stages import Stages, latest, log_stage

# --- files -----------------------------------------------------------------------


def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one page, conversations as files of a page a turn."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file_id"), F.lit(1).alias("page_no"), "text")
    return docs.unionByName(table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("file_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text"))


PAGES_SQL = "pages_of AS (SELECT 'd' || doc_id AS file_id, 1::INT AS page_no, text FROM documents UNION ALL SELECT 'c' || conv_id, (turn + 1)::INT, text FROM conversations)"


def page_scan(spark, sf_dir):
    """The first two pages of every file, stripped, without empty ones."""
    return P.slide_texts(P.first_pages(file_pages(spark, sf_dir)))


PAGE_SCAN = f"WITH {PAGES_SQL} SELECT file_id, page_no AS slide_no, {sql_strip('text')} AS text FROM pages_of WHERE page_no <= 2 AND {sql_strip('text')} <> ''"


def file_texts(spark, sf_dir):
    return P.file_text(file_pages(spark, sf_dir))




def file_text_sql(source: str, name: str = "file_id") -> str:
    return f"SELECT file_id AS {name}, {sql_strip('string_agg(text, chr(10) ORDER BY page_no)')} AS text FROM {source} WHERE coalesce(text, '') <> '' GROUP BY file_id"


FILE_TEXTS = f"WITH {PAGES_SQL} {file_text_sql('pages_of')}"


def collected_lines(spark, sf_dir):
    """Lines kept as an array of structs, and as an array of strings under the
    other name of the file's name."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("l"))
    structs = docs.select(F.col("doc_id").alias("file_id"), F.lit("a").alias("file_name"), F.transform("l", lambda x: F.struct(F.concat(x, F.lit("\n")).alias("text"))).alias("sentences"))
    plain = docs.select((-F.col("doc_id") - 1).alias("file_id"), F.lit("b").alias("filename"), F.col("l").alias("sentences"))
    return P.collect_lines(structs).unionByName(P.collect_lines(plain))


COLLECTED_LINES = """
WITH l AS (SELECT doc_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
SELECT doc_id AS file_id, 'a' AS file_name, ord, text FROM l UNION ALL SELECT -doc_id - 1, 'b', ord, text FROM l"""


def base_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.base_name(F.col("url")).alias("name"))


BASE_NAMES = "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages"


def files() -> RuleProvider:
    """A file with a question mark on its first two pages is a slide deck; texts
    of an even length get no answer at all."""
    said = F.to_json(F.struct(F.contains(F.col("text"), F.lit("?")).alias("is_presentation"), F.lit("?").alias("justification")))
    return RuleProvider({"file_type": lambda: F.when(F.length("text") % 2 == 1, said)})


def file_type_rows(spark, sf_dir):
    asked = R.ask_file_types(file_pages(spark, sf_dir), files())
    return R.file_types(asked)


_FIRST = "firsts2 AS (SELECT file_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page_no) AS text FROM pages_of WHERE page_no <= 2 GROUP BY file_id)"
TYPES_SQL = f"{_FIRST}, types AS (SELECT file_id, CASE WHEN length(text) % 2 = 1 AND contains(text, '?') THEN 'presentation' ELSE 'document' END AS file_type FROM firsts2)"
FILE_TYPES = f"WITH {PAGES_SQL}, {TYPES_SQL} SELECT * FROM types"

# --- chains ------------------------------------------------------------------------


def document_chain(spark, sf_dir):
    return chains.document_chain(table(spark, sf_dir, "documents").select("doc_id", "text"), id_col="doc_id", rules=RULES)


DOCUMENT_CHAIN = line_merge_sql(TEXT_LINES)


def document_chunks(spark, sf_dir):
    """Merged sentences, joined by spaces and cut."""
    return chains.create_chunks(document_chain(spark, sf_dir), "char", id_col="doc_id", rules=RULES)


def _joined(merged: str) -> str:
    return f"(SELECT doc_id, string_agg(text, ' ' ORDER BY sent_no) AS text FROM ({merged}) GROUP BY doc_id)"


DOCUMENT_CHUNKS = chunk_sql(_joined(DOCUMENT_CHAIN))


def file_chunks(spark, sf_dir):
    """Both kinds of file, each by its chain."""
    return chains.file_chunks(file_pages(spark, sf_dir), file_type_rows(spark, sf_dir), rules=RULES)


def lines_sql(source: str) -> str:
    return f"SELECT doc_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM {source})"


_DOC_TEXT = "(" + file_text_sql("(SELECT p.* FROM pages_of p JOIN types USING (file_id) WHERE file_type = 'document')", "doc_id") + ")"
_DECK = "(SELECT file_id AS doc_id, page_no, text FROM pages_of JOIN types USING (file_id) WHERE file_type = 'presentation')"
_DECK_CHUNKS = f"""SELECT doc_id, page_no AS chunk_no, string_agg(text, ' ' ORDER BY ord) AS text FROM (
  SELECT doc_id, page_no, unnest(range(len(l)))::INT AS ord, unnest(l) AS text FROM (
    SELECT doc_id, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM {_DECK})) GROUP BY ALL"""
_ALL_CHUNKS = f"SELECT * FROM ({chunk_sql(_joined(line_merge_sql(lines_sql(_DOC_TEXT))))}) UNION ALL SELECT doc_id, chunk_no, text FROM ({_DECK_CHUNKS})"
FILE_CHUNKS = f"WITH {PAGES_SQL}, {TYPES_SQL} SELECT doc_id AS file_id, chunk_no, text FROM ({_ALL_CHUNKS})"


def line_merge_chunked(spark, sf_dir):
    return chains.merge_in_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=RULES)


_KEYED = f"SELECT key AS doc_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS text FROM (SELECT doc_id || ':' || chunk_no AS key, string_split(text, chr(10)) AS l FROM ({CHUNK_CHAR}))"
LINE_MERGE_CHUNKED = f"SELECT split_part(doc_id, ':', 1)::BIGINT AS doc_id, split_part(doc_id, ':', 2)::INT AS chunk_no, sent_no, text FROM ({line_merge_sql(_KEYED)})"


def stage_latest(spark, sf_dir):
    """Two runs of a stage and a log of one; the newer run is read back."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    folder = Stages(spark).folder + "/latest-" + Stages(spark).run
    for run, df in (("r1", sizes.limit(1)), ("r2", sizes)):
        Stages(spark, folder, run).keep("sizes", df)
    log_stage(sizes.where("n < 0"), folder, "log", "r1")
    return latest(spark, folder, "sizes", "doc_id bigint, n int")


STAGE_LATEST = "SELECT doc_id, length(text)::INT AS n FROM documents"

# --- views and mentions ------------------------------------------------------------


def view_parse(spark, sf_dir):
    """Spans from answers: blanks, repeats, nulls and unknown views fall away, and
    a chunk whose answer is no JSON has none."""
    s = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("file_id"), F.lit(0).alias("chunk_no"), F.split("text", "\n", -1).alias("l"))
    payload = F.to_json(F.struct(F.concat(F.array(F.lit(" "), F.lit("")), F.col("l"), F.col("l")).alias("value_analysis"), F.slice("l", 1, 1).alias("data_analysis"), F.col("l").alias("other")))
    said = s.select("file_id", "chunk_no", F.when(F.col("file_id") % 5 == 0, F.lit("no json")).otherwise(payload).alias("payload"))
    return views.parse_spans(said, keys=["file_id"])


VIEW_PARSE = f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l, {sql_strip('string_split(text, chr(10))[1]')} AS first FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0),
v AS (SELECT doc_id, 'value_analysis' AS view_type, list_filter(l, lambda x, i: list_position(l, x) = i)[1:3] AS t FROM l UNION ALL SELECT doc_id, 'data_analysis', [first] FROM l WHERE first <> '')
SELECT doc_id AS file_id, view_type, unnest(range(1, len(t) + 1))::INT AS rank, unnest(t) AS text FROM v"""


def view_nested(spark, sf_dir):
    """The nested form of a document's views, told as one string."""
    nested = views.nest_views(view_dedup(spark, sf_dir))
    return nested.select("doc_id", F.array_join(F.transform("views", lambda v: F.concat_ws(":", v["type"], F.sha2(F.array_join(v["texts"], "\n"), 256))), ",").alias("views"))


VIEW_NESTED = f"""
WITH {spans_sql(CHUNK_CHAR)},{_KEPT}, o AS ({_ORDERED}), g AS (SELECT doc_id, view_type, sha256(string_agg(text, chr(10) ORDER BY ord)) AS t FROM o GROUP BY ALL)
SELECT doc_id, string_agg(view_type || ':' || t, ',' ORDER BY list_position([{", ".join(map(q, views.VIEWS))}], view_type)) AS views FROM g GROUP BY doc_id"""


def mention_rules() -> RuleProvider:
    """Of each line the first number and the first capitalised word before a comma."""
    line = lambda kind, pattern: F.struct(F.lit(kind).alias("class"), F.regexp_extract("text", pattern, 1).alias("label"), F.lit("s").alias("source"))
    first = F.when(F.length("text") % 11 == 0, "gadget").otherwise("customer")
    return RuleProvider({"mentions": lambda: F.to_json(F.array(
        F.struct(first.alias("class"), F.regexp_extract("text", "([0-9]+)", 1).alias("label"), F.lit("s").alias("source")), line("region", "([A-Z][a-z]+),"),
        F.struct(F.lit(None).cast("string").alias("class"), F.lit("x").alias("label"), F.lit("s").alias("source")),
    ))})


def mention_requests(spark, sf_dir):
    """Requests by document and view: their texts, told by size and digest."""
    known, _ = shop.metamodel(spark)
    asked = R.ask_mentions(view_dedup(spark, sf_dir), known, mention_rules(), id_col="doc_id", request_chars=2000)
    return asked.select("doc_id", "view_type", "part", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))


_VIEWS_KNOWN = f"SELECT DISTINCT view_type FROM {_CLASSES_SQL}"
_ASKED = f"""{spans_sql(CHUNK_CHAR)},{_KEPT}, o AS ({_ORDERED}),
parts AS (SELECT *, ((sum(length(text) + 1) OVER (PARTITION BY doc_id, view_type ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1) // 2000)::INT AS part FROM o WHERE view_type IN ({_VIEWS_KNOWN})),
asked AS (SELECT doc_id, view_type, part, string_agg(text, chr(10) ORDER BY ord) AS text FROM parts GROUP BY ALL)"""
MENTION_REQUESTS = f"WITH {_ASKED} SELECT doc_id, view_type, part, length(text)::INT AS n, sha256(text) AS sha FROM asked"


def mention_rows(spark, sf_dir):
    known, _ = shop.metamodel(spark)
    asked = R.ask_mentions(view_dedup(spark, sf_dir), known, mention_rules(), id_col="doc_id", request_chars=2000)
    return R.mentions(asked, known, id_col="doc_id").select("file_id", "view_type", "class", "label", "class_iri")


MENTION_ROWS = f"""
WITH {_ASKED}, m AS (
  SELECT doc_id, view_type, CASE WHEN length(text) % 11 = 0 THEN 'gadget' ELSE 'customer' END AS class, regexp_extract(text, '([0-9]+)', 1) AS label FROM asked
  UNION ALL SELECT doc_id, view_type, 'region', regexp_extract(text, '([A-Z][a-z]+),', 1) FROM asked)
SELECT DISTINCT doc_id::VARCHAR AS file_id, m.view_type, class, label, CASE WHEN c.name IS NULL THEN '' ELSE '{NS}' || c.name END AS class_iri
FROM m LEFT JOIN {_CLASSES_SQL} ON c.view_type = m.view_type AND c.name = class"""


def message_texts(spark, sf_dir):
    """Messages as plain strings, as parts with a text, and as parts without."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    part = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("text").alias("text"))
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.to_json(F.array(part("image"), part("output_text")))).otherwise(F.to_json(F.array(part("image"))))
    return t.select("conv_id", "turn", R.message_text(said).alias("text"))


MESSAGE_TEXTS = "SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN text END AS text FROM conversations WHERE text IS NOT NULL"


def prompts(spark, sf_dir):
    """A template filled with a text that itself looks like a template."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("{b} "), F.coalesce("text", F.lit(""))).alias("a"), F.lit("{a}").alias("b"))
    return t.select("doc_id", F.sha2(R.fill("<{a}|{b}|{c}>{a}", a=F.col("a"), b=F.col("b")), 256).alias("sha"))


PROMPTS = "SELECT doc_id, sha256('<{b} ' || coalesce(text, '') || '|{a}|{c}>{b} ' || coalesce(text, '')) AS sha FROM documents"

# --- classes -------------------------------------------------------------------------


def metamodel_scan(spark, sf_dir):
    """The metamodel's JSON read back: a row per class."""
    known, props = metamodel.parse_metamodel(spark, json.dumps({"classes": shop.CLASSES, "properties": shop.PROPERTIES}))
    here = known.select("ord", "name", "view_type", F.size("extract_rules").alias("n")).unionByName(props.select("ord", "name", F.lit("").alias("view_type"), F.lit(0).alias("n")))
    return here.unionByName(metamodel.classes_of_view(known, "value_analysis").select((F.col("ord") + 100).alias("ord"), "name", "view_type", F.lit(0).alias("n")))


METAMODEL_SCAN = f"""SELECT o::INT AS ord, name, view_type, len(rules)::INT AS n FROM {_CLASSES_SQL} UNION ALL SELECT (o + 100)::INT, name, view_type, 0 FROM {_CLASSES_SQL} WHERE view_type = 'value_analysis'
UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, '{p['name']}', '', 0)" for i, p in enumerate(shop.PROPERTIES))})"""


def class_names(spark, sf_dir):
    """Name and rules of each instance's class, counted; unknown IRIs too."""
    known, _ = shop.metamodel(spark)
    rows = shop.instances(spark, sf_dir).select(F.when(F.col("source") == "orders", F.concat("class_iri", F.lit("-x"))).otherwise(F.col("class_iri")).alias("class_iri"))
    rules = metamodel.render_rules(known, rules="extract_rules", empty="(none)").withColumnsRenamed({"iri": "class_iri", "text": "wanted"})
    named = C.class_names(rows, known).join(rules, "class_iri", "left")
    return named.groupBy("class_iri", "class_name", "wanted").agg(F.count(F.lit(1)).alias("n"))


CLASS_NAMES = f"""WITH {INSTANCES_SQL}, r AS (SELECT '{NS}' || name AS class_iri, CASE WHEN len(rules) = 0 THEN '(none)' ELSE '- ' || array_to_string(rules, chr(10) || '- ') END AS wanted FROM {_CLASSES_SQL}),
i AS (SELECT CASE WHEN source = 'orders' THEN class_iri || '-x' ELSE class_iri END AS class_iri FROM instances)
SELECT class_iri, string_split(class_iri, '#')[-1] AS class_name, wanted, count(*) AS n FROM i LEFT JOIN r USING (class_iri) GROUP BY ALL"""


def _limit_of(which: str):
    out = F.lit(None).cast("int")
    for c in shop.CLASSES:
        out = F.when(F.col("class_iri") == c["iri"], c[which]).otherwise(out)
    return out


def block_rules(*, short: bool = False) -> RuleProvider:
    """The shop's rules for whole blocks; with ``short`` lists lack their last
    answer, and blocks of an odd number have none."""
    low, high = _limit_of("min_length"), _limit_of("max_length")
    verdict = lambda label: F.when(F.length(label) < low, "REJECT").when(F.length(label) > high, "REVIEW").otherwise("ACCEPT")
    judged = F.transform("items", lambda x: F.struct(verdict(x["label"]).alias("judgment"), F.lit("length").alias("justification")))
    judged = F.slice(judged, 1, F.size(judged) - 1) if short else judged
    fixed = F.transform("items", lambda x: F.struct(F.regexp_replace(x["label"], " [^ ]*$", "").alias("revised_label"), (~F.contains(x["label"], F.lit(" "))).alias("should_reject"), F.lit("").alias("revision_reason")))
    told = F.to_json(F.struct(judged.alias("judgments")))
    return RuleProvider({"judge": lambda: F.when(F.col("block") % 2 == 0, told) if short else told, "correct": lambda: F.to_json(F.struct(fixed.alias("corrections")))})


def class_judge_blocks(spark, sf_dir):
    """Judgments by place, with lists that are too short or missing."""
    rows, (known, _) = shop.instances(spark, sf_dir), shop.metamodel(spark)
    told = R.judged(rows, R.ask_judgments(rows, known, block_rules(short=True), block_rows=50), block_rows=50)
    return told.select("instance_id", "judgment")


def _block_sql(key: str, rows: int, groups: str = "class_iri", source: str = "instances") -> str:
    return f"""blocked AS (
  SELECT *, (('0x' || left(md5({key}), 8))::BIGINT % ceil(count(*) OVER (PARTITION BY {groups}) / {rows}.0)::BIGINT)::INT AS block FROM {source}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {groups}, block ORDER BY instance_id) - 1 AS pos, count(*) OVER (PARTITION BY {groups}, block) AS size FROM blocked)"""


CLASS_JUDGE_BLOCKS = f"""WITH {INSTANCES_SQL}, {_LIMITS}, {_block_sql('instance_id', 50)}
SELECT instance_id, CASE WHEN block % 2 = 1 OR pos = size - 1 THEN 'REJECT' ELSE {_VERDICT.format('label')} END AS judgment FROM placed JOIN limits USING (class_iri)"""


def class_review_blocks(spark, sf_dir):
    """The review loop with a request per block of a class."""
    rows, (known, _) = shop.instances(spark, sf_dir), shop.metamodel(spark)
    done, _ = R.review(rows.select("instance_id", "class_iri", "label", "source"), known, block_rules(), Stages(spark).keep)
    return done.select("instance_id", "label", "judgment", "rounds")


def class_sections(spark, sf_dir):
    """Accepted, reviewed and rejected rows, in the order of their union."""
    rows, (known, _) = shop.instances(spark, sf_dir), shop.metamodel(spark)
    told = C.three_way(R.judged(rows, R.ask_judgments(rows, known, block_rules())))
    place = F.row_number().over(Window.partitionBy("class_iri").orderBy("section", "instance_id"))
    return told.withColumn("place", place).where("place <= 5").select("class_iri", "place", "section", "instance_id")


CLASS_SECTIONS = f"""WITH {INSTANCES_SQL}, {_LIMITS}, j AS (SELECT class_iri, instance_id, CASE {_VERDICT.format('label')} WHEN 'ACCEPT' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS section FROM instances JOIN limits USING (class_iri))
SELECT class_iri, row_number() OVER (PARTITION BY class_iri ORDER BY section, instance_id)::INT AS place, section, instance_id FROM j QUALIFY place <= 5"""


def class_accepted(spark, sf_dir):
    """What the filter lets through; no judgment is a rejection."""
    rows, (known, _) = shop.instances(spark, sf_dir), shop.metamodel(spark)
    told = R.judged(rows, R.ask_judgments(rows, known, block_rules()))
    told = told.withColumn("judgment", F.when(F.length("label") % 7 != 0, F.col("judgment")))
    return C.accepted(told).groupBy("class_iri", "judgment").agg(F.count(F.lit(1)).alias("n"))


CLASS_ACCEPTED = f"WITH {INSTANCES_SQL}, {_LIMITS}, j AS (SELECT class_iri, CASE WHEN length(label) % 7 <> 0 THEN {_VERDICT.format('label')} END AS judgment FROM instances JOIN limits USING (class_iri)) SELECT class_iri, judgment, count(*) AS n FROM j WHERE judgment <> 'REJECT' GROUP BY ALL"


def synonym_rules(letters: int = 1000) -> RuleProvider:
    """Labels that agree in their first ``letters`` (below 0: in all but so many) are
    one; each group also names indices that are no rows, and its greatest label."""
    whole = lambda x: F.lower(F.trim(x["label"]))
    folded = lambda x: F.left(whole(x), F.lit(letters) if letters >= 0 else F.length(whole(x)) + letters)

    def group(own):
        return F.struct(F.concat(F.transform(own, lambda x: x["i"]), F.array(F.lit(-1), F.lit(100_000))).alias("indices"), F.array_max(F.transform(own, lambda x: x["label"])).alias("canonical_label"), F.lit("").alias("reason"))

    def grouped(rows):
        """Rows sorted by what they are called: a group is what stands between two cuts."""
        first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda k: (k == 0) | (rows[k]["f"] != rows[k - 1]["f"]))
        return let(F.concat(first, F.array(F.size(rows))), lambda cuts: F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda g: let(F.slice(rows, cuts[g] + 1, cuts[g + 1] - cuts[g]), group)))

    groups = let(F.array_sort(F.transform("items", lambda x, i: F.struct(folded(x).alias("f"), i.alias("i"), x["label"].alias("label")))), grouped)
    return RuleProvider({"synonyms": lambda: F.to_json(F.struct(groups.alias("groups")))})


def _merged_synonyms(instances, spark, provider, block_rows):
    merged, members, _ = R.merge_synonyms(instances, shop.metamodel(spark)[0], provider, Stages(spark).keep, block_rows=block_rows)
    sizes = members.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_members"))
    return merged.join(sizes, "instance_id").select("instance_id", "class_iri", "label", "n_sources", "n_files", "n_members")


def class_synonyms(spark, sf_dir):
    """Instances merged by the groups a provider names, and their members."""
    label = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, F.lower("p_type")).otherwise(F.concat("p_type", F.lit(" ")))
    parts = table(spark, sf_dir, "part").select(shop.key("part-type", "p_partkey").alias("instance_id"), F.lit(NS + "part-type").alias("class_iri"), label.alias("label"), F.col("p_brand").alias("source"), F.concat(F.lit("f"), F.col("p_size") % 4).alias("file_id"))
    return _merged_synonyms(parts, spark, synonym_rules(1), 200)


def customer_synonyms(spark, sf_dir, block_rows=64):
    """Synonyms of a class of many labels, in many blocks: customers whose numbers
    agree but for their last two digits are called one, so groups reach over blocks."""
    own = table(spark, sf_dir, "customer").select(shop.key("customer", "c_custkey").alias("instance_id"), F.lit(NS + "customer").alias("class_iri"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("source"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("file_id"))
    return _merged_synonyms(own, spark, synonym_rules(-2), block_rows)


CUSTOMER_SYNONYMS = f"""SELECT min('customer:' || c_custkey) AS instance_id, '{NS}customer' AS class_iri, max(c_name) AS label, count(DISTINCT c_mktsegment) AS n_sources, count(DISTINCT c_nationkey) AS n_files, count(*) AS n_members
FROM customer GROUP BY left(c_name, length(c_name) - 2)"""

CLASS_SYNONYMS = f"""
WITH m AS (SELECT 'part-type:' || p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE p_type || ' ' END AS label, p_brand AS source, 'f' || p_size % 4 AS file_id FROM part)
SELECT min(id) AS instance_id, '{NS}part-type' AS class_iri, max(item) AS label, count(DISTINCT source) AS n_sources, count(DISTINCT file_id) AS n_files, count(*) AS n_members
FROM (SELECT *, arg_min(label, id) OVER (PARTITION BY lower(trim(label, ' '))) AS item FROM m) GROUP BY left(lower(trim(label, ' ')), 1)"""

# --- edges ---------------------------------------------------------------------------


def in_nations(spark, sf_dir):
    """Instances placed in files, one file per nation: the nation and its
    customers and suppliers."""
    own = lambda name, tab, k, nation: table(spark, sf_dir, tab).select(shop.key(name, k).alias("instance_id"), F.lit(NS + name).alias("class_iri"), shop.key(name, k).alias("label"), F.concat(F.lit("n"), nation).alias("file_id"))
    return own("nation", "nation", "n_nationkey", "n_nationkey").unionByName(own("customer", "customer", "c_custkey", "c_nationkey")).unionByName(own("supplier", "supplier", "s_suppkey", "s_nationkey"))


_NATIONS = "instances AS (" + " UNION ALL ".join(
    f"SELECT '{n}:' || {k} AS instance_id, '{NS}{n}' AS class_iri, 'n' || {f} AS file_id FROM {t}" for n, t, k, f in (("nation", "nation", "n_nationkey", "n_nationkey"), ("customer", "customer", "c_custkey", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "s_nationkey"))
) + ")"


def edge_requests(spark, sf_dir):
    """The candidate space as requests: blocks of sources by blocks of
    destinations, in every file."""
    asked = R.candidate_requests(in_nations(spark, sf_dir), shop.metamodel(spark)[1])
    return asked.select("file_id", "property_iri", "src_block", "dest_block", F.size("src_items").alias("n_src"), F.size("dest_items").alias("n_dest"), F.col("src_items")[0]["id"].alias("first"))


EDGE_REQUESTS = f"""WITH {_NATIONS}, {shop.PROPERTIES_SQL}, {_block_sql('instance_id', 20, 'file_id, class_iri')},
b AS (SELECT file_id, class_iri, block, count(*)::INT AS n, min(instance_id) AS first FROM placed GROUP BY ALL)
SELECT s.file_id, property_iri, s.block AS src_block, d.block AS dest_block, s.n AS n_src, d.n AS n_dest, s.first FROM props JOIN b s ON s.class_iri = src_class JOIN b d ON d.class_iri = dest_class AND d.file_id = s.file_id"""


def edge_rules() -> RuleProvider:
    """Every source goes to the first destination; some ids are blank or padded.
    Verdicts leave out what the reader fills in."""
    pair = lambda s, d: F.struct(F.concat(F.lit(" "), s, F.lit("\t")).alias("src_id"), d.alias("dest_id"))
    pairs = F.concat(F.transform("src_items", lambda s: pair(s["id"], F.col("dest_items")[0]["id"])), F.array(pair(F.lit("x"), F.lit(" ")), pair(F.lit("x"), F.lit(None).cast("string"))))
    told = lambda x: F.struct(
        x["src_id"].alias("src_id"), x["dest_id"].alias("dest_id"), F.when(F.length(x["src_id"]) % 5 == 0, F.lit(True)).alias("prohibited"), F.repeat(x["src_id"], F.lit(60)).alias("justification"),
        F.when(F.length(x["src_id"]) % 4 != 0, F.length(x["src_id"]) / 16).alias("confidence"),
    )
    return RuleProvider({"edges": lambda: F.to_json(F.struct(pairs.alias("properties"))), "verdicts": lambda: F.to_json(F.struct(F.transform("items", told).alias("relations")))})


def edges_proposed(spark, sf_dir):
    props = shop.metamodel(spark)[1]
    return R.proposed_edges(R.ask_edges(R.candidate_requests(in_nations(spark, sf_dir), props), edge_rules()))


_PROPOSED = f"""{_NATIONS}, {shop.PROPERTIES_SQL}, proposed AS (
  SELECT property_iri, s.instance_id AS src_id, d.instance_id AS dest_id FROM props JOIN instances s ON s.class_iri = src_class JOIN instances d ON d.class_iri = dest_class AND d.file_id = s.file_id)"""
EDGES_PROPOSED = f"WITH {_PROPOSED} SELECT * FROM proposed"


def edge_verdict_blocks(spark, sf_dir):
    """Verdicts asked by blocks of a property, with their cut justification."""
    props = shop.metamodel(spark)[1]
    candidates = Stages(spark).keep("candidates", edges_proposed(spark, sf_dir))
    told = R.verdicts(R.ask_verdicts(candidates, in_nations(spark, sf_dir).select("instance_id", "label"), props, edge_rules()))
    judged = properties.join_verdicts(candidates, told)
    return judged.select("property_iri", "src_id", "dest_id", "prohibited", "confidence", F.length("justification").alias("n"))


EDGE_VERDICT_BLOCKS = f"""WITH {_PROPOSED} SELECT property_iri, src_id, dest_id, length(src_id) % 5 = 0 AS prohibited,
  CASE WHEN length(src_id) % 4 <> 0 THEN length(src_id) / 16.0 ELSE 0.5 END::DOUBLE AS confidence, least(500, 60 * length(src_id))::INT AS n FROM proposed"""

# --- exports -------------------------------------------------------------------------


def nodes_files(spark, sf_dir):
    """Nodes with their files as a list in one field."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("file_ids"))
    return export.nodes_table(rows.select(shop.key("region", "n_regionkey").alias("instance_id"), F.lit(NS + "region").alias("class_iri"), F.lit("r").alias("label"), "file_ids"))


NODES_FILES = f"""SELECT 'region:' || n_regionkey AS "id:ID", '{NS}region' AS iri, 'region' AS ":LABEL", 'r' AS label, string_agg(n_name, ',' ORDER BY n_name) AS file_id FROM nation GROUP BY n_regionkey"""


def nodes_upsert(spark, sf_dir):
    """Customers as versions, one per order, in no order: the last order's version
    stays (ties: the greater label), customers whose last order is open are gone."""
    label = F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string"))
    versions = table(spark, sf_dir, "orders").select(
        shop.key("customer", "o_custkey").alias("instance_id"), F.col("o_orderdate").alias("version"), F.lit(NS + "customer").alias("class_iri"), label.alias("label"), F.lit("").alias("file_id"), (F.col("o_orderstatus") == "O").alias("gone")
    )
    return export.nodes_table(export.upsert_nodes(versions, order="version", deleted="gone"))


NODES_UPSERT = f"""WITH v AS (SELECT o_custkey, o_orderpriority || ' ' || o_orderkey AS label, o_orderstatus = 'O' AS gone,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority || ' ' || o_orderkey DESC) AS r FROM orders)
SELECT 'customer:' || o_custkey AS "id:ID", '{NS}customer' AS iri, 'customer' AS ":LABEL", label, '' AS file_id FROM v WHERE r = 1 AND NOT gone"""


def turtle_document(spark, sf_dir):
    """The Turtle document's blocks: one per subject, in sections."""
    edges = Stages(spark).keep("edges", BASE["property_verdicts"][0](spark, sf_dir).select("property_iri", "src_id", "dest_id"))
    return export.turtle_blocks(export.triples(shop.instances(spark, sf_dir), edges)).withColumn("section", F.col("section").cast("int"))


def _turtle_sql() -> str:
    rows = BASE["turtle_triples"][1]
    section = "CASE WHEN object = 'owl:Class' THEN 1 WHEN object = 'owl:ObjectProperty' THEN 2 WHEN predicate IN ('rdf:type', 'rdfs:label', 'ex:fileId', 'ex:classInstanceId') THEN 3 ELSE 4 END"
    return f"""WITH t AS (SELECT *, {section} AS section, CASE WHEN predicate = 'rdf:type' THEN 'a' ELSE predicate END AS verb FROM ({rows}))
SELECT section::INT AS section, subject, subject || ' ' || string_agg(verb || ' ' || object, ' ;' || chr(10) || '    ' ORDER BY predicate <> 'rdf:type', verb, object) || ' .' AS block FROM t GROUP BY section, subject"""


def csv_round_trip(spark, sf_dir):
    """Nodes with quotes, commas and line ends, written as CSV and read back."""
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    rows = pages.select(shop.key("page", "page_id").alias("instance_id"), F.lit(NS + "page").alias("class_iri"), F.concat(F.lit('a "b", '), F.left("html", F.lit(40)), F.lit("\n x ")).alias("label"), F.lit("").alias("file_id"))
    stages = Stages(spark)
    export.write_csv(export.nodes_table(rows), stages.path("nodes-csv"))
    names = "`id:ID` string, iri string, `:LABEL` string, label string, file_id string"
    back = spark.read.schema(names).options(header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n").csv(stages.path("nodes-csv"))
    return back.select("id:ID", ":LABEL", "label", F.coalesce("file_id", F.lit("")).alias("file_id"))


CSV_ROUND_TRIP = """SELECT 'page:' || page_id AS "id:ID", 'page' AS ":LABEL", 'a "b", ' || left(html, 40) || chr(10) || ' x ' AS label, '' AS file_id FROM pages WHERE html IS NOT NULL"""


def transform_files(spark, sf_dir):
    """Re-flowed lines under their files' names; every third document has none."""
    docs = table(spark, sf_dir, "documents")
    names = docs.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("file_name"))
    return lines.transform_files(lines.text_lines(docs.select("doc_id", "text"), keep_blank=True), names, id_col="doc_id", rules=RULES)


TRANSFORM_FILES = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'f' || doc_id END AS file_name, sent_no, text FROM ({BASE['text_reflow'][1]})"


def summary_files(spark, sf_dir):
    """Instances, edges and files of a run."""
    return export.run_summary(shop.instances(spark, sf_dir), BASE["property_verdicts"][0](spark, sf_dir), files=file_pages(spark, sf_dir).select("file_id").distinct())


SUMMARY_FILES = f"WITH {shop.GRAPH_SQL}, {PAGES_SQL} SELECT (SELECT count(*) FROM instances) AS classes, (SELECT count(*) FROM edges) AS properties, (SELECT count(DISTINCT file_id) FROM pages_of) AS files"


def long_literals(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.sha2(long_literal(F.col("html")), 256).alias("sha"))


LONG_LITERALS = """SELECT page_id, sha256('\"\"\"' || replace(replace(html, '\\', '\\\\'), '"', '\\"') || '\"\"\"') AS sha FROM pages WHERE html IS NOT NULL"""

# --- whole graphs ----------------------------------------------------------------------

M = "http://example.org/notes#"
NOTE_CLASSES = [
    {"iri": M + "amount", "name": "amount", "description": "a number", "view_type": "business_requirement", "prohibit_rules": ["no years"], "extract_rules": ["digits"]},
    {"iri": M + "topic", "name": "topic", "description": "a capitalised word", "view_type": "system_requirement"},
]
NOTE_PROPERTIES = [{"iri": M + "about", "name": "about", "description": "what an amount is about", "src_class": M + "amount", "dest_class": M + "topic"}]


def note_rules() -> RuleProvider:
    """Amounts stand in one view, topics in another.  Amounts of one digit are
    rejected; equal labels of a class are one instance; every pair in a file is an
    edge, and those of long amounts are prohibited."""
    amount, topic = F.regexp_extract("text", "([0-9]+)", 1), F.regexp_extract("text", "([A-Z][a-z]+),", 1)
    item = lambda kind, label: F.array(F.struct(kind.alias("class"), label.alias("label"), F.lit("s").alias("source")))
    amounts = item(F.when(F.length("text") % 11 == 0, "gadget").otherwise("amount"), amount)
    said = F.when(F.col("view_type") == "business_requirement", F.to_json(amounts)).otherwise(F.to_json(item(F.lit("topic"), topic)))
    judged = F.transform("items", lambda x: F.struct(F.when(F.length(x["label"]) < 2, "REJECT").otherwise("ACCEPT").alias("judgment"), F.lit("").alias("justification")))
    pairs = F.flatten(F.transform("src_items", lambda s: F.transform("dest_items", lambda d: F.struct(s["id"].alias("src_id"), d["id"].alias("dest_id")))))
    told = lambda x: F.struct(x["src_id"].alias("src_id"), x["dest_id"].alias("dest_id"), (F.length(x["src_label"]) > 8).alias("prohibited"), F.lit("").alias("justification"), F.lit(0.75).alias("confidence"))
    return RuleProvider({
        **files().rules, "mentions": lambda: F.when(F.length("text") % 13 != 0, said), "judge": lambda: F.to_json(F.struct(judged.alias("judgments"))), "correct": lambda: F.lit("{}"),
        **synonym_rules().rules, "edges": lambda: F.to_json(F.struct(pairs.alias("properties"))), "verdicts": lambda: F.to_json(F.struct(F.transform("items", told).alias("relations"))),
    })


def note_graph(spark, sf_dir) -> build.Graph:
    known, props = metamodel.metamodel_frames(spark, NOTE_CLASSES, NOTE_PROPERTIES)
    return build.build_graph(file_pages(spark, sf_dir), known, props, note_rules(), view_patterns=VIEW_PATTERNS, rules=RULES)


def graph_edges_two_views(spark, sf_dir):
    """Edges between instances found in different views of a file."""
    graph = note_graph(spark, sf_dir)
    label = lambda side: graph.instances.select(F.col("instance_id").alias(f"{side}_id"), F.col("label").alias(side))
    return graph.edges.join(label("src"), "src_id").join(label("dest"), "dest_id").select("property_iri", "src", "dest")


_NOTES = f"""{PAGES_SQL}, {TYPES_SQL}, {spans_sql(_ALL_CHUNKS)},{_KEPT}, o AS ({_ORDERED}),
parts AS (SELECT *, ((sum(length(text) + 1) OVER (PARTITION BY doc_id, view_type ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1) // 8000)::INT AS part FROM o WHERE view_type IN ('business_requirement', 'system_requirement')),
asked AS (SELECT doc_id, view_type, part, string_agg(text, chr(10) ORDER BY ord) AS text FROM parts GROUP BY ALL),
m AS (
  SELECT DISTINCT doc_id, CASE WHEN view_type = 'system_requirement' THEN 'topic' WHEN length(text) % 11 = 0 THEN 'gadget' ELSE 'amount' END AS class,
    CASE WHEN view_type = 'system_requirement' THEN regexp_extract(text, '([A-Z][a-z]+),', 1) ELSE regexp_extract(text, '([0-9]+)', 1) END AS label
  FROM asked WHERE length(text) % 13 <> 0)"""
GRAPH_EDGES = f"""WITH {_NOTES}, own AS (SELECT DISTINCT doc_id, class, lower(trim(label, ' ')) AS k FROM m WHERE class <> 'gadget' AND length(label) >= 2),
heads AS (SELECT class, lower(trim(label, ' ')) AS k, max(label) AS label FROM m WHERE class <> 'gadget' AND length(label) >= 2 GROUP BY ALL)
SELECT DISTINCT '{M}about' AS property_iri, a.label AS src, b.label AS dest FROM own s JOIN own d ON s.doc_id = d.doc_id JOIN heads a ON a.class = s.class AND a.k = s.k JOIN heads b ON b.class = d.class AND b.k = d.k
WHERE s.class = 'amount' AND d.class = 'topic' AND length(a.label) <= 8"""


def graph_errors(spark, sf_dir):
    """What a run leaves as errors, counted."""
    return note_graph(spark, sf_dir).errors.groupBy("stage", "message").agg(F.count(F.lit(1)).alias("n"))


GRAPH_ERRORS = f"""WITH {_NOTES}, e AS (
  SELECT 'classify' AS stage, 'no answer' AS message FROM firsts2 WHERE length(text) % 2 = 0
  UNION ALL SELECT 'classes', 'no answer' FROM asked WHERE length(text) % 13 = 0
  UNION ALL SELECT 'classes', 'unknown class gadget' FROM m WHERE class = 'gadget')
SELECT stage, message, count(*) AS n FROM e GROUP BY ALL"""

CHAINS = {
    "page_scan": (page_scan, PAGE_SCAN), "file_texts": (file_texts, FILE_TEXTS), "collected_lines": (collected_lines, COLLECTED_LINES), "base_names": (base_names, BASE_NAMES),
    "file_types": (file_type_rows, FILE_TYPES), "document_chain": (document_chain, DOCUMENT_CHAIN), "document_chunks": (document_chunks, DOCUMENT_CHUNKS), "file_chunks": (file_chunks, FILE_CHUNKS),
    "line_merge_chunked": (line_merge_chunked, LINE_MERGE_CHUNKED), "stage_latest": (stage_latest, STAGE_LATEST), "view_parse": (view_parse, VIEW_PARSE), "view_nested": (view_nested, VIEW_NESTED),
    "mention_requests": (mention_requests, MENTION_REQUESTS), "mention_rows": (mention_rows, MENTION_ROWS), "message_texts": (message_texts, MESSAGE_TEXTS), "prompts": (prompts, PROMPTS),
    "metamodel_scan": (metamodel_scan, METAMODEL_SCAN), "class_names": (class_names, CLASS_NAMES), "class_judge_blocks": (class_judge_blocks, CLASS_JUDGE_BLOCKS),
    "class_review_blocks": (class_review_blocks, CLASS_LOOP), "class_accepted": (class_accepted, CLASS_ACCEPTED), "class_sections": (class_sections, CLASS_SECTIONS), "class_synonyms": (class_synonyms, CLASS_SYNONYMS), "customer_synonyms": (customer_synonyms, CUSTOMER_SYNONYMS),
    "edge_requests": (edge_requests, EDGE_REQUESTS), "edges_proposed": (edges_proposed, EDGES_PROPOSED), "edge_verdict_blocks": (edge_verdict_blocks, EDGE_VERDICT_BLOCKS),
    "nodes_files": (nodes_files, NODES_FILES), "nodes_upsert": (nodes_upsert, NODES_UPSERT), "csv_round_trip": (csv_round_trip, CSV_ROUND_TRIP), "transform_files": (transform_files, TRANSFORM_FILES), "turtle_document": (turtle_document, _turtle_sql()), "summary_files": (summary_files, SUMMARY_FILES), "long_literals": (long_literals, LONG_LITERALS),
    "graph_edges_two_views": (graph_edges_two_views, GRAPH_EDGES), "graph_errors": (graph_errors, GRAPH_ERRORS),
}
