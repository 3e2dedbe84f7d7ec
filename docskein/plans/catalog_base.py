"""The query catalogue, part 1: text, views, classes, properties and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.functions import text as T
from docskein.functions.iri import local_name, slug, snake_case, stable_id
from docskein.operators import chunks, classes, lines, properties, views
from docskein.plans import shop
from docskein.plans.shop import GRAPH_SQL, INSTANCES_SQL, NS, table
from docskein.sources import export, metamodel
from docskein.sources.stages import Stages

RULES = T.western()
#: Rules by which a sentence belongs to a view, in both engines' syntax.
VIEW_PATTERNS = {
    "value_analysis": "(^|[^a-z])(the|der|la|el)[^a-z]", "business_concept": "(^|[^a-z])(and|und|et|y)[^a-z]", "business_requirement": "[0-9]",
    "system_requirement": "[A-Z][a-z]+,", "system_component": "(^|[^a-z])(de|in|on)[^a-z]", "data_analysis": "[?!]$",
}
S = T.SPACE
_C = "chr(1)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("slide"), "text")
    return lines.slide_lines(df, id_col="conv_id", slide_col="slide")


# --- text --------------------------------------------------------------------


def text_lines(spark, sf_dir):
    return lines.text_lines(_docs(spark, sf_dir))


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '')"
TEXT_LINES = f"SELECT doc_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS text FROM (SELECT doc_id, {_LINES} AS l FROM documents)"


def slide_lines(spark, sf_dir):
    return _slides(spark, sf_dir)


_SLIDES = f"SELECT conv_id, (turn + 1)::INT AS slide_no, unnest(range(len(l)))::INT AS ord, unnest(l) AS text FROM (SELECT conv_id, turn, {_LINES} AS l FROM conversations)"


def line_merge(spark, sf_dir):
    return lines.merge_lines(lines.text_lines(_docs(spark, sf_dir), keep_blank=True), rules=RULES)


_RAW = "SELECT doc_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
def line_merge_sql(raw: str) -> str:
    """Merged lines of rows (doc_id, ord, text)."""
    return f"""
WITH a AS (SELECT doc_id, ord, trim(regexp_replace(replace(text, chr(173), ''), '[ \\t]{{2,}}', ' ', 'g'), chr(13)) AS t FROM ({raw})),
b AS (
  SELECT *, {sql_strip('t')} = '' AS blank, regexp_matches(t, {q(T.BULLET)}) AS item, regexp_matches(t, {q(T.sentence_end(RULES.merge_ends))}) AS ends,
    regexp_matches(t, {q(T.EXCLUDED)}) AS ex FROM a),
c AS (SELECT *, last_value(CASE WHEN blank THEN 'B' WHEN item THEN 'L' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS mode FROM b),
d AS (
  SELECT *, lag(blank) OVER w IS NULL OR lag(blank) OVER w OR item OR (coalesce(lag(mode) OVER w, 'B') <> 'L' AND lag(ends) OVER w) AS begins0,
    coalesce(lag(ex) OVER w, false) AS p_ex FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
e AS (
  SELECT *, ex AND coalesce(last_value(CASE WHEN ex AND NOT p_ex THEN begins0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), false) AS gone FROM d),
f AS (SELECT *, begins0 OR coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY ord), false) AS begins FROM e),
g AS (
  SELECT doc_id, ord, t, sum(begins::INT) OVER w AS g, CASE WHEN NOT begins THEN lag(t) OVER (PARTITION BY doc_id ORDER BY ord) END AS prev,
    coalesce(lead(begins) OVER (PARTITION BY doc_id ORDER BY ord), true) AS last
  FROM f WHERE NOT blank AND NOT gone WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, CASE WHEN last THEN t ELSE regexp_replace(t, '-$', '') END AS body FROM g),
i AS (
  SELECT doc_id, ord, g, CASE WHEN prev IS NULL THEN body WHEN ends_with(prev, '-') THEN regexp_replace(body, '^{S}+', '')
    WHEN regexp_matches(t, '{T.NO_SPACE_BEFORE}') OR regexp_matches(prev, '{T.NO_SPACE_AFTER}') OR ends_with(prev, ' ') OR starts_with(t, ' ') THEN body ELSE ' ' || body END AS piece FROM h)
SELECT doc_id, (g - 1)::INT AS sent_no, regexp_replace(string_agg(piece, '' ORDER BY ord), '{S}+$', '') AS text FROM i GROUP BY doc_id, g
"""


LINE_MERGE = line_merge_sql(_RAW)


def text_reflow(spark, sf_dir):
    return lines.reflow(lines.text_lines(_docs(spark, sf_dir), keep_blank=True), rules=RULES)


TEXT_REFLOW = f"""
WITH a AS (SELECT doc_id, ord, {sql_strip('text')} AS t FROM ({_RAW})),
b AS (SELECT *, t = '' AS blank, regexp_matches(t, {q(T.REFLOW_BULLET)}) AS item FROM a),
c AS (SELECT *, blank OR item OR coalesce(lag(blank OR item) OVER (PARTITION BY doc_id ORDER BY ord), true) AS begins FROM b),
d AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g, CASE WHEN NOT begins THEN lag(t) OVER (PARTITION BY doc_id ORDER BY ord) END AS prev,
    coalesce(lead(begins) OVER (PARTITION BY doc_id ORDER BY ord), true) AS last FROM c),
e AS (SELECT *, CASE WHEN last THEN t ELSE regexp_replace(t, '-$', '') END AS body FROM d WHERE NOT blank),
f AS (
  SELECT doc_id, g, bool_or(item) AS item, string_agg(CASE WHEN prev IS NULL OR ends_with(prev, '-') OR (regexp_matches(prev, {q(T.CJK + '$')}) AND regexp_matches(t, {q('^' + T.CJK)}))
    THEN body ELSE ' ' || body END, '' ORDER BY ord) AS text FROM e GROUP BY doc_id, g),
h AS (
  SELECT doc_id, g, CASE WHEN item THEN [text] ELSE list_filter(list_transform(string_split(regexp_replace(text, {q(f"([{RULES.reflow_ends}]{T.REFLOW_CLOSERS}*)")}, '\\1' || {_C}, 'g'), {_C}),
    lambda x: {sql_strip('x')}), lambda x: x <> '') END AS s FROM f),
k AS (SELECT doc_id, flatten(list(s ORDER BY g)) AS l FROM h GROUP BY doc_id)
SELECT doc_id, unnest(range(len(l)))::INT AS sent_no, unnest(l) AS text FROM k
"""


def sentence_split(spark, sf_dir):
    return chunks.sentences(_docs(spark, sf_dir), rules=RULES)


def sql_sentences(x: str) -> str:
    cut = f"regexp_replace(regexp_replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), '([{RULES.split_ends}]){S}*', '\\1' || {_C}, 'g'), '\\n{{2,}}', {_C}, 'g')"
    return f"list_filter(list_transform(string_split({cut}, {_C}), lambda x: {sql_strip('x')}), lambda x: x <> '')"


SENTENCES = f"SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS text FROM (SELECT doc_id, {sql_sentences('text')} AS l FROM documents)"


def chunk_char(spark, sf_dir):
    return chunks.char_chunks(_docs(spark, sf_dir), rules=RULES)


_FOLD = f"""list_reduce(list_transform({sql_sentences('text')}, lambda s: {{'done': []::VARCHAR[], 'cur': s}}), lambda a, s: CASE
    WHEN length(a.cur) + length(s.cur) + 1 <= {RULES.max_chars} THEN {{'done': a.done, 'cur': {sql_strip("a.cur || ' ' || s.cur")}}}
    ELSE {{'done': CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END, 'cur': {sql_strip(f"right(a.cur, {RULES.overlap_chars}) || ' ' || s.cur")}}} END,
    {{'done': []::VARCHAR[], 'cur': ''}})"""


def chunk_sql(source: str) -> str:
    """Chunks of texts (doc_id, text)."""
    chunked = f"SELECT doc_id, CASE WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END AS l FROM (SELECT doc_id, {_FOLD} AS f FROM {source})"
    return f"SELECT doc_id, unnest(range(len(l)))::INT AS chunk_no, unnest(l) AS text FROM ({chunked})"


CHUNK_CHAR = chunk_sql("documents")


def chunk_page(spark, sf_dir):
    return chunks.slide_chunks(_slides(spark, sf_dir), id_col="conv_id")


CHUNK_PAGE = f"SELECT conv_id, slide_no, string_agg(text, ' ' ORDER BY ord) AS text FROM ({_SLIDES}) GROUP BY ALL"


def route_counts(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.lit("document").alias("file_type")).unionByName(
        table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.lit("presentation").alias("file_type"))
    )
    slides, docs = chunks.route(files)
    return slides.unionByName(docs).groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))


ROUTE_COUNTS = "SELECT 'document' AS file_type, count(*) AS n FROM documents UNION ALL SELECT 'presentation', count(DISTINCT conv_id) FROM conversations"

# --- views -------------------------------------------------------------------


def view_spans_topk(spark, sf_dir):
    return views.view_spans(chunk_char(spark, sf_dir), VIEW_PATTERNS, rules=RULES)


_VIEWS_SQL = "(VALUES " + ", ".join(f"({i}, '{v}', {q(p)})" for i, (v, p) in enumerate(VIEW_PATTERNS.items())) + ") v(vno, view_type, pattern)"
_HITS = "list_filter(s, lambda x: regexp_matches(x, pattern))"


def spans_sql(chunks: str) -> str:
    """Common table ``spans`` over chunks (doc_id, chunk_no, text)."""
    return f"""spans AS (
  SELECT doc_id, chunk_no, vno, view_type, unnest(range(1, len(l) + 1))::INT AS rank, unnest(l) AS text FROM (
    SELECT doc_id, chunk_no, vno, view_type, list_filter(h, lambda x, i: list_position(h, x) = i)[1:3] AS l FROM (
      SELECT doc_id, chunk_no, vno, view_type, {_HITS} AS h FROM (SELECT doc_id, chunk_no, {sql_sentences('text')} AS s FROM ({chunks})) c, {_VIEWS_SQL})))"""


_SPANS = spans_sql(CHUNK_CHAR)
VIEW_SPANS = f"WITH {_SPANS} SELECT doc_id, chunk_no, view_type, rank, text FROM spans"


def view_dedup(spark, sf_dir):
    return views.view_texts_of_any_size(_docs(spark, sf_dir), VIEW_PATTERNS, rules=RULES)


_KEPT = """
firsts AS (SELECT doc_id, view_type, text, min(chunk_no * 10 + rank) AS o FROM spans GROUP BY ALL),
kept AS (SELECT * FROM firsts f WHERE NOT exists (SELECT 1 FROM firsts g WHERE g.doc_id = f.doc_id AND g.view_type = f.view_type AND length(g.text) > length(f.text) AND contains(g.text, f.text)))"""
_DEDUP = f"{_SPANS},{_KEPT}"
_ORDERED = "SELECT doc_id, view_type, (row_number() OVER (PARTITION BY doc_id, view_type ORDER BY o) - 1)::INT AS ord, text FROM kept"
VIEW_DEDUP = f"WITH {_DEDUP} {_ORDERED}"


def view_dedup_spread(spark, sf_dir):
    """The same rows by the way made for giant documents, for every document."""
    return views.view_texts_of_any_size(_docs(spark, sf_dir), VIEW_PATTERNS, giant=0, rules=RULES)


def view_summary(spark, sf_dir):
    return view_dedup(spark, sf_dir).groupBy("view_type").agg(F.count(F.lit(1)).alias("n_texts"))


VIEW_SUMMARY = f"WITH {_DEDUP} SELECT view_type, count(*) AS n_texts FROM kept GROUP BY ALL"

# --- classes -----------------------------------------------------------------


def class_resolve(spark, sf_dir):
    view_of = {c["name"]: c["view_type"] for c in shop.CLASSES}
    pairs = [x for n, v in view_of.items() for x in (F.lit(NS + n), F.lit(v))]
    rows = shop.instances(spark, sf_dir)
    name = F.substring_index("class_iri", "#", -1)
    # Parts whose id ends in 7 name a class that the metamodel lacks.
    unknown = (name == "part-type") & F.col("instance_id").endswith("7")
    rows = rows.select("instance_id", F.create_map(*pairs)[F.col("class_iri")].alias("view_type"), F.when(unknown, "gadget").otherwise(name).alias("class"), "label", "source")
    known, _ = shop.metamodel(spark)
    return classes.resolve_classes(rows, known).select("instance_id", "class_iri", "label")


CLASS_RESOLVE = f"WITH {INSTANCES_SQL} SELECT instance_id, CASE WHEN source = 'part' AND instance_id LIKE '%7' THEN '' ELSE class_iri END AS class_iri, label FROM instances WHERE label IS NOT NULL"


def class_policy_text(spark, sf_dir):
    known, _ = shop.metamodel(spark)
    return metamodel.render_definitions(known).join(metamodel.render_policies(known), "view_type")


_CLASSES_SQL = "(VALUES " + ", ".join(
    f"({i}, {q(c['name'])}, {q(c['description'])}, {q(c['view_type'])}, {c['min_length']}, {c['max_length']}, [{', '.join(map(q, c['extract_rules']))}]::VARCHAR[])" for i, c in enumerate(shop.CLASSES)
) + ") c(o, name, description, view_type, lo, hi, rules)"
CLASS_POLICY = f"""SELECT view_type, string_agg('- ' || name || ': ' || description, chr(10) ORDER BY o) AS definitions,
  string_agg('- ' || name || chr(10) || '  - 文字数: ' || lo || '～' || hi || '字' || array_to_string(list_transform(rules, lambda r: chr(10) || '  - ' || r), ''), chr(10) ORDER BY o) AS policies
FROM {_CLASSES_SQL} GROUP BY view_type"""


def class_judge(spark, sf_dir):
    judged = classes.judge(shop.instances(spark, sf_dir), shop.rules())
    return judged.groupBy("class_iri", "judgment").agg(F.count(F.lit(1)).alias("n"))


_LIMITS = f"limits AS (SELECT '{NS}' || name AS class_iri, lo, hi FROM {_CLASSES_SQL})"
_VERDICT = "CASE WHEN length({0}) < lo THEN 'REJECT' WHEN length({0}) > hi THEN 'REVIEW' ELSE 'ACCEPT' END"
CLASS_JUDGE = f"WITH {INSTANCES_SQL}, {_LIMITS} SELECT class_iri, {_VERDICT.format('label')} AS judgment, count(*) AS n FROM instances JOIN limits USING (class_iri) GROUP BY ALL"


def class_correct_loop(spark, sf_dir):
    done = classes.review_loop(shop.instances(spark, sf_dir).select("instance_id", "class_iri", "label"), shop.rules())
    return done.select("instance_id", "label", "judgment", "rounds")


def _loop_sql() -> str:
    out = [f"r0 AS (SELECT instance_id, label, lo, hi, {_VERDICT.format('label')} AS j, 0 AS rounds FROM instances JOIN limits USING (class_iri))"]
    for k in (1, 2, 3):
        short = "regexp_replace(label, ' [^ ]*$', '')"
        out.append(
            f"""r{k} AS (SELECT instance_id, CASE WHEN j = 'REVIEW' AND contains(label, ' ') AND {short} <> '' THEN {short} ELSE label END AS label, lo, hi,
  CASE WHEN j <> 'REVIEW' THEN j WHEN NOT contains(label, ' ') THEN 'REJECT' ELSE {_VERDICT.format(f"CASE WHEN {short} <> '' THEN {short} ELSE label END")} END AS j,
  CASE WHEN j = 'REVIEW' THEN {k} ELSE rounds END AS rounds FROM r{k - 1})"""
        )
    return ", ".join(out)


CLASS_LOOP = f"WITH {INSTANCES_SQL}, {_LIMITS}, {_loop_sql()} SELECT instance_id, label, CASE WHEN j = 'REVIEW' THEN 'ACCEPT' ELSE j END AS judgment, rounds FROM r3"


def class_consolidate(spark, sf_dir):
    label = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, F.lower("p_type")).otherwise(F.concat("p_type", F.lit(" ")))
    parts = table(spark, sf_dir, "part").select(shop.key("part-type", "p_partkey").alias("instance_id"), F.lit(NS + "part-type").alias("class_iri"), label.alias("label"), F.col("p_brand").alias("source"), F.lit("part").alias("file_id"), F.col("p_partkey").alias("ord"))
    suppliers = table(spark, sf_dir, "supplier").select(
        shop.key("supplier", "s_suppkey").alias("instance_id"), F.lit(NS + "supplier").alias("class_iri"), F.col("s_name").alias("label"), F.col("s_nationkey").cast("string").alias("source"), F.lit("supplier").alias("file_id"), F.col("s_suppkey").alias("ord")
    )
    merged, _ = classes.consolidate(parts.unionByName(suppliers), F.lower(F.trim("label")))
    return merged.select("class_iri", "label", "n_sources", F.col("instance_id").alias("first_id"))


CLASS_CONSOLIDATE = f"""
WITH m AS (
  SELECT 'part-type:' || p_partkey AS id, '{NS}part-type' AS class_iri, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE p_type || ' ' END AS label, p_brand AS source, p_partkey AS o FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, '{NS}supplier', s_name, s_nationkey::VARCHAR, s_suppkey FROM supplier)
SELECT class_iri, arg_min(label, o) AS label, count(DISTINCT source) AS n_sources, arg_min(id, o) AS first_id FROM m GROUP BY class_iri, lower(trim(label, ' '))
"""

# --- properties --------------------------------------------------------------


def property_blocks(spark, sf_dir):
    few = shop.instances(spark, sf_dir).where(F.col("class_iri").isin(NS + "nation", NS + "region", NS + "customer"))
    return properties.candidate_blocks(few, shop.metamodel(spark)[1])


PROPERTY_BLOCKS = f"""
WITH {INSTANCES_SQL}, {shop.PROPERTIES_SQL},
b AS (SELECT class_iri, ((row_number() OVER (PARTITION BY class_iri ORDER BY instance_id) - 1) // 20)::INT AS block FROM instances WHERE source IN ('nation', 'region', 'customer')),
s AS (SELECT class_iri, block, count(*) AS n FROM b GROUP BY ALL)
SELECT property_iri, x.block AS src_block, y.block AS dest_block, (x.n * y.n)::BIGINT AS n_pairs
FROM props JOIN s x ON x.class_iri = src_class JOIN s y ON y.class_iri = dest_class
"""


def property_block_ranges(spark, sf_dir):
    """The candidate space of every property, over all instances."""
    return properties.candidate_ranges(shop.instances(spark, sf_dir), shop.metamodel(spark)[1])


PROPERTY_BLOCK_RANGES = f"""
WITH {INSTANCES_SQL}, {shop.PROPERTIES_SQL},
b AS (SELECT class_iri, ((row_number() OVER (PARTITION BY class_iri ORDER BY instance_id) - 1) // 20)::INT AS block FROM instances),
s AS (SELECT class_iri, block, count(*) AS n FROM b GROUP BY ALL),
d AS (SELECT class_iri, max(block) AS last_dest_block, arg_max(n, block) AS n_last_dest, sum(n) AS n FROM s GROUP BY ALL)
SELECT property_iri, s.block AS src_block, s.n AS n_src, last_dest_block, n_last_dest, (s.n * d.n)::BIGINT AS n_pairs
FROM props JOIN s ON s.class_iri = src_class JOIN d ON d.class_iri = dest_class
"""


def property_candidates(spark, sf_dir):
    return properties.candidates_from_links(shop.links(spark, sf_dir), shop.instances(spark, sf_dir), shop.metamodel(spark)[1])


PROPERTY_CANDIDATES = f"WITH {INSTANCES_SQL}, {shop.LINKS_SQL}, {shop.PROPERTIES_SQL}, {shop.CANDIDATES_SQL} SELECT * FROM candidates"


def property_verdicts(spark, sf_dir):
    judged = properties.join_verdicts(property_candidates(spark, sf_dir), shop.verdicts(spark, sf_dir))
    return properties.accept_edges(judged).select("property_iri", "src_id", "dest_id", "confidence")


PROPERTY_VERDICTS = f"WITH {GRAPH_SQL} SELECT property_iri, src_id, dest_id, confidence FROM edges"
#: Edges that must fail, from the first customers: (property, source, destination).
BAD = [
    ("customerIn", "concat('customer:x', c_custkey)", "'nation:1'"), ("customerIn", "concat('customer:', c_custkey)", "concat('nation:', c_custkey + 900)"),
    ("likes", "concat('customer:', c_custkey)", "'nation:1'"), ("inRegion", "concat('customer:', c_custkey)", "'region:1'"), ("customerIn", "concat('customer:', c_custkey)", "'region:1'"),
]


def property_validate(spark, sf_dir):
    few = table(spark, sf_dir, "customer").where("c_custkey < 20")
    edges = property_verdicts(spark, sf_dir).select("property_iri", "src_id", "dest_id")
    for p, s, d in BAD:
        edges = edges.unionByName(few.select(F.lit(NS + p).alias("property_iri"), F.expr(s).alias("src_id"), F.expr(d).alias("dest_id")))
    told = properties.validate_edges(edges, shop.instances(spark, sf_dir), shop.metamodel(spark)[1])
    return told.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


PROPERTY_VALIDATE = f"""
WITH {GRAPH_SQL}, every AS (SELECT property_iri, src_id, dest_id FROM edges {' '.join(f"UNION ALL SELECT '{NS}{p}', {s}, {d} FROM customer WHERE c_custkey < 20" for p, s, d in BAD)})
SELECT CASE WHEN s.instance_id IS NULL THEN 'source missing' WHEN d.instance_id IS NULL THEN 'destination missing' WHEN p.property_iri IS NULL THEN 'property undefined'
  WHEN s.class_iri <> p.src_class THEN 'source class differs' WHEN d.class_iri <> p.dest_class THEN 'destination class differs' ELSE 'valid' END AS reason, count(*) AS n
FROM every e LEFT JOIN instances s ON s.instance_id = e.src_id LEFT JOIN instances d ON d.instance_id = e.dest_id LEFT JOIN props p ON p.property_iri = e.property_iri GROUP BY ALL
"""


def label_enrich(spark, sf_dir):
    named = properties.enrich_labels(property_verdicts(spark, sf_dir), shop.instances(spark, sf_dir))
    return named.select("src_label", "property_iri", "dest_label")


LABEL_ENRICH = f"""WITH {GRAPH_SQL} SELECT coalesce(s.label, src_id) AS src_label, property_iri, coalesce(d.label, dest_id) AS dest_label
FROM edges LEFT JOIN instances s ON s.instance_id = src_id LEFT JOIN instances d ON d.instance_id = dest_id"""

# --- names and exports ---------------------------------------------------------

IRIS = ["http://h/a#b", "http://h/a/b/", "ex:b", "plain", "http://h/x#y-z", "a#b#c"]


def local_names(spark, sf_dir):
    iris = table(spark, sf_dir, "pages").select(F.col("url").alias("iri")).unionByName(spark.createDataFrame([(i,) for i in IRIS], "iri string"))
    name = local_name(F.col("iri"))
    return iris.select("iri", name.alias("local_name"), snake_case(name).alias("snake"))


_LOCAL = "CASE WHEN contains(iri, '#') THEN string_split(iri, '#')[-1] WHEN contains(iri, '/') THEN string_split(rtrim(iri, '/'), '/')[-1] WHEN contains(iri, ':') THEN string_split(iri, ':')[-1] ELSE iri END"
LOCAL_NAMES = f"SELECT iri, {_LOCAL} AS local_name, replace({_LOCAL}, '-', '_') AS snake FROM (SELECT url AS iri FROM pages UNION ALL SELECT unnest([{', '.join(map(q, IRIS))}]))"


def slugs(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("label")))
    labels = labels.unionByName(spark.createDataFrame([("  Größe und\tWert ",), ("***",), ("",), ("価値 と 目的",)], "label string"))
    return labels.select("label", slug(F.col("label")).alias("slug"))


def sql_slug(x: str) -> str:
    from docskein.functions.iri import SLUG_ALPHABET

    flat = f"left(trim(regexp_replace(regexp_replace({sql_strip(f'''regexp_replace({x}, '{S}+', ' ', 'g')''')}, '[^{SLUG_ALPHABET}]', '-', 'g'), '-{{2,}}', '-', 'g'), '-'), 48)"
    return f"CASE WHEN {flat} = '' THEN left(sha256({x}), 8) ELSE {flat} END"


SLUGS = f"SELECT label, {sql_slug('label')} AS slug FROM (SELECT p_name AS label FROM part UNION ALL SELECT url FROM pages UNION ALL SELECT unnest(['  Größe und' || chr(9) || 'Wert ', '***', '', '価値 と 目的']))"


def nodes_export(spark, sf_dir):
    return export.nodes_table(shop.instances(spark, sf_dir))


NODES = f"""WITH {INSTANCES_SQL} SELECT instance_id AS "id:ID", class_iri AS iri, replace(string_split(class_iri, '#')[-1], '-', '_') AS ":LABEL", label, file_id FROM instances"""


def relationships_export(spark, sf_dir):
    return export.relationships_table(property_verdicts(spark, sf_dir))


RELATIONSHIPS = f"""WITH {GRAPH_SQL} SELECT src_id AS ":START_ID", dest_id AS ":END_ID", string_split(property_iri, '#')[-1] AS ":TYPE", property_iri,
  sha256(src_id || chr(2) || property_iri || chr(2) || dest_id) AS id FROM edges"""


def turtle_triples(spark, sf_dir):
    # Edges are read for their properties and for their ends: they are made once.
    edges = Stages(spark).keep("edges", property_verdicts(spark, sf_dir).select("property_iri", "src_id", "dest_id"))
    return export.triples(shop.instances(spark, sf_dir), edges).drop("section")


def _quoted(x: str) -> str:
    return f"""'"' || replace(replace(replace(replace({x}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r') || '"'"""


TRIPLES = f"""
WITH {GRAPH_SQL}, own AS (SELECT *, '<{export.BASE}#instance/' || {sql_slug('label')} || '-' || left(sha256(instance_id), 8) || '>' AS node FROM instances)
SELECT DISTINCT '<' || class_iri || '>' AS subject, 'rdf:type' AS predicate, 'owl:Class' AS object FROM own
UNION ALL SELECT DISTINCT '<' || property_iri || '>', 'rdf:type', 'owl:ObjectProperty' FROM edges
UNION ALL SELECT node, 'rdf:type', '<' || class_iri || '>' FROM own
UNION ALL SELECT node, 'rdfs:label', {_quoted('label')} || '@ja' FROM own
UNION ALL SELECT node, 'ex:fileId', {_quoted('file_id')} FROM own
UNION ALL SELECT node, 'ex:classInstanceId', {_quoted('instance_id')} FROM own
UNION ALL SELECT s.node, '<' || property_iri || '>', d.node FROM edges JOIN own s ON s.instance_id = src_id JOIN own d ON d.instance_id = dest_id
"""


def run_summary(spark, sf_dir):
    return export.run_summary(shop.instances(spark, sf_dir), property_verdicts(spark, sf_dir))


RUN_SUMMARY = f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM instances) AS classes, (SELECT count(*) FROM edges) AS properties"


def document_ids(spark, sf_dir):
    """Stable ids of files and their lines: equal on every run."""
    df = lines.text_lines(_docs(spark, sf_dir))
    return df.select("doc_id", "ord", stable_id(F.col("doc_id"), F.col("ord"), F.col("text")).alias("line_id"))


DOCUMENT_IDS = f"SELECT doc_id, ord, sha256(doc_id || chr(2) || ord || chr(2) || text) AS line_id FROM ({TEXT_LINES})"

BASE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "text_lines": (text_lines, TEXT_LINES), "slide_lines": (slide_lines, _SLIDES), "line_merge": (line_merge, LINE_MERGE), "text_reflow": (text_reflow, TEXT_REFLOW),
    "sentence_split": (sentence_split, SENTENCES), "chunk_char": (chunk_char, CHUNK_CHAR), "chunk_page": (chunk_page, CHUNK_PAGE), "route_counts": (route_counts, ROUTE_COUNTS),
    "view_spans_topk": (view_spans_topk, VIEW_SPANS), "view_dedup": (view_dedup, VIEW_DEDUP), "view_dedup_spread": (view_dedup_spread, VIEW_DEDUP), "view_summary": (view_summary, VIEW_SUMMARY),
    "class_resolve": (class_resolve, CLASS_RESOLVE), "class_policy_text": (class_policy_text, CLASS_POLICY), "class_judge": (class_judge, CLASS_JUDGE),
    "class_correct_loop": (class_correct_loop, CLASS_LOOP), "class_consolidate": (class_consolidate, CLASS_CONSOLIDATE), "property_blocks": (property_blocks, PROPERTY_BLOCKS), "property_block_ranges": (property_block_ranges, PROPERTY_BLOCK_RANGES),
    "property_candidates": (property_candidates, PROPERTY_CANDIDATES), "property_verdicts": (property_verdicts, PROPERTY_VERDICTS), "property_validate": (property_validate, PROPERTY_VALIDATE),
    "label_enrich": (label_enrich, LABEL_ENRICH), "local_names": (local_names, LOCAL_NAMES), "slug": (slugs, SLUGS), "nodes_export": (nodes_export, NODES),
    "relationships_export": (relationships_export, RELATIONSHIPS), "turtle_triples": (turtle_triples, TRIPLES), "run_summary": (run_summary, RUN_SUMMARY), "document_ids": (document_ids, DOCUMENT_IDS),
}

