"""Requests to a provider, group by group, and what their answers mean.

A request is one row: what the decision is about, and the filled prompt.  The
provider adds ``payload`` (JSON).  Groups are cut into blocks of bounded size, so
no row grows with a class, a property or a document.  Answers are exploded into
rows; an answer that is missing or unreadable is a row of errors (file_id,
stage, message), never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions.iri import stable_id
from docskein.functions.text import strip
from docskein.operators import classes as C
from docskein.operators import views as V
from docskein.operators.check import require
from docskein.operators.joins import components, hot_join, ranked
from docskein.prompts import template
from docskein.sources.metamodel import render_definitions, render_policies, render_rules
from docskein.sources.pages import first_pages
from docskein.sources.stages import Stages

JUDGMENTS = f"judgments array<struct<{', '.join(': '.join(f.split(' ', 1)) for f in C.JUDGMENT.split(', '))}>>"
CORRECTIONS = f"corrections array<struct<{', '.join(': '.join(f.split(' ', 1)) for f in C.CORRECTION.split(', '))}>>"
MENTIONS = "array<struct<class: string, label: string, source: string>>"
SPANS = ", ".join(f"{v} array<string>" for v in V.VIEWS)
GROUPS = "groups array<struct<indices: array<int>, canonical_label: string, reason: string>>"
PAIRS = "properties array<struct<src_id: string, dest_id: string>>"
RELATIONS = "relations array<struct<src_id: string, dest_id: string, prohibited: boolean, justification: string, confidence: double>>"


def fill(template_text: str, /, **columns: Column) -> Column:
    """The template with every ``{name}`` replaced by its column; other braces
    stay.  It is read in one pass: what a column holds is not looked at again."""
    parts: list[Column] = []
    for piece in re.split("(" + "|".join(re.escape("{" + n + "}") for n in columns) + ")", template_text):
        name = piece[1:-1]
        known = piece.startswith("{") and piece.endswith("}") and name in columns
        parts.append(F.coalesce(columns[name].cast("string"), F.lit("")) if known else F.lit(piece))
    return F.concat(*parts)


def numbered(items: Column, line) -> Column:
    """A line ``[i] ...`` for each item, counted from 0."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), line(x))), "\n")


def message_text(message: Column) -> Column:
    """A model's message as text: a string as it is; of a JSON list of parts the
    first text (types text and output_text); null without one."""
    parts = F.from_json(message, "array<struct<type: string, text: string>>")
    texts = F.filter(parts, lambda p: p["type"].isin("text", "output_text") & p["text"].isNotNull())
    listed = F.startswith(F.ltrim(message), F.lit("[")) & parts.isNotNull() & F.exists(parts, lambda p: p["type"].isNotNull())
    return F.when(F.coalesce(listed, F.lit(False)), F.get(texts, F.lit(0))["text"]).otherwise(message)


def _ask(requests: DataFrame, provider, kind: str, keys: list[str], **columns: Column) -> DataFrame:
    return provider.attach(kind, requests.withColumn("prompt", fill(template(kind), **columns)), [*keys, "prompt"])


def unanswered(answers: DataFrame, stage: str, ddl: str, fields: list[str] | None = None) -> DataFrame:
    """Errors of requests without a payload that ``ddl`` reads: a list, or an
    object with one of ``fields`` (default: the first of ``ddl``)."""
    told = F.from_json("payload", ddl)
    there = [told] if ddl.startswith("array") else [told[f] for f in fields or [ddl.split(" ", 1)[0]]]
    readable = F.col("payload").isNotNull() & F.coalesce(*[F.when(x.isNotNull(), True) for x in there], F.lit(False))
    who = F.col("file_id") if "file_id" in answers.columns else F.lit(None)
    missing = F.concat_ws(": ", F.lit("no answer"), *(["cause"] if "cause" in answers.columns else []))
    return answers.where(~readable).select(who.cast("string").alias("file_id"), F.lit(stage).alias("stage"), F.when(F.col("payload").isNull(), missing).otherwise("unreadable answer").alias("message"))


# --- files and views -----------------------------------------------------------


def ask_file_types(pages: DataFrame, provider) -> DataFrame:
    """A request per file about its first two pages (keys: text)."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    df = first_pages(pages).groupBy("file_id").agg(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"))
    return _ask(df, provider, "file_type", ["text"], text=F.col("text"))


def file_types(answers: DataFrame) -> DataFrame:
    """(file_id, file_type): presentation where the answer says so, else document."""
    told = F.from_json("payload", "is_presentation boolean, justification string")["is_presentation"]
    return answers.select("file_id", F.when(F.coalesce(told, F.lit(False)), "presentation").otherwise("document").alias("file_type"))


def ask_views(chunks: DataFrame, provider) -> DataFrame:
    """A request per chunk for its passages by view (keys: text)."""
    return _ask(require(chunks, "text"), provider, "views", ["text"], text=F.col("text"), views=F.lit(", ".join(V.VIEWS)))


# --- mentions ------------------------------------------------------------------


def ask_mentions(view_texts: DataFrame, known: DataFrame, provider, *, id_col: str = "file_id", request_chars: int = 8000) -> DataFrame:
    """Requests per document and view (keys: view_type, text): its texts, a line
    each, in as many requests of about ``request_chars`` as they need."""
    require(view_texts, id_col, "view_type", "ord", "text")
    place = Window.partitionBy(id_col, "view_type").orderBy("ord")
    df = view_texts.withColumn("part", F.floor((F.sum(F.length("text") + 1).over(place.rowsBetween(Window.unboundedPreceding, 0)) - 1) / request_chars).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    df = df.groupBy(id_col, "view_type", "part").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    df = df.join(render_definitions(known), "view_type").join(render_policies(known), "view_type")
    asked = _ask(df, provider, "mentions", ["view_type", "text"], text=F.col("text"), definitions=F.col("definitions"), policies=F.col("policies"))
    return asked.drop("definitions", "policies", "prompt")


def mentions(answers: DataFrame, known: DataFrame, *, id_col: str = "file_id") -> DataFrame:
    """(file_id, view_type, class, label, source, class_iri, instance_id): items
    with all three fields, each distinct one once."""
    found = answers.select(F.col(id_col).cast("string").alias("file_id"), "view_type", F.explode(F.from_json("payload", MENTIONS)).alias("m")).select("file_id", "view_type", "m.*")
    found = C.resolve_classes(found, known)
    return found.withColumn("instance_id", stable_id("file_id", "view_type", "class", "label", "source")).dropDuplicates(["instance_id"])


# --- judgments -------------------------------------------------------------------


def _blocks(instances: DataFrame, fields: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, one row per block with its items in order)."""
    rows = C.number_in_blocks(instances, block_rows=block_rows)
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return rows, rows.groupBy("class_iri", "block").agg(items.alias("items"))


def ask_judgments(instances: DataFrame, known: DataFrame, provider, *, block_rows: int = 200) -> DataFrame:
    """Requests per class block (keys: class_iri, items with labels)."""
    _, blocks = _blocks(instances, ["label"], block_rows)
    rules = render_rules(known, key="iri", rules="prohibit_rules", empty="(none)").withColumnsRenamed({"iri": "class_iri", "text": "rules"})
    df = C.class_names(blocks, known).join(rules.dropDuplicates(["class_iri"]), "class_iri", "left")
    items = numbered(F.col("items"), lambda x: x["label"])
    return _ask(df, provider, "judge", ["class_iri", "items"], class_name=F.col("class_name"), rules=F.col("rules"), items=items).drop("rules", "prompt")


def judged(instances: DataFrame, answers: DataFrame, *, block_rows: int = 200) -> DataFrame:
    """``instances`` with judgment and justification, by place in their block.
    Rows beyond a list's end get none of their own: they are rejected, as are
    rows of blocks without a readable answer."""
    rows, _ = _blocks(instances.drop("judgment", "justification"), ["label"], block_rows)
    told = answers.select("class_iri", "block", F.posexplode(F.from_json("payload", JUDGMENTS)["judgments"]).alias("pos", "item"))
    out = rows.join(told, ["class_iri", "block", "pos"], "left")
    return out.withColumns({"judgment": F.coalesce(F.col("item")["judgment"], F.lit(C.REJECT)), "justification": F.left(F.col("item")["justification"], F.lit(500))}).drop("block", "pos", "item")


def ask_corrections(instances: DataFrame, known: DataFrame, provider, *, block_rows: int = 200) -> DataFrame:
    """Requests per class block of REVIEW rows (label, source, justification)."""
    _, blocks = _blocks(instances, ["label", "source", "justification"], block_rows)
    rules = render_rules(known, key="iri", rules="extract_rules", empty="(none)").withColumnsRenamed({"iri": "class_iri", "text": "rules"})
    df = C.class_names(blocks, known).join(rules.dropDuplicates(["class_iri"]), "class_iri", "left")
    items = numbered(F.col("items"), lambda x: F.concat_ws(" | ", x["label"], x["source"], x["justification"]))
    return _ask(df, provider, "correct", ["class_iri", "items"], class_name=F.col("class_name"), rules=F.col("rules"), items=items).drop("rules", "prompt")


def corrected(review: DataFrame, answers: DataFrame, round_no: int, *, block_rows: int = 200) -> DataFrame:
    """REVIEW rows with their new labels; rejected ones and rows without an
    answer become REJECT, rows with an empty label stay as they are."""
    rows, _ = _blocks(review, ["label"], block_rows)
    told = answers.select("class_iri", "block", F.posexplode(F.from_json("payload", CORRECTIONS)["corrections"]).alias("pos", "item"))
    out = rows.join(told, ["class_iri", "block", "pos"], "left")
    bad = F.col("item").isNull() | F.coalesce(F.col("item")["should_reject"], F.lit(False))
    label = F.coalesce(F.col("item")["revised_label"], F.lit(""))
    return out.withColumns({
        "label": F.when(~bad & (label != ""), label).otherwise(F.col("label")),
        "judgment": F.when(bad, C.REJECT).otherwise(F.col("judgment")), "rounds": F.lit(round_no),
    }).drop("block", "pos", "item")


def review(instances: DataFrame, known: DataFrame, provider, keep, *, rounds: int = 3, block_rows: int = 200) -> tuple[DataFrame, DataFrame]:
    """(judged instances with ``rounds``, errors): the loop of ``review_loop`` with
    a request per class block.  ``keep(name, df)`` writes a table down: every
    request is made once.  A round without a REVIEW row ends the loop."""
    asked = keep("judge-0", ask_judgments(instances, known, provider, block_rows=block_rows))
    done = keep("judged-0", judged(instances, asked, block_rows=block_rows).withColumn("rounds", F.lit(0)))
    errors = unanswered(asked, "classes", JUDGMENTS)
    settled = [done.where(F.col("judgment") != C.REVIEW)]
    open_ = done.where(F.col("judgment") == C.REVIEW)
    for k in range(1, rounds + 1):
        if open_.isEmpty():
            break
        fixed_by = keep(f"correct-{k}", ask_corrections(open_, known, provider, block_rows=block_rows))
        fixed = keep(f"corrected-{k}", corrected(open_, fixed_by, k, block_rows=block_rows))
        again = fixed.where(F.col("judgment") == C.REVIEW)
        asked = keep(f"judge-{k}", ask_judgments(again, known, provider, block_rows=block_rows))
        done = keep(f"judged-{k}", judged(again, asked, block_rows=block_rows))
        errors = errors.unionByName(unanswered(fixed_by, "classes", CORRECTIONS)).unionByName(unanswered(asked, "classes", JUDGMENTS))
        settled += [fixed.where(F.col("judgment") != C.REVIEW), done.where(F.col("judgment") != C.REVIEW)]
        open_ = done.where(F.col("judgment") == C.REVIEW)
    note = F.concat(F.lit(f"Accepted after {rounds} reviews. "), F.coalesce("justification", F.lit("")))
    out = open_.withColumns({"justification": note, "judgment": F.lit(C.ACCEPT)})
    for df in settled:
        out = out.unionByName(df)
    return out, errors


# --- synonyms ----------------------------------------------------------------------

# Orders in which labels that may mean the same stand near each other: as written,
# from behind, by their words whatever their order, by their consonants, and by the
# least hashes of their three-letter grams (near copies share one).
LABEL_ORDERS: dict[str, Callable[[Column], Column]] = {
    "label": lambda x: x,
    "behind": F.reverse,
    "words": lambda x: F.array_join(F.array_sort(F.split(x, " ")), " "),
    "frame": lambda x: F.concat(F.left(x, F.lit(1)), F.regexp_replace(x, r"[aeiou\W_]", "")),
    "grams": lambda x: F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.hex(F.xxhash64(F.substring(x, i, F.lit(3))))))), 1, 4), ""),
}


def _label_blocks(items: DataFrame, block_rows: int, orders: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(class_iri, block, pos, node, label, whole): blocks of at most ``block_rows``
    items.  In each order a class is cut into blocks that overlap by half, so
    neighbours always meet; a class that fits a block is one (``whole``)."""
    half = max(1, block_rows // 2)
    sizes = items.groupBy("class_iri").agg(F.count(F.lit(1)).alias("n"))
    sized = C.join_sizes(items, sizes, "class_iri")
    out = sized.where(F.col("n") <= 2 * half).select("class_iri", F.lit("all").alias("block"), "node", "label", F.col("_folded").alias("_key"), F.lit(True).alias("whole"))
    large = sized.where(F.col("n") > 2 * half)
    if not large.isEmpty():
        for name, order in orders.items():
            placed = ranked(large.withColumn("_key", order(F.col("_folded"))), ["class_iri"], ["_key", "node"])
            first = F.floor(F.col("rank") / half)
            # A last block whose items all stand in the one before is none.
            numbers = F.filter(F.array(first - 1, first), lambda j: (j == 0) | ((j > 0) & (F.col("n") > (j + 1) * half)))
            out = out.unionByName(placed.withColumn("j", F.explode(numbers)).select("class_iri", F.concat(F.lit(f"{name} "), F.col("j").cast("string")).alias("block"), "node", "label", "_key", F.lit(False).alias("whole")))
    place = F.row_number().over(Window.partitionBy("class_iri", "block").orderBy("_key", "node")) - 1
    return out.select("class_iri", "block", place.alias("pos"), "node", "label", "whole")


def label_items(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, items): rows of a class whose labels agree without case and outer
    spaces are one item, with the least instance_id as node and its label."""
    folded = instances.withColumn("_folded", F.lower(F.trim(F.coalesce("label", F.lit("")))))
    items = folded.groupBy("class_iri", "_folded").agg(F.min("instance_id").alias("node"), F.min_by("label", "instance_id").alias("label"))
    return folded, items


def ask_synonyms(items: DataFrame, known: DataFrame, provider, *, block_rows: int = 200, orders: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, requests): requests per block of two labels or more; keys class_iri,
    items with labels.  The prompt has the class's extraction and prohibition rules."""
    placed = _label_blocks(items, block_rows, LABEL_ORDERS if orders is None else orders)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: F.struct(x["label"].alias("label")))
    blocks = placed.groupBy("class_iri", "block").agg(listed.alias("items"), F.first("whole").alias("whole")).where(F.size("items") >= 2)
    both = known.select("iri", F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("extract_rules", "prohibit_rules")]).alias("rules"))
    rules = render_rules(both, rules="rules").withColumnsRenamed({"iri": "class_iri", "text": "rules"}).dropDuplicates(["class_iri"])
    df = C.class_names(blocks, known).join(F.broadcast(rules), "class_iri", "left")
    asked = _ask(df, provider, "synonyms", ["class_iri", "items"], class_name=F.col("class_name"), rules=F.coalesce("rules", F.lit("")), items=numbered(F.col("items"), lambda x: x["label"]))
    return placed, asked.drop("prompt", "rules")


def named_groups(placed: DataFrame, answers: DataFrame) -> DataFrame:
    """(class_iri, block, whole, g, node, label, canonical): the items of each group
    that an answer names.  Indices beyond the block or below 0 are passed over; an
    index named twice belongs to the first group that names it."""
    told = answers.select("class_iri", "block", F.posexplode(F.from_json("payload", GROUPS)["groups"]).alias("g", "group"))
    named = told.select("class_iri", "block", "g", F.col("group")["canonical_label"].alias("canonical"), F.explode(F.col("group")["indices"]).alias("pos"))
    firsts = named.groupBy("class_iri", "block", "pos").agg(F.min(F.struct("g", "canonical")).alias("n")).select("class_iri", "block", "pos", "n.g", "n.canonical")
    return placed.join(firsts, ["class_iri", "block", "pos"]).select("class_iri", "block", "whole", "g", "node", "label", "canonical")


def merge_synonyms(instances: DataFrame, known: DataFrame, provider, keep, *, block_rows: int = 200, orders: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instances, members, errors): instances of a class that the provider calls one.

    Labels meet in blocks of bounded size, in several orders.  What any answer
    groups is one, and so is what several answers link: groups are the components
    of all of them, so the same labels come together whatever ``block_rows`` is, if
    neighbours in some order lead from one to the other.  Where a class needed more
    than one block and groups joined, the heads of its groups meet again, closer
    to each other than before, until nothing joins.

    A group takes the id of its first row (least instance_id).  Its label is the
    greatest of the canonical labels named for it that are labels of its own, else
    the first row's.  Rows that no group names stand alone."""
    folded, items = label_items(instances)
    rows, items = keep("label-rows", folded), keep("label-items", items)
    open_, found_roots, names, errors = items, [], None, None
    for k in count():
        placed, asked = ask_synonyms(open_, known, provider, block_rows=block_rows, orders=orders)
        placed = keep(f"label-blocks-{k}", placed)
        answers = keep(f"synonym-answers-{k}", asked)
        found = keep(f"synonym-groups-{k}", named_groups(placed, answers))
        head = found.groupBy("class_iri", "block", "g").agg(F.min("node").alias("head"))
        edges = found.join(head, ["class_iri", "block", "g"]).where("node <> head").select("class_iri", F.col("node").alias("u"), F.col("head").alias("v"), "whole").distinct()
        said = found.where("canonical IS NOT NULL").select("node", "canonical").distinct()
        bad = unanswered(answers, "consolidate", GROUPS)
        names, errors = (said, bad) if names is None else (names.unionByName(said), errors.unionByName(bad))
        roots = components(edges.select("u", "v")).where("node <> root")
        found_roots.append(roots)
        # Heads of classes with several blocks in which something joined.
        again = edges.where("NOT whole").select("class_iri").distinct()
        if again.isEmpty():
            break
        open_ = keep(f"label-heads-{k}", open_.join(F.broadcast(again), "class_iri", "left_semi").join(roots.select("node"), "node", "left_anti"))
    # A round joins heads of the rounds before, so their roots lead from one to the next:
    # no link is gone over twice.
    told = items.withColumn("head", F.col("node"))
    for k, roots in enumerate(found_roots):
        joined = hot_join(told, roots.withColumnRenamed("node", "head"), "head")
        told = keep(f"label-groups-{k}", joined.withColumn("head", F.coalesce("root", "head")).drop("root"))
    # A canonical label counts if it is a label of some row of the group.
    own = rows.join(told.select("class_iri", "_folded", "head"), ["class_iri", "_folded"])
    own = keep("label-members", own)
    said = names.join(told.select("node", "head"), "node").select("head", F.col("canonical").alias("label")).distinct()
    named = said.join(own.select("head", "label").distinct(), ["head", "label"]).groupBy("head").agg(F.max("label").alias("canonical"))
    first = told.where("head = node").select("head", F.col("label").alias("first_label"))
    labels = first.join(named, "head", "left").select("head", F.coalesce("canonical", "first_label").alias("head_label"))
    members = hot_join(own.drop("label"), labels, "head", "inner").select(F.col("head").alias("instance_id"), F.col("instance_id").alias("mention_id"), "class_iri", F.col("head_label").alias("label"), "source", "file_id")
    members = keep("synonym-members", members)
    distinct = lambda c, n: members.select("instance_id", c).distinct().groupBy("instance_id").agg(F.count(c).alias(n))
    out = members.select("instance_id", "class_iri", "label").distinct().join(distinct("source", "n_sources"), "instance_id").join(distinct("file_id", "n_files"), "instance_id")
    return out, members.select("instance_id", "mention_id", "source", "file_id"), errors


# --- edges ---------------------------------------------------------------------------


CELL = 64  # blocks of either side of a cell of the candidate space


def candidate_requests(placed: DataFrame, props: DataFrame, *, scope: str = "file_id", block: int = 20) -> DataFrame:
    """Requests for edges: (scope, property_iri, property_name, description,
    src_class, dest_class, src_block, dest_block, src_items, dest_items), for every
    property and every pair of blocks of its classes' instances (instance_id,
    class_iri, label) in one scope (a document).

    Instances meet wherever in the scope they were found, whatever their view.
    A block holds about ``block`` instances by a hash, so the rows of a scope
    grow with the product of its classes' blocks, as the pairs to be judged do.
    That product is cut into a grid of cells of CELL x CELL blocks; a source block
    goes to a row of cells and a destination block to a column, and they meet by
    cell: whatever a scope holds, a key has at most CELL blocks of either side."""
    require(placed, scope, "instance_id", "class_iri", "label")
    rows = C.number_in_blocks(placed, block_rows=block, groups=(scope, "class_iri"))
    blocks = rows.groupBy(scope, "class_iri", "block").agg(F.array_sort(F.collect_set(F.struct(F.col("instance_id").alias("id"), "label"))).alias("items"))
    blocks = Stages(placed.sparkSession).keep("instance-blocks", blocks)
    counts = blocks.groupBy(scope, "class_iri").agg((F.floor(F.max("block") / CELL) + 1).cast("int").alias("bands"))
    wanted = F.broadcast(props.select(F.col("iri").alias("property_iri"), F.col("name").alias("property_name"), "description", "src_class", "dest_class"))
    bands = lambda side: counts.select(scope, F.col("class_iri").alias(f"{side}_class"), F.col("bands").alias(f"{side}_bands"))
    # A row per scope and property, with the size of its grid.
    grids = bands("src").join(wanted, "src_class").join(bands("dest"), [scope, "dest_class"])

    def side(own: str, other: str, fields: list[str]) -> DataFrame:
        grid = grids.select(scope, "property_iri", F.col(f"{own}_class").alias("class_iri"), F.col(f"{other}_bands").alias("across"), *fields)
        df = C.join_sizes(blocks, grid, scope, "class_iri").withColumn(f"{own}_cell", F.floor(F.col("block") / CELL).cast("int"))
        df = df.withColumn(f"{other}_cell", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
        return df.select(scope, "property_iri", "src_cell", "dest_cell", *fields, F.col("block").alias(f"{own}_block"), F.col("items").alias(f"{own}_items"))

    out = side("src", "dest", ["property_name", "description", "src_class", "dest_class"]).join(side("dest", "src", []), [scope, "property_iri", "src_cell", "dest_cell"])
    return out.select(scope, "property_iri", "property_name", "description", "src_class", "dest_class", "src_block", "dest_block", "src_items", "dest_items")


def ask_edges(requests: DataFrame, provider, known: DataFrame | None = None) -> DataFrame:
    """``requests`` with their answers.  ``known`` (the metamodel's classes) gives
    the prompt the names and descriptions of both classes."""
    line = lambda x: F.concat_ws(" ", x["id"], x["label"])
    columns = requests.columns
    for side in ("src", "dest"):
        told = F.lit("")
        if known is not None:
            text = F.concat_ws(": ", "name", F.when(F.coalesce("description", F.lit("")) != "", F.col("description")))
            requests = requests.join(F.broadcast(known.groupBy(F.col("iri").alias(f"{side}_class")).agg(F.min_by(text, "ord").alias(f"{side}_told"))), f"{side}_class", "left")
            told = F.coalesce(f"{side}_told", F.lit(""))
        requests = requests.withColumn(f"{side}_told", told)
    asked = _ask(
        requests, provider, "edges", ["property_iri", "src_items", "dest_items"], property_name=F.col("property_name"), description=F.col("description"), src_class=F.col("src_told"), dest_class=F.col("dest_told"),
        src_items=numbered(F.col("src_items"), line), dest_items=numbered(F.col("dest_items"), line),
    )
    return asked.select(*columns, *[c for c in asked.columns if c not in (*columns, "prompt", "src_told", "dest_told")])


def clean_ids(edges: DataFrame) -> DataFrame:
    """Edges whose two ids are there and not blank, stripped."""
    src, dest = strip(F.col("src_id")), strip(F.col("dest_id"))
    return edges.withColumns({"src_id": src, "dest_id": dest}).where((F.coalesce("src_id", F.lit("")) != "") & (F.coalesce("dest_id", F.lit("")) != ""))


def proposed_edges(answers: DataFrame) -> DataFrame:
    """Distinct (property_iri, src_id, dest_id) of all answers."""
    found = answers.select("property_iri", F.explode(F.from_json("payload", PAIRS)["properties"]).alias("e")).select("property_iri", "e.src_id", "e.dest_id")
    return clean_ids(found).distinct()


def ask_verdicts(candidates: DataFrame, instances: DataFrame, props: DataFrame, provider, *, block: int = 24) -> DataFrame:
    """Requests per property and block of candidates (keys: property_iri, items
    with ids and labels)."""
    from docskein.operators.properties import enrich_labels

    sizes = candidates.groupBy("property_iri").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = C.join_sizes(enrich_labels(candidates, instances), sizes, "property_iri").withColumn("block", F.pmod(F.xxhash64("src_id", "dest_id"), F.col("blocks")).cast("int"))
    fields = ["src_id", "dest_id", "src_label", "dest_label"]
    blocks = rows.groupBy("property_iri", "block").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    rules = render_rules(props, key="iri", rules="prohibit_rules").withColumnsRenamed({"iri": "property_iri", "text": "rules"})
    names = props.select(F.col("iri").alias("property_iri"), F.col("name").alias("property_name"))
    df = blocks.join(names.dropDuplicates(["property_iri"]), "property_iri", "left").join(rules.dropDuplicates(["property_iri"]), "property_iri", "left")
    line = lambda x: F.concat(x["src_id"], F.lit(" "), x["src_label"], F.lit(" -> "), x["dest_id"], F.lit(" "), x["dest_label"])
    return _ask(df, provider, "verdicts", ["property_iri", "items"], property_name=F.col("property_name"), rules=F.col("rules"), items=numbered(F.col("items"), line)).drop("rules", "prompt")


def verdicts(answers: DataFrame) -> DataFrame:
    """(property_iri, src_id, dest_id, ord, prohibited, confidence, justification):
    without a word on it a relation is not prohibited, with a confidence of a half."""
    told = answers.select("property_iri", F.posexplode(F.from_json("payload", RELATIONS)["relations"]).alias("ord", "r")).where("r IS NOT NULL")
    return told.select(
        "property_iri", F.col("r")["src_id"].alias("src_id"), F.col("r")["dest_id"].alias("dest_id"), "ord", F.coalesce(F.col("r")["prohibited"], F.lit(False)).alias("prohibited"),
        F.coalesce(F.col("r")["confidence"], F.lit(0.5)).alias("confidence"), F.col("r")["justification"].alias("justification"),
    )
