"""Secret scans (operator 6): credentials in texts, and weak parts that link up.

Native: only DataFrame functions.  Strong kinds are found by pattern alone.
Multipart credential linking then joins access identifiers, secrets and
endpoints as intervals: within a scope (a document) a weak candidate is
reported only when the parts that complete it lie within ``reach`` code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import need, whole_text
from docskein.llm.pii import count_kind, span_sql
from docskein.llm.spans import NO_SPANS, add_spans, let, render, running

# Fixed patterns of the base kinds, in the order in which they are listed.  The
# last two state their least length in the pattern: their classes make a run
# maximal, so a run that is too short can hold no other match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
# Weak kinds: a bare 40-character key and a URL or ARN mean nothing alone.
BARE = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"(?:https?://|arn:aws:)[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
ORDER = {"assign": 0, "access": 1, "hex": 2, "bare": 3, "endpoint": 4}


def find_secrets(docs: DataFrame, *, text_col: str = "text", reach: int = 400) -> DataFrame:
    """``docs`` plus ``secrets``: an array of spans (start, end, kind, hit).

    Base kinds assign (value of 12 or more characters), access (18 or more) and
    hex (16 or more) always stay.  Weak kinds are added by linking:

    - ``bare`` (40 characters of base64, with a letter and a digit, outside all
      base spans) when an access span lies within ``reach`` code points;
    - ``endpoint`` when an access span and a secret (assign or linked bare)
      both lie within ``reach``.

    Distance is the gap between spans; overlap counts as 0.  Places are code
    points, end exclusive, sorted by start and then by kind in the order above.

    Null or empty text: no spans.  Repeated rows and null ids need no care:
    the scope of a link is the row.  An empty table gives an empty table.  A
    column already called secrets is replaced.

    Linking is an interval join done as a sweep: the parts of a scope are
    ordered by place, and running maxima and minima give each the nearest
    complementary part on both sides, so no pair list is made however many parts
    a document holds.  All of it is expressions over the row: no shuffle, and
    nothing is written.
    """
    need(docs, text=text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = docs.select(row, whole_text(text_col).alias("t"))
    t = F.col("t")
    yes = lambda m: F.lit(True)
    df = add_spans(df, "assign", "t", "assign", 0, ASSIGN, lambda v: F.length(v) >= 12, probe=t.rlike(r"(?i:passw|secret|token|api_?key)"), group=2)
    df = add_spans(df, "access", "t", "access", 1, ACCESS, yes, probe=t.contains("AKIA"))
    df = add_spans(df, "hex", "t", "hex", 2, HEX, yes, probe=t.rlike(HEX))
    linkable = F.size("access") > 0
    df = add_spans(df, "bare", "t", "bare", 3, BARE, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), probe=linkable)
    df = add_spans(df, "endpoint", "t", "endpoint", 4, ENDPOINT, yes, probe=linkable & t.contains(":"))
    own = [c for c in docs.columns if c.lower() != "secrets"]
    df = df.select("row", F.sort_array(F.concat("assign", "access", "hex")).alias("base"), F.sort_array(F.concat("bare", "endpoint")).alias("weak"))
    df = df.withColumn("linked", F.when(F.size("weak") > 0, _linked(reach)).otherwise(F.array().cast(NO_SPANS)))
    spans = F.transform(F.sort_array(F.concat("base", "linked")), lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"], s["hit"]))
    return df.select(*[F.col("row").getField(c).alias(c) for c in own], spans.alias("secrets"))


FAR = 2**30


def _near(parts: Column, test, reach: int) -> Column:
    """Per part (ordered by start): whether a part that passes ``test`` lies
    within ``reach``, on either side or over it."""
    ends = F.transform(parts, lambda s: F.when(test(s), s["end"]).otherwise(-FAR))
    starts = F.transform(F.reverse(parts), lambda s: F.when(test(s), s["start"]).otherwise(FAR))
    left = running(ends, F.lit(-FAR), lambda a, b: F.greatest(a, b), "int")
    right = F.reverse(running(starts, F.lit(FAR), lambda a, b: F.least(a, b), "int"))
    return F.transform(F.arrays_zip(parts.alias("s"), left.alias("l"), right.alias("r")), lambda x: (x["s"]["start"] - x["l"] <= reach) | (x["r"] - x["s"]["end"] <= reach))


def _pick(parts: Column, flags: Column) -> Column:
    """The parts whose flag is set."""
    return F.transform(F.filter(F.arrays_zip(parts.alias("s"), flags.alias("f")), lambda x: x["f"]), lambda x: x["s"])


def _linked(reach: int) -> Column:
    """The weak spans of ``weak`` whose complements in ``base`` are in reach."""
    is_base = lambda s: s["ord"] < 3
    is_bare = lambda s: s["kind"] == "bare"
    every = F.sort_array(F.concat("base", "weak"))
    # A bare key that overlaps a base span is that span, not a further part.
    overlaps = lambda parts: F.zip_with(parts, _near(parts, is_base, -1), lambda s, f: ~(is_bare(s) & f))
    free = let(every, lambda parts: _pick(parts, overlaps(parts)))

    def by_access(parts: Column) -> Column:
        near = _near(parts, lambda s: s["kind"] == "access", reach)
        return _pick(parts, F.zip_with(parts, near, lambda s, f: is_base(s) | f))

    def by_secret(parts: Column) -> Column:
        near = _near(parts, lambda s: s["kind"].isin("assign", "bare"), reach)
        return _pick(parts, F.zip_with(parts, near, lambda s, f: is_bare(s) | ((s["kind"] == "endpoint") & f)))

    return let(let(free, by_access), by_secret)


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every stretch of text that found spans cover replaced by
    ``mark``; spans that overlap or touch are one stretch.  Texts without spans
    (and null texts) stay as they are."""
    found = find_secrets(docs, text_col=text_col, **options)
    clean = F.when(F.size("secrets") == 0, F.col(text_col)).otherwise(let(F.transform("secrets", lambda s: F.struct(s["start"].alias("b"), s["end"].alias("e"))), lambda s: _redacted(F.col(text_col), s, mark)))
    return found.select(*[(clean if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns if c.lower() != "secrets" or c == text_col])


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with a mark for each stretch of ``spans`` (b, e; by b).

    A substring costs its distance from the front of its string, so the text is
    first cut into as many parts as each part then has stretches: about two
    square roots of their number of passes over the text, not their number."""
    far = running(F.transform(spans, lambda s: s["e"]), F.lit(0), lambda a, b: F.greatest(a, b), "int")
    # A stretch begins where no span before it reaches; it ends at the greatest end before the next.
    zipped = F.arrays_zip(spans["b"].alias("b"), far.alias("e"), F.concat(F.array(F.lit(-1)), F.slice(far, 1, F.size(far) - 1)).alias("p"))

    def stretches(z: Column) -> Column:
        begins = F.transform(F.filter(z, lambda x: x["b"] > x["p"]), lambda x: x["b"])
        ends = F.transform(F.filter(F.arrays_zip(z.alias("x"), F.concat(F.slice(spans["b"], 2, F.size(spans)), F.array(F.lit(FAR))).alias("n")), lambda y: y["n"] > y["x"]["e"]), lambda y: y["x"]["e"])
        return F.arrays_zip(begins.alias("b"), ends.alias("e"))

    def parts(s: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(s))).cast("int")
        # Each part: its stretches, from the end of the stretch before it to its own last end.
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / step).cast("int")), lambda i: F.struct(
            F.slice(s, i * step + 1, step).alias("s"), F.when(i > 0, F.element_at(s, F.greatest(i * step, F.lit(1)))["e"]).otherwise(0).alias("at")))
        done = F.transform(cut, lambda c: let(F.struct(c["s"].alias("s"), c["at"].alias("at"), F.substring(text, c["at"] + 1, F.element_at(c["s"], -1)["e"] - c["at"]).alias("t")), one))
        return F.concat(F.array_join(done, ""), F.substring(text, F.element_at(s, -1)["e"] + 1, F.length(text)))

    def one(c: Column) -> Column:
        starts = F.concat(F.array(c["at"]), F.transform(c["s"], lambda x: x["e"]))
        gaps = F.zip_with(F.slice(starts, 1, F.size(c["s"])), c["s"], lambda a, x: F.concat(F.substring(c["t"], a - c["at"] + 1, x["b"] - a), F.lit(mark)))
        return F.array_join(gaps, "")

    return let(let(zipped, stretches), parts)


# --- query ------------------------------------------------------------------

NAME = "op6_secrets"
BASE = ("assign", "access", "hex")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # The text has served once the spans are found; the digest needs only those.
    found = find_secrets(docs.select("doc_id", "text")).drop("text")
    found = found.withColumn("base", F.filter("secrets", lambda s: s["kind"].isin(*BASE)))
    counts = [count_kind("base", k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("secrets")).alias("spans"))


_ASSIGN_RE2 = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_VALUE = "length(regexp_extract(x.m, '{}', 1)) >= 12".format(_ASSIGN_RE2.replace("'", "''"))
_NEAR = "exists (SELECT 1 FROM {} o WHERE o.doc_id = w.doc_id AND o.{} AND o.s - w.e <= 400 AND w.s - o.e <= 400)"

ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({span_sql([
    ("assign", _ASSIGN_RE2, _VALUE),
    ("access", r"AKIA[A-Z0-9]+", "length(x.m) >= 18"),
    ("hex", r"[0-9a-f]{16,}", "true"),
    ("bare", r"[A-Za-z0-9/+=]{40,}", "length(x.m) = 40 AND regexp_matches(x.m, '[0-9]') AND regexp_matches(x.m, '[A-Za-z]')"),
    ("endpoint", r"(?:https?://|arn:aws:)[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", "true"),
])}),
base AS (SELECT * FROM spans WHERE ord < 3),
bare AS (
  SELECT * FROM spans w WHERE kind = 'bare' AND {_NEAR.format("base", "kind = 'access'")}
    AND NOT exists (SELECT 1 FROM base o WHERE o.doc_id = w.doc_id AND o.s < w.e AND w.s < o.e)),
secret AS (SELECT * FROM base WHERE kind = 'assign' UNION ALL SELECT * FROM bare),
endpoint AS (
  SELECT * FROM spans w WHERE kind = 'endpoint' AND {_NEAR.format("base", "kind = 'access'")}
    AND {_NEAR.format("secret", "s >= 0")}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare UNION ALL SELECT * FROM endpoint),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS every
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)
"""
