"""Personal data (operator 9).

Native: only DataFrame functions.  Regular expressions propose spans, checksum
validators (Luhn, mod-97) confirm them, nearby context words adjust the score.
Every value is one expression over its own row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import need, whole_text
from docskein.llm.spans import add_spans, render

# Fixed patterns.  Each finds what the plain pattern of its kind finds, written
# so that a long run cannot cost quadratic time or deep recursion: possessive
# loops where the next character cannot belong to the loop, and starts only
# where a run of the first class begins (or where the last match ended).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Whole words that raise a span's score when they stand near it, by kind.
CONTEXT = {
    "email": ["mail", "email", "e-mail", "contact", "write to", "reach"],
    "ip": ["ip", "server", "host", "address"],
    "card": ["card", "visa", "credit", "payment", "amex"],
    "phone": ["phone", "telephone", "tel", "call", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "transfer"],
}
#: Words that lower it.
DENY = ["example", "version", "order", "invoice", "isbn", "serial", "test"]
#: Hundredths before context: what the validator of the kind is worth.
BASE_SCORE = {"email": 80, "ip": 50, "card": 80, "phone": 60, "iban": 90}
HELPS, DENIES = 20, 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_pattern(words: list[str]) -> str:
    """One of ``words`` as a whole word, in both engines' syntax."""
    return f"(?:^|[^a-z0-9_])(?:{'|'.join(words)})(?:[^a-z0-9_]|$)"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """Luhn's check over a string of digits."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def iban_ok(hit: Column) -> Column:
    """ISO 7064 mod-97: first four characters moved to the end, letters as 10
    to 35, remainder 1; 15 to 34 characters."""
    plain = F.translate(hit, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    value = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)
    return F.length(plain).between(15, 34) & (value == 1)


def find_pii(docs: DataFrame, *, text_col: str = "text", window: int = 40) -> DataFrame:
    """``docs`` plus ``pii``: an array of spans with kind, start, end, hit, score.

    Kinds email, ip, card and phone are the base kinds (confirmed: octets up
    to 255, Luhn over 12 to 19 digits, 9 to 15 digits in a phone number); iban
    (mod-97) is added by the method.  Starts and ends are code points, end
    exclusive, sorted by start and then kind in the order above.  The score is
    the kind's base score plus 0.2 when a context word stands within
    ``window`` code points, less 0.3 for a denying word, within 0 and 1.  Words
    count as whole words, in either case.

    Null or empty text: no spans.  Spans of different kinds may overlap; all
    stay.  Repeated rows and null ids need no care: each row stands alone.  A
    column already called pii is replaced.
    """
    need(docs, text=text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = docs.select(row, whole_text(text_col).alias("t"))
    t = F.col("t")
    kinds = [
        ("email", EMAIL, lambda m: F.lit(True), t.contains("@")),
        ("ip", IP, lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), t.rlike(r"[0-9]\.[0-9]")),
        ("card", CARD, lambda m: F.length(digits(m)).between(12, 19) & luhn_ok(digits(m)), t.rlike(r"[0-9][\x20-]?[0-9]")),
        ("phone", PHONE, lambda m: F.length(digits(m)).between(9, 15), t.rlike(r"\+[0-9]")),
        ("iban", IBAN, iban_ok, t.rlike(r"[A-Z]{2}[0-9]{2}")),
    ]
    for order, (kind, pattern, accept, probe) in enumerate(kinds):
        df = add_spans(df, kind, "t", kind, order, pattern, accept, probe=probe, context=window)
    spans = F.transform(F.sort_array(F.concat(*[F.col(k[0]) for k in kinds])), _scored)
    own = [c for c in docs.columns if c.lower() != "pii"]
    return df.select(*[F.col("row").getField(c).alias(c) for c in own], spans.alias("pii"))


def _scored(s: Column) -> Column:
    near = F.translate(F.concat_ws(" ", s["before"], s["after"]), UPPER, LOWER)
    base, helps = F.lit(0), F.lit(False)
    for kind, words in CONTEXT.items():
        base = F.when(s["kind"] == kind, F.lit(BASE_SCORE[kind])).otherwise(base)
        helps = F.when(s["kind"] == kind, near.rlike(word_pattern(words))).otherwise(helps)
    score = base + F.when(helps, HELPS).otherwise(0) - F.when(near.rlike(word_pattern(DENY)), DENIES).otherwise(0)
    return F.struct(
        s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"),
        (F.least(F.greatest(score, F.lit(0)), F.lit(100)) / 100).alias("score"),
    )


# --- query ------------------------------------------------------------------

NAME = "op9_pii"
BASE = ("email", "ip", "card", "phone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).withColumn("base", F.filter("pii", lambda s: s["kind"].isin(*BASE)))
    counts = [count_kind("base", k).alias(f"n_{k}") for k in BASE]
    # In the order of the spans, in hundredths.
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("pii")).alias("spans"), scores.alias("scores"))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_sql(kinds: list[tuple[str, str, str]]) -> str:
    """DuckDB: one list of spans per kind from (kind, RE2 pattern, test of m)."""
    out = []
    for order, (kind, pattern, test) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        out.append(f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS ord, x.s AS s, x.s + length(x.m) AS e, x.near AS near FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{
      's': coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0)
         + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0), 'm': ms[i],
      'near': right(ps[i], 40) || ' ' || left(ps[i + 1], 40)}})) AS x
    FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS ps
          FROM texts)) WHERE {test}""")
    return " UNION ALL ".join(out)


_LUHN = """(len(regexp_replace(x.m, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND list_sum(list_transform(
      string_split(reverse(regexp_replace(x.m, '[^0-9]', '', 'g')), ''), lambda c, i:
      CASE WHEN i % 2 = 0 THEN c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END ELSE c::INT END)) % 10 = 0)"""
_TURNED = "(substr(replace(x.m, ' ', ''), 5) || left(replace(x.m, ' ', ''), 4))"
_IBAN = f"""(length(replace(x.m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({_TURNED}, ''),
      lambda c: (CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)::BIGINT),
      lambda r, v: (CASE WHEN v > 9 THEN r * 100 + v ELSE r * 10 + v END) % 97, 0::BIGINT) = 1)"""
_OCTETS = " AND ".join(f"regexp_full_match(split_part(x.m, '.', {i}), '0*([0-9]{{1,2}}|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])')" for i in (1, 2, 3, 4))
_DIGITS = "length(regexp_replace(x.m, '[^0-9]', '', 'g'))"

ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({span_sql([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", _OCTETS),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{_DIGITS} BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _IBAN),
])}),
scored AS (
  SELECT *, greatest(0, least(100, CASE kind {" ".join(f"WHEN '{k}' THEN {BASE_SCORE[k]} + CASE WHEN regexp_matches(low, '{word_pattern(w)}') THEN {HELPS} ELSE 0 END" for k, w in CONTEXT.items())} END
    - CASE WHEN regexp_matches(low, '{word_pattern(DENY)}') THEN {DENIES} ELSE 0 END)) AS score
  FROM (SELECT *, translate(near, '{UPPER}', '{LOWER}') AS low FROM spans)),
joined AS (
  SELECT doc_id, string_agg(score::VARCHAR, ',' ORDER BY s, ord) AS scores, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (kind <> 'iban') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS every
  FROM scored GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip,
  coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(scores, '') AS scores
FROM texts LEFT JOIN joined USING (doc_id)
"""
