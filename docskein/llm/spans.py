"""Span machinery for the native text scanners: where a pattern's matches lie.

Spark's regular-expression functions give the matched strings, not their
places.  The pieces between the matches (``split``) and the matches
(``regexp_extract_all``) come from the same leftmost, non-overlapping scan, so
running sums of their lengths give the places, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,ord:int,end:int,kind:string,hit:string,before:string,after:string>"
NO_SPANS = f"array<{SPAN}>"
RUN = 128


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, op, kind: str) -> Column:
    """Element i: ``op`` over ``zero`` and elements 0 to i (``op`` associative,
    ``zero`` neutral).  A fold that appends to its result copies it each time;
    so runs of RUN elements are folded apart, each from the total of the runs
    before it, and the work per element does not grow with the array."""

    def fold(items: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))

        start = F.struct(first.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(items, start, step)["out"]

    def joined(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, zero.cast(kind), op))
        before = F.slice(F.concat(F.array(zero.cast(kind)), fold(totals, zero)), 1, F.size(runs))
        return F.flatten(F.zip_with(runs, before, fold))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda c: F.slice(v, c * RUN + 1, RUN))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(F.array().cast(f"array<{kind}>")))


def add_spans(
    df: DataFrame,
    out: str,
    text: str,
    kind: str,
    order: int,
    pattern: str,
    accept,
    *,
    probe: Column,
    group: int | None = None,
    context: int = 0,
) -> DataFrame:
    """Add column ``out``: the spans of ``pattern`` in ``text`` that pass ``accept``.

    ``probe`` is a cheap necessary condition that spares most texts the scan.
    ``accept`` maps the matched string (or capture group ``group`` of it) to a
    boolean.  ``context`` code points on each side go into before and after;
    they come from the neighbouring pieces, so all work is linear in the text,
    however many matches it has.
    """
    hits, words, pieces, ends = (f"{out}_{x}" for x in "hwpe")
    none = F.array().cast("array<string>")
    df = df.withColumn(hits, F.when(probe, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    if group is not None:
        df = df.withColumn(words, F.when(F.size(hits) > 0, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).otherwise(none))
    judged = words if group is not None else hits
    df = df.withColumn(pieces, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    before, after = F.slice(F.col(pieces), 1, F.size(hits)), F.slice(F.col(pieces), 2, F.size(hits))
    lengths = F.zip_with(before, F.col(hits), lambda p, m: F.length(p) + F.length(m))
    df = df.withColumn(ends, F.when(F.size(hits) > 0, running(lengths, F.lit(0), lambda a, b: a + b, "int")))
    parts = F.arrays_zip(F.col(hits).alias("m"), F.col(judged).alias("g"), before.alias("p"), after.alias("n"), F.col(ends).alias("e"))

    def span(x: Column) -> Column:
        return F.struct(
            (x["e"] - F.length(x["m"])).alias("start"), F.lit(order).alias("ord"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("hit"),
            (F.right(x["p"], F.lit(context)) if context else F.lit("")).alias("before"), (F.left(x["n"], F.lit(context)) if context else F.lit("")).alias("after"),
        ).cast(SPAN)

    spans = F.when(F.size(hits) > 0, F.transform(F.filter(parts, lambda x: accept(x["g"])), span)).otherwise(F.array().cast(NO_SPANS))
    return df.withColumn(out, spans).drop(hits, words, pieces, ends)


def render(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
