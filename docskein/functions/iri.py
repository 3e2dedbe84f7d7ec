"""Names and IRIs of graph items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docskein.functions.text import SPACE, strip

# Characters that a slug keeps.
SLUG_ALPHABET = r"0-9A-Za-z\x{C0}-\x{24F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}_.-"
SLUG_LENGTH = 48


def stable_id(*parts: Column | str) -> Column:
    """A hash of the natural key: the same on every run and partitioning."""
    return F.sha2(F.concat_ws("\x02", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def local_name(iri: Column) -> Column:
    """After the last ``#``, else the last path part, else after the last ``:``."""
    return (
        F.when(iri.contains("#"), F.substring_index(iri, "#", -1))
        .when(iri.contains("/"), F.substring_index(F.rtrim(iri, F.lit("/")), "/", -1))
        .when(iri.contains(":"), F.substring_index(iri, ":", -1)).otherwise(iri)
    )


def snake_case(name: Column) -> Column:
    return F.translate(name, "-", "_")


def slug(label: Column) -> Column:
    """At most 48 characters of the slug alphabet; a label without any gives
    the first 8 digits of its hash, so that it stays the same."""
    label = F.coalesce(label, F.lit(""))
    s = strip(F.regexp_replace(label, f"{SPACE}+", " "))
    s = F.regexp_replace(F.regexp_replace(s, f"[^{SLUG_ALPHABET}]", "-"), "-{2,}", "-")
    s = F.left(F.trim(s, F.lit("-")), F.lit(SLUG_LENGTH))
    return F.when(s == "", F.left(F.sha2(label, 256), F.lit(8))).otherwise(s)


def node_iri(base: str, label: Column, key: Column) -> Column:
    """One IRI per node: slug of the label and the first digits of its id."""
    return F.concat(F.lit(f"<{base.rstrip('#/')}#instance/"), slug(label), F.lit("-"), F.left(key, F.lit(8)), F.lit(">"))


def escape_iri(iri: Column) -> Column:
    """Characters that may not stand between angle brackets, percent-encoded."""
    out = iri
    for c in " <>\"{}|^`\\":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def term(iri: Column) -> Column:
    """Prefixed names stay; other IRIs get angle brackets.  What follows a prefix
    must be a plain local name, else the IRI is written in brackets as well."""
    return F.when(iri.rlike(r"^(?:ex|rdf|rdfs|owl|xsd):[\w\-]+$"), iri).otherwise(F.concat(F.lit("<"), escape_iri(iri), F.lit(">")))


def full_iri(name: Column, prefixes: dict[str, str]) -> Column:
    """A prefixed name with its prefix written out (up to the first colon);
    anything else as it is."""
    out = name
    for prefix, iri in prefixes.items():
        local = F.substring(name, len(prefix) + 2, 2**31 - 1)
        out = F.when(F.startswith(name, F.lit(f"{prefix}:")), F.concat(F.lit(f"<{iri}"), local, F.lit(">"))).otherwise(out)
    return out


def long_literal(value: Column) -> Column:
    """A Turtle string in triple quotes: only backslashes and quotes are escaped."""
    return F.concat(F.lit('"""'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"""'))


def literal(value: Column) -> Column:
    """A quoted Turtle string."""
    out = value
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))
