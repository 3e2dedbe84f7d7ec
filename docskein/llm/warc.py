"""WARC archives (operator 8): write with deduplication, read with salvage.

Writing: one scan counts the digests of payloads (partial aggregation, so a
payload that a third of all pages share costs one row per task), a join gives
every page its keeper (by broadcast for digests that many pages share, so pages
are not gathered by payload), an Arrow pass makes each record a gzip member, and
Spark's text sink writes files of members, as WARC/1.1 advises: damage to one
member leaves the others readable.

Reading: archives come as binary files, one row each.  After a failed check
the reader searches for the next version line or gzip member that holds a valid
record, goes on there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import materialize, need, new_path, skewed_join

END = "\r\n\r\n"
CRLF = "\r\n"
RECORD_URN = "urn:docskein:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
STEP = 1 << 16


def base32(hex_digest: Column) -> Column:
    """A 20-byte hex digest in base 32 (RFC 4648): four groups of 40 bits, each
    eight digits of Spark's base 32, renamed to the standard alphabet."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def warc_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``record``: a WARC/1.1 record per page, without its closing
    CR LF CR LF.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with
    the largest id is a response and the others are revisits that refer to it;
    smaller payloads are all responses.  Null html is the empty payload, a null
    url is written as the page's URN, and line ends in a url are escaped.  A
    null id is smaller than any other; if all ids of a payload are null, or a
    row repeats the largest id, each such row is a response.
    """
    need(pages, id=id_col, url=url_col, html=html_col)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    keepers = (
        rows.where(F.octet_length("html") >= min_bytes).groupBy("sha")
        .agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    df = skewed_join(rows, materialize(keepers, "keepers"), ["sha"], "n", "left")
    name = lambda c: F.concat(F.lit(RECORD_URN), F.coalesce(c.cast("string"), F.lit("null")))
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    df = df.select("id", "url", "sha", "keeper", revisit.alias("revisit"), block.alias("block"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    uri = F.coalesce(F.regexp_replace("url", r"[\r\n]", "%0A"), name(F.col("id")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), name(F.col("id")), F.lit(">"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(F.col("block").cast("binary"))))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("keeper")), F.lit(">"))))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF),
    )
    return df.select(F.concat(head, F.col("block")).alias("record"))


def write_warc(records: DataFrame, path: str, *, records_per_file: int = 8192, file_bytes: int = 8 << 20) -> None:
    """Write ``record`` rows as gzip-compressed WARC files, one member for each
    record.  A file ends with the record that brings it to ``records_per_file``
    records or ``file_bytes`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held = [], 0
        for batch in batches:
            for record in batch.column(0):
                members.append(gzip.compress(record.as_py() + END.encode(), 6, mtime=0))
                held += len(members[-1])
                if len(members) >= records_per_file or held >= file_bytes:
                    yield _file(members)
                    members, held = [], 0
        if members:
            yield _file(members)

    # The text sink adds a separator of one byte at least to each row, here a file.
    # It is the zero byte that ends the last member.
    files = records.select(F.col("record").cast("binary")).mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _file(members: list[bytes]) -> pa.RecordBatch:
    """A row with the members but the last byte, which is zero: a member ends
    with its record's length, and after one of 16 MiB an empty member is put."""
    data = b"".join(members)
    if data[-1]:
        data += gzip.compress(b"", mtime=0)
    return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])


# --- reading ----------------------------------------------------------------


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_end(data: bytes, at: int) -> int:
    """Where the blank line after the header at ``at`` is, however long the
    header; -1 where there is none.  The search ends at the next record, so that
    many broken headers do not each search the whole file."""
    size = STEP
    while True:
        stop = data.find(b"\r\n\r\n", at, at + size)
        if stop >= 0 or at + size >= len(data) or data.find(b"\r\nWARC/1.", at, at + size) >= 0:
            return stop
        size *= 2


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, "") for a plain record that passes every check at ``at``,
    else (None, at, reason)."""
    if not VERSION.match(data, at):
        return None, at, "no version line"
    stop = header_end(data, at)
    if stop < 0:
        return None, at, "header without end"
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None, at, "malformed header line"
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields or "warc-record-id" not in fields:
        return None, at, "required field missing"
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "length does not meet the record's end"
    block = data[begin:end]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        return None, at, "block digest differs"
    payload, size = None, int(length)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", head)
        size = int(told[1]) if told and fields["warc-type"] == "revisit" else len(payload)
    elif fields["warc-type"] in ("resource", "conversion"):
        payload = block
    digest = fields.get("warc-payload-digest", "")
    if payload is not None and fields["warc-type"] != "revisit" and digest.startswith("sha1:") and digest[5:] != sha1_base32(payload):
        return None, at, "payload digest differs"
    if fields["warc-type"] == "revisit":
        payload = None
    return fields | {"payload": payload, "payload_bytes": size}, end + 4, ""


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(plain bytes, end, "") of the gzip member at ``at``; after an error what
    came before it, about where it is, and the reason.

    The library gives nothing of a step in which it meets an error, so that step is
    taken again from a copy of the state before it, by ever smaller ones: all that
    the bytes before the broken one stand for is kept, the whole member if only
    its trailer is wrong."""
    member, out, pos, step = zlib.decompressobj(31), [], at, STEP
    while not member.eof:
        if pos >= len(data):
            return b"".join(out), min(pos, len(data)), "gzip member without end"
        before = member.copy()
        try:
            out.append(member.decompress(data[pos : pos + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos + 1, f"gzip: {e}"
            member, step = before, max(1, step // 256)
            continue
        pos += step
    return b"".join(out), min(pos, len(data)) - len(member.unused_data), ""


def next_start(data: bytes, at: int) -> int:
    """The next place from ``at`` on where a record may begin."""
    found = START.search(data, at)
    return found.start() if found else len(data)


Found = tuple[int, int, int, str, dict | None]


def salvage(data: bytes) -> Iterator[Found]:
    """(offset, length, inner offset, reason, record): valid records in order,
    and between them quarantined gaps (record None) with the first reason.  A
    gzip member may hold one record or many; inner offsets are places in it."""
    at, gap, why = 0, None, ""
    while at < len(data):
        if data[at : at + 3] == b"\x1f\x8b\x08":
            plain, end, reason = inflate(data, at)
            inner = list(salvage(plain)) if VERSION.search(plain) else []
            good = any(r for *_, r in inner) or not (plain or reason)
        else:
            record, end, reason = parse_record(data, at)
            inner, good = [(0, end - at, 0, "", record)], record is not None
        if good:
            if gap is not None:
                yield gap, at - gap, 0, why, None
                gap = None
            for offset, _, _, r_why, r in inner:
                yield at, end - at, offset, r_why, r
        if good and not reason:
            at = end
            continue
        if gap is None:
            # A broken member is a gap even where its first records came out.
            gap, why = at, reason or "no record in a member"
        at = next_start(data, at + 1)
    if gap is not None and gap < len(data):
        yield gap, len(data) - gap, 0, why, None


SCHEMA = (
    "path string, offset bigint, length bigint, inner_offset bigint, status string, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``: status is record or
    gap.  Damaged, truncated and empty files give what can be recovered."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for offset, length, inner, reason, r in salvage(batch.column(1)[i].as_py()):
                    payload = r["payload"] if r else None
                    r = r or {}
                    rows.append((
                        name, offset, length, inner, "gap" if reason else "record", reason or None, r.get("warc-type"), _bare(r.get("warc-record-id")),
                        r.get("warc-target-uri"), _bare(r.get("warc-refers-to")), (r.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        r.get("payload_bytes"), payload,
                    ))
                    held += len(payload or b"")
                    if held > 4_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, SCHEMA)


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
_FIELDS = [tuple(f.split()) for f in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def gzip_members(records: list[bytes]) -> bytes:
    """Records as a gzip file of one member each (for tests and tools)."""
    return b"".join(gzip.compress(r, mtime=0) for r in records)


# --- query ------------------------------------------------------------------

NAME = "op8_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_warc(warc_records(pages), path)
    back = materialize(read_warc(spark, path).drop("payload"), "records")
    told, written = back.agg(F.count_if(F.col("status") == "record").alias("records"), F.count_if(F.col("status") == "gap").alias("gaps")).first(), pages.count()
    if told.gaps or told.records != written:
        raise ValueError(f"{written} pages were written, {told.records} records and {told.gaps} gaps read back")
    back = back.where("status = 'record'")
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(RECORD_URN) + 1}) AS bigint)")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
bits AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper, list_aggregate(list_transform(string_split(sha, ''),
    lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS b FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda k: substr(b, (5 * i + k + 1)::INT, 1)::INT * (16 >> k::INT)))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM bits
"""
