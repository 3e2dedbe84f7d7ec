"""Ogg media columns (operator 1).

Writing: samples go into logical streams (one per channel, 8-bit PCM after a
header and a comment packet), packets are cut by lacing values into pages, and
pages of all streams are multiplexed by time.  Reading: pages are found by
their capture pattern, checksums verified, streams told apart by serial number,
packets put together from lacing values across pages, and the time of every
packet derived from granule positions.

Everything works on one row at a time inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import need, slices

BOS, EOS, CONTINUED = 2, 4, 1
PAGE_HEADER = struct.Struct("<4sBBqIII B".replace(" ", ""))
PCM_HEADER = struct.Struct(">8sHHIIBBHI")
NO_GRANULE = -1
CHANNEL = re.compile(rb"channel=([0-9]{1,4})/([0-9]{1,4})(?![0-9])")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04c11db7, most significant bit first, start
    0.  zlib's runs least significant bit first, so bits are mirrored on the
    way in and out, and its inversions undone."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


# --- writing ----------------------------------------------------------------


def _pages(serial: int, packets: list[bytes], ends: list[int], per_page: int) -> list[tuple[int, bytes]]:
    """(time of the last sample so far, page) for one logical stream.  Header
    packets (end 0) take a page each; the others fill pages of ``per_page``
    lacing values, so that packets run on over page borders."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, number, continued = bytearray(), [], NO_GRANULE, 0, False
    now = 0

    def flush(more: bool, last: bool) -> None:
        nonlocal lacing, body, granule, number, continued
        flags = CONTINUED * continued | BOS * (number == 0) | EOS * last
        head = PAGE_HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
        page = head + bytes(lacing) + b"".join(body)
        out.append((now, page[:22] + struct.pack("<I", page_crc(page)) + page[26:]))
        lacing, body, granule, number, continued = bytearray(), [], NO_GRANULE, number + 1, more

    for i, (packet, end) in enumerate(zip(packets, ends)):
        at, left = 0, len(packet) // 255 + 1
        while left:
            if len(lacing) == per_page:
                flush(at > 0, False)
            take = min(left, per_page - len(lacing))
            size = min(take * 255, len(packet) - at)
            lacing += b"\xff" * (take - 1) + bytes([255 if left > take else len(packet) - at - 255 * (take - 1)])
            body.append(packet[at : at + size])
            at, left = at + size, left - take
        granule, now = end, end
        if end == 0 or i == len(packets) - 1:
            flush(False, i == len(packets) - 1)
    return out


def write_ogg(samples: bytes, *, channels: int = 2, rate: int = 8000, packet_samples: int = 4096, per_page: int = 48) -> bytes:
    """Interleaved unsigned 8-bit ``samples`` as one multiplexed Ogg stream:
    a logical stream of mono PCM per channel.  The same samples give the same
    bytes: serial numbers come from the content."""
    seed = zlib.crc32(samples)
    pages: list[tuple[int, int, bytes]] = []
    for c in range(channels):
        own = samples[c::channels]
        cuts = range(0, len(own), packet_samples)
        head = PCM_HEADER.pack(b"PCM     ", 0, 0, 1, rate, 8, 1, packet_samples, 1)
        note = f"channel={c}/{channels}".encode()
        comment = struct.pack("<I", 8) + b"docskein" + struct.pack("<II", 1, len(note)) + note
        packets = [head, comment, *(own[a : a + packet_samples] for a in cuts)]
        ends = [0, 0, *(min(a + packet_samples, len(own)) for a in cuts)]
        pages += [(t, c, p) for t, p in _pages((seed + c) & 0xFFFFFFFF, packets, ends, per_page)]
    # All first pages come before any other page; later ones in order of time.
    firsts = [p for _, _, p in pages if p[5] & BOS]
    rest = sorted(((t, c, p) for t, c, p in pages if not p[5] & BOS), key=lambda x: x[:2])
    return b"".join([*firsts, *(p for _, _, p in rest)])


# --- reading ----------------------------------------------------------------


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    granule: int  # the end of the packet in samples, derived where a page has none
    start_s: float = 0.0
    end_s: float = 0.0
    whole: bool = True
    placed: bool = False  # whether its time is known and lies within the media


@dataclass
class Stream:
    serial: int
    order: int
    rate: int = 0
    channel: int = 0
    channels: int = 1
    packets: list[Packet] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)
    next_page: int = 0
    lost: bool = False
    ended: bool = False


@dataclass
class Demuxed:
    streams: list[Stream]
    pages: int = 0
    bad_pages: int = 0
    skipped_bytes: int = 0
    size: int = 0  # bytes read


def read_ogg(data: bytes) -> Demuxed:
    """Pages verified and taken apart; bytes outside valid pages are counted
    and skipped, a packet that lost a part is marked as not whole.  Any bytes are
    read without an error: what a valid page claims is never taken for a size."""
    by_serial: dict[int, Stream] = {}
    out = Demuxed([], size=len(data))
    at, size = 0, len(data)
    while at < size:
        begin = data.find(b"OggS", at)
        if begin < 0 or begin + 27 > size:
            out.skipped_bytes += size - at
            break
        out.skipped_bytes += begin - at
        _, version, flags, granule, serial, number, crc, n = PAGE_HEADER.unpack_from(data, begin)
        lacing = data[begin + 27 : begin + 27 + n]
        end = begin + 27 + n + sum(lacing)
        page = data[begin:end]
        if version != 0 or len(lacing) < n or end > size or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad_pages += 1
            out.skipped_bytes += 4
            at = begin + 4
            continue
        at, out.pages = end, out.pages + 1
        stream = by_serial.get(serial)
        if stream is None:
            stream = by_serial[serial] = Stream(serial, len(by_serial))
            out.streams.append(stream)
        _take_page(stream, flags, granule, number, lacing, page[27 + n :])
    for s in out.streams:
        _timestamps(s)
    return out


def _take_page(s: Stream, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
    if number != s.next_page or bool(flags & CONTINUED) != bool(s.open):
        s.lost = bool(s.open) or bool(flags & CONTINUED) or s.lost
        s.open = []
    s.next_page, s.ended = number + 1, bool(flags & EOS)
    at = 0
    parts, done = s.open, []
    skip = bool(flags & CONTINUED) and not parts  # its beginning is lost
    run = 0
    for v in lacing:
        run += v
        if v < 255:
            parts.append(body[at : at + run])
            at, run = at + run, 0
            done.append(Packet(s.serial, len(s.packets) + len(done), b"".join(parts), NO_GRANULE, whole=not skip))
            parts, skip = [], False
    if lacing and lacing[-1] == 255:
        parts.append(body[at:])
    s.open = parts
    if done:
        done[-1].granule = granule
    s.packets += done


def _timestamps(s: Stream) -> None:
    """Header fields, and the end of every packet: a page's granule position
    belongs to the last packet that ends on it; earlier packets of the page
    count back from there by their lengths (one byte is one sample)."""
    if s.packets and s.packets[0].data.startswith(b"PCM     ") and len(s.packets[0].data) >= PCM_HEADER.size:
        s.rate = PCM_HEADER.unpack_from(s.packets[0].data)[4]
    told = CHANNEL.search(s.packets[1].data) if len(s.packets) > 1 else None
    if told:
        s.channel, s.channels = int(told[1]), int(told[2])
    later = None
    for p in reversed(s.packets[2:]):
        if p.granule == NO_GRANULE and later is not None and later.granule != NO_GRANULE:
            p.granule = later.granule - len(later.data)
        later = p
        if s.rate and p.granule != NO_GRANULE:
            p.start_s, p.end_s = (p.granule - len(p.data)) / s.rate, p.granule / s.rate


def samples_of(media: Demuxed) -> bytes:
    """The interleaved samples, every packet at the place its time gives it.

    A packet without a time, or that ends before sample 0 or beyond as many
    samples as the media has bytes, has no place and is left out; one that
    begins before sample 0 gives what comes after (and is not whole)."""
    streams = sorted((s for s in media.streams if s.rate), key=lambda s: s.channel)
    if not streams:
        return b""
    for s in streams:
        for p in s.packets[2:]:
            p.placed = p.granule != NO_GRANULE and 0 <= p.granule <= media.size
    longest = max((p.granule for s in streams for p in s.packets[2:] if p.placed), default=0)
    grid = np.zeros((longest, len(streams)), dtype=np.uint8)
    for c, s in enumerate(streams):
        for p in (p for p in s.packets[2:] if p.placed):
            data = p.data[max(0, len(p.data) - p.granule) :]
            p.whole = p.whole and len(data) == len(p.data)
            grid[p.granule - len(data) : p.granule, c] = np.frombuffer(data, dtype=np.uint8)
    return grid.tobytes()


def describe(media: Demuxed, samples: bytes) -> str:
    """Integer features of the decoded sound, so that equal media agree exactly."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    packets = sum(len(s.packets) for s in media.streams)
    last = max((p.end_s for s in media.streams for p in s.packets if p.placed), default=0.0)
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0))) if x.size else 0
    peak = int(np.abs(x).max()) if x.size else 0
    return (
        f"streams={len(media.streams)};pages={media.pages};bad_pages={media.bad_pages};packets={packets};"
        f"duration_us={round(last * 1e6)};sum={int(x.sum())};energy={int((x * x).sum())};peak={peak};crossings={crossings}"
    )


# --- columns ----------------------------------------------------------------

ENCODED = "payload binary, media binary"


def _per_value(df: DataFrame, column: str, fields: list[pa.Field], work) -> DataFrame:
    """``df`` plus fields that ``work`` (value or None -> tuple) gives for each
    value of ``column``; columns of those names are replaced."""
    need(df, column=column)
    new = {f.name.lower() for f in fields}
    own = [c for c in df.columns if c.lower() not in new]
    at = df.columns.index(column)
    keep = [df.columns.index(c) for c in own]
    spark_type = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    schema = df.select(*[F.col(f"`{c}`") for c in own]).schema
    for f in fields:
        schema = schema.add(f.name, spark_type[f.type])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = [work(v) for v in part.column(at).to_pylist()]
            cols = [part.column(i) for i in keep] + [pa.array([m[k] for m in made], f.type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def text_payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def encode_media(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` plus ``media``: each text's UTF-8 bytes, zero-padded to a positive
    multiple of 64, as 8-bit samples in an Ogg stream (binary).

    Null text counts as empty: 64 zero samples.  Equal texts give equal bytes,
    whatever the row.  An empty table gives an empty table.
    """
    return _per_value(df, text_col, [pa.field("media", pa.binary())], lambda v: (write_ogg(text_payload(v)),))


def decode_media(df: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``df`` plus ``payload`` (the samples as binary) and ``feature``.

    Null media or bytes without a valid page: an empty payload.  Pages that
    fail their checksum are left out, and their samples are 0; so are packets
    whose time no page tells or the media cannot hold.  Any bytes are read, and
    no more than their own number of samples a stream is made of them.
    """

    def work(v: bytes | None) -> tuple[bytes, str]:
        media = read_ogg(v or b"")
        samples = samples_of(media)
        return samples, describe(media, samples)

    return _per_value(df, media_col, [pa.field("payload", pa.binary()), pa.field("feature", pa.string())], work)


def packets_of(df: DataFrame, *, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per packet: id, serial, packet number, start and end in seconds,
    whether it is whole, and its bytes."""
    need(df, id=id_col, media=media_col)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, serial bigint, packet int, granule bigint, start_s double, end_s double, whole boolean, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            for i, v in enumerate(part.column(1)):
                packets = [p for s in read_ogg(v.as_py() or b"").streams for p in s.packets]
                if packets:
                    columns = [
                        pa.array([part.column(0)[i].as_py()] * len(packets), part.column(0).type),
                        pa.array([p.serial for p in packets], pa.int64()), pa.array([p.number for p in packets], pa.int32()),
                        pa.array([p.granule for p in packets], pa.int64()), pa.array([p.start_s for p in packets]),
                        pa.array([p.end_s for p in packets]), pa.array([p.whole for p in packets]),
                        pa.array([p.data for p in packets], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "serial", "packet", "granule", "start_s", "end_s", "whole", "data"])

    return df.select(id_col, media_col).mapInArrow(run, schema)


# --- query ------------------------------------------------------------------

NAME = "op1_ogg"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    media = encode_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    back = decode_media(media)
    tail = F.expr("substring(payload, greatest(length(payload) - 63, 1), 64)")
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )
