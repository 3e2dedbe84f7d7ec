import base64
import gzip
import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docskein.llm import ogg, warc
from tests.conftest import DATA


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_page_crc():
    for n in (0, 1, 5, 255, 1000):
        data = os.urandom(n)
        assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [64, 128, 510 * 2, 4096 * 2, 4096 * 2 + 64, 255 * 48 * 2, 300_032])
@pytest.mark.parametrize("channels", [1, 2, 4])
def test_round_trip_and_times(n, channels):
    x = os.urandom(n)
    media = ogg.read_ogg(ogg.write_ogg(x, channels=channels, packet_samples=1020, per_page=5))
    assert ogg.samples_of(media) == x and not media.bad_pages and not media.skipped_bytes
    assert len(media.streams) == channels
    for s in media.streams:
        assert s.ended and not s.lost
        at = 0
        for p in s.packets[2:]:
            assert p.start_s == pytest.approx(at / 8000) and p.whole
            at += len(p.data)
            assert p.granule == at


def test_damage_is_seen_and_skipped():
    x = bytes(range(256)) * 200
    raw = bytearray(ogg.write_ogg(x, packet_samples=1000, per_page=6))
    where = raw.index(b"OggS", len(raw) // 2) + 60
    raw[where] ^= 1
    media = ogg.read_ogg(b"junk" + bytes(raw))
    assert media.bad_pages == 1 and media.skipped_bytes > 4
    back = ogg.samples_of(media)
    assert len(back) == len(x) and back != x and sum(a != b for a, b in zip(back, x)) < 7000


def page(flags, granule, serial, number, lacing, body):
    raw = ogg.PAGE_HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + bytes(lacing) + body
    return raw[:22] + ogg.page_crc(raw).to_bytes(4, "little") + raw[26:]


def test_valid_pages_of_foreign_streams():
    head = ogg.PCM_HEADER.pack(b"PCM     ", 0, 0, 1, 8000, 8, 1, 4096, 1)
    start = lambda note: page(2, 0, 7, 0, [len(head)], head) + page(0, 0, 7, 1, [len(note)], note)
    for note in (b"channel=left", b"channel=", b"channel=1/2/3", b"channel=99999999999/1", b""):
        for granule, samples in ((-1, b""), (2, b"cd"), (4, b"abcd"), (2**45, b""), (2**62, b""), (-5, b""), (0, b"")):
            media = ogg.read_ogg(start(note) + page(4, granule, 7, 2, [4], b"abcd"))
            assert ogg.samples_of(media) == samples and media.pages == 3
            assert ogg.describe(media, ogg.samples_of(media))


def test_any_damage_with_repaired_checksums():
    rng = random.Random(9)
    whole = ogg.write_ogg(bytes(rng.randrange(256) for _ in range(6000)), packet_samples=700, per_page=4)
    for _ in range(300):
        raw = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        at = raw.find(b"OggS")
        while at >= 0:  # every page's checksum is made right again
            n = raw[at + 26] if at + 26 < len(raw) else 0
            end = at + 27 + n + sum(raw[at + 27 : at + 27 + n])
            if end <= len(raw):
                raw[at + 22 : at + 26] = bytes(4)
                raw[at + 22 : at + 26] = ogg.page_crc(bytes(raw[at:end])).to_bytes(4, "little")
            at = raw.find(b"OggS", at + 4)
        media = ogg.read_ogg(bytes(raw))
        samples = ogg.samples_of(media)
        assert len(samples) <= len(raw) * max(1, len(media.streams)) and ogg.describe(media, samples)


def test_media_frames(spark, docs):
    df = docs((1, None), (2, ""), (3, "é" * 32), (None, "abc"), (3, "é" * 32)).withColumn("media", F.lit("old"))
    rows = ogg.decode_media(ogg.encode_media(df)).collect()
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[1, None].payload == by[2, ""].payload == bytes(64)
    assert by[3, "é" * 32].payload == ("é" * 32).encode() and len(rows) == 5
    assert bytes(by[None, "abc"].payload) == b"abc" + bytes(61) and by[2, ""]["a b"] == 7
    assert ogg.packets_of(ogg.encode_media(df), id_col="doc_id").where("doc_id = 2").count() == 6
    assert ogg.encode_media(df.limit(0)).count() == 0
    assert ogg.decode_media(df.select(F.lit(b"not ogg").alias("media"))).first().payload == b""


def test_media_query(spark):
    rows = ogg.query(spark, f"{DATA}/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        payload = ogg.text_payload(texts[r.doc_id])
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.payload_bytes == len(payload) and len(payload) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(ogg.write_ogg(payload)).hexdigest()


def record(i, body=b"<p>x</p>"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Type: application/http\r\nWARC-Block-Digest: sha1:{warc.sha1_base32(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def ids_and_gaps(data):
    found = list(warc.salvage(data))
    return [f[-1]["warc-record-id"] for f in found if f[-1]], [(f[0], f[1]) for f in found if not f[-1]]


def test_salvage_plain():
    parts = [record(i, b"body %d" % i) for i in range(5)]
    whole = b"".join(parts)
    assert ids_and_gaps(whole) == ([f"<urn:{i}>" for i in range(5)], [])
    bad = bytearray(whole)
    bad[len(parts[0]) + len(parts[1]) - 6] ^= 1  # in the body of record 1
    assert ids_and_gaps(bytes(bad)) == ([f"<urn:{i}>" for i in (0, 2, 3, 4)], [(len(parts[0]), len(parts[1]))])
    assert ids_and_gaps(b"junk\r\n" + whole[:-9]) == ([f"<urn:{i}>" for i in range(4)], [(0, 6), (6 + len(whole) - len(parts[4]), len(parts[4]) - 9)])
    assert ids_and_gaps(b"") == ([], []) and ids_and_gaps(b"WARC/1.1\r\n") == ([], [(0, 10)])
    tricky = record(9, b"WARC/1.1\r\nfake")
    assert ids_and_gaps(tricky)[0] == ["<urn:9>"]


def test_salvage_members():
    rng = random.Random(1)
    parts = [record(i, bytes(rng.randrange(256) for _ in range(400))) for i in range(6)]
    members = [warc.gzip_members([p]) for p in parts]
    data = bytearray(b"".join(members))
    assert ids_and_gaps(bytes(data))[0] == [f"<urn:{i}>" for i in range(6)]
    data[len(members[0]) + len(members[1]) // 2] ^= 0xFF
    ids, gaps = ids_and_gaps(bytes(data))
    assert ids == [f"<urn:{i}>" for i in (0, 2, 3, 4, 5)] and sum(n for _, n in gaps) <= len(members[1])
    many = warc.gzip_members([b"".join(parts)])
    assert ids_and_gaps(many + parts[0]) == ([f"<urn:{i}>" for i in (*range(6), 0)], [])
    ids, gaps = ids_and_gaps(many[: len(many) // 2] + b"\r\n" + parts[3])
    assert ids[-1] == "<urn:3>" and gaps


def test_error_in_a_member_of_many_records():
    """All that stands before the broken byte is kept; a wrong trailer loses nothing."""
    for n, size in ((8000, 20), (300, 4000), (1, 10)):
        rng = random.Random(n)
        parts = [record(i, rng.randbytes(size)) for i in range(n)]
        member = bytearray(warc.gzip_members([b"".join(parts)]))
        member[-5] ^= 1  # in the checksum
        ids, gaps = ids_and_gaps(bytes(member) + warc.gzip_members([record("next")]))
        assert ids == [f"<urn:{i}>" for i in (*range(n), "next")] and gaps
        if n > 1:
            member = bytearray(warc.gzip_members([b"".join(parts)]))
            member[len(member) // 2 : len(member) // 2 + 40] = b"\xff" * 40
            assert len(ids_and_gaps(bytes(member))[0]) >= 0.45 * n


def test_reader_from_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1) + b"damage" + record(2))
    (tmp_path / "b.warc.gz").write_bytes(warc.gzip_members([record(3), record(4)]))
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows if r.status == "record") == [f"urn:{i}" for i in (1, 2, 3, 4)]
    assert [(r.length, r.reason) for r in rows if r.status == "gap"] == [(6, "no version line")]


def test_warc_edges(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nWARC-Type: x", None), (4, "u", ""), (None, "u", "x"), (2, "u", "x"), (7, "u", "é" * 10)],
        "page_id bigint, url string, html string",
    )
    path = str(tmp_path / "w")
    warc.write_warc(warc.warc_records(pages), path)
    rows = warc.read_warc(spark, path).collect()
    got = sorted((r.record_id.rsplit(":", 1)[1], r.record_type, (r.refers_to or ":").rsplit(":", 1)[1], r.payload_bytes, r.target_uri) for r in rows)
    assert got == sorted([
        ("1", "revisit", "2", 1, "http://a/"), ("2", "response", "", 1, "urn:docskein:page:2"), ("2", "response", "", 1, "u"),
        ("3", "revisit", "4", 0, "u%0A%0AWARC-Type: x"), ("4", "response", "", 0, "u"), ("null", "revisit", "2", 1, "u"), ("7", "response", "", 20, "u"),
    ])
    digest = {r.payload_digest for r in rows if r.payload_bytes == 20}
    assert digest == {base64.b32encode(hashlib.sha1(("é" * 10).encode()).digest()).decode()}
    small = warc.warc_records(pages, min_bytes=2).collect()
    assert sum("WARC-Type: revisit" in r.record for r in small) == 0
    assert warc.warc_records(pages.limit(0)).count() == 0


def test_damage_to_written_archive(spark, tmp_path):
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{rng.random()}</p>" * 20) for i in range(60)], "page_id bigint, url string, html string")
    path = tmp_path / "w"
    warc.write_warc(warc.warc_records(pages).coalesce(1), str(path), records_per_file=40)
    files = sorted(f for f in path.iterdir() if f.name.startswith("part-"))
    assert sorted(len(ids_and_gaps(f.read_bytes())[0]) for f in files) == [20, 40]
    for f in files:
        data = bytearray(f.read_bytes())
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") in (20, 40)
        whole, none = ids_and_gaps(bytes(data))
        for at in (len(data) // 3, len(data) - 30):
            bad = bytearray(data)
            bad[at] ^= 0xFF
            ids, gaps = ids_and_gaps(bytes(bad))
            assert not none and len(ids) == len(whole) - 1 and len(gaps) == 1


def test_members_of_all_sizes(spark, tmp_path):
    pages = spark.range(4).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), if(id = 2, 17000000, 10)) AS html").coalesce(1)
    path = tmp_path / "w"
    for size in (1, 8 << 20):
        warc.write_warc(warc.warc_records(pages), f"{path}{size}", file_bytes=size)
        rows = warc.read_warc(spark, f"{path}{size}").select("record_id", "status", "payload_bytes").collect()
        assert sorted(r.payload_bytes for r in rows) == [10, 10, 10, 17_000_000] and {r.status for r in rows} == {"record"}


def test_empty_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_warc(warc.warc_records(pages), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_long_url(spark, tmp_path):
    url = "http://h/?q=" + "é WARC/1.1" * 20_000
    pages = spark.createDataFrame([(1, url, "x"), (2, "data:" + "y" * 65_536, "z"), (3, "u", "w")], "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(warc.warc_records(pages), path)
    rows = warc.read_warc(spark, path).collect()
    assert {r.target_uri: r.payload for r in rows} == {url: b"x", "data:" + "y" * 65_536: b"z", "u": b"w"}
    cut = b"WARC/1.1\r\nWARC-Type: response\r\n" + b"x" * 200_000
    assert ids_and_gaps(cut + b"\r\n" + record(1)) == (["<urn:1>"], [(0, len(cut) + 2)])
