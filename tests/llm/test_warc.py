"""WARC archives written and read back, at every way of cutting them."""

import base64
import gzip
import hashlib
import io
import os
import zlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import warc

PAGES = [
    (1, "http://a/x", "<p>one</p>"), (2, "http://a/é b\r\nX: y", "<p>two</p>"), (3, None, "<p>one</p>"), (9, "http://a/z", "<p>one</p>"),
    (4, "http://b", None), (5, "http://b", ""), (6, "u", "ü" * 3000), (None, "n", "<p>two</p>"), (None, "n", "no id"), (None, "n", "no id"),
    (7, "twice", "twice"), (7, "twice", "twice"), (-8, "less", "twice"), (10, "", "HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\n"), (11, "l", "x" * 300_000),
]


def frame(spark, rows=PAGES):
    made = [(*r, 1, "h") for r in rows]
    return spark.createDataFrame(made, "page_id long, url string, html string, holder int, h string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(least=0):
    out = []
    for i, _, html in PAGES:
        size = len((html or "").encode())
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        revisit = size >= least and ids and (i is None or i < max(ids))
        out.append((i, size, digest(html), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(map(str, out))


def test_pages_come_back(spark):
    for least in (0, 6):
        got = warc.archived_pages(frame(spark).repartition(3), least).collect()
        assert sorted(str(tuple(r)[:5]) for r in got) == brute(least)
        assert all(r["digest_holds"] for r in got if r["record_type"] == "response")
    assert warc.archived_pages(frame(spark).limit(0)).count() == 0


def archive(tmp_path, members, name="a.warc.gz"):
    (tmp_path / name).write_bytes(b"".join(members))
    return str(tmp_path / name)


def files(spark, *paths):
    return spark.createDataFrame([(p, os.path.getsize(p)) for p in paths], "path string, size long")


def response(i, payload):
    return warc.page_record(i, f"http://x/{i}", payload, None, "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 1 << 20])
def test_ranges_own_what_starts_in_them(spark, tmp_path, split):
    members = [response(i, f"page {i} ".encode() * (1 if split < 100 else i)) for i in range(2 if split < 7 else 40)]
    path = archive(tmp_path, members)
    rows = sorted(warc.read_archives(files(spark, path), split_bytes=split).collect(), key=lambda r: r["start"])
    assert [r["record_id"] for r in rows] == [f"<urn:page:{i}>" for i in range(len(members))]
    at = 0
    for r, m in zip(rows, members, strict=True):
        assert (r["start"], r["stop"]) == (at, at + len(m)) and r["range_start"] <= at < r["range_start"] + split
        assert r["digest_holds"] and r["payload_bytes"] == len(r["payload"])
        at += len(m)


def test_an_archive_inside_a_payload(spark, tmp_path):
    """What is stored uncompressed shows the members of an inner archive, and they look like records."""
    inner = b"".join(response(1000 + i, os.urandom(300)) for i in range(20))

    def stored(i, payload):
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        packer = zlib.compressobj(0, zlib.DEFLATED, warc.GZIP)
        return packer.compress(head + payload + b"\r\n\r\n") + packer.flush()

    members = [response(0, b"first"), stored(1, inner + os.urandom(400)), stored(2, inner), response(3, b"last")]
    path = archive(tmp_path, members)
    data = (tmp_path / "a.warc.gz").read_bytes()
    assert sum(warc.begins_record(io.BytesIO(data), i) for i in range(len(data)) if data.startswith(warc.MAGIC, i)) > 30
    for split in (500, 2000, 5000, 1 << 20):
        rows = sorted(warc.read_archives(files(spark, path), split_bytes=split).collect(), key=lambda r: r["start"])
        assert [r["record_id"] for r in rows] == [f"<urn:page:{i}>" for i in range(4)]
        assert bytes(rows[2]["payload"]) == inner


def test_damage_is_told(spark, tmp_path):
    """Broken members in the middle and at the end, and bytes that never were a record."""
    good = [response(i, b"page %d" % i) for i in range(6)]
    broken = bytearray(good[2])
    broken[30] ^= 0xFF
    members = [good[0], good[1], bytes(broken), good[3], gzip.compress(b"not a record"), good[4], good[5][:-9]]
    path = archive(tmp_path, members)
    for split in (50, 300, 1 << 20):
        rows = sorted(warc.read_archives(files(spark, path), split_bytes=split).collect(), key=lambda r: r["start"])
        assert [r["record_id"] for r in rows if r["record_type"] != warc.DAMAGED] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
        lost = [(r["start"], r["stop"]) for r in rows if r["record_type"] == warc.DAMAGED]
        at = [sum(map(len, members[:k])) for k in range(8)]
        assert lost == [(at[2], at[3]), (at[4], at[5]), (at[6], at[7])]


def test_other_writers(spark, tmp_path):
    """A resource without HTTP headers, a digest that doesn't hold, files found in a folder."""
    plain = warc.record("resource", "<urn:x:1>", b"\x00\xff", [("Content-Type", "image/png")])
    wrong = warc.record("resource", "<urn:x:2>", b"abc", [("WARC-Payload-Digest", "sha1:" + "A" * 32)])
    archive(tmp_path, [plain, wrong])
    archive(tmp_path, [], "empty.warc.gz")
    (tmp_path / "other.txt").write_text("no archive")
    rows = {r["record_id"]: r for r in warc.read_archives(warc.archive_files(spark, str(tmp_path))).collect()}
    assert bytes(rows["<urn:x:1>"]["payload"]) == b"\x00\xff" and rows["<urn:x:1>"]["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"\x00\xff").digest()).decode()
    assert rows["<urn:x:2>"]["digest_holds"] is False and len(rows) == 2


def test_many_files(spark, tmp_path):
    """Small files of one task; each begins with a record about itself."""
    made = warc.write_archives(frame(spark), str(tmp_path / "out"), file_bytes=600)
    rows = made.collect()
    assert len(rows) > 2 and sum(r["records"] for r in rows) == len(PAGES) + len(rows)
    kinds = warc.read_archives(made, want_payload=False).groupBy("record_type").agg(F.count("*")).collect()
    assert dict(map(tuple, kinds))["warcinfo"] == len(rows)
    with gzip.open(rows[0]["path"]) as f:  # any gzip reader takes them
        assert f.read().startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n")


def test_one_payload_of_most_pages(spark):
    """A third of the pages alike: one response."""
    pages = spark.range(0, 3000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('p', id) END AS html")
    got = warc.archived_pages(pages)
    assert {tuple(r) for r in got.where("record_type = 'revisit'").groupBy("refers_to").count().collect()} == {(2997, 999)}
    assert got.count() == 3000 and got.select("page_id").distinct().count() == 3000
