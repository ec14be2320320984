"""WARC archives on small inputs, against the payloads themselves."""

import gzip
import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import warc

LONG = "<p>same</p>" * 200
PAGES = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/9", LONG), (None, "http://a/n", LONG),  # the largest id keeps the payload
    (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, None, None), (6, "", ""), (7, "http://a/\r\nWARC-Type: x é", "é\r\n\r\nWARC/1.1\r\n\x00" * 300),
    (9, "http://a/9", LONG), (8, "http://a/8", "x" * 1000), (10, "http://a/10", "x" * 1000), (11, "http://a/11", "y" * 999), (12, "http://a/12", "y" * 999),
    (None, "u", "z" * 1000), (None, "u", "z" * 1000),
]


def expected(rows):
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        keys = [k for k, _, h in rows if h == html and k is not None] if len(payload) >= 1000 else []
        revisit = bool(keys) and key != max(keys)
        out.append((key, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", max(keys) if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_pages_come_back(spark, tmp_path, split):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({"payload": F.lit(0), "key": F.lit("k"), "a.b": F.lit(1)}).repartition(3)
    files = warc.write_warc(pages, f"file://{tmp_path}", file_bytes=2000)
    assert files.agg(F.sum("records")).first()[0] == len(PAGES)
    records = warc.read_warc(files, split_bytes=split)
    assert got(warc.pages_of(records)) == expected(PAGES)
    assert got(warc.pages_of(warc.read_warc(files, split_bytes=split, payloads=False))) == expected(PAGES)
    rows = [r for r in records.collect() if r.record_type == "response"]
    assert all(r.digest_ok and len(r.payload) == r.payload_bytes for r in rows)
    assert sorted(r.payload for r in rows if r.record_id == "<urn:x-page:7>") == ["é\r\n\r\nWARC/1.1\r\n\x00".encode() * 300 for _ in range(1)]
    revisits = [r for r in records.collect() if r.record_type == "revisit"]
    assert all(r.payload is None and r.headers["warc-profile"] == warc.PROFILE and r.digest_ok is None for r in revisits) and len(revisits) == 4
    for name in os.listdir(tmp_path):  # one gzip member a record, one stream for other readers
        if name.endswith(".warc.gz"):
            assert gzip.open(tmp_path / name).read().count(b"WARC-Record-ID") >= 2


def test_empty_table(spark, tmp_path):
    files = warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), f"file://{tmp_path}")
    assert files.count() == 0 and warc.pages_of(warc.read_warc(files)).count() == 0


def stored(record):
    squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def test_every_split_owns_each_record_once(spark, tmp_path):
    """Archives whose payloads hold magic bytes, headers of members and whole members, stored without compression."""
    draw, members, want = random.Random(3), [], []
    for n in range(40):
        inner = warc.member(warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", f"<inner:{n}>")], b"i" * n))
        noise = bytes(draw.randrange(256) for _ in range(draw.randrange(60)))
        block = draw.choice([noise, noise + inner, inner * 3, warc.MAGIC * 5 + noise, inner[:-3] + noise, warc.MAGIC + b"\x00" * 7 + noise])
        members.append(draw.choice([stored, warc.member])(warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", f"<outer:{n}>")], block)))
        want.append((f"<outer:{n}>", block))
    two = warc.record_bytes([("WARC-Record-ID", "<two:0>")], b"a") + warc.record_bytes([("WARC-Record-ID", "<two:1>")], b"b")
    members += [gzip.compress(b""), gzip.compress(b"no record"), warc.member(two), gzip.compress(warc.record_bytes([("WARC-Record-ID", "<last>")], b""))]
    want += [("<two:0>", b"a"), ("<two:1>", b"b"), ("<last>", b"")]
    whole = b"".join(members)
    (tmp_path / "x.warc.gz").write_bytes(b"junk" + whole + b"\x1f\x8b")
    (tmp_path / "cut.warc.gz").write_bytes(members[0] + members[1][:-5])
    files = warc.archive_files(spark, f"file://{tmp_path}")
    for split in (173, 1500, 1 << 20):
        rows = warc.read_warc(files, split_bytes=split).where(F.col("file").endswith("x.warc.gz")).orderBy("offset", "record_id").collect()
        assert [(r.record_id, bytes(r.payload)) for r in rows] == want
    rows = warc.read_warc(files, split_bytes=150).where(F.col("file").endswith("cut.warc.gz")).collect()
    assert [r.record_id for r in rows if r.record_id.startswith("<outer")] == ["<outer:0>"]


def test_magic_across_reads(tmp_path, monkeypatch):
    from pyarrow import fs
    record = warc.record_bytes([("WARC-Record-ID", "<a>")], b"x" * 50)
    (tmp_path / "a").write_bytes(b"\x1f\x1f\x8b" + warc.member(record) * 3)
    size = os.path.getsize(tmp_path / "a")
    for block in (1, 2, 3, 5, 64):
        monkeypatch.setattr(warc, "_BLOCK", block)
        for cut in range(size + 1):
            with fs.LocalFileSystem().open_input_file(str(tmp_path / "a")) as file:
                found = [*warc.Members(file, 0, cut), *warc.Members(file, cut, size)]
            assert [d for *_, d in found] == [record] * 3


def test_declared_digests():
    assert warc.digest_hex("sha1:" + "A" * 32) == "00" * 20 and warc.digest_hex("SHA1:" + "Ab" * 20) == "ab" * 20
    assert warc.digest_hex(None) is warc.digest_hex("md5:aa") is warc.digest_hex("sha1:?") is None
