"""WARC archives: one gzip member per record, and a reader that splits any archive by bytes.

A reading task gets a byte range. It looks for the gzip magic, decodes the member
that seems to begin there, and accepts it if it opens with a WARC header and its
checksum holds; it owns the records of the members that begin inside its range and
reads past the range's end to finish the last one. A page may itself hold gzipped
WARC bytes, and a range may begin inside such a page. So ranges of files with several
of them are scanned once beforehand for the place where their last member ends: no
member of a later range begins before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import first_column, pinned, text_slices, tidied
from pairloom.operators.joins import lookup_join

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = "urn:x-page:"
_BLOCK = 1 << 20
_CONTROL = re.compile("[\x00-\x20\x7f]")

FILES = "file string, bytes bigint, records bigint"


def record_bytes(headers: list[tuple[str, str]], block: bytes = b"") -> bytes:
    """One WARC record; control characters and spaces in header values are percent-encoded where they would break a line."""
    lines = [f"{name}: {value}" for name, value in headers if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + END


def member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member of its own, the same bytes on every run."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def page_record(name: str, url: str | None, payload: bytes, size: int, sha1: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response and repeats its HTTP header only."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    uri = None if url is None else _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record_bytes([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{NAMES}{name}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", f"<{NAMES}{refers_to}>" if revisit else None),
    ], http if revisit else http + payload)


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = 1000, file_bytes: int = 1 << 30, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write every row as a record below ``path``; return the finished files (file, bytes, records).

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest
    key hold the payload and the others revisit it; equal rows with that key all hold it.
    A null key is smaller than any other and becomes an empty name, a null url leaves its
    header out, a null payload is empty; payloads are whole, other columns are ignored, and
    an empty table writes no file. Each task names its files anew, and only the files of
    the attempts that finished are returned, so a lost executor leaves no half records.
    ``path`` must be a place that tasks reach through ``pyarrow.fs`` (file, hdfs, s3, gs).
    """
    spark = pages.sparkSession
    whole = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), whole.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "same": F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256))})
    copies = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.max("key").alias("original"), F.count("*").alias("n"))
    copies = pinned(copies.where((F.col("n") > 1) & F.col("original").isNotNull()).drop("n"))
    joined = lookup_join(rows, copies, "same", "left", spread_by=["key", "url"])
    revisits = F.col("original").isNotNull() & ~F.col("key").eqNullSafe(F.col("original"))
    planned = joined.select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name"), "url",
        F.when(revisits, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", F.sha1("payload").alias("sha1"),
        F.when(revisits, F.col("original").cast("string")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        out, name, written, records = None, "", 0, 0

        def finished() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "bytes": [written], "records": [records]})

        for part in text_slices(batches, "payload"):
            for row in part.to_pylist():
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, records = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                    info = member(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    written = len(info)
                packed = member(page_record(row["name"], row["url"], row["payload"], row["size"], row["sha1"], row["refers_to"], date))
                out.write(packed)
                written, records = written + len(packed), records + 1
                if written >= file_bytes:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return pinned(planned.mapInArrow(tidied(run), FILES))


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """The archives below ``path`` (file, bytes), for a folder that this module did not write."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


class Members:
    """The gzip members with WARC records that begin in [start, end) of an open file, in order."""

    def __init__(self, file: pa.NativeFile, start: int, end: int):
        self.file, self.end = file, end
        self.move(start)

    def move(self, place: int) -> None:
        self.file.seek(place)
        self.place, self.held = place, b""

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(first byte, byte after the last one, decoded records)."""
        while self.place < self.end:
            found = self.held.find(MAGIC)
            if found < 0:
                more = self.file.read(_BLOCK)
                # Two bytes stay: the magic may lie across the limit of two reads.
                kept = self.held[-2:]
                self.place += len(self.held) - len(kept)
                self.held = kept + more
                if not more:
                    return
                continue
            self.place += found
            self.held = self.held[found:]
            if self.place >= self.end:
                return
            begin = self.place
            data = self.decoded()
            if data is None:
                self.move(begin + 1)
            else:
                yield begin, self.place, data

    def decoded(self) -> bytes | None:
        """The member at the current place, which moves behind it; None if no whole member with a WARC header begins here."""
        expand, parts, checked, piece, used = zlib.decompressobj(31), [], False, self.held, 0
        head = b""
        while True:
            try:
                data = expand.decompress(piece)
            except zlib.error:
                return None
            used += len(piece) - len(expand.unused_data)
            parts.append(data)
            if not checked:
                head += data[:5 - len(head)]
                if not b"WARC/".startswith(head) or expand.eof and len(head) < 5:
                    return None
                checked = len(head) == 5
            if expand.eof:
                self.place, self.held = self.place + used, expand.unused_data
                return b"".join(parts)
            piece = self.file.read(_BLOCK)
            if not piece:
                return None


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a decoded member."""
    place = 0
    while data.startswith(b"WARC/", place):
        stop = data.index(END, place)
        headers = {}
        for line in data[place:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        yield headers, data[stop + 4:stop + 4 + size]
        place = stop + 4 + size
        while data[place:place + 1] in (b"\r", b"\n"):
            place += 1


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)", re.IGNORECASE)
_HEX = re.compile("[0-9a-fA-F]{40}")


def digest_hex(header: str | None) -> str | None:
    """A declared SHA-1 in lower-case hexadecimal; it may be written in base 32 or in hexadecimal."""
    kind, _, value = (header or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if _HEX.fullmatch(value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def described(file: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> dict:
    """A record as a row. The size of a revisit's payload is the one that its HTTP header declares."""
    payload, revisit = block, headers.get("warc-type") == "revisit"
    size = None if revisit else len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(END)
        declared = _LENGTH.search(head + b"\r\n") if revisit else None
        size = int(declared[1]) if declared else None if revisit else len(payload)
    declared = digest_hex(headers.get("warc-payload-digest"))
    found = None if revisit else hashlib.sha1(payload).hexdigest()
    return {
        "file": file, "offset": offset, "length": length, "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"),
        "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "headers": list(headers.items()),
        "payload_bytes": size, "payload_digest": found or declared, "digest_ok": found == declared if found and declared else None, "payload": None if revisit else payload,
    }


RECORDS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("digest_ok", T.BooleanType()), T.StructField("payload", T.BinaryType()),
])
_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary()),
])
_BATCH_BYTES = 8 << 20


def ranges_of(files: DataFrame, split_bytes: int) -> DataFrame:
    """The byte ranges (file, start, stop) of every file, one range a task."""
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start")
    cut = files.where("bytes > 0").select("file", "bytes", begin)
    # A range that would read beyond its file ends with it.
    cut = cut.select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("stop"))
    return cut.repartition(max(1, cut.count()))


def first_places(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``place``, the byte before which no member of the range begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["file"])
                last = row["start"]
                with store.open_input_file(name) as file:
                    for _, last, _ in Members(file, row["start"], row["stop"]):
                        pass
                yield pa.RecordBatch.from_pylist([row | {"last": last}])

    before = Window.partitionBy("file").orderBy("start")
    many = ranges.withColumn("ranges", F.count("*").over(Window.partitionBy("file")))  # the ranges of a file are few
    alone = many.where("ranges = 1").select("file", "start", "stop", F.col("start").alias("place"))
    scanned = many.where("ranges > 1").select("file", "start", "stop")
    scanned = scanned.repartition(max(1, scanned.count())).mapInArrow(tidied(run), "file string, start bigint, stop bigint, last bigint")
    earlier = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    placed = scanned.select("file", "start", "stop", F.greatest("start", F.coalesce(earlier, F.col("start"))).alias("place"))
    return alone.unionByName(placed)


def read_warc(files: DataFrame, split_bytes: int = 64 << 20, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``files`` (file, bytes), whatever tasks their bytes go to.

    ``payload_bytes``, ``payload_digest`` (SHA-1, lower-case hexadecimal) and ``digest_ok``
    are taken from the payload as read; a revisit has none, so it gives what its headers
    declare and null for ``digest_ok``. Headers have lower-case names. ``payloads=False``
    leaves the payloads in the task that read them. A member that is cut off or damaged is
    no record; the scan goes on behind its first byte. A record must fit into a task.
    """
    ranges = pinned(first_places(ranges_of(files, split_bytes)))
    schema = RECORDS if payloads else T.StructType(RECORDS.fields[:-1])
    arrow = _ARROW if payloads else pa.schema(list(_ARROW)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["file"])
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for offset, after, data in Members(file, row["place"], row["stop"]):
                        for headers, block in records_of(data):
                            rows.append(described(row["file"], offset, after - offset, headers, block))
                            held += len(block) + 1000 if payloads else 1000
                            if not payloads:
                                del rows[-1]["payload"]
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return ranges.repartition(max(1, ranges.count())).mapInArrow(tidied(run), schema)


def named_key(name: str) -> Column:
    """The key inside a record's name; null for an empty one."""
    return F.nullif(F.regexp_extract(name, f"^<{NAMES}(.*)>$", 1), F.lit(""))


def pages_of(records: DataFrame, key_type: str = "bigint") -> DataFrame:
    """The page records as (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    kept = records.where(F.col("record_type").isin("response", "revisit"))
    return kept.select(named_key("record_id").cast(key_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", named_key("refers_to").cast(key_type).alias("refers_to"))
