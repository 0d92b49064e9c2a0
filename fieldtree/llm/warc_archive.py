"""WARC: dictionary-compressed archives (operator 1).

An archive is a ``.warc.zst`` file: a skippable frame that holds a Zstandard dictionary trained on
the archive's own records, then each record as a Zstandard frame of its own. Identical payloads are
stored once: the row with the largest id is the ``response``, the others are ``revisit`` records that
name it and keep the payload's length and SHA-1.

Nulls: a null payload is empty; a null id is smaller than any other and reads back as null; a null
URL is empty, and line ends in a URL become spaces. A record's date is the page's capture time where a
column of it is named and not null, else the time at which the archives are written. Rows that tie on the largest id of equal payloads are each stored as responses, so
repeated rows stay; a record's id is made from the page's id, so such rows share it. An empty table gives no archive and an empty result. Other columns are ignored.

Recovery: every attempt writes a file under a new name, and only the manifest, which Spark's own
committer writes, says which files count. Files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import open_shared, scratch, slices, stored, to_arrow, utf8

SKIPPABLE = 0x184D2A5D
#: An archive holds about so many bytes before compression; a task holds one at a time.
ARCHIVE_BYTES = 32 << 20
#: The dictionary's size, and the bytes of records it is trained on, spread evenly over the archive.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
LEVEL = 5
MANIFEST = "archive string, records long, raw_bytes long, stored_bytes long"
RECORDS = "record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, date string, payload binary"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; of their plain bytes where they are too few to train on."""
    total = sum(map(len, records))
    step = max(1, total // SAMPLE_BYTES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record_bytes(record_id: str, url: str, digest: str, length: int, refers_to: str | None, payload: bytes, date: str | None = None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit without one; without a date, of now."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date or time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime())}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    kind, digest, length = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(said["content-length"])
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, length):
            raise ValueError("a payload doesn't have its digest")
    return {"record_id": fields["WARC-Record-ID"][1:-1], "url": fields["WARC-Target-URI"], "record_type": kind, "payload_digest": digest, "payload_bytes": length, "refers_to": fields.get("WARC-Refers-To", "<>")[1:-1] or None, "date": fields["WARC-Date"], "payload": payload if kind == "response" else None}


def write_archive(uri: str, records: list[bytes]) -> int:
    """One archive file; its size."""
    dictionary = train(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    raw, size = dictionary.as_bytes(), 0
    with open_shared(uri, "wb") as out:
        for piece in (struct.pack("<II", SKIPPABLE, len(raw)), raw):
            out.write(piece)
            size += len(piece)
        for record in records:
            frame = packer.compress(record)
            out.write(frame)
            size += len(frame)
    return size


def read_archive(uri: str) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    with open_shared(uri, "rb") as source:
        magic, length = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE:
            raise ValueError("the archive doesn't begin with its dictionary")
        raw = source.read(length)
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        left = source.read(1 << 14)
        while left:
            frame, pieces = unpacker.decompressobj(), []
            while not frame.eof:
                if not left and not (left := source.read(1 << 14)):
                    raise ValueError("the archive ends inside a record")
                pieces.append(frame.decompress(left))
                left = frame.unused_data if frame.eof else b""
            left = left or source.read(1 << 14)
            yield b"".join(pieces)


def _urn(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str | Column = "html", least: int = 0, captured: str | None = None) -> DataFrame:
    """Write the rows of ``pages`` to archives in the shared folder; the manifest, one row per archive.

    Payloads of fewer than ``least`` bytes are never replaced by revisits. ``captured`` names a timestamp
    column, the dates of records (UTC, whole seconds). Shuffles: digests once
    for the groups of equal payloads, payloads once to meet their group. That join is one that the
    engine can split where a group is large, and each partial count keeps one row per digest.
    """
    spark = pages.sparkSession
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    seen = now if captured is None else F.coalesce(F.to_utc_timestamp(F.col(captured).cast("timestamp"), F.current_timezone()), now)
    date = F.date_format(seen, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " ").alias("url"), utf8(payload).alias("payload"), date.alias("date"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    joined = rows.join(groups.select(F.col("digest").alias("of"), "response"), F.col("digest") == F.col("of"), "left").select("page_id", "url", "payload", "digest", F.when(~F.coalesce(F.col("page_id") == F.col("response"), F.col("response").isNull()), F.col("response")).alias("refers_to"), "date")
    folder = scratch(spark, "archives")
    arrow = to_arrow(pages, MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            size = write_archive(uri, held)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((uri, len(held), total, size), arrow)], schema=arrow)

        held, total = [], 0
        for batch in batches:
            for part in slices(batch):
                for page, address, data, digest, refers, date in zip(*(c.to_pylist() for c in part.columns)):
                    code = base64.b32encode(bytes.fromhex(digest)).decode()
                    held.append(record_bytes(_urn(page), address, code, len(data), None if refers is None else _urn(refers), data, date))
                    total += len(held[-1])
                    if total >= ARCHIVE_BYTES:
                        yield flush()
                        held, total = [], 0
        if held:
            yield flush()

    return stored(joined.mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest names (``RECORDS``), each archive in one task."""
    arrow = to_arrow(manifest, RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                held, size = [], 0
                for data in read_archive(uri):
                    record = parse_record(data)
                    if not payloads:
                        record["payload"] = None
                    held.append(record)
                    size += len(data) if payloads else 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return manifest.select("archive").repartition(manifest.sparkSession.sparkContext.defaultParallelism, F.rand(1)).mapInArrow(run, RECORDS)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read them back, and give a row per page without its payload."""
    records = read_archives(write_archives(pages), payloads=False)
    number = lambda c: F.when(F.col(c) != "urn:page:", F.substring(c, 10, 40).cast("long"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
