import base64
import hashlib
import struct
from collections import defaultdict

import pytest

from fieldtree.llm import warc_archive as W

SCHEMA = "page_id long, url string, html string, digest string, payload string, response long"


def expected(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        known = [p for p in groups[html or ""] if p is not None]
        first = max(known) if known else None
        refers = None if page == first else first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [],
    [(1, "http://a/", None), (2, "http://b/\r\nX: y", ""), (3, None, "é" * 10), (None, "http://c/", "é" * 10), (5, "http://d/", "é" * 10)],
    [(7, "u", "same"), (7, "u", "same"), (None, None, "alone"), (None, None, "alone"), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n")],
    [(i, f"http://h/{i}", "page %d " % (i % 40) + "filler text " * (i % 17)) for i in range(300)] + [(1000, "long", "x y z " * 400_000)],
])
def test_round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in W.archived_pages(df).collect()), key=str)
    assert got == expected(rows)


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = {r.record_id: r.record_type for r in W.read_archives(W.write_archives(df, least=3)).collect()}
    assert kinds == {"urn:page:1": "response", "urn:page:2": "response", "urn:page:3": "revisit", "urn:page:4": "response"}


def test_dates_are_the_capture_times(spark):
    """Of the column that is named, in UTC; a null one, and all without a column, of the time of writing."""
    from datetime import datetime, timedelta, timezone

    when = datetime(2021, 3, 4, 5, 6, 7, 890_000, tzinfo=timezone.utc)
    df = spark.createDataFrame([(1, "u", "a", when), (2, "u", "a", when + timedelta(days=1)), (3, "u", "b", None)], "page_id long, url string, html string, date timestamp")
    named = {r.record_id: r.date for r in W.read_archives(W.write_archives(df, captured="date")).collect()}
    assert (named["urn:page:1"], named["urn:page:2"]) == ("2021-03-04T05:06:07Z", "2021-03-05T05:06:07Z")
    plain = {r.date for r in W.read_archives(W.write_archives(df)).collect()}
    for text in [named["urn:page:3"], *plain]:
        assert abs(datetime.now(timezone.utc) - datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)) < timedelta(minutes=5)
    assert len(plain) == 1


def test_archive_layout(tmp_path):
    records = [W.record_bytes(f"urn:page:{i}", "http://x/", "D", 3, None, b"abc") for i in range(50)]
    path = str(tmp_path / "a.warc.zst")
    W.write_archive(path, records)
    data = open(path, "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == W.SKIPPABLE and data[8 : 8 + size] == W.train(records).as_bytes()
    assert data.count(b"\x28\xb5\x2f\xfd") >= 50  # a frame per record
    assert list(W.read_archive(path)) == records
    with pytest.raises(ValueError):
        open(path, "wb").write(data[:-5])
        list(W.read_archive(path))


def test_damage_is_found():
    record = W.record_bytes("urn:page:1", "u", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), 3, None, b"abc")
    assert W.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        W.parse_record(record.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
