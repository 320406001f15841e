import hashlib
import zlib

from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.shared import Scratch

SCHEMA = "page_id long, url string, html string, payload string, archive string, length long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", "a", 1) for r in rows], SCHEMA)


def test_round_trip(spark):
    big, long = "<p>é</p>" * 200, "x" * 300_000
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (5, None, big), (None, "http://n", big), (2, "u", "small"), (3, "u", "small"), (4, "http://a/4", None), (6, "bad\r\nurl", ""), (-7, "http://a/7", long), (12, "t", "y" * 999), (11, "t", "y" * 999), (13, "t", "z" * 1000), (14, "t", "z" * 1000)]
    got = {r["page_id"]: r for r in warc.archive_pages(pages(spark, rows).repartition(3)).collect()}
    for page, _, html in rows:
        data, r = (html or "").encode(), got[page]
        first = max((x[0] for x in rows if x[0] is not None and (x[2] or "").encode() == data), default=None)
        again = len(data) >= 1000 and first != page and sum((x[2] or "").encode() == data for x in rows) > 1
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))


def test_selected_records_and_payloads(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)]
    scratch = Scratch(spark, "warc-test")
    index = warc.write_archives(pages(spark, rows).coalesce(2), scratch)
    some = index.filter(F.col("page_id") % 7 == 0)
    got = warc.read_records(some, scratch.path("archives"), span_bytes=4096, gap_bytes=100).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got} == {i: h for i, _, h in rows if i % 7 == 0}
    assert {r["url"] for r in got} == {u for i, u, _ in rows if i % 7 == 0}


def test_repeated_rows_and_empty(spark):
    body = "q" * 2000
    got = warc.archive_pages(pages(spark, [(3, "a", body), (3, "a", body), (1, "b", body)])).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "revisit"), (3, "response"), (3, "response")]
    assert {r["record_type"] for r in warc.archive_pages(pages(spark, [(None, "a", body), (None, "b", body)])).collect()} == {"response"}
    assert warc.archive_pages(pages(spark, [])).collect() == []


def test_records_are_whole(spark):
    """Every record has the fields that readers ask for, and what cannot stand on a line comes back as it was."""
    for page, url in ((1, "http://a/b"), (None, "bad\r\nurl: x"), (-5, None)):
        data = warc.encode_record(page, url, b"<p>x</p>", hashlib.sha1(b"<p>x</p>").hexdigest(), "response", None, date="2020-01-02T03:04:05Z")
        head = zlib.decompress(data, 31).split(b"\r\n\r\n")[0].decode().split("\r\n")
        names = {line.partition(":")[0] for line in head[1:]}
        assert head[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= names and "WARC-Date: 2020-01-02T03:04:05Z" in head
        got = warc.decode_record(data)
        assert (got["page_id"], got["url"], got["payload"]) == (page, url, b"<p>x</p>")


def test_large_payload(spark):
    body = "é" * 3_000_000
    got = warc.archive_pages(pages(spark, [(1, "u", body)])).first()
    assert (got["payload_bytes"], got["payload_digest"]) == (6_000_000, hashlib.sha1(body.encode()).hexdigest())
