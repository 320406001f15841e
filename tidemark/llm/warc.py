"""WARC archives: written by many tasks, indexed first, read back by coalesced byte ranges.

Each task writes one archive at a time, a gzip member per record, into the shared folder by a name of its own
attempt; the index (archive, offset, length, URL, digest, kind) is a written table, so it names only the archives of
attempts that ended well. Reading selects index rows, sorts them by archive and offset, cuts the archives in spans and
merges neighbouring records of a span into one read.

Defined results: null html is an empty payload; a record of a null page_id has a random id and one of a null url no
address, and both are read back as null; a url that cannot stand on a line is told in a field of its own besides;
of equal payloads long enough, the rows with the largest page_id are responses (all of them, if that row repeats) and
rows without a page_id are revisits, but responses if no row of the group has a page_id; an empty table gives an empty
index and an empty result. Columns beyond the named ones are not read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, small

INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: An archive is closed at this size and the next one begun.
ARCHIVE_BYTES = 1 << 30
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EXACT_URL = "X-Exact-Target-URI"
_ID_SPACE = 0x7469_6465_6D61_8000 << 64


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_ID_SPACE | (page_id & 0xFFFF_FFFF_FFFF_FFFF))}>"


def page_of(record: str) -> int | None:
    """The page that record_id was made of; ids of another space belong to none."""
    number = uuid.UUID(record[10:-1]).int
    low = number & 0xFFFF_FFFF_FFFF_FFFF
    return None if number >> 64 != _ID_SPACE >> 64 else low - (1 << 64) if low >> 63 else low


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str | None = None) -> bytes:
    """One gzip member. The HTTP head tells the payload's full length, in revisits too, which carry no payload. date: when the page was taken, now unless given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    own = record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if url is not None:
        plain = url.replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {plain}")
        if plain != url:
            head.append(f"{_EXACT_URL}: {json.dumps(url)}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def decode_record(data: bytes) -> dict:
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload it names")
    own, other = fields["WARC-Record-ID"], fields.get("WARC-Refers-To")
    url = json.loads(fields[_EXACT_URL]) if _EXACT_URL in fields else fields.get("WARC-Target-URI")
    return {"page_id": page_of(own), "url": url, "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": page_of(other) if other else None, "payload": payload if kind == "response" else None}


def plan_records(pages: DataFrame, scratch: Scratch, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to. Only digests are shuffled, and only those of several rows are joined back."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= revisit_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    same = scratch.save(same.filter("n > 1").select("payload_digest", "first"), "same")
    rows = rows.join(small(same), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, scratch: Scratch, revisit_bytes: int = 1000) -> DataFrame:
    """Writes the archives and returns their index, a written table."""
    folder = scratch.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            found: dict[str, list] = {k: [] for k in ("archive", "offset", "length", "payload_bytes")}
            for page_id, url, payload, digest, kind, refers in zip(*(batch.column(i) for i in range(6)), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                data = payload.as_py()
                member = encode_record(page_id.as_py(), url.as_py(), data, digest.as_py(), kind.as_py(), refers.as_py())
                out.write(member)
                for k, v in (("archive", name), ("offset", at), ("length", len(member)), ("payload_bytes", len(data))):
                    found[k].append(v)
                at += len(member)
            columns = {c: batch.column(i) for i, c in enumerate(("page_id", "url", "_", "payload_digest", "record_type", "refers_to")) if c != "_"}
            columns |= {"archive": pa.array(found["archive"], pa.string())} | {k: pa.array(found[k], pa.int64()) for k in ("offset", "length", "payload_bytes")}
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in ("page_id", "url", "archive", "offset", "length", "payload_digest", "payload_bytes", "record_type", "refers_to")})
        if out is not None:
            out.close()

    return scratch.save(plan_records(pages, scratch, revisit_bytes).mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, folder: str, span_bytes: int = 8 << 20, gap_bytes: int = 64 << 10, payloads: bool = True) -> DataFrame:
    """The records that the index rows name. A task's unit is a span of an archive; its records no further apart than gap_bytes come by one read."""
    spans = index.select("archive", "offset", "length").withColumn("span", F.expr(f"offset div {span_bytes}"))
    spans = spans.groupBy("archive", "span").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                wanted, found = [(r["offset"], r["length"]) for r in records.as_py()], []
                with store.open_input_file(archive) as source:
                    i = 0
                    while i < len(wanted):
                        j, end = i, wanted[i][0] + wanted[i][1]
                        while j + 1 < len(wanted) and wanted[j + 1][0] - end <= gap_bytes:
                            j += 1
                            end = max(end, wanted[j][0] + wanted[j][1])
                        source.seek(start := wanted[i][0])
                        block = source.read(end - start)
                        found += [decode_record(block[o - start : o - start + n]) for o, n in wanted[i : j + 1]]
                        i = j + 1
                if not payloads:
                    for r in found:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(found, schema)

    return spans.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Writes every page, reads every record back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    scratch = Scratch(pages.sparkSession, "warc")
    index = write_archives(pages, scratch, revisit_bytes)
    return read_records(index, scratch.path("archives"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
