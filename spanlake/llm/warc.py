"""WARC archives: one gzip member a record, written by tasks and read back by a splittable reader.

Written records follow WARC/1.1: responses hold an HTTP message whose body is the payload, repeats are revisit records of the
identical-payload-digest profile. The reader takes archives of others as well: any record type, any record id, digests
of any kind or none, HTTP messages or plain blocks.

The reader cuts archives into byte ranges. A task scans its range for the gzip magic, takes a candidate as a record
only if the member decodes to a WARC header with the required fields and its length and checksum agree, and owns
the records that start inside its range, reading past the end of the range to finish the last one. No index is kept.
Damage is not passed over: the bytes after each record, in whatever range, must begin another or be the archive's end, and what begins as a
record must be one; else the read fails. With ``strict=False`` the scan goes on to the next whole record instead.

Defined cases: a null or empty payload is a record of length 0; a null URL has no target field; a null page_id is written as
none and read as null; a payload repeated under one page_id is a response each time; of equal payloads without any
page_id all are responses; an empty table writes no archive and reads no record. Archives are put in place by a
rename, so a task that runs twice leaves the same file. A payload is held whole by one task, however long. Other columns of the input, whatever
their names, are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 128 << 20
STEP = 1 << 20
#: payloads under this many bytes are stored again rather than referred to
LEAST_REVISIT = 1000
#: a revisit table of at most so many rows (about 80 bytes each) is broadcast; beyond it only digests of very many pages are
BROADCAST_DIGESTS = 200_000
#: bytes of records that a read task holds before it hands them on
HELD_BYTES = 8 << 20
MANIFEST = "path string, bytes long, records long"
RECORD = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "content-length")
PAGE = re.compile(r"<urn:page:(-?\d+)>")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int, date: str = "1970-01-01T00:00:00Z") -> bytes:
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(raw: bytes) -> dict | None:
    """The fields of a decoded member by lower-case name, ``block`` and ``payload``; None if it is no whole WARC record."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if any(not fields.get(k) for k in REQUIRED) or not fields["content-length"].isdigit():
        return None
    size = int(fields["content-length"])
    if len(body) < size or body[size:].strip(b"\r\n"):
        return None
    block, http = body[:size], b""
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    return fields | {"block": block, "payload": payload, "told": int(told[1]) if told else None}


def digest_of(fields: dict) -> tuple[str | None, bool]:
    """The SHA-1 of the whole payload as lower-case hex, and whether what the record says agrees with what it holds."""
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    said = None
    if kind.lower() == "sha1" and value:
        said = value.lower() if len(value) == 40 else base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    if fields["warc-type"] == "revisit":
        return said, True
    own = hashlib.sha1(fields["payload"]).hexdigest()
    return own, said is None or said == own


def row_of(fields: dict, with_payload: bool) -> tuple:
    page = lambda key: int(m[1]) if (m := PAGE.fullmatch(fields.get(key, ""))) else None
    revisit = fields["warc-type"] == "revisit"
    # a revisit repeats the headers of the message that it refers to, whose length is that of the whole payload
    size = fields["told"] if revisit else len(fields["payload"])
    return (
        fields["warc-record-id"], page("warc-record-id"), fields.get("warc-target-uri"), fields["warc-type"], size,
        digest_of(fields)[0], page("warc-refers-to"), fields["payload"] if with_payload else None,
    )


def write_archives(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """(page_id, url, payload binary, digest, refers_to) -> the manifest of the archives, one a task."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        done = f"{base}/pages-{task.partitionId():06d}.warc.gz"
        part = f"{done}.{task.taskAttemptId()}"
        out, n, size = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to")}
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(part, compression=None)
                record = encode_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], level, date)
                out.write(record)
                n, size = n + 1, size + len(record)
        if out is not None:
            out.close()
            if store.get_file_info(done).type != fs.FileType.NotFound:  # of an earlier run of this task; some stores do not rename over it
                store.delete_file(done)
            store.move(part, done)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{done.rsplit('/', 1)[1]}"], "bytes": [size], "records": [n]})

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, MANIFEST)


def begins(handle, at: int) -> bool:
    """Whether a member that decodes to the start of a WARC header begins at a byte."""
    handle.seek(at)
    try:
        front = zlib.decompressobj(31).decompress(handle.read(4096), 64)
    except zlib.error:
        return False
    return front.startswith(b"WARC/")


def records_in(handle, start: int, end: int, size: int, strict: bool = False) -> Iterator[dict]:
    """Records of an open archive whose member starts in [start, end). strict: fail where bytes are no part of a record."""
    at, buffer, base, next_to = start, b"", start, start == 0
    while at < end:
        if next_to and strict and not begins(handle, at):
            raise ValueError(f"byte {at}: no record begins after the last one")
        if at + len(MAGIC) > base + len(buffer):
            handle.seek(at)
            base, buffer = at, handle.read(min(STEP, end - at) + len(MAGIC) - 1)
            if len(buffer) < len(MAGIC):
                return
        hit = buffer.find(MAGIC, at - base)
        if hit < 0:
            at = base + len(buffer) - len(MAGIC) + 1
            continue
        at = base + hit
        if at >= end:
            return
        found = member(handle, at, size)
        if found is None:
            if strict and begins(handle, at):
                raise ValueError(f"byte {at}: a record begins that is damaged or cut off")
            at, next_to = at + 1, False
        else:
            yield found[0]
            at, next_to = found[1], True
    if next_to and strict and at < size and not begins(handle, at):
        raise ValueError(f"byte {at}: no record begins after the last one")


def member(handle, at: int, size: int) -> tuple[dict, int] | None:
    """The record whose member starts at a byte, and where the member ends; None if there is none."""
    inflate, parts, pos, first = zlib.decompressobj(31), [], at, True
    while not inflate.eof and pos < size:
        handle.seek(pos)
        chunk = handle.read(4096 if first else 1 << 16)
        if not chunk:
            return None
        try:
            parts.append(inflate.decompress(chunk))
        except zlib.error:
            return None
        pos += len(chunk) - len(inflate.unused_data)
        if first and not b"".join(parts).startswith(b"WARC/"[: max(1, len(parts[0]))]):
            return None
        first = False
    if not inflate.eof or (fields := parse_record(b"".join(parts))) is None:
        return None
    return fields, pos


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """(path, bytes) -> one row a record, read by byte ranges. strict: damage and wrong digests fail the read."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    splits = splits.repartition(max(1, splits.count()))  # a stated number: splits are a few bytes each and would be coalesced into one task

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
        for batch in batches:
            for split in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(split["path"])
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(path) as handle:
                    for x in records_in(handle, split["start"], min(split["start"] + split_bytes, split["bytes"]), split["bytes"], strict):
                        if strict and not digest_of(x)[1]:
                            raise ValueError(f"{split['path']}: digest of {x['warc-record-id']} does not match its payload")
                        rows.append(row_of(x, with_payload))
                        held += 500 + (len(x["payload"]) if with_payload else 0)
                        if held > HELD_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return splits.mapInArrow(read, RECORD)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> payload, digest and refers_to: the largest page_id among equal payloads, null on itself."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    again = common.saved(rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "digests")
    told = again.agg(F.count(F.lit(1)).alias("digests"), F.sum("n").alias("pages")).first()
    refers = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))), F.col("first_id"))
    shown = ["page_id", "url", "payload", "digest", refers.alias("refers_to")]
    if told["digests"] <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(again.drop("n")), "digest", "left").select(*shown)
    # digests of very many pages, of which there are at most BROADCAST_DIGESTS, are broadcast; their pages are then spread
    least = told["pages"] // BROADCAST_DIGESTS
    hot = again.filter(F.col("n") > least).select("digest", F.col("first_id").alias("hot_id"))
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("_key", F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.concat("digest", F.uuid())))
    rows = rows.join(again.filter(F.col("n") <= least).select(F.col("digest").alias("_key"), "first_id"), "_key", "left")
    return rows.withColumn("first_id", F.coalesce("hot_id", "first_id")).select(*shown)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written as WARC archives in the shared folder and read back by byte ranges."""
    pages = with_revisits(common.table(spark, sf_dir, "pages"))
    manifest = common.saved(write_archives(pages, common.scratch(spark, "warc")), "manifest")
    back = read_archives(manifest, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
