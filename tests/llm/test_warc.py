import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from spanlake.llm import common, warc


@pytest.fixture
def pages(spark):
    big = "<p>" + "é" * 900
    rows = [(i, f"http://h/{i}", f"<b>{i}</b>" * (i * 40)) for i in range(30)]
    rows += [(100, None, big), (101, "http://x/\r\ny z", big), (102, "u", big), (103, "u", "small"), (104, "u", "small"), (105, "u", None), (106, "u", ""), (107, "u", big + "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def archived(spark, pages, parts=3):
    rows = warc.with_revisits(pages).repartition(parts)
    return common.saved(warc.write_archives(rows, common.scratch(spark, "warc")), "manifest")


@pytest.mark.parametrize("split", [64, 777, 1 << 22])
def test_round_trip_at_any_split(spark, pages, split):
    back = {r["page_id"]: r for r in warc.read_archives(archived(spark, pages), split).collect()}
    want = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    assert back.keys() == want.keys()
    for i, html in want.items():
        raw, r = html.encode(), back[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 102) if i in (100, 101) else ("response", None))
        assert r["payload"] == (b"" if i in (100, 101) else raw)


def test_archives_are_gzip_members(spark, pages):
    manifest = archived(spark, pages, 1).collect()[0]
    with gzip.open(manifest["path"].removeprefix("file://")) as f:
        text = f.read()
    assert text.count(b"WARC/1.1\r\n") == manifest["records"] == pages.count()


def test_false_magic_is_no_record(tmp_path):
    nested = gzip.compress(b"WARC/1.1\r\nnot a record")
    payload = b"\x1f\x8b\x08 noise " + nested
    records = [warc.encode_record(i, "u", payload, hashlib.sha1(payload).hexdigest(), None, 0) for i in range(5)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"\x1f\x8b\x08junk".join([b"", *records]))
    size = path.stat().st_size
    for step in (50, 101, 10_000):
        found = []
        for start in range(0, size, step):
            with path.open("rb") as f:
                found += [x["warc-record-id"] for x in warc.records_in(f, start, min(start + step, size), size)]
        assert found == [f"<urn:page:{i}>" for i in range(5)]


def foreign(kind, body, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:6b1f>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": str(len(body))} | {k.replace("_", "-"): v for k, v in fields.items()}
    return gzip.compress(("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n"
    sha = hashlib.sha1(b"hello").hexdigest()
    records = [
        foreign("warcinfo", b"software: x\r\n"), foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("response", http + b"hello", Content_Type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{sha}"),
        foreign("revisit", http, Content_Type="application/http", WARC_Payload_Digest="sha1:" + base64.b32encode(bytes.fromhex(sha)).decode(), WARC_Refers_To="<urn:uuid:1>"),
        foreign("response", http + b"other", Content_Type="application/http", WARC_Payload_Digest="md5:00"), foreign("metadata", b"", content_type="text/plain"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", sum(map(len, records)), len(records))], warc.MANIFEST)
    for split in (100, 1 << 20):
        rows = warc.read_archives(manifest, split).collect()
        assert [r["record_type"] for r in rows].count("response") == 2 and len(rows) == 6 and {r["page_id"] for r in rows} == {None}
        got = {(r["record_type"], bytes(r["payload"])): (r["payload_bytes"], r["payload_digest"]) for r in rows}
        assert got["response", b"hello"] == (5, sha) and got["response", b"other"][0] == 5 and got["revisit", b""] == (None, sha)
        assert got["warcinfo", b"software: x\r\n"][0] == 13 and got["metadata", b""][0] == 0


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_damage_is_not_passed_over(spark, tmp_path, split):
    records = [warc.encode_record(i, "u", (b"text %d " % i) * 200, hashlib.sha1((b"text %d " % i) * 200).hexdigest(), None, 3) for i in range(5)]
    raw = b"".join(records)
    third = sum(map(len, records[:2]))
    path = tmp_path / "a.warc.gz"
    manifest = spark.createDataFrame([(f"file://{path}", len(raw), 5)], warc.MANIFEST)
    path.write_bytes(raw)
    assert warc.read_archives(manifest, split).count() == 5
    for at in (0, third, third + 1, third + 60, len(raw) - 5):
        path.write_bytes(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :])
        with pytest.raises(Exception, match="byte|digest"):
            warc.read_archives(manifest, split).collect()
        assert warc.read_archives(manifest, split, strict=False).count() == 4
    path.write_bytes(raw[:-40])
    with pytest.raises(Exception, match="byte"):
        warc.read_archives(manifest, split).collect()


def test_pages_without_id_and_hot_digests(spark, monkeypatch):
    rows = [(None, "u", "n" * 1500), (None, "u", "n" * 1500), (None, "u", "m" * 1500), (7, "u", "m" * 1500), (None, None, None)]
    rows += [(i, "u", "h" * 2000) for i in range(100, 130)] + [(i, "u", chr(97 + i % 9) * 1200) for i in range(200, 218)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = lambda: sorted((tuple(r[c] for c in ("page_id", "record_type", "payload_bytes", "refers_to")) for r in warc.read_archives(archived(spark, table)).collect()), key=str)
    whole = read()
    assert len(whole) == len(rows) and (None, "revisit", 1500, 7) in whole and whole.count((None, "response", 1500, None)) == 2
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 4)
    assert read() == whole


def test_empty_table(spark, pages):
    assert warc.read_archives(archived(spark, pages.limit(0))).count() == 0


def test_repeated_rows(spark):
    page = "x" * 2000
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (0, "u", page)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"]) for r in warc.read_archives(archived(spark, rows)).collect())
    assert got == [(0, "revisit"), (1, "response"), (1, "response")]
