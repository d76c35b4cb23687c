import base64
import gzip
import hashlib
import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from queuelens.llm.warc import (
    SCHEMA, WarcReader, archive_round_trip, read_archives, record_bytes, to_records, write_archives)

PAGES = [(1, "http://a/1", "<p>x</p>", "e"), (2, "http://a/2", "<p>x</p>", "e"), (3, None, "<p>é</p>", "e"),
         (4, "http://a/4", None, "e"), (5, "http://a/5", "", "e"), (6, "http://a/6", "y" * 300_000, "e"),
         (6, "http://a/6", "y" * 300_000, "e"), (None, "http://a/n", "<p>x</p>", "e"), (7, "http://a/7\r\nX: y", "z", "e")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(stored):
    pages = stored(PAGES, "page_id long, url string, html string, record_type string")
    got = archive_round_trip(pages).collect()
    best = {}
    for k, _, h, _ in PAGES:
        best[digest(h)] = max(best.get(digest(h), -1), -1 if k is None else k)
    want, used = Counter(), set()
    for k, _, h, _ in PAGES:
        d = digest(h)
        first = k == best[d] and d not in used
        used |= {d} if first else set()
        want[(k, len((h or "").encode()), d, "response" if first else "revisit", None if first else best[d])] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert archive_round_trip(pages.limit(0)).collect() == []


def test_smallest_payload(stored):
    pages = stored(PAGES, "page_id long, url string, html string, x string")
    kinds = {r.record_id: r.record_type for r in to_records(pages, smallest=100).collect()}
    assert kinds["<urn:page:1>"] == "response" and "revisit" in {
        r.record_type for r in to_records(pages, smallest=100).collect()}


def test_files_are_plain_gzip_with_standard_headers(spark, stored, tmp_path):
    pages = stored(PAGES, "page_id long, url string, html string, x string")
    path = str(tmp_path / "w")
    write_archives(to_records(pages), path)
    files = [f for f in os.listdir(path) if f.endswith(".warc.gz")]
    raw = b"".join(gzip.decompress(open(f"{path}/{f}", "rb").read()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == len(PAGES)
    assert raw.count(b"WARC-Type: revisit") == 4 and b"Content-Length: 300000\r\n" in raw
    assert b"\r\nX: y" not in raw.replace(b"X-Payload", b"")       # a header value can't add a header


def test_uncommitted_files_are_not_read(spark, stored, tmp_path):
    pages = stored(PAGES, "page_id long, url string, html string, x string")
    path = str(tmp_path / "w")
    write_archives(to_records(pages), path)
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"\x1f\x8b broken off")
    assert read_archives(spark, path).count() == len(PAGES)


def test_filters_reach_the_reader(spark, stored, tmp_path):
    pages = stored(PAGES, "page_id long, url string, html string, x string")
    path = str(tmp_path / "w")
    write_archives(to_records(pages), path)
    some = read_archives(spark, path).filter((F.col("record_type") == "response") & F.col("target_uri").isin("http://a/2"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    # the reader decides both values; Spark is left with the null check alone
    assert plan.count("Filter ") == 1 and "Filter isnotnull(target_uri" in plan
    assert [bytes(r.payload) for r in some.collect()] == [b"<p>x</p>"]
    assert [r.payload for r in read_archives(spark, path, payload=False).collect()] == [None] * len(PAGES)


class Watched:
    """A file that notes which bytes were read."""

    def __init__(self, data):
        self.data, self.at, self.seen = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at:self.at + n]
        self.at += len(out)
        self.seen += len(out)
        return out


def test_unwanted_payloads_are_neither_read_nor_decompressed():
    import random
    body = random.Random(0).randbytes(200_000)
    data = b"".join(record_bytes({"record_type": t, "target_uri": t}, body) for t in ("a", "b", "a"))
    reader = WarcReader.__new__(WarcReader)
    reader.fields, reader.payload, reader.accepted = ["record_type", "payload"], True, {"record_type": frozenset(["b"])}
    f = Watched(data)
    assert list(reader._records(f, "x")) == [("b", body)]
    assert f.seen < 220_000
    reader.payload, reader.accepted, f = False, {}, Watched(data)
    assert [t for t, _ in reader._records(f, "x")] == ["a", "b", "a"] and f.seen < 20_000


def test_long_headers_and_damage():
    long = record_bytes({"record_type": "response", "target_uri": "http://" + "".join(map(str, range(9000)))}, b"p")
    reader = WarcReader.__new__(WarcReader)
    reader.fields, reader.payload, reader.accepted = ["target_uri", "payload"], True, {}
    (uri, payload), = reader._records(Watched(long), "x")
    assert len(uri) > 30_000 and payload == b"p"
    with pytest.raises(Exception):
        list(reader._records(Watched(long[:50]), "x"))
    assert "payload binary" in SCHEMA


def foreign(kind, uri, block, extra=""):
    return (f"WARC/1.0\r\nwarc-type:{kind}\r\nWARC-Target-URI: {uri}\r\n{extra}"
            f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


HTTP = "Content-Type: application/http;\r\n msgtype=response\r\n"
BODY = b"<p>\r\n\r\n</p>" + bytes(range(256)) * 2000
FOREIGN = [foreign("warcinfo", "http://a/0", b"software: x"),
           foreign("response", "http://a/1", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + BODY, HTTP),
           foreign("resource", "http://a/2", BODY), foreign("response", "http://a/3", b"")]
FOUND = [("warcinfo", "http://a/0", 11, b"software: x"), ("response", "http://a/1", None, BODY),
         ("resource", "http://a/2", len(BODY), BODY), ("response", "http://a/3", 0, b"")]


@pytest.mark.parametrize("data", [
    b"".join(FOREIGN), b"".join(map(gzip.compress, FOREIGN)), gzip.compress(b"".join(FOREIGN)),
    gzip.compress(FOREIGN[0]) + record_bytes({"record_type": "own"}, BODY) + b"".join(map(gzip.compress, FOREIGN[1:]))],
    ids=["plain", "by record", "as a whole", "mixed"])
def test_archives_of_other_writers(spark, tmp_path, data):
    (tmp_path / ("a.warc.gz" if data[:2] == b"\x1f\x8b" else "a.warc")).write_bytes(data)
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    names = ["record_type", "target_uri", "payload_bytes", "payload"]
    rows = [tuple(r) for r in read_archives(spark, str(tmp_path)).filter("record_type <> 'own'").select(*names).collect()]
    assert [(*r[:3], bytes(r[3])) for r in rows] == FOUND
    heads = read_archives(spark, str(tmp_path), payload=False).filter("record_type <> 'own'").select(*names).collect()
    assert [tuple(r)[:3] for r in heads] == [r[:3] for r in FOUND]
    some = read_archives(spark, str(tmp_path)).filter("record_type = 'response'").select(*names).collect()
    assert [(*tuple(r)[:3], bytes(r.payload)) for r in some] == [r for r in FOUND if r[0] == "response"]


def test_one_file_is_read_by_its_path(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"".join(FOREIGN))
    assert read_archives(spark, str(tmp_path / "a.bin")).count() == 4


def test_every_record_is_one_member():
    data, n = b"".join(record_bytes({"record_type": "response"}, b"x" * k) for k in (0, 5, 70_000)), 0
    while data:
        inflate = zlib.decompressobj(31)
        text = inflate.decompress(data)
        assert inflate.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        data, n = inflate.unused_data, n + 1
    assert n == 3


@pytest.mark.parametrize("data", [
    b"no archive at all", gzip.compress(b"no archive"), b"".join(FOREIGN)[:-300_000], gzip.compress(b"".join(FOREIGN))[:-30],
    b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", gzip.compress(FOREIGN[0]) + b"rest",
    record_bytes({}, BODY)[:900]],
    ids=["text", "packed text", "cut", "packed and cut", "no length", "rest", "own and cut"])
@pytest.mark.parametrize("payload", [True, False])
def test_malformed_files_are_named(data, payload):
    reader = WarcReader.__new__(WarcReader)
    reader.fields, reader.payload, reader.accepted = ["record_type"], payload, {}
    with pytest.raises(ValueError, match="^some.warc: after"):
        list(reader._records(Watched(data), "some.warc"))


def test_keys_of_other_types(stored):
    keys = ["a b", "é/1", "null", "", None, "<x>\r\n"]
    pages = stored([(k, f"u{i}", f"h{i}") for i, k in enumerate(keys)], "page_id string, url string, html string")
    got = {r.target_uri: r.page_id for r in archive_round_trip(pages).collect()}
    assert got == {f"u{i}": k for i, k in enumerate(keys)}
