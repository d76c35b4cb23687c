"""WARC archives as a Spark data source.

``df.write.format("warc").save(folder)`` writes a gzip member per record, as
the format wants it; ``spark.read.format("warc").load(path)`` reads a file or
a folder, of this writer or of any other: compressed by record, compressed as
a whole, or plain. It plans one partition per run of whole files, parses a
record's headers first and goes past the block of a record that a pushed
filter rejects or that is not asked for: in a plain file by the block's length, in
a member of this writer by the member's length, which stands in an extra field
of its gzip header that other tools pass over. Members without that field are
inflated piece by piece and the pieces dropped.

The payload of an HTTP message (``Content-Type: application/http``) is what
follows the message's headers, as it was transferred; of any other record it
is the block. A file that is not a WARC file, or ends within a record, is an
error that names the file and the record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DataType, LongType, StructType

from queuelens.llm.common import numbered, settle, utf8
from queuelens.session import ensure_checkpoint_dir

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, payload_digest string, "
          "payload_bytes long, refers_to string, payload binary")
# Fixed values of the format
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
    "payload_bytes": "X-Payload-Length",
}
MAGIC = b"\x1f\x8b"
LENGTH = struct.pack("<H2sH", 12, b"Ql", 8)      # extra field: the length of the whole member
PIECE = 4096
LONGEST_HEAD = 16 << 20
MANIFEST = "_committed"


def filesystem(path: str):
    """(file system, path there); any store that pyarrow reaches, plain paths are local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict, payload: bytes) -> bytes:
    """One record as one gzip member; what holds the headers can be inflated by itself."""
    lines = [f"{HEADERS[k]}: {row[k]}" for k in HEADERS if row.get(k) is not None]
    if row.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(payload)}")
    clean = "\r\n".join(x.replace("\r", " ").replace("\n", " ") for x in lines)
    head, block = VERSION + clean.encode() + b"\r\n\r\n", payload + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(head) + deflate.flush(zlib.Z_FULL_FLUSH) + deflate.compress(block) + deflate.flush()
    start = MAGIC + b"\x08\x04\0\0\0\0\0\xff" + LENGTH
    end = struct.pack("<II", zlib.crc32(block, zlib.crc32(head)), len(head) + len(block) & 0xFFFFFFFF)
    return start + struct.pack("<Q", len(start) + 8 + len(body) + len(end)) + body + end


class Plain:
    """The bytes of a file, with those read ahead in ``buffer``."""

    def __init__(self, f) -> None:
        self.f, self.at, self.buffer = f, 0, b""

    def fetch(self, size: int) -> bytes:
        data = self.f.read(size)
        self.at += len(data)
        return data

    def more(self, need: int) -> bytes:
        """Some bytes more, about ``need``; none at the end."""
        return self.fetch(min(max(need, PIECE), 1 << 20))

    def head(self) -> bytes | None:
        """A record's headers without their blank line; None where no record follows."""
        while not (text := self.buffer.lstrip(b"\r\n")):
            self.buffer = self.more(PIECE)
            if not self.buffer:
                return None
        seen = 0
        while (end := text.find(b"\r\n\r\n", seen)) < 0:
            if not b"WARC/".startswith(text[:5]) or len(text) > LONGEST_HEAD:
                raise ValueError("no WARC headers")
            seen, piece = max(0, len(text) - 3), self.more(PIECE)
            if not piece:
                raise ValueError("record breaks off")
            text += piece
        if not text.startswith(b"WARC/"):
            raise ValueError("no WARC headers")
        self.buffer = text[end + 4:]
        return text[:end]

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next ``n`` bytes, or none of them in memory."""
        parts, left = [], n
        while left:
            piece = self.buffer or self.more(left)
            if not piece:
                raise ValueError("record breaks off")
            self.buffer = piece[left:]
            left -= min(left, len(piece))
            if keep:
                parts.append(piece[:len(piece) - len(self.buffer)])
        return b"".join(parts)

    def go_past(self, n: int) -> None:
        """To the end of a block of ``n`` bytes."""
        ahead = len(self.buffer)
        if n <= ahead:
            self.buffer = self.buffer[n:]
            return
        self.buffer = b""
        self.at += n - ahead - 1
        self.f.seek(self.at)
        if not self.fetch(1):
            raise ValueError("record breaks off")


class Inflated(Plain):
    """What a file of gzip members holds, one member after the other."""

    def __init__(self, f) -> None:
        super().__init__(f)
        self.raw, self.inflate, self.ends = b"", None, None

    def more(self, need: int) -> bytes:
        while True:
            if self.inflate is None:
                if len(self.raw) < 32:
                    self.raw += self.fetch(PIECE)
                if not self.raw:
                    return b""
                if not self.raw.startswith(MAGIC):
                    raise ValueError("no gzip member")
                own = self.raw[3] == 4 and self.raw[10:16] == LENGTH
                self.ends = (self.at - len(self.raw) + struct.unpack_from("<Q", self.raw, 16)[0]) if own else None
                self.inflate = zlib.decompressobj(31)
            data = self.raw or self.fetch(min(max(need, PIECE), 1 << 20))
            out = self.inflate.decompress(data, max(need, PIECE))
            self.raw = self.inflate.unused_data or self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.inflate = None
            elif not data and not out:
                raise ValueError("record breaks off")
            if out:
                return out

    def go_past(self, n: int) -> None:
        if self.ends is None:
            self.take(n, keep=False)
            return
        start = self.at - len(self.raw)
        if self.ends <= self.at:
            self.raw = self.raw[max(0, self.ends - start):]
        else:
            self.f.seek(self.ends - 1)
            self.at, self.raw = self.ends, b""
            if not self.f.read(1):
                raise ValueError("record breaks off")
        self.buffer, self.inflate = b"", None


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    records: int


class WarcWriter(DataSourceWriter):
    """Each attempt writes a file of its own name; only committed names enter the manifest."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = filesystem(self.path)
        name, n, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for row in rows:
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}", compression=None)
            d = dict(zip(self.names, row))
            out.write(record_bytes(d, bytes(d.get("payload") or b"")))
            n += 1
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        names = "".join(f"{m.name}\t{m.records}\n" for m in messages if m is not None and m.name)
        with store.open_output_stream(f"{folder}/{MANIFEST}-{uuid.uuid4().hex}", compression=None) as f:
            f.write(names.encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{folder}/{m.name}")


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, size: int, payload: bool) -> None:
        self.path, self.fields, self.size, self.payload = path, schema.names, size, payload
        self.accepted: dict[str, frozenset] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on headers are decided here; Spark decides the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and column != "payload_bytes" and isinstance(f, (EqualTo, In)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.accepted[column] = self.accepted.get(column, values) & values
            elif isinstance(f, IsNotNull) and column == "record_type":
                continue                     # every record has a type
            else:
                yield f

    def partitions(self) -> list[Files]:
        """A file, or a folder's files: those that manifests name, or else all named .warc or .warc.gz;
        small ones together up to ``size`` bytes."""
        from pyarrow import fs

        store, path = filesystem(self.path)
        there = store.get_file_info(path)
        found = [there] if there.is_file else store.get_file_info(fs.FileSelector(path))
        size = {f.path: f.size for f in found if f.is_file}
        manifests = [f.path for f in found if not there.is_file and f.base_name.startswith(MANIFEST)]
        if manifests:
            names, by_name = [], {p.rsplit("/", 1)[-1]: p for p in size}
            for m in manifests:
                with store.open_input_stream(m, compression=None) as lines:
                    names += [by_name[x.split("\t")[0]] for x in lines.read().decode().splitlines()]
        else:
            names = [p for p in size if there.is_file or p.endswith((".warc", ".warc.gz"))]
        out, used = [], 0
        for name in sorted(names):
            if not out or used + size[name] > self.size:
                out.append(Files([]))
                used = 0
            out[-1].names.append(name)
            used += size[name]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = filesystem(self.path)
        for name in partition.names:
            with store.open_input_file(name) as f:
                yield from self._records(f, name)

    def _records(self, f, name: str) -> Iterator[tuple]:
        packed = f.read(2) == MAGIC
        f.seek(0)
        stream, n = Inflated(f) if packed else Plain(f), 0
        try:
            while (text := stream.head()) is not None:
                n += 1
                row, length, http = self._headers(text)
                wanted = all(row.get(c) in ok for c, ok in self.accepted.items())
                if not (wanted and self.payload):
                    stream.go_past(length)
                    if not wanted:
                        continue
                else:
                    block = stream.take(length)
                    row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
                yield tuple(row.get(c) for c in self.fields)
        except (ValueError, zlib.error) as e:
            raise ValueError(f"{name}: after {n} records: {e}") from e

    @staticmethod
    def _headers(text: bytes) -> tuple[dict, int, bool]:
        """Columns, the block's length, whether the block is an HTTP message."""
        unfolded = text.decode(errors="replace").replace("\r\n ", " ").replace("\r\n\t", " ")
        pairs = (line.partition(":") for line in unfolded.split("\r\n")[1:])
        given = {k.strip().lower(): v.strip() for k, _, v in pairs}
        row = {c: given.get(h.lower()) for c, h in HEADERS.items()}
        if not given.get("content-length", "").isdecimal():
            raise ValueError("record without Content-Length")
        length = int(given["content-length"])
        http = given.get("content-type", "").lower().startswith("application/http")
        size = row["payload_bytes"]
        row["payload_bytes"] = int(size) if size is not None else None if http else length
        return row, length, http


class WarcSource(DataSource):
    """Options: path; payload ("false": leave it null and go past it); splitBytes.

    ``payload_bytes`` is what the record states (X-Payload-Length, else the block's length; null for an
    HTTP message that does not state it).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("splitbytes", 128 << 20)),
                          self.options.get("payload", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def payload_digest(payload):
    """Bare base32 SHA-1 of a binary column."""
    @pandas_udf("string")
    def digest(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: sha1_base32(bytes(p)))

    return digest(payload)


def page_id_of(key: str):
    """Record id of a page key; a null key has one of its own."""
    return F.when(F.col(key).isNull(), "<urn:page>").otherwise(
        F.concat(F.lit("<urn:page:"), F.url_encode(F.col(key).cast("string")), F.lit(">")))


def page_of(record: str, kind: DataType = LongType()):
    """Page key inside a record id; null for a null key and for records of other writers."""
    inside = F.regexp_extract(record, r"^<urn:page:(.*)>$", 1)
    return F.when(F.col(record).startswith("<urn:page:"), F.url_decode(inside)).cast(kind)


def to_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               smallest: int = 0) -> DataFrame:
    """A WARC record per page: of equal payloads of ``smallest`` bytes or more the one with the
    largest key is a response, the others are revisits without a payload.

    A null payload counts as empty; a null key loses to any other, and of
    rows that repeat the largest key one is the response. Keys of any type
    that a string can be cast to come back from a record's id. Texts of any
    length are written whole (one payload at a time is in memory); an empty
    table gives no records; other columns, whatever their names, are left out.
    """
    body = utf8(html)
    pages, row = numbered(pages)
    heads = settle(pages.select(F.col(row).alias("_row"), F.col(key).alias("_key"), F.octet_length(body).alias("_n"),
                                payload_digest(body).alias("_digest")))
    first = (heads.filter(F.col("_n") >= smallest).groupBy("_digest")
             .agg(F.max(F.struct("_key", "_row")).alias("_best"), F.count("*").alias("_copies"))
             .filter("_copies > 1").drop("_copies"))
    heads = (heads.join(first.withColumnRenamed("_digest", "_d"), F.col("_digest") == F.col("_d"), "left")
             .withColumn("_again", F.coalesce(F.col("_best._row") != F.col("_row"), F.lit(False))))
    named = (heads.select(F.col("_row").alias("_r"), "_n", "_digest", "_again",
                          F.when(F.col("_again"), F.col("_best._key")).alias("_to")))
    return (pages.select(F.col(row).alias("_row"), F.col(key).alias("_key"),
                         (F.col(url) if url in pages.columns else F.lit(None)).cast("string").alias("target_uri"),
                         body.alias("_body"))
            .join(named, F.col("_row") == F.col("_r"))
            .select(page_id_of("_key").alias("record_id"),
                    F.when(F.col("_again"), "revisit").otherwise("response").alias("record_type"), "target_uri",
                    F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
                    F.concat(F.lit("sha1:"), "_digest").alias("payload_digest"),
                    F.col("_n").cast("long").alias("payload_bytes"),
                    F.when(F.col("_again"), page_id_of("_to")).alias("refers_to"),
                    F.when(F.col("_again"), F.lit(b"")).otherwise(F.col("_body")).alias("payload")))


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                       smallest: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared checkpoint folder and read them back.

    A response's size and digest are computed anew from the payload that was
    read; a revisit's stand in its headers, and its block is not decompressed.
    Nulls, long texts, repeated rows, empty tables and other columns: as in ``to_records``.
    """
    spark, kind = pages.sparkSession, pages.schema[key].dataType
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(to_records(pages, key, url, html, smallest), path)
    full = (read_archives(spark, path).filter(F.col("record_type") == "response")
            .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", payload_digest("payload")))
    heads = (read_archives(spark, path, payload=False).filter(F.col("record_type") == "revisit")
             .withColumn("payload_digest", F.expr("substring(payload_digest, 6)")))
    return (full.drop("payload").unionByName(heads.drop("payload"))
            .select(page_of("record_id", kind).alias(key), "payload_bytes", "payload_digest", "record_type",
                    page_of("refers_to", kind).alias("refers_to"), "target_uri"))
