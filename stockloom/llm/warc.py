"""WARC archives: one gzip member per record, written by tasks, read back record by record.

Of records with equal payloads (SHA-1 and length) the one with the largest
page_id is a `response`; the others are `revisit` records that name it and
carry no payload. The reader inflates a file in small pieces, frames each
record by its Content-Length and checks its block and payload digests.

A null html is an empty payload, a null url leaves WARC-Target-URI out. Rows
with a null page_id are written too; they count as smaller than any id and only
among themselves are all responses. Rows that repeat the largest page_id of a
payload are all responses. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm import files
from stockloom.llm.common import run_folder, small_text_batches, stored

#: A file is closed once it holds so many compressed bytes.
FILE_BYTES = 64 << 20
#: Bytes read and inflated at a time.
PIECE = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Date of every record: the archive is a function of its input.
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, html: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. refers_to: page_id of the response with the same payload, for a revisit."""
    sha = digest(html)
    block = HTTP.format(len(html)).encode()
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, sha), "WARC-Date": DATE, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha}"}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is None:
        block += html
    else:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, sha), "X-Refers-To-Page-Id": str(refers_to)}
    head |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", block, b"", b""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines)) + pack.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


class Damaged(ValueError):
    """A record that breaks off, has a wrong length or a wrong digest."""


class Reader:
    """Iterates over the records of a WARC stream, holding one record and one piece at a time."""

    def __init__(self, stream, name: str = ""):
        self.stream, self.name, self.raw, self.ready = stream, name, b"", b""
        self.member = None

    def _fail(self, why: str):
        raise Damaged(f"{self.name}: {why}")

    def _inflate(self) -> bool:
        """Add inflated bytes of the current member; False at its end."""
        if self.member.eof:
            return False
        piece = self.member.unconsumed_tail or self.raw or self.stream.read(PIECE)
        self.raw = b""
        if not piece:
            self._fail("a gzip member breaks off")
        try:
            self.ready += self.member.decompress(piece, PIECE)
        except zlib.error as e:
            self._fail(str(e))
        if self.member.eof:
            self.raw = self.member.unused_data
        return True

    def _take(self, n: int) -> bytes:
        parts, have = [self.ready[:n]], len(self.ready[:n])
        self.ready = self.ready[n:]
        while have < n:
            if not self._inflate():
                self._fail("a record is shorter than its Content-Length")
            parts.append(self.ready[: n - have])
            self.ready = self.ready[n - have :]
            have += len(parts[-1])
        return b"".join(parts)

    def _head(self, limit: int = 1 << 20) -> bytes:
        while b"\r\n\r\n" not in self.ready:
            if len(self.ready) > limit or not self._inflate():
                self._fail("a record has no end of header")
        head, _, self.ready = self.ready.partition(b"\r\n\r\n")
        return head

    @staticmethod
    def _fields(lines: list[bytes]) -> dict[str, str]:
        pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
        return {k.strip(): v.strip() for k, _, v in pairs}

    def __iter__(self) -> Iterator[Record]:
        while True:
            if not self.raw:
                self.raw = self.stream.read(PIECE)
            if not self.raw:
                return
            self.member = zlib.decompressobj(31)
            first, *lines = self._head().split(b"\r\n")
            if not first.startswith(b"WARC/"):
                self._fail("a member does not start with a WARC record")
            found = Record(self._fields(lines))
            block = self._take(int(found.headers["Content-Length"]))
            if self._take(4) != b"\r\n\r\n" or self.ready or self._inflate() and self.ready:
                self._fail("a record is longer than its Content-Length")
            while not self.member.eof:  # the trailer may come in a later piece
                self._inflate()
            self._check(found, "WARC-Block-Digest", block)
            http, _, found.payload = block.partition(b"\r\n\r\n")
            found.http = self._fields(http.split(b"\r\n")[1:])
            if found.headers.get("WARC-Type") == "response":
                if int(found.http.get("Content-Length", -1)) != len(found.payload):
                    self._fail("a payload's length differs from its header")
                self._check(found, "WARC-Payload-Digest", found.payload)
            yield found

    def _check(self, found: Record, key: str, data: bytes) -> None:
        said = found.headers.get(key, "")
        if said and said.removeprefix("sha1:") != digest(data):
            self._fail(f"{key} of {found.headers.get('WARC-Record-ID')} does not match")


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html binary, refers_to): refers_to is set for revisits.

    Payloads are grouped by digest on ids only, and those are joined back by
    page, so a payload that a third of the pages share moves no html to one task.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.length("html"))
    ids = keyed.select("page_id", "sha", "size")
    kept = ids.groupBy("sha", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    roles = ids.join(kept, ["sha", "size"]).where("page_id is null or page_id < kept").groupBy("page_id", "sha", "size").agg(F.first("kept").alias("refers_to"))
    left, right = keyed.alias("l"), roles.alias("r")
    same = F.col("l.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("l.sha") == F.col("r.sha")) & (F.col("l.size") == F.col("r.size"))
    return left.join(right, same, "left").select("l.page_id", "l.url", "l.html", "r.refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as .warc.gz files into a shared folder; returns the stored manifest (file, records, bytes)."""
    small_text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = files.put(folder, ".warc.gz", lambda out: [out.write(x) for x in held])
            return pa.record_batch([[name], [len(held)], [size]], names=["file", "records", "bytes"])

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4))):
                held.append(record(page_id, url, html, refers_to))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return stored(with_roles(pages).mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in a manifest: page_id, url, record_type, payload_bytes, payload_digest, refers_to, html.

    A revisit's length and digest are those of the payload it stands for; its
    html is null. With payloads=False html is left null throughout.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("html", pa.binary())])

    def rows(uri: str) -> Iterator[pa.RecordBatch]:
        with files.opened(uri) as stream:
            held: list[tuple] = []
            size = 0
            for r in Reader(stream, uri):
                number = lambda k, h=r.headers: int(h[k]) if k in h else None
                response = r.headers["WARC-Type"] == "response"
                html = r.payload if payloads and response else None
                held.append((number("X-Page-Id"), r.headers.get("WARC-Target-URI"), r.headers["WARC-Type"], int(r.http["Content-Length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), number("X-Refers-To-Page-Id"), html))
                size += len(html or b"")
                if len(held) >= 1000 or size >= 8 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], names=names)
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], names=names)

    return files.per_file(manifest.select("file"), rows, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html binary")


def op6_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page written to archives and read back from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, run_folder(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: The contract's rows in DuckDB SQL. Base32: five hexadecimal digits of the SHA-1 are four letters.
SQL = """SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1) for i in range(0, 32)], '') AS payload_digest,
  IF(page_id = largest, 'response', 'revisit') AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to, url
FROM (SELECT page_id, url, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, MAX(page_id) OVER (PARTITION BY body) AS largest
      FROM (SELECT page_id, url, COALESCE(html, '') AS body FROM pages))"""
