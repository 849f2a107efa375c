"""Legacy archive converter: ARC archives to WARC archives, and both formats' writers and readers.

An ARC file opens with a version block that names its header fields; version 1 has five, version 2 ten; files may be
joined end to end. A record is one header line, read from the right because a URL may hold spaces, and as many bytes as
the line declares. From it the converter makes a WARC/1.0 record: an identifier (a UUID of version 8 that carries the
record's number, or one drawn from its place in the archive), an ISO timestamp from the 14 digits, a type, and SHA-1
digests of block and payload. A record whose payload is known already becomes a revisit that keeps the HTTP head and
refers to the response.

:func:`write_archives` makes ARC files of pages, :func:`convert_archives` reads ARC files, plain or gzipped whole or record
by record, and writes WARC files, and :func:`read_archives` reads those. All go through Spark's own file sources, so any
Hadoop path works and lost tasks are run again. A written row is a run of records of at most an Arrow batch's bytes, and a
file holds ``FILE_ROWS`` of them, so that files are bounded in bytes (but for a single longer record) and fit one value.

Edge cases: null html is an empty payload; a null URL is ``unknown:``; blanks in URLs are percent-encoded; a body without
an HTTP head is a resource; very long pages are written whole; rows equal in id and payload have the same type; rows with
a null id are never the response of others unless all are null, and refer to the response; an empty table writes no
record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, delete_path, scratch_path, table

SALTS = 64
#: Runs of records in one archive file, of at most 8 MB each, or one record.
FILE_ROWS = 16
DATE = "20000101000000"
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def record_uuid(number: int | None) -> str:
    """A version 8 UUID that carries a 64-bit number; the nil UUID for none."""
    if number is None:
        return str(uuid.UUID(int=0))
    n = number & (1 << 64) - 1
    return str(uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | 2 << 62 | (n & 0xFFFF) << 46 | 1))


def uuid_number(text: str) -> int | None:
    """The number in a UUID of :func:`record_uuid`."""
    v = uuid.UUID(text).int
    if not v:
        return None
    n = (v >> 80) << 16 | v >> 46 & 0xFFFF
    return n - (1 << 64) if n >> 63 else n


def sha1_base32(data: bytes) -> str:
    """The SHA-1 of the bytes in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(rows: Iterable[tuple[int | None, str | None, bytes]], version: int) -> bytes:
    """An ARC file of the given version from (number, url, payload)."""
    about = f"{version} 0 lumenmill\n{_FIELDS[version]}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 pages.arc"
    out = [f"filedesc://pages.arc 0.0.0.0 {DATE} text/plain{extra} {len(about)}\n".encode(), about, b"\n"]
    offset = sum(map(len, out))
    for number, url, payload in rows:
        head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Record-Number: {'' if number is None else number}\r\nContent-Length: {len(payload)}\r\n\r\n"
        body = head.encode() + payload
        where = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:") or "unknown:"
        extra = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - {offset} pages.arc"
        out += [f"{where} 0.0.0.0 {DATE} text/html{extra} {len(body)}\n".encode(), body, b"\n"]
        offset += sum(map(len, out[-3:]))
    return b"".join(out)


class _Chunks:
    """A file that arrives in chunks."""

    def __init__(self, chunks: Iterable[bytes]):
        self.held, self.source, self.at = bytearray(), iter(chunks), 0

    def fill(self, n: int) -> bool:
        """Hold ``n`` bytes, if there are as many."""
        while len(self.held) < n:
            more = next(self.source, None)
            if more is None:
                return False
            self.held.extend(more)
        return True

    def until(self, mark: bytes) -> bytes:
        """The bytes before the mark, which is taken too."""
        seen = 0
        while (end := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.fill(seen + 1):
                raise ValueError("a header does not end")
        return self.take(end + len(mark))[:end]

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes."""
        if not self.fill(n):
            raise ValueError("a record ends before its declared length")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += n
        return out


def read_arc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of the records of ARC files of either version, version blocks excluded.

    ``Position`` is added to the fields: where the record begins.
    """
    file, fields = _Chunks(chunks), None
    while file.fill(1):
        if file.held[0] == 10:  # records are set apart by line feeds
            file.take(1)
            continue
        at, line = file.at, file.until(b"\n")
        if line.startswith(b"filedesc://"):
            version, names = file.take(int(line.rsplit(b" ", 1)[1])).decode().splitlines()[:2]
            fields = names.split(" ")
            if len(fields) != len(_FIELDS[int(version.split(" ")[0])].split(" ")):
                raise ValueError("the version block does not match its version")
            continue
        if fields is None:
            raise ValueError("not an ARC file")
        head = dict(zip(fields, line.decode(errors="replace").rsplit(" ", len(fields) - 1), strict=True))
        yield head | {"Position": str(at)}, file.take(int(head["Archive-length"]))


def parts_of(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head, its closing blank line included, and payload; without a head all is payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    http, gap, payload = body.partition(b"\r\n\r\n")
    return http + gap, payload


def record_number(head: dict[str, str], http: bytes, place: str) -> int | None:
    """The number a record was written with; of others, one drawn from where they stand."""
    if found := re.search(rb"X-Record-Number: (-?\d*)", http):
        return int(found[1]) if found[1] else None
    own = f"{place} {head['Position']} {head['URL']} {head['Archive-date']}"
    return int.from_bytes(hashlib.sha1(own.encode()).digest()[:8], "big", signed=True)


def to_warc(head: dict[str, str], number: int | None, http: bytes, payload: bytes, first: int | None) -> bytes:
    """The WARC record of an ARC record, without its closing blank lines; ``first`` is the response's number."""
    d = head["Archive-date"].ljust(14, "0")
    lines = [
        "WARC/1.0",
        f"WARC-Record-ID: <urn:uuid:{record_uuid(number)}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {head['URL']}",
        f"WARC-IP-Address: {head['IP-address']}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: " + ("application/http;msgtype=response" if http else head["Content-type"]),
    ]
    body = http + payload
    if number == first:
        lines.append("WARC-Type: " + ("response" if http else "resource"))
    else:
        body = http
        lines += ["WARC-Type: revisit", f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_uuid(first)}>"]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(body)}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body


def read_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a WARC file that arrives in chunks."""
    file = _Chunks(chunks)
    while file.fill(1):
        lines = file.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        yield head, file.take(int(head["Content-Length"]))
        if file.fill(4):
            file.take(4)


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a file in chunks, of all members if it is gzipped."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    view = memoryview(data)
    at = 0
    while at < len(data):
        tool = zlib.decompressobj(31)
        while not tool.eof:
            piece = view[at : at + step]
            out = tool.decompress(piece, step)
            if not piece and not out and not tool.eof:
                raise ValueError("a gzip file is cut short")
            at += len(piece) - len(tool.unused_data if tool.eof else tool.unconsumed_tail)
            if out:
                yield out


def first_of_payload(records: DataFrame, min_bytes: int) -> DataFrame:
    """(number, sha, first) of records (number, sha, n): the smallest number of each payload of ``min_bytes`` or more."""
    salt = F.pmod(F.xxhash64("number"), F.lit(SALTS)).cast("int")
    x = records.distinct().withColumn("salt", salt)
    heads = x.groupBy("sha", "salt").agg(F.min("number").alias("m"))
    heads = heads.select("sha", "salt", F.min("m").over(W.partitionBy("sha")).alias("m"))
    own = F.when(F.col("n") >= min_bytes, F.col("m")).otherwise(F.col("number"))
    return x.join(heads, ["sha", "salt"]).select("number", "sha", own.alias("first"))


def _write(runs: DataFrame, path: str, separator: str) -> None:
    """Runs of records, as bytes, to gzip files."""
    writer = runs.selectExpr("CAST(value AS string) AS value").write.option("lineSep", separator).option("compression", "gzip")
    writer.option("maxRecordsPerFile", FILE_ROWS).text(path)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as ARC files below ``path``, of both versions in turn."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            ids, urls, texts = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
            if ids:
                arc = write_arc(zip(ids, urls, ((t or "").encode() for t in texts), strict=True), k % 2 + 1)
                yield pa.RecordBatch.from_arrays([pa.array([arc[:-1]], pa.binary())], names=["value"])

    _write(pages.select("page_id", "url", "html").mapInArrow(run, "value binary"), path, "\n")


_RECORD = pa.schema([("number", pa.int64()), ("sha", pa.string()), ("n", pa.int64()), ("head", pa.map_(pa.string(), pa.string())), ("http", pa.binary()), ("payload", pa.binary())])


def arc_records(spark: SparkSession, path: str, *, narrow: bool = False) -> DataFrame:
    """(number, sha, n, head, http, payload) of the records of the ARC files below ``path``; the first three if ``narrow``."""
    bounded_batches(spark)
    schema = pa.schema(list(_RECORD)[:3]) if narrow else _RECORD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for head, body in read_arc(inflate(content.as_py())):
                    http, payload = parts_of(body)
                    row = (record_number(head, http, place), sha1_base32(payload), len(payload))
                    rows.append(row if narrow else (*row, list(head.items()), http, payload))
                    held += 0 if narrow else len(body)
                    if held > 4 << 20 or len(rows) >= 10_000:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = "number long, sha string, n long" + ("" if narrow else ", head map<string,string>, http binary, payload binary")
    return files.mapInArrow(run, kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def convert_archives(spark: SparkSession, source: str, path: str, min_bytes: int = 0) -> None:
    """Write a WARC record for each record of the ARC files below ``source`` to gzip archives below ``path``."""
    firsts = first_of_payload(arc_records(spark, source, narrow=True), min_bytes).withColumnsRenamed({"number": "_number", "sha": "_sha"})
    same = F.col("number").eqNullSafe(F.col("_number")) & (F.col("sha") == F.col("_sha"))
    rows = arc_records(spark, source).join(firsts, same).select("number", "head", "http", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = (batch.column(c).to_pylist() for c in ("head", "number", "http", "payload", "first"))
            made = [to_warc(dict(head), *rest) for head, *rest in zip(*fields, strict=True)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(made)], pa.binary())], names=["value"])

    _write(rows.mapInArrow(run, "value binary"), path, "\r\n\r\n")


def convert_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one WARC record for each row (page_id, url, html) below ``path``, through ARC files."""
    spark = pages.sparkSession
    legacy = scratch_path(spark, "arc")
    write_archives(pages, legacy)
    convert_archives(spark, legacy, path, min_bytes)
    delete_path(spark, legacy)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``. Digests of whole payloads are checked."""
    bounded_batches(spark)

    def parse(head: dict[str, str], block: bytes) -> tuple:
        _, payload = parts_of(block)
        if sha1_base32(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError(f"the block of {head['WARC-Record-ID']} does not match its digest")
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        kind = head["WARC-Type"]
        if kind != "revisit" and (sha1_base32(payload) != digest or len(payload) != size):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its digest")
        known = [uuid_number(head[k][10:-1]) if k in head else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
        return known[0], size, digest, kind, known[1]

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in read_warc(inflate(content.as_py())):
                    rows.append(parse(head, block))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC archives and back."""
    path = scratch_path(spark, "warc")
    convert_pages(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, unhex(sha1(html))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
    + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
