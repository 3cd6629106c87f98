"""WARC archives and the chunked record table.

Writing: each task streams its rows into one archive of gzip members, one member a record, on any
file system that pyarrow opens by the URI of the shared folder. Files are written under a name of
their own and renamed when whole; the archives table names those of the tasks that counted, and a
repeated task's other file is never read. A response's block is an HTTP response, head and
payload; a revisit's is the head alone.

Reading: archives become a table of (archive, record, chunk, ...) rows. A payload is read in
pieces of ``chunk`` bytes, without the block's HTTP head; each row carries its piece, the payload's bytes and SHA-1 so far, and
whether it is the last. No step holds a whole record, however large. Anything computed over
payloads takes chunks in order; the digest is that of the last row.

Deduplication: of records with equal payloads the one with the largest id is written as a
response, the others as revisits that name it and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut, scratch

CHUNK = 1 << 20
LEAST = 0  # bytes from which equal payloads are written once
FIELDS = "archive string, record_no long, chunk_no long, warc_type string, record_id string, target_uri string, refers_to string, declared_digest string, last boolean, bytes_so_far long, digest_so_far string"
CHUNKS = FIELDS + ", chunk binary"
DATE = "2024-01-01T00:00:00Z"  # of records whose capture time isn't known
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format


def _open(uri: str):
    """(file system, path) of a folder's URI, on the driver or an executor."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record/{key}')}>"


def _safe(s: str | None) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in s or "")


def _writer(folder: str, chunk: int, date: str):
    """Batches of (id, url, response, first, digest, size, body) to one archive; returns its path and records."""

    def write(batches):
        out = fs = None
        n = 0
        for b in batches:
            if out is None and b.num_rows:
                fs, path = _open(folder)
                fs.create_dir(path, recursive=True)
                name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{name}.part", compression=None)
            ids, urls, responses, firsts, digests, sizes, body = (b.column(i) for i in range(7))
            for i in range(b.num_rows):
                key, response = ids[i].as_py(), responses[i].as_py()
                data = body[i].as_buffer() if response and body[i].is_valid else pa.py_buffer(b"")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {sizes[i].as_py()}\r\n\r\n".encode()
                head = [
                    "WARC/1.1",
                    f"WARC-Type: {'response' if response else 'revisit'}",
                    f"WARC-Record-ID: {record_id(key)}",
                    f"WARC-Target-URI: {_safe(urls[i].as_py())}",
                    f"WARC-Date: {date}",
                    f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(digests[i].as_py()))}",
                    f"X-Record-Key: {key}",
                ]
                if not response:
                    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(firsts[i].as_py())}", f"X-Refers-To-Key: {firsts[i].as_py()}"]
                head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block) + data.size}"]
                z = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member of its own
                out.write(z.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block))
                for at in range(0, data.size, chunk):
                    out.write(z.compress(memoryview(data)[at : at + chunk]))
                out.write(z.compress(b"\r\n\r\n"))
                out.write(z.flush())
                n += 1
        if out is not None:
            out.close()
            fs.move(f"{name}.part", name)
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    return write


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST, chunk: int = CHUNK, date: str = DATE) -> DataFrame:
    """Archives of all rows in folder; returns (archive, records). body: text, written as UTF-8, or binary. Null: empty.

    Payloads of fewer than least bytes are all responses. Rows that agree in key and payload are
    one page: if it is the first, each of them is a response. A null key is below all others.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("p"))
    rows = rows.withColumn("d", F.sha1("p"))
    first = rows.groupBy("d").agg(F.max("k").alias("first"))
    small = F.octet_length("p") < least
    rows = rows.join(first, "d").withColumn("r", small | F.col("k").eqNullSafe(F.col("first")))
    # a revisit's payload needn't travel to Python
    rows = rows.select("k", "u", "r", "first", "d", F.octet_length("p").alias("n"), F.when(F.col("r"), F.col("p")).alias("p"))
    return cut(rows.mapInArrow(_writer(folder, chunk, date), "archive string, records long"), "archives")


class _Members:
    """The bytes of an archive's gzip members, decompressed in pieces."""

    def __init__(self, raw, chunk: int):
        self.raw, self.chunk, self.held, self.z, self.rest = raw, chunk, b"", None, b""

    def fill(self) -> bool:
        while True:
            data = self.rest or self.raw.read(self.chunk)
            self.rest = b""
            if not data:
                return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data, self.chunk)
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            else:
                self.rest = self.z.unconsumed_tail
            if out:
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.held.find(mark)) < 0:
            if not self.fill():
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while not self.held and self.fill():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out


def records(raw, chunk: int = CHUNK):
    """(record number, chunk number, headers, piece, last, bytes so far, digest so far) of an open archive."""
    m, no = _Members(raw, chunk), 0
    while (head := m.until(b"\r\n\r\n")) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n") if ": " in x)
        left, done, sha, k = int(fields["Content-Length"]), 0, hashlib.sha1(), 0
        if fields.get("Content-Type", "").startswith("application/http"):
            if (http := m.until(b"\r\n\r\n")) is None:
                raise ValueError(f"record {no} ends early")
            left -= len(http) + 4
        while True:
            piece = b""
            while left and len(piece) < chunk:
                if not (x := m.take(min(left, chunk - len(piece)))):
                    raise ValueError(f"record {no} ends early")
                piece += x
                left -= len(x)
            sha.update(piece)
            done += len(piece)
            yield no, k, fields, piece, not left, done, base32(sha.copy().digest())
            k += 1
            if not left:
                break
        if m.until(b"\r\n\r\n") != b"":
            raise ValueError(f"record {no} isn't followed by an empty line")
        no += 1


def _reader(folder: str, chunk: int, pieces: bool):
    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, _ = _open(folder)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for no, k, f, piece, last, done, digest in records(raw, chunk):
                        row = (path, no, k, f["WARC-Type"], f.get("X-Record-Key"), f.get("WARC-Target-URI"), f.get("X-Refers-To-Key"), f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), last, done, digest)
                        rows.append((*row, piece) if pieces else row)
                        size += len(piece) if pieces else 0
                        if len(rows) >= 4096 or size >= 4 * chunk:
                            yield _batch(rows, pieces)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, pieces)

    return read


def _batch(rows: list[tuple], pieces: bool) -> pa.RecordBatch:
    s, i, b = pa.string(), pa.int64(), pa.bool_()
    types = [s, i, i, s, s, s, s, s, b, i, s] + [pa.binary()] * pieces
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in (CHUNKS if pieces else FIELDS).split(", ")])


def chunks(archives: DataFrame, folder: str, chunk: int = CHUNK, pieces: bool = True) -> DataFrame:
    """The chunked record table of archives (archive, ...); without pieces, all but the payload bytes."""
    files = archives.select("archive")
    spread = files.repartition(max(1, min(archives.count(), 4096)), "archive")
    return spread.mapInArrow(_reader(folder, chunk, pieces), CHUNKS if pieces else FIELDS)


RECORDS = "warc_type string, record_id string, refers_to string, declared_digest string, bytes_so_far long, digest_so_far string"


def _digests(batches):
    """Rows of the chunk table, each record's in order, to RECORDS; one piece at a time."""
    of, sha, size, due = None, None, 0, 0
    for b in batches:
        rows = []
        names = ("archive", "record_no", "chunk_no", "last", "warc_type", "record_id", "refers_to", "declared_digest")
        for (archive, no, k, last, *fields), piece in zip(zip(*(b.column(c).to_pylist() for c in names), strict=True), b.column("chunk"), strict=True):
            if k == 0 and sha is None:
                of, sha, size, due = (archive, no), hashlib.sha1(), 0, 0
            if (archive, no) != of or k != due or sha is None:
                raise ValueError(f"record {no} of {archive} or the one before lacks chunk {due}")
            data = piece.as_buffer()
            sha.update(data)
            size, due = size + data.size, due + 1
            if last:
                rows.append((*fields, size, base32(sha.digest())))
                sha = None
        if rows:
            types = [pa.int64() if f.endswith(" long") else pa.string() for f in RECORDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in RECORDS.split(", ")])
    if sha is not None:
        raise ValueError(f"record {of[1]} of {of[0]} lacks chunk {due}")


def digested(table: DataFrame) -> DataFrame:
    """RECORDS, a row a record of a chunk table, its bytes and digest computed from the table's pieces.

    Records of one piece stay where they are; the pieces of longer ones meet in order.
    """
    whole = (F.col("chunk_no") == 0) & F.col("last")
    parts = table.where(~whole).repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")
    return table.where(whole).mapInArrow(_digests, RECORDS).unionByName(parts.mapInArrow(_digests, RECORDS))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST) -> DataFrame:
    """Write pages and read the archives back: (key, payload_bytes, payload_digest, record_type, refers_to).

    The archives are read into a chunk table with its payload pieces, in the shared folder. Bytes and
    digest of a response are computed from its pieces in that table, those of a revisit are its
    response's. A response whose digest isn't the declared one fails the read.
    """
    folder = scratch(pages.sparkSession, "warc")
    table = cut(chunks(write(pages, folder, key, url, body, least), folder), "chunks")
    last = cut(digested(table), "records")
    kind = pages.schema[key].dataType
    own = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(kind)
    good = F.when(F.col("digest_so_far") == F.col("declared_digest"), F.col("digest_so_far")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs in record "), F.col("record_id"))).cast("string"))
    responses = last.where("warc_type = 'response'").select(own("record_id").alias(key), F.col("bytes_so_far").alias("payload_bytes"), good.alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    named = responses.select(F.col("payload_digest").alias("declared_digest"), "payload_bytes").distinct()
    revisits = last.where("warc_type = 'revisit'").join(named, "declared_digest")
    return responses.unionByName(revisits.select(own("record_id").alias(key), "payload_bytes", F.col("declared_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), own("refers_to").alias("refers_to")))
