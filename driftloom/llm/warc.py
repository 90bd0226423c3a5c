"""WARC archives: a writer with one gzip member per record and a sequential reader.

The reader inflates an archive piece by piece, frames each record by its Content-Length and verifies the payload's digest.
Archives are ordinary .warc.gz contents, held as rows of a table (archive binary) so that any store that Spark writes to
can keep them. read_files() also reads archives of other writers, if each record is a gzip member of its own: header names
in any case, records of all types, ids of any form, digests by SHA-1, SHA-256, SHA-512 or MD5 in hex or base-32, or none.

A null html is an empty payload; a null url is written as an empty target. Rows that repeat a page_id each get a record.
Equal payloads: the record with the smallest page_id is a response, as are those that repeat this id; the others are
revisits of it. A null page_id comes after all others. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small_batches

LEAST_BYTES = 100
ARCHIVE_BYTES = 4 << 20
PIECE = 1 << 16
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, record_id string, payload binary"


def marked(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, body, digest, refers_to: the response that a row revisits, else null."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body")).withColumn("digest", F.sha2("body", 256))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))).alias("first")
    groups = rows.where(F.length("body") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first.id")), F.col("first.id"))
    return rows.join(groups.select("digest", "first"), "digest", "left").select("page_id", "url", "body", "digest", F.when(F.length("body") >= least, refers).alias("refers_to"))


def _clean(value: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in value or "")


def _record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(body)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Rows of marked() to archives of about archive_bytes: n_records, archive."""
    small_batches(records.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["n_records", "archive"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_gzip_member(_record(*row), level))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return records.select("page_id", "url", "body", "digest", "refers_to").mapInArrow(run, "n_records long, archive binary")


class Reader:
    """Records of one archive in order. data: its bytes, in any pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, b""

    def members(self) -> Iterator[Iterator[bytes]]:
        """For each gzip member, its inflated pieces."""
        while self._fill():
            yield self._member()

    def _fill(self) -> bool:
        while not self.rest:
            try:
                self.rest = bytes(next(self.pieces))
            except StopIteration:
                return False
        return True

    def _member(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self._fill():
                raise EOFError("the archive ends within a gzip member")
            data, self.rest = self.rest, b""
            while data and not z.eof:
                yield z.decompress(data, PIECE)
                data = z.unconsumed_tail
            while not z.eof and (more := z.decompress(b"", PIECE)):
                yield more
            self.rest = z.unused_data

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for member in self.members():
            buffer = bytearray()
            at = -1
            for piece in member:
                buffer += piece
                if at < 0 and (at := buffer.find(b"\r\n\r\n")) >= 0:
                    lines = bytes(buffer[:at]).decode("utf-8").split("\r\n")
                    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if at < 0:
                if not buffer.strip():
                    continue
                raise ValueError("a record without the end of its header")
            start, length = at + 4, int(head["content-length"])
            if len(buffer) != start + length + 4 or buffer[start + length :] != b"\r\n\r\n":
                raise ValueError(f"the record {head.get('warc-record-id')} doesn't have the length that it states")
            yield head, bytes(buffer[start : start + length])


def _number(urn: str | None) -> int | None:
    """The page of a record id that write_archives() gives; null for any other."""
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdecimal() else None


def digest_fits(stated: str | None, payload: bytes) -> bool | None:
    """Whether a digest (algorithm:value, in hex or base-32) is the payload's; null if there is none, or of an unknown algorithm."""
    name, _, value = (stated or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    found = hashlib.new(name, payload)
    value = value.strip()
    if len(value) == 2 * found.digest_size:
        return value.lower() == found.hexdigest()
    return value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


def _fields(head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS."""
    kind, http = head.get("warc-type", ""), head.get("content-type", "").lower().startswith("application/http")
    end = block.find(b"\r\n\r\n") if http else -1
    payload = block[end + 4 :] if end >= 0 else b"" if http else block
    revisit, stated, length = kind == "revisit", head.get("warc-payload-digest"), head.get("warc-payload-length")
    if stated is None and not http:
        stated = head.get("warc-block-digest")
    good = None if revisit else digest_fits(stated, payload)
    if good and length is not None:
        good = len(payload) == int(length)
    size = int(length) if length is not None else None if revisit else len(payload)
    bare = stated.partition(":")[2].strip() if stated else None
    return _number(head.get("warc-record-id")), head.get("warc-target-uri"), kind, _number(head.get("warc-refers-to")) if revisit else None, size, bare, good, head.get("warc-record-id"), payload


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """All records of a table with a column archive, as RECORDS. verified: the payload has its digest (null for revisits, and where no digest is known).

    Of an HTTP record the payload is what follows its header, of any other the whole block. page_id and refers_to are null where the ids are another writer's.
    """
    schema = RECORDS if keep_payload else RECORDS.rpartition(",")[0]
    small_batches(archives.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary()][: len(names)]
        for batch in batches:
            for archive in batch.column(0):
                view = memoryview(archive.as_buffer())
                rows, size = [], 0
                for head, block in Reader(view[i : i + PIECE] for i in range(0, len(view), PIECE)):
                    rows.append(_fields(head, block)[: len(names)])
                    size += len(block)
                    if len(rows) >= 1000 or size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("archive").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc.gz files, of this or any other writer."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")))


def warc_round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages, read the archives back, and fail on a record that isn't verified."""
    read = read_archives(saved(write_archives(marked(pages), archive_bytes), "warc"), keep_payload=False)
    ok = F.when(F.coalesce("verified", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest of page "), F.col("page_id"))))
    return read.select("page_id", "payload_bytes", ok.cast("string").alias("payload_digest"), "record_type", "refers_to")
