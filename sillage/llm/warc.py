"""WARC archives as a table of chunks: once a payload is in Arrow's buffers, nothing copies it but a chunk at a time.

A row is (record, chunk, last, data, sha1_so_far): the bytes of a record in pieces of at most CHUNK and its headers, numbered from 0,
each with the digest of the payload up to its end. Payloads are cut into such rows first; what follows (finding equal payloads,
deciding which records are revisits, writing and reading) moves chunks and narrow rows only. A file is the data of its records, one
after the other, each in order of chunk; export() writes such files and load() reads them.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm.common import forget, read, slices, stored, whole

#: Bytes of a payload in one row, at most.
CHUNK = 1 << 18
#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 0
#: Bytes of chunks that go to Spark in one batch, about.
TOGETHER = 1 << 21

_PIECES = "record string, page_id long, url string, chunk long, last boolean, data binary, sha1_so_far string, size long, sha256 binary"
_PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def digest(sha1: hashlib._Hash) -> str:
    """Bare upper-case base32, as WARC-Payload-Digest has it after its label."""
    return base64.b32encode(sha1.digest()).decode()


def pieces(payload: memoryview) -> Iterator[tuple[int, bool, memoryview, str, int, bytes | None]]:
    """(chunk, last, data, sha1_so_far, size so far, sha256 of the whole with the last) of a payload; data are views of it, not copies.

    An empty payload is one empty chunk. Chunks count from 1, since 0 is for the headers.
    """
    sha1, sha256 = hashlib.sha1(), hashlib.sha256()
    for number, at in enumerate(range(0, max(len(payload), 1), CHUNK), 1):
        part = payload[at : at + CHUNK]
        sha1.update(part)
        sha256.update(part)
        last = at + CHUNK >= len(payload)
        yield number, last, part, digest(sha1), at + len(part), sha256.digest() if last else None


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The values of a string column as views of its buffer; nulls as empty ones."""
    column = column.cast(pa.large_binary()) if column.type in (pa.large_string(), pa.large_binary()) else column.cast(pa.binary())
    _, _, data = column.buffers()
    view = memoryview(data) if data is not None else memoryview(b"")
    wide = 8 if column.type == pa.large_binary() else 4
    offsets = memoryview(column.buffers()[1]).cast("B")[column.offset * wide : (column.offset + len(column) + 1) * wide].cast("q" if wide == 8 else "i") if len(column) else []
    for k in range(len(column)):
        yield view[offsets[k] : offsets[k + 1]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record", "page_id", "url", "chunk", "last", "data", "sha1_so_far", "size", "sha256"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows, held = [], 0
    for given in batches:
        records, ids, urls = (given.column(k).to_pylist() for k in range(3))
        for record, page, url, payload in zip(records, ids, urls, _views(given.column(3)), strict=True):
            for number, last, part, so_far, size, sha256 in pieces(payload):
                rows.append((record, page, url, number, last, part, so_far, size, sha256))
                held += len(part)
                if held >= TOGETHER or len(rows) >= 1024:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)
            rows, held = [], 0


def _lines(*lines: Column) -> Column:
    return F.concat_ws(_CRLF, *lines)


def head() -> Column:
    """WARC and HTTP headers as bytes, of a record's row (record, page_id, url, size, sha1, to_record, to_page). A revisit keeps the HTTP headers, and so
    its payload's size, but not the payload. Pages have their ids in a field of their own, since record ids are unique and these may repeat."""
    revisit = F.col("to_record").isNotNull()
    http = F.concat(_lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), "size")), F.lit(_CRLF * 2))
    warc = _lines(
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), "record", F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.lit("Content-Type: application/http; msgtype=response"), F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), "page_id")),
        F.when(revisit, _lines(F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), "to_record", F.lit(">")), F.concat(F.lit("X-Refers-To-Page-ID: "), "to_page"), F.lit(f"WARC-Profile: {_PROFILE}"))),
        F.concat(F.lit("Content-Length: "), F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))),
    )
    return F.encode(F.concat(warc, F.lit(_CRLF * 2), http), "UTF-8")


class Reader:
    """Takes the chunks of records in order and gives each record's (page_id, payload_bytes, digest, type, refers_to, intact).

    The payload's digest is computed as its bytes pass and held against every chunk's sha1_so_far and against the header.
    A revisit's size and digest are those its headers state.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.sha1, self.waiting, self.left, self.fields, self.size, self.got, self.whole = hashlib.sha1(), b"", -1, {}, 0, 0, True

    def feed(self, data: bytes, so_far: str, last: bool) -> tuple | None:
        at = 0
        if self.left < 0:
            self.waiting += data
            ends = self.waiting.find(b"\r\n\r\n")
            http = self.waiting.find(b"\r\n\r\n", ends + 4) if ends >= 0 else -1
            if http < 0:
                return None
            for line in self.waiting[:ends].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
                name, _, value = line.partition(": ")
                self.fields[name.lower()] = value
            for line in self.waiting[ends + 4 : http].decode("latin-1").split("\r\n"):
                if line.lower().startswith("content-length: "):
                    self.size = int(line[16:])
            self.left = int(self.fields["content-length"]) - (http - ends)
            data, at, self.waiting = self.waiting, http + 4, b""
        part = memoryview(data)[at : at + self.left] if data else memoryview(b"")
        self.sha1.update(part)
        self.left -= len(part)
        self.got += len(part)
        self.whole &= digest(self.sha1) == so_far
        if not last:
            return None
        stated, kind = self.fields["warc-payload-digest"].removeprefix("sha1:"), self.fields["warc-type"]
        number = lambda name: int(self.fields[name]) if name in self.fields else None
        size, sha1 = (self.size, stated) if kind == "revisit" else (self.got, digest(self.sha1))
        record = number("x-page-id"), size, sha1, kind, number("x-refers-to-page-id"), self.whole and self.left == 0 and sha1 == stated
        self.clear()
        return record


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for last, data, so_far in slices(batches, 64):
        found = [r for x in zip(data, so_far, last, strict=True) if (r := reader.feed(*x)) is not None]
        if found:
            columns = zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])


def cut(pages: DataFrame) -> DataFrame:
    """The payloads of pages (page_id, url, html) as chunk rows, in the shared folder: record (a new UUID for each row), page_id, url, chunk, last,
    data, sha1_so_far, size so far, and with the last chunk the sha256 of all."""
    rows = pages.select(F.expr("uuid()").alias("record"), F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), whole("html").alias("html"))
    return stored(rows.mapInArrow(_cut, _PIECES), "payloads")


def firsts(payloads: DataFrame, least_revisit: int) -> tuple[DataFrame, DataFrame]:
    """The last chunks of payloads, one for each record; and of payloads that repeat, by sha256 and size, the page and record that the others revisit."""
    ends = payloads.where("last").select("record", "page_id", "url", "size", "sha256", F.col("sha1_so_far").alias("sha1"))
    able = ends.where(f"page_id is not null and size >= {least_revisit}")
    first = able.groupBy("sha256", "size").agg(F.max(F.struct("page_id", "record")).alias("to"), F.count("*").alias("n")).where("n > 1")
    # A table of its own, so that the join with it has plain exchanges on both sides and Spark can split the pages of one hot payload.
    return ends, stored(first.select("sha256", "size", F.col("to.page_id").alias("to_page"), F.col("to.record").alias("to_record")), "firsts")


def referring(ends: DataFrame, first: DataFrame) -> DataFrame:
    """record, page_id, url, size, sha1, and of revisits the page and record that they revisit."""
    refers = F.expr("page_id < to_page")
    return ends.join(first, ["sha256", "size"], "left").select("record", "page_id", "url", "size", "sha1", F.when(refers, F.col("to_page")).alias("to_page"), F.when(refers, F.col("to_record")).alias("to_record"))


def write_archives(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """The chunk table of pages (page_id, url, html), one record each: record, chunk, last, data, sha1_so_far.

    Of equal payloads (by SHA-256 and size) of at least least_revisit bytes the largest page_id is the response; rows that repeat that id
    are responses too. A null html is the empty payload, a null url an empty target. A row with a null page_id is
    a response of its own, to which nothing refers. Empty tables give no rows; other columns are ignored.
    """
    payloads = cut(pages)
    ends, first = firsts(payloads, least_revisit)
    decided = stored(referring(ends, first), "records")
    heads = decided.select("record", F.lit(0).cast("long").alias("chunk"), F.col("to_record").isNotNull().alias("last"), F.concat(head(), F.when(F.col("to_record").isNotNull(), F.encode(F.lit(_CRLF * 2), "UTF-8")).otherwise(F.lit(b""))).alias("data"), F.lit(digest(hashlib.sha1())).alias("sha1_so_far"))
    # A table of its own, so that Spark knows how small it is: where few payloads repeat, no payload moves for this.
    revisits = stored(decided.where("to_record is not null").select("record"), "revisits")
    bodies = payloads.join(revisits, "record", "left_anti")
    bodies = bodies.select("record", "chunk", "last", F.when(F.col("last"), F.concat("data", F.encode(F.lit(_CRLF * 2), "UTF-8"))).otherwise(F.col("data")).alias("data"), "sha1_so_far")
    archive = stored(heads.unionByName(bodies), "warc")
    forget(payloads, first, decided, revisits)
    return archive


def _in_order(archive: DataFrame) -> DataFrame:
    return archive.repartition("record").sortWithinPartitions("record", "chunk")


def read_archives(archive: DataFrame) -> DataFrame:
    """Every record of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Null ids stay null; records are known by their own ids, so rows that repeat a page_id stay apart; an empty table gives no rows;
    other columns are ignored. A record that lacks its last chunk gives no row.
    """
    return _in_order(archive).select("last", "data", "sha1_so_far").mapInArrow(_parse, _PARSED)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def export(archive: DataFrame, folder: str) -> DataFrame:
    """Write a chunk table as .warc files into a folder that all executors share (any store that Arrow knows); a row for each file: path, records, bytes.

    A task writes one file, chunk by chunk, under a name of its own, and gives it its last name when it is complete, so that a task that runs again
    leaves no half file behind. The files are written as the result is read, and once: it is stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        name = f"{base.rstrip('/')}/part-{uuid.uuid4().hex}"
        records = size = 0
        out = None
        try:
            for lasts, data in slices(batches, 16):
                out = out or store.open_output_stream(f"{name}.part")
                for last, piece in zip(lasts, data, strict=True):
                    out.write(piece)
                    records, size = records + last, size + len(piece)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            store.move(f"{name}.part", f"{name}.warc")
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    with contextlib.suppress(OSError):
        store, base = _opened(folder)
        store.create_dir(base)
    return stored(_in_order(archive).select("last", "data").mapInArrow(run, "path string, records long, bytes long"), "exported")


def records_of(stream, size: int = CHUNK) -> Iterator[tuple[int, bool, bytes, str]]:  # noqa: ANN001
    """(chunk, last, data, sha1_so_far) of every record of a WARC stream, which is read size bytes at a time."""
    waiting = b""
    while True:
        while b"\r\n\r\n" not in waiting:
            more = stream.read(size)
            if not more:
                if waiting.strip():
                    raise ValueError("a WARC file ends within a header")
                return
            waiting += more
        ends = waiting.index(b"\r\n\r\n") + 4
        fields = dict(line.lower().split(b": ", 1) for line in waiting[:ends].split(b"\r\n")[1:] if b": " in line)
        left = int(fields[b"content-length"])
        # The record's HTTP headers go with its own.
        while waiting.find(b"\r\n\r\n", ends) < 0 and len(waiting) - ends < left:
            more = stream.read(size)
            if not more:
                raise ValueError("a WARC file ends within a record")
            waiting += more
        http = min(waiting.find(b"\r\n\r\n", ends) + 4, ends + left)
        left -= http - ends
        sha1, number, data = hashlib.sha1(), 0, waiting[:http]
        waiting = waiting[http:]
        while left:
            yield number, False, data, digest(sha1)
            number += 1
            if not waiting:
                waiting = stream.read(size)
                if not waiting:
                    raise ValueError("a WARC file ends within a record")
            data, waiting = waiting[: min(left, size)], waiting[min(left, size) :]
            sha1.update(data)
            left -= len(data)
        while len(waiting) < 4:
            more = stream.read(size)
            if not more:
                break
            waiting += more
        yield number, True, data + waiting[:4], digest(sha1)
        waiting = waiting[4:]


def load(files: DataFrame) -> DataFrame:
    """The chunk table of .warc files (path), uncompressed: each is read as a stream. Files that aren't whole raise ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (paths,) in slices(batches, 16):
            for path in paths:
                store, at = _opened(path)
                with store.open_input_stream(at) as stream:
                    for number, last, data, so_far in records_of(stream):
                        record = uuid.uuid4().hex if not number else record
                        yield pa.RecordBatch.from_arrays([pa.array([record]), pa.array([number], pa.int64()), pa.array([last]), pa.array([data], pa.binary()), pa.array([so_far])], names=["record", "chunk", "last", "data", "sha1_so_far"])

    return stored(files.select("path").mapInArrow(run, "record string, chunk long, last boolean, data binary, sha1_so_far string"), "warc")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(read(spark, sf_dir, "pages")))


OP6_SQL = r"""
with hashed as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
digested as (select page_id, html, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  cast(((cast('0x' || substr(h, cast((i // 8) * 10 + 1 as bigint), 10) as bigint) >> cast(35 - 5 * (i % 8) as integer)) & 31) + 1 as bigint), 1)), '') as payload_digest from hashed),
ranked as (select *, max(page_id) over (partition by html) as last_id from digested)
select page_id, payload_bytes, payload_digest, case when page_id = last_id then 'response' else 'revisit' end as record_type,
  case when page_id < last_id then last_id end as refers_to, true as intact from ranked
"""
