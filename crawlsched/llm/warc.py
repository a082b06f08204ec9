"""WARC archives through a chunked record table.

``write`` puts rows (id, url, payload) out as gzipped WARC/1.1: a payload over ``chunk_bytes`` becomes a first segment
and ``continuation`` records, as the standard has it, each with the digest of the payload up to its end. ``read_chunks``
gives the record table: one row per record, or, for oversized payloads, one row per (record identifier, chunk number).
It takes archives as streams of lines, which Spark's reader unpacks as they come, so neither an archive nor a record
is ever held whole, but for a line: a record that some other program wrote in one piece is cut into chunks as it passes
by, with its digest carried along. Stated digests and lengths are compared with what was read. ``digests`` folds a record
table to one row per record, with a running SHA-1 for the records of several chunks.

Defined cases: a null payload is empty; a null url leaves out WARC-Target-URI; a null id is kept as null and is never
a response for others; repeated rows stay separate records (several rows with the largest id of a group are all
responses); an empty table gives an archive folder without records; other columns play no part. An archive that ends
within a record, or whose digests or lengths do not fit, raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsched.llm.shared import Scratch

CHUNK_BYTES = 256 * 1024
RECORDS_PER_FILE = 1000
LONGEST_HEAD = 1 << 20
BROADCAST_DIGESTS = 1 << 18
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = b"1970-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = "page_id long, record_id string, record_type string, refers_to long, chunk int, last boolean, payload_bytes long, stated_digest string, running_digest string, data binary"


def revisits(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses). Equal payloads of at least ``least_bytes`` point
    to the one with the largest id. The groups are found by an aggregate that combines before the shuffle. The digests that occur
    more than once are sent to all while there are few, so that payloads stay where they are; else joined by a shuffle."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    big = F.octet_length("payload") >= least_bytes
    top = p.filter(big).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null").select("digest", "top")
    top = Scratch(pages.sparkSession, "revisits").keep(top, "top")
    found = p.join(F.broadcast(top) if top.count() <= BROADCAST_DIGESTS else top, "digest", "left")
    return found.select("page_id", "url", "payload", "digest", F.when(big & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def _cut(data: memoryview, at: int, size: int) -> int:
    """End of the chunk from ``at``: at most ``size`` bytes, not within a character."""
    end = min(at + size, len(data))
    while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def _uri(url: str) -> bytes:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode()


def records(batches: Iterator[pa.RecordBatch], chunk_bytes: int, partition: int) -> Iterator[pa.RecordBatch]:
    """WARC text of each chunk, without the last line end (the text sink adds that)."""
    n = 0
    for batch in batches:
        out: list[bytes] = []
        held = 0
        cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
        for k in range(batch.num_rows):
            pid, url, digest, to = cols[0][k].as_py(), cols[1][k].as_py(), cols[3][k].as_py(), cols[4][k].as_py()
            data = memoryview(cols[2][k].as_buffer())
            rid = f"urn:page:{'null' if pid is None else pid}:{partition}-{n}".encode()
            n += 1
            shared = b"WARC-Date: " + DATE + (b"\r\nWARC-Target-URI: " + _uri(url) if url is not None else b"")
            whole = b"\r\nWARC-Payload-Digest: sha1:" + digest.encode() + b"\r\nX-Payload-Length: %d" % len(data)
            if to is not None:
                out.append(b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <" + rid + b">\r\n" + shared + whole + b"\r\nWARC-Refers-To: <urn:page:%d>\r\nWARC-Profile: " % to + PROFILE + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(HTTP) + HTTP + b"\r\n")
            else:
                state, at, number, many = hashlib.sha1(), 0, 1, len(data) > chunk_bytes
                while True:
                    end = _cut(data, at, chunk_bytes)
                    part = bytes(data[at:end])
                    state.update(part)
                    head = HTTP if number == 1 else b""
                    kind = b"response" if number == 1 else b"continuation"
                    more = b""
                    if many:
                        more = b"\r\nWARC-Segment-Number: %d\r\nX-Running-Digest: sha1:" % number + state.hexdigest().encode()
                        if number > 1:
                            more += b"\r\nWARC-Segment-Origin-ID: <" + rid + b">"
                        if end == len(data):
                            more += b"\r\nWARC-Segment-Total-Length: %d" % (len(data) + len(HTTP))
                    own = rid if number == 1 else rid + b":%d" % number
                    out.append(b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <" + own + b">\r\n" + shared + (whole if number == 1 else b"") + more + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % (len(head) + len(part)) + head + part + b"\r\n")
                    held += len(part)
                    if held > 16 * chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                        out, held = [], 0
                    at, number = end, number + 1
                    if at >= len(data):
                        break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 1000, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one record per row below ``path``, in archives of at most RECORDS_PER_FILE records."""

    def put(batches):
        from pyspark import TaskContext

        return records(batches, chunk_bytes, TaskContext.get().partitionId())

    revisits(pages, page_id, url, payload, least_bytes).mapInArrow(put, "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def _header(line: bytes, name: bytes) -> str | None:
    m = re.search(rb"\r\n" + name + rb":[ \t]*([^\r]*)", line, re.I)
    return m[1].decode() if m else None


class Reader:
    """Rows of CHUNK_SCHEMA from the bytes of archives, fed piece by piece. Payloads of one chunk are digested here; their
    bytes are passed on only with ``keep_all``. No more than a chunk, a head and the piece at hand are held."""

    def __init__(self, keep_all: bool = True, chunk_bytes: int = CHUNK_BYTES):
        self.keep_all, self.chunk_bytes = keep_all, chunk_bytes
        self.held = bytearray()
        self.at = 0  # bytes of ``held`` that are done with
        self.step, self.left = self._head, 0

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.held += data
        while (row := self.step()) is not None:
            if row:
                yield row
        del self.held[: self.at]
        self.at = 0

    def end(self) -> None:
        if self.step != self._head or self.held:
            raise ValueError("an archive ends within a record")

    # Steps: each returns a row, () to go on, or None for more bytes.

    def _until_blank(self, what: str) -> bytes | None:
        end = self.held.find(b"\r\n\r\n", self.at, self.at + LONGEST_HEAD)
        if end < 0:
            if len(self.held) - self.at > LONGEST_HEAD:
                raise ValueError(f"a {what} of more than {LONGEST_HEAD} bytes")
            return None
        out = bytes(self.held[self.at : end])
        self.at = end + 4
        return out

    def _head(self):
        if len(self.held) == self.at or (head := self._until_blank("record head")) is None:
            return None
        if not head.startswith(b"WARC/1.") or (size := _header(head, b"Content-Length")) is None:
            raise ValueError(f"no WARC record where one should begin: {head[:40]!r}")
        self.left, self.kind, self.rid = int(size), _header(head, b"WARC-Type"), _header(head, b"WARC-Record-ID")[1:-1]
        self.number, total = int(_header(head, b"WARC-Segment-Number") or 0), _header(head, b"WARC-Segment-Total-Length")
        self.length, self.digest, self.running = _header(head, b"X-Payload-Length"), _header(head, b"WARC-Payload-Digest"), _header(head, b"X-Running-Digest")
        to = _header(head, b"WARC-Refers-To")
        self.to, self.closing = int(to[1:-1].split(":")[2]) if to else None, total is not None
        if self.kind == "continuation":
            self.rid = _header(head, b"WARC-Segment-Origin-ID")[1:-1]
        pid = self.rid.split(":")[2]
        self.pid = None if pid == "null" else int(pid)
        self.part, self.state, self.read, self.chunk = bytearray(), hashlib.sha1(), 0, 0
        self.step = self._body if self.kind == "continuation" else self._http
        return ()

    def _http(self):
        before = self.at
        if self._until_blank("payload head") is None:
            return None
        self.left -= self.at - before
        if self.left < 0:
            raise ValueError(f"record {self.rid}: its stated length ends within the payload's head")
        self.step = self._body
        return ()

    def _body(self):
        n = min(self.left, len(self.held) - self.at, self.chunk_bytes - len(self.part) if not self.number else self.left)
        piece = self.held[self.at : self.at + n]
        self.part += piece
        self.state.update(piece)
        self.at, self.left, self.read = self.at + n, self.left - n, self.read + n
        if self.left and not self.number and len(self.part) == self.chunk_bytes:
            return self._row(last=False)
        if self.left:
            return None
        self.step = self._close
        return ()

    def _close(self):
        if len(self.held) - self.at < 4:
            return None
        if self.held[self.at : self.at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {self.rid} does not end after its stated length")
        self.at += 4
        self.step = self._head
        worked = self.state.hexdigest()
        if self.kind == "revisit":
            return (self.pid, self.rid, self.kind, self.to, 0, True, int(self.length) if self.length else None, self.digest and self.digest[5:], self.digest and self.digest[5:], b"" if self.keep_all else None)
        if not self.number:
            if self.digest and self.digest.startswith("sha1:") and self.digest[5:] != worked:
                raise ValueError(f"record {self.rid}: its payload's digest does not fit")
            if self.length is not None and int(self.length) != self.read:
                raise ValueError(f"record {self.rid}: {self.read} bytes, {self.length} stated")
            self.length = self.read
        return self._row(last=self.closing or not self.number)

    def _row(self, last: bool):
        if self.number:  # a segment, whose running digest stands in its head
            number, running, keep = self.number, self.running and self.running[5:], True
        else:
            self.chunk += 1
            number = 0 if last and self.chunk == 1 else self.chunk
            running, keep = self.state.hexdigest(), self.keep_all or number > 0
        data, self.part = bytes(self.part), bytearray()
        return (self.pid, self.rid, "response" if self.kind == "continuation" else self.kind, self.to, number, last, int(self.length) if self.length is not None else None, self.digest and self.digest[5:], running, data if keep else None)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])


def read_chunks(spark: SparkSession, path: str, keep_all: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The record table of the gzipped archives below ``path``."""

    def get(batches):
        reader, rows, held = Reader(keep_all, chunk_bytes), [], 0
        for batch in batches:
            lines = batch.column(0).cast(pa.binary()).to_pylist()
            for lo in range(0, len(lines), 256):
                for row in reader.feed(b"\n".join(lines[lo : lo + 256]) + b"\n"):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 16 * CHUNK_BYTES or len(rows) >= 4096:
                        yield _table(rows)
                        rows, held = [], 0
        reader.end()
        if rows:
            yield _table(rows)

    return spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).mapInArrow(get, CHUNK_SCHEMA)


def digests(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. ``chunks`` is read twice, so it
    should be a written table. Records of several chunks are dealt out by identifier, sorted by chunk number, and digested as they stream by; a running digest or a length
    that does not fit raises."""
    names = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    one = chunks.filter("chunk = 0").select("page_id", "payload_bytes", F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")

    def fold(batches):
        state = rid = first = None
        size = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["record_id"] != rid:
                    if rid is not None:
                        raise ValueError(f"record {rid} has no last chunk")
                    state, rid, first, size = hashlib.sha1(), row["record_id"], row, 0
                state.update(row["data"])
                size += len(row["data"])
                if row["running_digest"] and state.hexdigest() != row["running_digest"]:
                    raise ValueError(f"record {rid}, chunk {row['chunk']}: digest does not fit")
                if row["last"]:
                    if first["stated_digest"] and state.hexdigest() != first["stated_digest"]:
                        raise ValueError(f"record {rid}: its payload's digest does not fit")
                    if first["payload_bytes"] is not None and size != first["payload_bytes"]:
                        raise ValueError(f"record {rid}: {size} bytes, {first['payload_bytes']} stated")
                    out.append((first["page_id"], size, state.hexdigest(), first["record_type"], None))
                    rid = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=[x.split()[0] for x in names.split(", ")])
        if rid is not None:
            raise ValueError(f"record {rid} has no last chunk")

    many = chunks.filter("chunk > 0").repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInArrow(fold, names)
    return one.unionByName(many)
