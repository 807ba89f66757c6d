"""WARC archives: a writer whose records say how long they are, and a Python data source that skips what isn't asked for.

The data source plans its partitions from file sizes (a large compressed archive is cut into ranges of bytes; the reader of
a range begins at the first record that starts in it), takes predicates on record type and on named headers from
Spark's optimiser, inflates the head of a record first and its payload only if the record is wanted and a column of
the schema needs it. Each record is a gzip member of its own; the writer notes the member's compressed length in
the gzip header's extra field (subfield ``SL``), so that an unwanted payload is passed over without inflating it.
Members without the note, from other writers, are inflated to find their end. Uncompressed archives are read as well, each
by one task. A record that ends before its stated length raises an error; nothing is left out in silence.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from .common import new_folder
from .files import list_files, make_folder, open_stream, write_bytes

#: Compressed bytes after which the writer starts another file, and that one read task is given at least.
FILE_BYTES, TASK_BYTES = 64 << 20, 16 << 20
#: Compressed bytes beyond which an archive is read by several tasks.
SPLIT_BYTES = 128 << 20
#: Rows that share a payload are dealt out over so many keys.
SALTS = 32
HEAD = 16 << 10
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with the subfield SL: compressed length of the whole member, then length of the data."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<H", 8)
    total = len(head) + 8 + len(body) + 8
    head += struct.pack("<II", total if total < 1 << 32 else 0, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(name: str, value: str) -> bytes:
    return f"{name}: {value}\r\n".encode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes | None, length: int, digest: str, refers_to: str | None = None) -> bytes:
    """A response, or a revisit that leaves the payload out; the HTTP head has the payload's length in either."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", str(length)) + b"\r\n"
    block = http + (payload or b"")
    out = [b"WARC/1.1\r\n", _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", _DATE)]
    if uri is not None:  # line ends and blanks can't stand in a header
        out.append(_line("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in uri)))
    out.append(_line("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        out += [_line("WARC-Refers-To", refers_to), _line("WARC-Profile", _PROFILE)]
    out += [_line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", str(len(block))), b"\r\n", block, b"\r\n\r\n"]
    return b"".join(out)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, held, size, done = TaskContext.get().partitionId(), 0, [], 0, []
        names = ("page_id", "url", "payload", "length", "digest", "refers_to")

        def close() -> None:
            nonlocal file, held, size
            if held:
                write_bytes(name := f"{folder}/part-{part:06d}-{file:04d}.warc.gz", *held)
                done.append((name, len(held), size))
                file, held, size = file + 1, [], 0

        for batch in batches:
            for page, url, payload, length, digest, first in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                own, other = (None if x is None else f"<urn:page:{x}>" for x in (page, first))
                own = own or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"
                sha = base64.b32encode(bytes.fromhex(digest)).decode()
                held.append(member(record("response" if first is None else "revisit", own, url, payload, length, sha, other)))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]}, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_pages(pages: DataFrame, folder: str | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, int]:
    """Writes a record for each row and returns the folder and the number of records.

    The payload is the html in UTF-8, a null is empty. Of rows with equal payloads of at least ``least`` bytes the one
    with the smallest id is a response and the others revisit it; shorter ones are all responses, as are rows without
    an id. Rows that repeat the smallest id are all responses. A null url is left out. A task that runs again writes
    the same file again.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("length"), F.sha1(payload).alias("digest"))
    firsts = rows.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = firsts.select("d", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))  # a payload of any number of pages stays spread
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    rows = rows.join(firsts, (F.col("digest") == F.col("d")) & (salt == F.col("s")), "left")
    again = (F.col("length") >= least) & (F.col("page_id") != F.col("first"))
    rows = rows.select("page_id", "url", F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"), "length", "digest", F.when(again, F.col("first")).alias("refers_to"))
    make_folder(folder := folder or new_folder(spark, "warc"))
    written = rows.mapInArrow(_write(folder), "file string, records long, bytes long").agg(F.sum("records")).first()
    return folder, written[0] or 0


@dataclass
class Record:
    """A record's head; ``payload()`` inflates the rest."""

    headers: dict[str, str]
    http_status: int | None
    http_headers: dict[str, str]
    body: Iterable[bytes]

    def payload(self) -> bytes:
        return b"".join(self.body)


def _parse(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded header goes on
            headers[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            headers[last := name.strip().lower()] = value.strip()
    return lines[0], headers


class _Source:
    """A buffered file: what has been read ahead, and the rest."""

    def __init__(self, file, start: int = 0):
        self.file, self.ahead, self.at = file, b"", start
        if start:
            file.seek(start)

    def take(self, n: int) -> bytes:
        while len(self.ahead) < n and (more := self.file.read(max(n - len(self.ahead), 1 << 18))):
            self.ahead += more
        out, self.ahead = self.ahead[:n], self.ahead[n:]
        self.at += len(out)
        return out

    def give_back(self, data: bytes) -> None:
        self.ahead, self.at = data + self.ahead, self.at - len(data)

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.ahead):
            self.ahead = self.ahead[n:]
        else:
            self.file.seek(n - len(self.ahead), 1)
            self.ahead = b""


def _inflated(source: _Source) -> Iterator[bytes]:
    """Pieces of the member that begins here, HEAD bytes first. Closing the iterator passes over the rest: by the
    noted length if there is one, else by inflating it."""
    start = source.take(24)
    noted = struct.unpack("<I", start[16:20])[0] if len(start) == 24 and start[3] & 4 and start[12:14] == b"SL" else 0
    used = len(start)
    inflate = zlib.decompressobj(31)
    data = start
    try:
        while not inflate.eof:
            if not data:
                data = source.take(min(noted - used, 1 << 16) if noted else 1 << 16)
                used += len(data)
                if not data:
                    raise EOFError("an archive ends within a record")
            piece = inflate.decompress(data, HEAD)
            data = inflate.unconsumed_tail
            if piece:
                yield piece
    finally:
        if noted:
            source.skip(noted - used)
        else:
            while not inflate.eof and (data or (data := source.take(1 << 16))):
                inflate.decompress(data, 1 << 20)
                data = inflate.unconsumed_tail
            source.give_back(inflate.unused_data)


def _stored(source: _Source) -> Iterator[bytes]:
    """Pieces of an uncompressed record; its length is known once its head is read."""
    head = b""
    while b"\r\n\r\n" not in head and (more := source.take(1024)):
        head += more
    at = head.find(b"\r\n\r\n") + 4
    size = at + int(_parse(head[: at - 4])[1].get("content-length", 0)) + 4
    source.give_back(head[size:])
    head, left = head[:size], max(0, size - len(head))
    try:
        yield head
        while left and (piece := source.take(min(left, 1 << 16))):
            left -= len(piece)
            yield piece
    finally:
        source.skip(left)


def _first_member(source: _Source, end: int) -> bool:
    """Moves to the first compressed record that starts at the source's place or behind it, before ``end``."""
    while source.at < end and (window := source.take(1 << 16)):
        at = window.find(b"\x1f\x8b\x08")
        if at < 0:
            source.give_back(window[-2:] if len(window) > 2 else b"")
            if len(window) <= 2:
                return False
            continue
        source.give_back(window[at:])
        probe = source.take(1 << 12)
        source.give_back(probe)
        try:
            if zlib.decompressobj(31).decompress(probe, 8).startswith(b"WARC/"):
                return source.at < end
        except zlib.error:
            pass
        source.take(1)
    return False


def records(file, wanted, start: int = 0, end: int | None = None) -> Iterator[Record]:
    """The records of an archive, or those that start in a range of its bytes, whose headers ``wanted`` admits. Each has to
    be used before the next is asked for."""
    source = _Source(file, start)
    if start and not _first_member(source, end):
        return
    while (end is None or source.at < end) and (mark := source.take(2)):
        source.give_back(mark)
        if mark != b"\x1f\x8b" and mark != b"WA":
            source.take(1)  # line ends between records
            continue
        pieces = _inflated(source) if mark == b"\x1f\x8b" else _stored(source)
        head = b""
        for piece in pieces:
            head += piece
            if b"\r\n\r\n" in head:
                break
        first, _, rest = head.partition(b"\r\n\r\n")
        version, headers = _parse(first)
        if version.startswith("WARC/") and wanted(headers):
            left = int(headers.get("content-length", 0))
            status, http = None, {}
            if headers.get("content-type", "").startswith("application/http"):
                while b"\r\n\r\n" not in rest and len(rest) < left and (more := next(pieces, None)):
                    rest += more
                http_head, _, body = rest.partition(b"\r\n\r\n")
                line, http = _parse(http_head)
                status = int(line.split()[1]) if line[:5] == "HTTP/" and line.split()[1:2] and line.split()[1].isdigit() else None
                left, rest = left - (len(rest) - len(body)), body
            yield Record(headers, status, http, _limited(rest, pieces, left))
        pieces.close()


def _limited(first: bytes, more: Iterator[bytes], left: int) -> Iterator[bytes]:
    yield first[:left]
    left -= len(first)
    while left > 0:
        if not (piece := next(more, None)):
            raise EOFError("a record is shorter than its stated length")
        yield piece[:left]
        left -= len(piece)


@dataclass
class Files(InputPartition):
    ranges: tuple[tuple[str, int, int | None], ...]  # name, first byte, end of the range (None: the file's)


#: Columns by name: type, and how a record gives the value.
_HEADERS = {"warc_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
_SCHEMA = ", ".join(f"{c} string" for c in _HEADERS) + ", content_length long, http_status int, http_length long, headers map<string,string>, payload binary, payload_bytes long, computed_digest string"
_PAYLOAD = {"payload", "payload_bytes", "computed_digest"}


class WarcReader(DataSourceReader):
    """Reads the columns of ``schema``; payloads are inflated only if one of them needs it."""

    def __init__(self, schema, options: dict):
        self.columns = schema.fieldNames()
        self.types = {f.name: f.dataType for f in schema.fields}
        self.path = options["path"]
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        rest = []
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name in _HEADERS:
                self.equal[name] = self.equal.get(name, {f.value}) & {f.value}
            elif isinstance(f, In) and name in _HEADERS:
                self.equal[name] = self.equal.get(name, set(f.value)) & set(f.value)
            else:
                rest.append((f, name))
        return [f for f, name in rest if not (isinstance(f, IsNotNull) and name in self.equal)]

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for name, n in list_files(self.path, (".warc.gz", ".warc")):
            if n > SPLIT_BYTES and name.endswith(".gz"):
                out += [Files(((name, at, min(n, at + SPLIT_BYTES)),)) for at in range(0, n, SPLIT_BYTES)]
                continue
            held.append((name, 0, None))
            size += n
            if size >= TASK_BYTES:
                out.append(Files(tuple(held)))
                held, size = [], 0
        return [*out, Files(tuple(held))] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([(c, to_arrow_type(self.types[c])) for c in self.columns])
        checks = [(_HEADERS[c], values) for c, values in self.equal.items()]

        def wanted(headers: dict[str, str]) -> bool:
            return all(headers.get(h) in values for h, values in checks)

        needs = bool(_PAYLOAD & set(self.columns))
        rows, size = [], 0
        for name, start, end in partition.ranges:
            with open_stream(name) as f:
                for r in records(f, wanted, start, end):
                    payload = r.payload() if needs and r.headers.get("warc-type") != "revisit" else None
                    rows.append([self._value(c, r, payload) for c in self.columns])
                    size += len(payload or b"") * ("payload" in self.columns) + 500
                    if size >= 8 << 20:
                        yield self._batch(rows, schema)
                        rows, size = [], 0
        yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    @staticmethod
    def _value(column: str, r: Record, payload: bytes | None):
        if column in _HEADERS:
            return r.headers.get(_HEADERS[column])
        if column == "content_length":
            return int(r.headers.get("content-length", 0))
        if column == "http_status":
            return r.http_status
        if column == "http_length":
            return int(r.http_headers["content-length"]) if r.http_headers.get("content-length", "").isdigit() else None
        if column == "headers":
            return list(r.headers.items())
        if payload is None:
            return None
        return sha1_base32(payload) if column == "computed_digest" else len(payload) if column == "payload_bytes" else payload


class WarcDataSource(DataSource):
    """``spark.read.format("warc").schema(some of the columns).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)


def read_warc(spark, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records of an archive or of all archives under a folder and its subfolders, with some or all of the columns. An
    empty folder gives no rows; a path where nothing is, and a torn archive, raise an error. Predicates reach the reader
    through the session's ``spark.sql.python.filterPushdown.enabled``, which this turns on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    kinds = dict(x.strip().split(" ", 1) for x in _SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(folder)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) as the written archives give them back.

    Responses have the length and digest of the payload that was read, revisits what their heads say of it. Rows
    without an id come back without one.
    """
    spark = pages.sparkSession
    folder, _ = write_pages(pages, None, 0, id_col, url_col, html_col)
    kind = dict(pages.select(id_col).dtypes)[id_col]
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    page_id = lambda c: F.when(page(c) != "", page(c)).cast(kind)
    responses = read_warc(spark, folder, ["warc_type", "record_id", "payload_bytes", "computed_digest"]).where("warc_type = 'response'")
    responses = responses.select(page_id("record_id").alias(id_col), "payload_bytes", F.col("computed_digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    revisits = read_warc(spark, folder, ["warc_type", "record_id", "http_length", "payload_digest", "refers_to"]).where("warc_type = 'revisit'")
    revisits = revisits.select(page_id("record_id").alias(id_col), F.col("http_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("warc_type").alias("record_type"), page_id("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)
