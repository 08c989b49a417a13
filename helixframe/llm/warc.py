"""WARC records in ZIP packages, read by range without extraction (operator 1).

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, WARC records that
are gzipped one by one, and ``indexes/index.cdxj``, one line a record with its offset and length.
A reader parses the end-of-central-directory record, the ZIP64 records where they are needed and the
central directory, finds where a stored member's bytes begin, and reads single records by range.

Packages live in the shared folder.  A task writes under a name of its own and only its
returned rows name it, so a task that is run again leaves at worst an unnamed file.

Equal payloads: the row with the largest page_id is the response, the others are revisit records
that keep the HTTP headers and so the payload's length and digest, but not the payload.

Nulls and edge cases: a null payload is empty; a null url is an empty target URI; rows with
equal payload and equal page_id are all responses if that id is the largest; rows with a null page_id
are responses only if no row with an id has the payload, and their ids come back null; an empty
table gives an empty result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import cut, open_store, scratch_path, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"

# Fixed values of the ZIP format: signatures, and the marks that refer to ZIP64.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

ReadAt = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    header_at: int
    stored: int
    size: int
    crc: int


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzipped WARC record; a revisit holds HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzipped record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


class ZipWriter:
    """Stored members of unknown length, one after another; ZIP64 fields throughout."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.members = sink, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, parts: Iterator[bytes]) -> None:
        start, raw = self.at, name.encode()
        # Bit 3: lengths follow the data; bit 11: the name is UTF-8.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        crc = size = 0
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            self._put(part)
        self._put(b"PK\7\x08" + struct.pack("<IQQ", crc, size, size))
        self.members.append(Member(name, 0, start, size, size, crc))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw, extra = m.name.encode(), struct.pack("<HHQQQ", 1, 24, m.size, m.stored, m.header_at)
            fixed = struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 33, m.crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32)
            self._put(CENTRAL + fixed + raw + extra)
        size, end, n = self.at - start, self.at, len(self.members)
        self._put(EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(EOCD + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def central_directory(read_at: ReadAt, size: int) -> dict[str, Member]:
    """Members by name, from the last bytes of a ZIP file and its central directory."""
    tail_at = max(0, size - 65_557 - 20)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(EOCD)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        more = read_at(where, 56)
        if more[:4] != EOCD64:
            raise ValueError("the ZIP64 end of central directory is not where its locator says")
        n, length, start = struct.unpack_from("<QQQ", more, 32)
    data, at, members = read_at(start, length), 0, {}
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, crc, stored, plain, names, extras, comments, header = struct.unpack_from("<6xH4xIIIHHH8xI", data, at + 4)
        name, extra = data[at + 46 : at + 46 + names].decode(), data[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            tag, width = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL32 else plain
                stored = next(wide) if stored == FULL32 else stored
                header = next(wide) if header == FULL32 else header
            extra = extra[4 + width :]
        members[name] = Member(name, method, header, stored, plain, crc)
        at += 46 + names + extras + comments
    return members


def data_start(read_at: ReadAt, member: Member) -> int:
    """Where a stored member's bytes begin; its local header may be longer than the central entry."""
    head = read_at(member.header_at, 30)
    if head[:4] != LOCAL or member.method != 0:
        raise ValueError(f"{member.name} is not a stored member")
    names, extras = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + names + extras


def read_package(path: str, ids: set[str] | None = None) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of a package, or those with the record ids given, each read by its range."""
    store, name = open_store(path)
    with store.open_input_file(name) as file:
        read_at = lambda at, n: file.read_at(n, at)
        members = central_directory(read_at, file.size())
        base = data_start(read_at, members[ARCHIVE])
        index_at = data_start(read_at, members[INDEX])
        for line in read_at(index_at, members[INDEX].size).splitlines():
            entry = json.loads(line.split(b" ", 2)[2])
            if ids is None or entry["id"] in ids:
                yield parse_record(read_at(base + entry["offset"], entry["length"]))


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    got = record_id[len("<urn:page:") : -1]
    return int(got) if got else None


class _Package:
    """One ZIP file under way: records go to the archive as they come, index lines wait."""

    def __init__(self, folder: str, most: int) -> None:
        self.path, self.most = f"{folder}/{uuid.uuid4().hex}.zip", most
        store, name = open_store(self.path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.sink = store.open_output_stream(name)
        self.lines: list[bytes] = []
        self.at = 0

    def write(self, records: Iterator[tuple[str, str, str, str, bytes]]) -> None:
        """Takes records until the package is full; ``records`` must outlive a loop that is left early."""

        def parts() -> Iterator[bytes]:
            for record_id, url, kind, digest, data in records:
                entry = {"id": record_id, "mime": "warc/revisit" if kind == "revisit" else "text/html", "digest": f"sha1:{digest}", "offset": self.at, "length": len(data)}
                self.lines.append(f"{url.replace(' ', '%20') or '-'} 20260101000000 {json.dumps(entry)}\n".encode())
                self.at += len(data)
                yield data
                if self.at >= self.most:
                    return

        zipped = ZipWriter(self.sink)
        zipped.add(ARCHIVE, parts())
        zipped.add(INDEX, iter([b"".join(self.lines)]))
        zipped.close()
        self.sink.close()


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                page, url, html, first, many = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "first_id", "many"))
                for k in range(batch.num_rows):
                    payload = (html[k].as_py() or "").encode()
                    p, u, f = page[k].as_py(), " ".join((url[k].as_py() or "").split()), first[k].as_py()
                    kind = "revisit" if many[k].as_py() and f is not None and p != f else "response"
                    digest = digest32(payload)
                    yield _id(p), u, kind, digest, record(kind, _id(p), u, payload, digest, _id(f) if kind == "revisit" else None)

        rows = records()
        while (head := next(rows, None)) is not None:
            package = _Package(folder, most)
            # Unlike a generator that delegates to rows, chain does not close them when it is freed.
            package.write(chain([head], rows))
            yield pa.RecordBatch.from_pydict({"path": [package.path], "records": [len(package.lines)]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return run


def write_packages(pages: DataFrame, folder: str | None = None, package_bytes: int | None = None) -> DataFrame:
    """Write a record per row of ``pages`` into packages of about ``package_bytes``; returns ``(path, records)``."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("key"))
    first = rows.groupBy("key").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # Cut, so that the join's sides have exchanges of their own and a hot payload can be split.
    copies = cut(first.where("n > 1").select("key", "first_id"), "warc-copies")
    marked = rows.join(copies.withColumn("many", F.lit(True)), "key", "left").drop("key")
    return cut(marked.mapInArrow(_write(folder, package_bytes or PACKAGE_BYTES), "path string, records long"), "warc-packages")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    )
    for batch in batches:
        for path in batch.column(0).to_pylist():
            out: list[tuple] = []
            size = 0
            for warc, http, payload in read_package(path):
                kind, digest, refers = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:"), None
                if kind == "revisit":
                    refers, length, payload = _page(warc["WARC-Refers-To"]), int(http["Content-Length"]), None
                else:
                    length = len(payload)
                    if digest32(payload) != digest:
                        raise ValueError(f"{path}: the payload of {warc['WARC-Record-ID']} does not have its digest")
                out.append((_page(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], kind, refers, length, digest, payload))
                size += 300 + len(payload or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of the packages in ``packages(path)``; a revisit's payload is null."""
    # Packages are few and large: each task takes some, as many tasks as there are cores a few times over.
    tasks = min(packages.count(), 8 * packages.sparkSession.sparkContext.defaultParallelism)
    spread = packages.select("path").repartition(max(1, tasks))
    return spread.mapInArrow(_read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_packages(write_packages(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
with p as (
  select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as first_id from pages
), h as (
  select page_id, first_id, strlen(html) as payload_bytes, sha1(html) as h from p
)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from h
"""
