"""Web archives in ZIP packages: WARC members and an index, stored, and a reader that never extracts.

Each task writes one package: members of gzipped records, a CDXJ index, and the directory with its ZIP64 parts. The
reader parses the end records and the central directory, finds members and index, and reads records by byte range.

Edge cases: null html is an empty payload; a null url is named by its page; of equal payloads the row with the largest
page_id is the response, the rest are revisits (a null page_id ranks below all; where all are null each is a response);
repeated rows of the largest page_id are all responses; an empty table has no package.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MEMBER_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
#: Fixed values of the ZIP format: signatures and the extra field of 64-bit sizes.
LOCAL, CENTRAL, END, END64, LOCATOR64, EXTRA64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", 1
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Stored members to a forward-only stream, with 64-bit sizes throughout."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, name: str, data: bytes) -> None:
        path, crc, at, n = name.encode(), zlib.crc32(data), self.at, len(data)
        extra = struct.pack("<HHQQ", EXTRA64, 16, n, n)
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, _FULL32, _FULL32, len(path), len(extra)) + path + extra)
        self._write(data)
        self.entries.append((path, crc, n, at))

    def close(self) -> None:
        start = self.at
        for path, crc, n, at in self.entries:
            extra = struct.pack("<HHQQQ", EXTRA64, 24, n, n, at)
            self._write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, _FULL32, _FULL32, len(path), len(extra), 0, 0, 0, 0, _FULL32) + path + extra)
        size, end, count = self.at - start, self.at, len(self.entries)
        self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start))
        self._write(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._write(END + struct.pack("<HHHHIIH", _FULL16, _FULL16, _FULL16, _FULL16, _FULL32, _FULL32, 0))


@dataclass
class Member:
    name: str
    header: int  #: offset of the local header
    size: int
    crc: int


class ZipReader:
    """Members of a package by its directory, and ranges of stored ones."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        tail_at = max(0, size - 65_557)  # the end record and the longest comment
        tail = self.range(tail_at, size - tail_at)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if (_FULL16 == count or _FULL32 in (length, start)) and at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
            (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            end = self.range(end64, 56)
            if end[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        self.members = {m.name: m for m in self._directory(self.range(start, length), count)}

    def range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        raw = self.source.read(n)
        if len(raw) != n:
            raise ValueError("package cut off")
        return raw

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, _, _, crc, packed, size, name, extra, comment = struct.unpack("<HHHIIIHHH", raw[at + 10 : at + 34])
            (header,) = struct.unpack("<I", raw[at + 42 : at + 46])
            path = raw[at + 46 : at + 46 + name].decode()
            more = raw[at + 46 + name : at + 46 + name + extra]
            while len(more) >= 4:
                kind, n = struct.unpack("<HH", more[:4])
                if kind == EXTRA64:
                    values = iter(struct.unpack(f"<{n // 8}Q", more[4 : 4 + n // 8 * 8]))
                    size = next(values) if size == _FULL32 else size
                    packed = next(values) if packed == _FULL32 else packed
                    header = next(values) if header == _FULL32 else header
                more = more[4 + n :]
            if method != 0 or packed != size:
                raise ValueError(f"{path} isn't stored")
            yield Member(path, header, size, crc)
            at += 46 + name + extra + comment

    def start(self, member: Member) -> int:
        head = self.range(member.header, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        name, extra = struct.unpack("<HH", head[26:30])
        return member.header + 30 + name + extra

    def read(self, name: str) -> bytes:
        m = self.members[name]
        return self.range(self.start(m), m.size)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: object) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str) -> bytes:
    """A gzipped record: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe='''!#$&'()*+,/:;=?@[]%''') if url else urn(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a gzipped record; digests are held against what they are of."""
    unpacker = zlib.decompressobj(31)
    data = unpacker.decompress(raw) + unpacker.flush()
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda part: {k.lower(): v for k, _, v in (x.partition(": ") for x in part.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if warc["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or (warc["warc-type"] == "response" and warc["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}"):
        raise ValueError(f"{warc['warc-record-id']}: the digest isn't that of the content")
    return warc, fields(http), payload


def write_package(out, rows: Iterable[tuple[object, str | None, bytes, object]], date: str) -> int:
    """(page_id, url, payload, refers_to) rows into a package; the count of rows."""
    package, index, some, size, member, n = ZipWriter(out), [], [], 0, 0, 0
    for page_id, url, payload, refers_to in rows:
        digest = base32_sha1(payload)
        raw = record(page_id, url, payload, digest, refers_to, date)
        name = f"archive/data-{member:05d}.warc.gz"
        index.append(f"{urn(page_id)[1:-1]} {date} " + json.dumps({"filename": name, "offset": size, "length": len(raw), "digest": f"sha1:{digest}"}))
        some.append(raw)
        size += len(raw)
        n += 1
        if size >= MEMBER_BYTES:
            package.add(name, b"".join(some))
            some, size, member = [], 0, member + 1
    if some:
        package.add(f"archive/data-{member:05d}.warc.gz", b"".join(some))
    package.add("indexes/index.cdxj", "".join(f"{x}\n" for x in index).encode())
    package.close()
    return n


def read_package(source) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Records in the order of the index, by ranges of the stored members."""
    package = ZipReader(source)
    entries = [json.loads(line.split(" ", 2)[2]) for name in sorted(package.members) if name.startswith("indexes/") for line in package.read(name).decode().splitlines()]
    i = 0
    starts: dict[str, int] = {}
    while i < len(entries):
        name, first, j = entries[i]["filename"], entries[i]["offset"], i
        end = first
        while j < len(entries) and entries[j]["filename"] == name and first <= entries[j]["offset"] <= end and (j == i or entries[j]["offset"] + entries[j]["length"] - first <= RANGE_BYTES):
            end = max(end, entries[j]["offset"] + entries[j]["length"])
            j += 1
        if name not in starts:
            starts[name] = package.start(package.members[name])
        raw = package.range(starts[name] + first, end - first)
        for e in entries[i:j]:
            yield parse(raw[e["offset"] - first : e["offset"] - first + e["length"]])
        i = j


def find_records(source, page_id: object) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of a page, by its lines in the index and one range each."""
    package, key, out = ZipReader(source), f"{urn(page_id)[1:-1]} ", []
    for name in sorted(m for m in package.members if m.startswith("indexes/")):
        for line in package.read(name).decode().splitlines():
            if line.startswith(key):
                e = json.loads(line.split(" ", 2)[2])
                out.append(parse(package.range(package.start(package.members[e["filename"]]) + e["offset"], e["length"])))
    return out


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and, for all but the largest page_id of equal payloads of min_bytes, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("path", shared.key_text("page_id"))
    narrow = shared.materialize(keyed.where(F.length("payload") >= min_bytes).select("page_id", "path", "digest"), "payloads")
    last = narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    again = shared.join_spread(narrow, shared.materialize(last, "copies"), "digest").where(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    again = shared.materialize(again.select("path", "digest", F.col("last").alias("refers_to")).distinct(), "revisits")
    first, others = shared.sieve(keyed, again, ["path", "digest"])
    columns = ["page_id", "url", "payload", "refers_to"]
    return first.withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType)).select(*columns).union(others.join(again, ["path", "digest"], "left").select(*columns))


@dataclass
class Packages:
    folder: str
    names: list[str]
    id_type: str

    def read(self, spark: SparkSession) -> DataFrame:
        """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from the packages."""
        schema = f"page_id {self.id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {self.id_type}"
        if not self.names:
            return spark.createDataFrame([], schema)
        folder, names = self.folder, self.names
        whole = self.id_type in ("bigint", "int")
        kind = {"bigint": pa.int64(), "int": pa.int32()}.get(self.id_type, pa.string())

        def page(value: str | None):
            text = value[len("<urn:page:") : -1] if value else "null"
            return None if text == "null" else int(text) if whole else text

        def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = shared.local_path(folder)
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    with fs.open_input_file(f"{root}/{names[i]}") as source:
                        out: list[tuple] = []
                        for warc, http, _ in read_package(source):
                            out.append((page(warc["warc-record-id"]), int(http["content-length"]), warc["warc-payload-digest"][5:], warc["warc-type"], page(warc.get("warc-refers-to"))))
                            if len(out) >= 5000:
                                yield _batch(out, kind)
                                out = []
                        if out:
                            yield _batch(out, kind)

        return spark.range(0, len(names), 1, len(names)).mapInArrow(load, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), kind]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Packages:
    """One package for each task that has rows."""
    spark = pages.sparkSession
    shared.prepare(spark)
    folder = folder or shared.scratch(spark, "archives")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, root = shared.local_path(folder)
        fs.create_dir(root, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"

        def rows() -> Iterator[tuple]:
            for b in chain([first], batches):
                for i in range(b.num_rows):
                    yield tuple(b.column(c)[i].as_py() for c in range(4))

        with fs.open_output_stream(f"{root}/{name}") as out:
            n = write_package(out, rows(), date)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    found = revisits(pages, min_bytes).mapInArrow(write, "name string, n long").collect()  # one row a package
    return Packages(folder, sorted(r.name for r in found), pages.schema["page_id"].dataType.simpleString())


def archive_report(pages: DataFrame) -> DataFrame:
    return write_archives(pages).read(pages.sparkSession)
