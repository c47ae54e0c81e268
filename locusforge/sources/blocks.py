"""One compressed file written and read by many tasks: parts joined end to end, gzip in blocks (BGZF) read by ranges of bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

RANGE = 16 << 20  # bytes of a file that one task reads
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # the empty block at the end of BGZF
_KNOWN: dict[tuple[str, str, str], list[tuple[int, int]] | None] = {}


def _opener(path: str):
    """A function, for tasks, that opens the path's file system in pyarrow; null where pyarrow doesn't know it."""

    def filesystem(place: str):
        from pyarrow import fs

        if place.startswith("file:"):
            return fs.LocalFileSystem(), "/" + place[5:].lstrip("/")
        return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)

    try:
        filesystem(path)
    except (pa.ArrowException, OSError, ValueError):
        return None
    return filesystem


def _packer(kind: str):
    """A function, for tasks, from stretches of bytes to compressed ones that may be joined: gz in blocks, bz2 a stream a task, none."""

    def pack(chunks: Iterator[bytes]) -> Iterator[bytes]:
        import bz2
        import struct
        import zlib

        if kind == "gz":
            for chunk in chunks:
                for at in range(0, len(chunk), 65_280):
                    some = chunk[at : at + 65_280]
                    c = zlib.compressobj(1, zlib.DEFLATED, -15)
                    body = c.compress(some) + c.flush()
                    yield b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(some), len(some))
        elif kind == "bz2":
            c, some = bz2.BZ2Compressor(), False
            for chunk in chunks:
                some = True
                yield c.compress(chunk)
            if some:
                yield c.flush()
        else:
            yield from chunks

    return pack


def write_lines(rows: DataFrame, head: list[str], path: str, kind: str = "none") -> None:
    """Head lines and then those in the column `value` as one file: tasks compress their parts, which are copied end to end."""
    spark, pack, filesystem = rows.sparkSession, _packer(kind), _opener(path)
    folder = f"{path}.parts-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def texts() -> Iterator[bytes]:
            for batch in batches:
                if batch.num_rows:
                    # lines lie end to end in the column's buffer
                    column, width = batch.column(0), 8 if pa.types.is_large_string(batch.schema[0].type) else 4
                    at = lambda i, c=column, w=width: int.from_bytes(c.buffers()[1][(c.offset + i) * w : (c.offset + i + 1) * w].to_pybytes(), "little")
                    yield column.buffers()[2][at(0) : at(len(column))].to_pybytes()

        context = TaskContext.get()
        name, size = f"{context.partitionId():08d}-{context.taskAttemptId()}", 0
        fs, where = filesystem(folder)
        fs.create_dir(where)
        with fs.open_output_stream(f"{where}/{name}", compression=None) as out:
            for some in pack(texts()):
                out.write(some)
                size += len(some)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["name", "size"])

    value = F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("value")
    parts = sorted(r.name for r in rows.select(value).mapInArrow(run, "name string, size long").collect() if r.size)  # one row a task
    target, fs = files._hadoop(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(b"".join(pack(iter(["".join(f"{x}\n" for x in head).encode()])))))
        for name in parts:
            part = fs.open(files._hadoop(spark, f"{folder}/{name}")[0])
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 4 << 20, False)
            finally:
                part.close()
        if kind == "gz":
            out.write(bytearray(END))
    finally:
        out.close()
    files.remove(spark, folder)


def _walker():
    """A function, for tasks: bytes of the BGZF block whose head is given, or 0 where it isn't one."""

    def block(head: bytes) -> int:
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return 0
        at, end = 12, 12 + int.from_bytes(head[10:12], "little")
        while at + 6 <= min(end, len(head)):
            if head[at : at + 4] == b"BC\x02\0":
                return int.from_bytes(head[at + 4 : at + 6], "little") + 1
            at += 4 + int.from_bytes(head[at + 2 : at + 4], "little")
        return 0

    return block


def ranges(spark: SparkSession, path: str) -> list[tuple[int, int]] | None:
    """(first byte, end) of stretches of whole blocks, if the file is BGZF throughout; null if it isn't.

    A task a stretch finds a block that inflates and steps from there to the first one that starts in the next stretch. The
    stretches have to meet, so that neither a chance likeness of a head nor another kind of member goes unseen.
    """
    filesystem, block = _opener(path), _walker()
    if filesystem is None or not files.is_file(spark, path):
        return None
    key = (spark.sparkContext.applicationId, path, files.stamp(spark, path))
    if key in _KNOWN:
        return _KNOWN[key]
    where, fs = files._hadoop(spark, path)
    stream = fs.open(where)
    try:
        first = bytes(stream.readNBytes(64))
    finally:
        stream.close()
    size = fs.getFileStatus(where).getLen()
    step, _KNOWN[key] = RANGE, None
    if not block(first):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high = i * step, min(size, (i + 1) * step)
                system, place = filesystem(path)
                with system.open_input_file(place) as f:
                    start = low
                    if i:
                        near, start = f.read_at(min(size - low, 1 << 18), low), -1
                        at = near.find(b"\x1f\x8b\x08\x04")
                        while at >= 0:
                            n = block(near[at : at + 64])
                            if n and at + n <= len(near):
                                try:
                                    zlib.decompress(near[at : at + n], 31)  # checks its sum
                                    start = low + at
                                    break
                                except zlib.error:
                                    pass
                            at = near.find(b"\x1f\x8b\x08\x04", at + 1)
                    at = start
                    while 0 <= at < high:
                        n = block(f.read_at(64, at))
                        at = at + n if n else -1
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([start], pa.int64()), pa.array([at], pa.int64())], ["i", "start", "end"])

    n = -(-size // step)
    found = sorted(tuple(r) for r in spark.range(0, n, 1, n).mapInArrow(run, "i long, start long, end long").collect())  # one row a stretch
    # blocks are smaller than a stretch: each has a start, but for the last, which the one before may reach over
    found = [(start, end) for i, start, end in found if i < n - 1 or start >= 0]
    whole = found and found[0][0] == 0 and found[-1][1] == size and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    _KNOWN[key] = [(s, e) for s, e in found if s < e] if whole else None
    return _KNOWN[key]


def read_lines(spark: SparkSession, path: str, stretches: list[tuple[int, int]]) -> DataFrame:
    """(line_no, value) of a BGZF file, a task a stretch: from behind its first line's end to the first line's end behind it."""
    filesystem, block, size = _opener(path), _walker(), stretches[-1][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        def inflated(f, low: int, high: int, step: int = 4 << 20) -> Iterator[bytes]:
            at = low
            while at < high:
                held = f.read_at(min(step, size - at), at)
                used, out = 0, []
                while at + used < high and (n := block(held[used : used + 64])) and used + n <= len(held):
                    out.append(zlib.decompress(held[used : used + n], 31))
                    used += n
                if not used:
                    raise ValueError(f"{path} changed while it was read")
                yield b"".join(out)
                at += used

        def shown(i: int, at: int, data: bytes) -> pa.RecordBatch:
            text = data.decode("utf-8", "replace")
            if "\r" in text:
                text = text.removesuffix("\r").replace("\r\n", "\n").replace("\r", "\n")
            some = text.split("\n")
            return pa.RecordBatch.from_arrays([pa.array(range((i << 33) + at, (i << 33) + at + len(some)), pa.int64()), pa.array(some, pa.string())], ["line_no", "value"])

        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high = stretches[i]
                system, place = filesystem(path)
                with system.open_input_file(place) as f:
                    rest, at, inside = b"", 0, i == 0
                    for data in inflated(f, low, high):
                        if not inside:
                            cut = data.find(b"\n")
                            if cut < 0:
                                continue
                            data, inside = data[cut + 1 :], True
                        cut = data.rfind(b"\n")
                        if cut < 0:
                            rest += data
                            continue
                        out = shown(i, at, rest + data[:cut])
                        at, rest = at + out.num_rows, data[cut + 1 :]
                        yield out
                    if inside:  # the line that begins here may end behind
                        tail = [rest]
                        for data in inflated(f, high, size, 1 << 17):
                            tail.append(data[: data.find(b"\n") + 1] or data)
                            if b"\n" in data:
                                break
                        if tail := b"".join(tail):
                            yield shown(i, at, tail.removesuffix(b"\n"))

    return spark.range(0, len(stretches), 1, len(stretches)).mapInArrow(run, "line_no long, value string")
