"""Token ids in files of Simple-8b words.

A file holds blocks and a footer. A block packs up to BLOCK_IDS ids into 64-bit words: the top four bits select how many
ids of how many bits the other sixty hold, so that all words of one selector decode at once. Ids beyond 60 bits are
escapes, kept whole beside their positions. The footer has the offset, ids and escapes of each block and the id and
length of each document. Files are written by range of doc_id; the manifest adds where each file's ids start.

Edge cases: null and empty texts are the end id alone; an empty table has no file; null ids come first and repeated rows
follow each other in an order of their own; a task that is run again writes a file of another name.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import pretoken, shared
from . import textcore as T

MAGIC = b"LFTOK8B1"
BLOCK_IDS = 1 << 16
#: (ids in a word, bits of each) by selector; fixed values of the Simple-8b layout, the first two being runs of zeros.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([c for c, _ in SELECTORS], np.int64)
_U = np.uint64


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, positions of escapes, their values) of unsigned integers."""
    ids = np.asarray(ids, _U)
    n = len(ids)
    away = np.flatnonzero(ids >> _U(60))
    escaped = ids[away]
    if len(away):
        ids = ids.copy()
        ids[away] = 0
    choice = np.full(n, len(SELECTORS) - 1, np.int8)
    open_ = np.arange(n, dtype=np.int32)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        wide = np.where(ids >> _U(bits) if bits else ids, open_, n + 240).astype(np.int32)  # past the end all fits
        after = np.minimum.accumulate(wide[::-1])[::-1]  # the next id that is too wide
        fits = after - open_ >= count
        if not fits.any():
            break  # what more ids of fewer bits need can't be met either
        choice[fits] = s
    steps, take, at, i = _COUNT[choice].tolist(), [], 0, 0
    while i < n:
        take.append(i)
        i += steps[i]
    first = np.array(take, np.int64)
    picked = choice[first] if n else np.zeros(0, np.int8)
    words = picked.astype(_U) << _U(60)
    padded = np.concatenate([ids, np.zeros(240, _U)])
    for s, (count, bits) in enumerate(SELECTORS):
        at = np.flatnonzero(picked == s)
        if len(at) and bits:
            part = padded[first[at][:, None] + np.arange(count)] << (np.arange(count, dtype=_U) * _U(bits))
            words[at] |= np.bitwise_or.reduce(part, axis=1)
    return words, away.astype(np.uint32), escaped


def unpack(words: np.ndarray, n: int, away: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The n unsigned integers that pack() was given."""
    selector = (words >> _U(60)).astype(np.int64)
    counts = _COUNT[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, _U)
    starts = ends - counts
    for s, (count, bits) in enumerate(SELECTORS):
        at = np.flatnonzero(selector == s)
        if len(at) and bits:
            places = np.arange(count)
            values = (words[at][:, None] >> (places.astype(_U) * _U(bits))) & _U((1 << bits) - 1)
            out[starts[at][:, None] + places] = values
    out = out[:n]
    out[away] = escaped
    return out


class Writer:
    """Documents in order to a binary stream; blocks are written as they fill."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        out.write(MAGIC)
        self.blocks: list[list[int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        i = 0
        while len(ids) - i >= BLOCK_IDS or (last and i < len(ids)):
            part = ids[i : i + BLOCK_IDS]
            words, away, escaped = pack(part)
            raw = words.astype("<u8").tobytes() + away.astype("<u4").tobytes() + escaped.astype("<u8").tobytes()
            self.out.write(raw)
            self.blocks.append([self.at, len(part), len(words), len(away)])
            self.at += len(raw)
            i += len(part)
        self.waiting = [ids[i:]]
        self.held = len(ids) - i

    def close(self, docs: pa.Table) -> None:
        """docs: doc_id and n_tokens of each document, in order."""
        self._flush(True)
        head = json.dumps({"blocks": self.blocks}).encode()
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_table(docs)
        table = sink.getvalue()
        self.out.write(head + table + struct.pack("<QQ", len(head), len(table)) + MAGIC)


def read_file(source) -> tuple[pa.Table, Iterator[np.ndarray]]:
    """(documents, ids block by block) of a seekable file."""
    source.seek(0, 2)
    end = source.tell() - 24
    source.seek(end)
    tail = source.read(24)
    if tail[16:] != MAGIC:
        raise ValueError("not a token file, or cut off")
    head, table = struct.unpack("<QQ", tail[:16])
    source.seek(end - head - table)
    blocks = json.loads(source.read(head))["blocks"]
    docs = pa.ipc.open_stream(source.read(table)).read_all()

    def ids() -> Iterator[np.ndarray]:
        for at, n, words, escapes in blocks:
            source.seek(at)
            raw = source.read(8 * words + 12 * escapes)
            yield unpack(np.frombuffer(raw, "<u8", words), n, np.frombuffer(raw, "<u4", escapes, 8 * words), np.frombuffer(raw[8 * words + 4 * escapes :], "<u8"))

    return docs, ids()


CACHED = 250_000  # pieces in each of two generations
CACHED_BYTES = 64  # of a piece that is kept
_LOADED: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """The tokenizers library, asked once for each distinct piece that its byte-level splitter makes.

    A piece's ids don't depend on what is around it. Texts that hold a special
    token's string, and tokenizers with another splitter, go through the library whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = pattern == pretoken.PATTERN
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        """Ids of each piece, by one call for all."""
        found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        count = np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts))
        ends = (4 * np.cumsum(count)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text) of UTF-8 texts laid end to end."""
        raw = data.tobytes()
        if not self.known or any(s in raw for s in self.special):
            parts = []
            for i in range(len(off) - 1):
                one = raw[off[i] : off[i + 1]]
                if not self.known or any(s in one for s in self.special):
                    parts.append(self.whole(one))
                else:
                    parts.append(self._plain(data[off[i] : off[i + 1]], np.array([0, len(one)]))[0])
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
        return self._plain(data, off)

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, before = pretoken.pieces(data, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(data))
        first, which = T.distinct_spans(data, start, end)
        young, old, ids, new, raw = self.young, self.old, [], [], data.tobytes()
        words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        for i, word in enumerate(words):
            if (got := young.get(word)) is None and (got := old.get(word)) is not None:
                young[word] = got
            if got is None:
                new.append(i)
            ids.append(got)
        if new:
            for i, got in zip(new, self._each([words[i].decode() for i in new]), strict=True):
                ids[i] = got
                if len(words[i]) <= CACHED_BYTES:
                    young[words[i]] = got
        if len(young) > CACHED:
            self.old, self.young = young, {}
        pool = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = np.cumsum(size) - size
        count = size[which]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        out = pool[np.repeat(place[which] - total[:-1], count) + np.arange(total[-1])]
        return out, total[before]


def piece_encoder(path: str, pattern: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path, pattern)
    return _LOADED[path]


@dataclass
class TokenFiles:
    """Files in order, as (name, documents, ids, ids before it)."""

    folder: str
    files: list[tuple[str, int, int, int]]
    id_type: str

    def read(self, spark: SparkSession) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
        return self._documents(spark, False)

    def read_ids(self, spark: SparkSession) -> DataFrame:
        """The same with `ids`, as little-endian unsigned 32-bit integers."""
        return self._documents(spark, True)

    def _documents(self, spark: SparkSession, with_ids: bool) -> DataFrame:
        schema = f"doc_id {self.id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
        if not self.files:
            return spark.createDataFrame([], schema)
        folder, files = self.folder, self.files

        def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = shared.local_path(folder)
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    name, _, _, before = files[i]
                    with fs.open_input_file(f"{root}/{name}") as source:
                        yield from documents(source, before, with_ids)

        return spark.range(0, len(files), 1, len(files)).mapInArrow(load, schema)


def documents(source, before: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    docs, blocks = read_file(source)
    lengths = docs.column("n_tokens").to_numpy()
    starts = before + np.cumsum(lengths) - lengths
    keep, crc, kept_ids, i, left = 0, [], [], 0, None
    part: list[bytes] = []
    from_row = 0
    need = int(lengths[0]) if len(lengths) else 0
    sum_ = 0
    for ids in blocks:
        raw = memoryview(ids.astype("<u4").tobytes())
        at = 0
        while at < len(raw):
            take = min(4 * need, len(raw) - at)
            sum_ = zlib.crc32(raw[at : at + take], sum_)
            if with_ids:
                part.append(bytes(raw[at : at + take]))
            at += take
            need -= take // 4
            if need == 0:
                crc.append(sum_)
                if with_ids:
                    kept_ids.append(b"".join(part))
                    part = []
                i, sum_ = i + 1, 0
                need = int(lengths[i]) if i < len(lengths) else 0
        if i > from_row:
            yield _rows(docs, starts, lengths, crc, kept_ids, from_row, i, with_ids)
            from_row, crc, kept_ids = i, [], []
    if i != len(lengths):
        raise ValueError("the file ends before its documents do")


def _rows(docs, starts, lengths, crc, ids, a, b, with_ids) -> pa.RecordBatch:
    column = docs.column("doc_id").slice(a, b - a).combine_chunks()
    cols = [column, pa.array(starts[a:b]), pa.array(lengths[a:b]), pa.array(crc, pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        cols.append(pa.array(ids, pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names)


def write_tokens(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, folder: str | None = None) -> TokenFiles:
    """Encode all texts in ascending order of doc_id into files of the shared folder."""
    spark = docs.sparkSession
    shared.prepare(spark)
    folder = folder or shared.scratch(spark, "tokens")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, ids_of, sizes, encode = None, [], [], piece_encoder(tokenizer, pattern).encode
        out = None
        for batch in batches:
            for rows, data, off in shared.steps(batch, "text", 4 << 20):
                if writer is None:
                    fs, root = shared.local_path(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok8b"
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer = Writer(out)
                ids, before = encode(data, off)
                writer.add(np.insert(ids, before[1:], end_id))
                sizes.append(np.diff(before) + 1)
                ids_of.append(rows.column("doc_id"))
        if writer is not None:
            sizes = np.concatenate(sizes)
            writer.close(pa.table({"doc_id": pa.chunked_array(ids_of), "n_tokens": pa.array(sizes, pa.int64())}))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([len(sizes)], pa.int64()), pa.array([writer.total], pa.int64())], ["part", "name", "docs", "ids"])

    ordered = docs.select("doc_id", shared.text_bytes()).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = sorted(map(tuple, ordered.mapInArrow(write, "part long, name string, docs long, ids long").collect()))  # one row a file
    files, before = [], 0
    for _, name, n, ids in rows:
        files.append((name, n, ids, before))
        before += ids
    return TokenFiles(folder, files, id_type)


def token_file_report(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0) -> DataFrame:
    return write_tokens(docs, tokenizer, pattern, end_id).read(docs.sparkSession)
