"""Benchmark decontamination: a broadcast hash set of test n-grams against windows of training words.

Words of documents and items are hashed; a window whose hash is in the set is held against the words themselves, and
confirmed windows mark their words. Items with fewer words than a window are windows of their own length. Tasks build the set in
blocks of a bounded size. One block is broadcast; more of them lie in the shared folder, where a worker holds the documents of
some 64 MB against one block at a time, so that a larger benchmark takes longer but no more memory.

Edge cases: null and empty texts have no words; items without words or without an id are left out; items that
repeat are found together; an item of any length is dealt over blocks; ties don't arise; repeated documents get equal rows; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textcore as T

WINDOW = 10
BLOCK_WINDOWS = 200_000  # windows of a block: some 40 MB with their words
HELD_BYTES = 64 << 20  # of documents that several blocks are read for


class Block:
    """Windows of some items: by length, sorted hashes with the words and items that each stands for."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        found: dict[int, dict[int, dict[tuple[bytes, ...], set[str]]]] = {}
        for item, text in items:
            data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64)
            data = T.LOWERED[data]
            w = T.words(data, off, T.ALNUM)
            k = min(n, len(w.start))
            if not k:
                continue
            raw = data.tobytes()
            said = [raw[s:e] for s, e in zip(w.start, w.end, strict=True)]
            first, hashes = T.windows(T.span_hashes(data, w.start, w.end), w.doc, k)
            for i, h in zip(first.tolist(), hashes.tolist(), strict=True):
                found.setdefault(k, {}).setdefault(h, {}).setdefault(tuple(said[i : i + k]), set()).add(item)
        self.windows = {k: (np.array(sorted(by), T.U), by) for k, by in found.items()}


def scan(data: np.ndarray, off: np.ndarray, blocks: list[Block], n: int = WINDOW) -> tuple[np.ndarray, np.ndarray, list[set[str]], T.Words]:
    """(words of each text, which words are hit, items of each text, the words) of lower-cased texts."""
    w = T.words(data, off, T.ALNUM)
    hashes = T.span_hashes(data, w.start, w.end)
    hit, items = np.zeros(len(w.start), bool), [set() for _ in range(len(off) - 1)]
    for k in sorted({k for b in blocks for k in b.windows}):
        first, window = T.windows(hashes, w.doc, k)
        for block in blocks:
            if k not in block.windows or not len(window):
                continue
            known, by = block.windows[k]
            at = np.minimum(np.searchsorted(known, window), len(known) - 1)
            maybe = np.flatnonzero(known[at] == window)
            sure = []
            for j in maybe.tolist():
                i = int(first[j])
                said = tuple(data[w.start[m] : w.end[m]].tobytes() for m in range(i, i + k))
                if got := by[int(window[j])].get(said):
                    sure.append(i)
                    items[w.doc[i]] |= got
            hit |= T.covered(np.array(sure, np.int64), k, len(hit))
    return np.diff(w.ptr), hit, items, w


def parts(item: str, text: bytes, n: int, most: int) -> Iterator[tuple[str, bytes, int]]:
    """(item, text, windows) of an item, in parts that share n - 1 words and have all its windows."""
    data = np.frombuffer(text, np.uint8)
    w = T.words(T.LOWERED[data], np.array([0, len(text)], np.int64), T.ALNUM)
    count = max(1, len(w.start) - n + 1) if len(w.start) else 0
    for i in range(0, count, most):
        last = min(len(w.start), i + min(most, count - i) + n - 1)
        yield item, text[w.start[i] : w.end[last - 1]], min(most, count - i)


def _blocks(benchmark: DataFrame, n: int) -> list[str]:
    """Paths of the blocks that the benchmark's items make."""
    spark = benchmark.sparkSession
    folder, most = shared.scratch(spark, "benchmark"), BLOCK_WINDOWS
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), shared.text_bytes()).distinct()
    size = rows.agg(F.sum(1 + F.octet_length("text") / 6)).first()[0] or 0

    @shared.lean
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0

        def store() -> pa.RecordBatch:
            fs, root = shared.local_path(folder)
            fs.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.block"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(pickle.dumps(Block(some, n)))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text"), strict=True):
                for name, part, windows in parts(item.as_py(), text.as_py(), n, most):
                    some.append((name, part))
                    held += windows
                    if held >= most:
                        yield store()
                        some, held = [], 0
        if some:
            yield store()

    found = rows.repartition(max(1, math.ceil(size / most))).mapInArrow(build, "name string").collect()  # one row a block
    return [f"{folder}/{r.name}" for r in found]


def load_block(path: str) -> Block:
    fs, name = shared.local_path(path)
    with fs.open_input_file(name) as source:
        return pickle.loads(source.read())


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `carry`, n_words, n_hit, n_items, items_sha256, contaminated; with `spans` also the text and the hit spans (bytes)."""
    spark = docs.sparkSession
    shared.prepare(spark)
    blocks = _blocks(benchmark, n)
    alone = spark.sparkContext.broadcast(load_block(blocks[0])) if len(blocks) == 1 else None  # BLOCK_WINDOWS at most, or little more
    keys = ["doc_id", *carry]
    fields = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def against(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        marks: list[tuple[np.ndarray, list[set[str]]] | None] = [None] * len(held)
        for path in blocks or [None]:
            block = [] if path is None else [alone.value if alone else load_block(path)]
            for i, (_, data, off) in enumerate(held):
                _, now, got, _ = scan(data, off, block, n)
                hit, items = marks[i] or (now, got)
                marks[i] = hit | now, [x | y for x, y in zip(items, got, strict=True)]
        for (rows, data, off), (hit, items) in zip(held, marks, strict=True):
            w = T.words(data, off, T.ALNUM)
            n_words = np.diff(w.ptr)
            n_hit = T.sums(hit, w.ptr)
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            cols = [*(rows.column(k) for k in keys), pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0)]
            names = [*keys, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if spans:
                edges = []
                for i in range(len(off) - 1):
                    a, z = w.ptr[i], w.ptr[i + 1]
                    at = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:z].view(np.int8), [0]])))
                    edges.append([{"start": int(w.start[a + s] - off[i]), "end": int(w.end[a + e - 1] - off[i])} for s, e in zip(at[::2], at[1::2], strict=True)])
                cols.append(pa.array(edges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                names.append("hits")
            yield pa.RecordBatch.from_arrays(cols, names)

    @shared.lean
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows, data, off in shared.steps(batch, "text"):
                held.append((rows, T.LOWERED[data], off))
                size += len(data)
                if len(blocks) < 2 or size >= HELD_BYTES:
                    yield from against(held)
                    held, size = [], 0
        yield from against(held)

    schema = f"{fields}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if spans:
        schema += ", hits array<struct<start:int,end:int>>"
    return docs.select(*keys, shared.text_bytes()).mapInArrow(look, schema)
