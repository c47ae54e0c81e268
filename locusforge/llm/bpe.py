"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus is taken by step: the distinct pieces of a step's texts that no earlier step of the task replayed (a bounded
cache has those) are laid out in one array of tokens. An inverted index maps each pair of tokens to the positions where
it stands; merges are taken in rank order and applied at all positions of their pairs, and only the neighbours of a merged pair
enter the index anew. Where a merge brings up one of an earlier rank, the rest of that piece waits until that is done.

Edge cases: null and empty texts have no tokens; a piece of any length costs time near its length; repeated rows get
equal results; strings of special tokens are plain text; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import pretoken, shared
from . import textcore as T

CACHED = 150_000  # pieces in each of two generations
CACHED_BYTES = 64  # of a piece that is kept
_LOADED: dict[tuple[str, str], Encoder] = {}


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.pattern, self.pieces = pattern, regex.compile(pattern)
        self.pairs: dict[int, int] = {}  # pair of tokens, as left << 32 | right -> rank of their union, -1 if there is none
        self.first = np.array([self.ranks.get(bytes([i >> 8, i & 255]), -1) for i in range(1 << 16)])  # the same for two bytes
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def let_go(self) -> None:
        """Forget the pieces and pairs that were met; the tables of the file stay."""
        self.pairs, self.young, self.old = {}, {}, {}

    def rank(self, pair: int) -> int:
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            found = self.pairs[pair] = self.ranks.get(self.bytes_of[pair >> 32] + self.bytes_of[pair & 0xFFFFFFFF], -1)
        return found

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers; no word is empty."""
        if not words:
            return []
        data = b"".join(words)
        edge = np.cumsum([0, *map(len, words)])
        edges, n = edge.tolist(), len(data)
        token = list(map(self.single.__getitem__, data))  # -1: merged away
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours in the word, -1 at its ends
        for i in edges[:-1]:
            left[i] = right[i - 1] = -1
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        ranks = self.first[(raw[:-1] << 8) | raw[1:]]
        ranks[edge[1:-1] - 1] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        cut = np.flatnonzero(np.diff(ranks[at], prepend=-1))
        index: dict[int, list[int]] = {}  # pair of tokens -> positions of its left one
        pairs: dict[int, list[int]] = {}  # merge -> pairs that make it and stand in the index
        known, rank = self.pairs.get, self.rank
        for x in np.split(at, cut[1:]):
            if len(x):
                i = int(x[0])
                pair = token[i] << 32 | token[i + 1]
                index[pair], pairs[int(ranks[i])] = x.tolist(), [pair]
        todo = sorted(pairs)

        def enter(pair: int, new: int, i: int) -> None:
            if pair in index:
                index[pair].append(i)
            else:
                index[pair] = [i]
                if new in pairs:
                    pairs[new].append(pair)
                else:
                    pairs[new] = [pair]
                    heappush(todo, new)

        while todo:
            r = heappop(todo)
            places = [i for pair in pairs.pop(r) for i in index.pop(pair)]
            places.sort()
            wait, until = [], 0  # a merge that brings up an earlier one lets the rest of its word wait for that
            for i in places:
                if i < until:
                    wait.append(i)
                    continue
                a, j = token[i], right[i]
                if a < 0 or j < 0:
                    continue
                pair = a << 32 | token[j]
                if known(pair) != r and rank(pair) != r:
                    continue
                token[i], token[j] = r, -1
                right[i] = k = right[j]
                if k >= 0:
                    left[k] = i
                    pair = r << 32 | token[k]
                    new = known(pair)
                    if new is None:
                        new = rank(pair)
                    if new >= 0:
                        enter(pair, new, i)
                        if new < r:
                            until = edges[bisect_right(edges, i)]
                h = left[i]
                if h >= 0:
                    pair = token[h] << 32 | r
                    new = known(pair)
                    if new is None:
                        new = rank(pair)
                    if new >= 0:
                        enter(pair, new, h)
                        if new < r:
                            until = edges[bisect_right(edges, i)]
            for i in wait:
                if token[i] >= 0 and right[i] >= 0 and rank(pair := token[i] << 32 | token[right[i]]) == r:
                    enter(pair, r, i)
        final = np.array(token)
        stays = final >= 0
        count = np.zeros(n + 1, np.int64)
        np.cumsum(stays, out=count[1:])
        ids = final[stays].astype("<u4").tobytes()
        ends = (4 * count[edge]).tolist()
        return [ids[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text) of UTF-8 texts laid end to end."""
        start, before = self.split(data, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(data))
        first, which = T.distinct_spans(data, start, end)
        young, old, ids, new, raw = self.young, self.old, [], [], data.tobytes()
        words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        for i, word in enumerate(words):
            if (got := young.get(word)) is None:
                if (got := old.get(word)) is not None:
                    young[word] = got
                elif (whole := self.ranks.get(word)) is not None:
                    got = whole.to_bytes(4, "little")
                else:
                    new.append(i)
            ids.append(got)
        for i, got in zip(new, self.replay([words[i] for i in new]), strict=True):
            ids[i] = got
            if len(words[i]) <= CACHED_BYTES:
                young[words[i]] = got
        if len(young) > CACHED:
            self.old, self.young = young, {}
        pool = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        count = size[which]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        out = pool[np.repeat((np.cumsum(size) - size)[which] - total[:-1], count) + np.arange(total[-1])]
        return out, total[before]

    def split(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte of each piece, pieces before each text)."""
        if self.pattern == pretoken.PATTERN:
            return pretoken.pieces(data, off)
        raw, starts, before = data.tobytes(), [], [0]
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            for piece in self.pieces.findall(raw[a:b].decode()):
                starts.append(a)
                a += len(piece.encode())
            before.append(len(starts))
        return np.array(starts, np.int64), np.array(before)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    """Loaded once a worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(path, pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with `ids` also the ids, as little-endian unsigned 32-bit integers."""
    shared.prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def told(bpe: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in shared.steps(batch, "text"):
                found, before = bpe.encode(data, off)
                found = found.astype("<u4", copy=False)
                parts = [found[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                hexed = lambda items: pa.array([hashlib.sha256(x).hexdigest() for x in items], pa.string())
                cols = [rows.column("doc_id"), pa.array(np.diff(before).astype(np.int64)), hexed(x.tobytes() for x in parts), hexed(map(bpe.decode, parts))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.array([x.tobytes() for x in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    @shared.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks, pattern)
        try:
            yield from told(bpe, batches)
        finally:
            bpe.let_go()

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.select("doc_id", shared.text_bytes()).mapInArrow(run, schema)
