"""Words, lines and windows of many texts at once, on UTF-8 bytes in numpy.

A text never shares a word or window with its neighbour in the batch. Hashes are 64 bits wide and depend on
the bytes alone, so that they agree between workers and runs; what must be exact compares keys or bytes besides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

U = np.uint64
SHORT = 16  # bytes of a span up to which its key holds them all
_P = U(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U)  # the low bytes of a word of eight
_WINDOW = np.random.default_rng(20240607).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


SPACE = byte_table(b" \t\n\x0b\x0c\r")
NOT_SPACE = ~SPACE
UPPER = byte_table(bytes(range(65, 91)))
LOWERED = np.arange(256, dtype=np.uint8) + np.where(UPPER, 32, 0).astype(np.uint8)
#: Bytes of words as decontamination sees them after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    start: np.ndarray  #: first byte of each word
    end: np.ndarray
    ptr: np.ndarray  #: words ptr[i]:ptr[i+1] are those of text i
    doc: np.ndarray  #: text of each word


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of the table's bytes within each text."""
    inside = table[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[off < n]] = False
    after[off[off > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    ptr = np.searchsorted(start, off)
    return Words(start, end, ptr, np.repeat(np.arange(len(off) - 1), np.diff(ptr)))


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, head, tail) of each span: its own bytes up to SHORT of them, and a 128-bit digest beyond."""
    n = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    head = eight[start] & _LOW[np.minimum(n, 8)]
    tail = np.where(n > 8, eight[np.maximum(end - 8, 0)], U(0))
    for i in np.flatnonzero(n > SHORT).tolist():
        digest = xxhash.xxh3_128_intdigest(data[start[i] : end[i]].tobytes())
        head[i], tail[i] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
    return n, head, tail


def _folded(n: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return mix(mix(head + n.astype(U) * _P) + tail)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each span."""
    return _folded(*span_keys(data, start, end))


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span of each content, the content of each span); where hashes meet, the keys decide."""
    keys = span_keys(data, start, end)
    _, first, which = np.unique(_folded(*keys), return_index=True, return_inverse=True)
    if all((k == k[first][which]).all() for k in keys):
        return first, which
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of all windows of k words that lie in one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    total = np.full(n, U(k))
    for j in range(k):
        total += h[j : j + n] * _WINDOW[j]
    first = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return first, mix(total[first])


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def covered(first: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in any window that starts at one of `first`."""
    edge = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(first + k, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0
