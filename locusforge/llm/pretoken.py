"""The byte-level splitter of many texts at once: token pieces as byte spans, found in numpy.

The splitter's pattern takes contractions, then letters, digits or other marks with one blank before, then white space
short of its last character where something follows. All of that shows in where runs of one class begin, so that pieces
come from boundaries of runs. It holds for this one pattern alone.
"""

from __future__ import annotations

import numpy as np
import regex

#: Fixed value: the pattern that this module stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0
_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point; made once a process."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[points[m.start() : m.end()]] = kind
        _TABLE.append(table)
    return _TABLE[0]


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each piece, pieces before each text) of UTF-8 texts laid end to end; a piece ends where the next starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(point)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    doc = np.searchsorted(at, off)  # first code point of each text
    kind = classes()[point]
    opens = np.zeros(n + 1, bool)  # a text begins
    opens[doc] = True
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin |= opens[:n]
    run = np.flatnonzero(begin)
    end = np.append(run[1:], n)
    what = kind[run]
    blank = np.zeros(n + 1, bool)
    blank[1:] = (point == 32) & ~opens[1:]  # a blank right before, in the same text
    # what isn't white space starts with the blank before it
    solid = run[what != SPACE]
    starts = np.zeros(n + 1, bool)
    starts[solid - blank[solid]] = True
    # contractions: a lone apostrophe without a blank, and letters that make one
    lone = run[(what == OTHER) & (end - run == 1)]
    lone = lone[(point[lone] == 39) & ~blank[lone]]
    lone = lone[(lone + 1 < n)]
    lone = lone[~opens[lone + 1]]
    if len(lone):
        one = point[lone + 1]
        third = lone + 2
        two = np.where((third < n) & ~opens[np.minimum(third, n)], point[np.minimum(third, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | ((one == ord("l")) & (two == ord("l")))
        for which, size in ((lone[short], 2), (lone[long & ~short], 3)):
            starts[which + 1] = False
            after = which + size
            inside = after[(after < n)]
            inside = inside[~opens[inside]]
            more = inside[(kind[inside] == LETTER)]
            starts[more] = True
    # white space: all of it at the end of a text, else all but the last, which stands alone unless it is a blank
    first, last = run[what == SPACE], end[what == SPACE] - 1
    starts[first[(last > first) | opens[last + 1] | (last + 1 == n)]] = True
    alone = last[~opens[last + 1] & (last + 1 < n) & (point[last] != 32)]
    starts[alone] = True
    found = np.flatnonzero(starts[:n])
    return at[found], np.searchsorted(found, doc)
