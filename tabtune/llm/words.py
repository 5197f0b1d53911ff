"""Words of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09 to
0x0D).  All hashes are fixed functions of the bytes: equal on every executor
and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are taken together up to this many bytes; longer ones come alone and
#: are scanned in blocks of this size, cut at white space.
PART_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
#: Odd multipliers of the two polynomial hashes.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n``."""
    have = _pow.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 4 * PART_BYTES:
            _pow[base] = have
    return have


def spans_hash(values: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of each ``values[first:end]`` (first < end) from prefix sums."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * _GOLD)


def grams_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = values[:n].copy()
    for i in range(1, k):
        out *= np.uint64(BASES[0])
        out += values[i:i + n]
    return mix(out)


@dataclass
class Part:
    """Some whole texts of a column: rows ``row`` to ``row + rows``."""

    row: int
    rows: int
    data: np.ndarray      # bytes of the texts
    offs: np.ndarray      # where each text starts in data, and the end
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    doc: np.ndarray       # text of each word, counted from row
    hash: np.ndarray      # hash of each word

    def words_of(self) -> np.ndarray:
        """Words before each text, and the number of all."""
        return np.searchsorted(self.doc, np.arange(self.rows + 1))

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Number of bytes of each text that ``mask`` marks."""
        if self.rows == 1:
            return np.array([np.count_nonzero(mask)])
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=kind)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs.astype(np.int64), data


def _scan(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words; words also end at ``borders``."""
    word = ~SPACE[data]
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    borders = borders[(borders > 0) & (borders < len(data))]
    head[borders] = word[borders]
    tail[borders - 1] = word[borders - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    if not len(start):
        return start, end, np.zeros(0, dtype=np.uint64)
    return start, end, spans_hash(_BYTE[data], start, end, BASES[0])


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of a long text that no word crosses."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + PART_BYTES)
        if to < n:
            gaps = np.flatnonzero(SPACE[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            while not len(gaps) and to < n:      # one word longer than a block
                more = min(n, to + PART_BYTES)
                gaps = np.flatnonzero(SPACE[data[to:more]])
                to = to + int(gaps[0]) + 1 if len(gaps) else more
        yield at, to
        at = to


def parts(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Part]:
    """The words of a text column, some whole texts at a time (null: none)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offs, data = _buffer(column)
    row = 0
    while row < n:
        to = int(np.searchsorted(offs, offs[row] + PART_BYTES, side="right")) - 1
        to = min(n, max(to, row + 1))
        own = offs[row:to + 1] - offs[row]
        text = data[offs[row]:offs[to]]
        if lower:
            text = LOWER[text]
        if len(text) <= PART_BYTES:
            start, end, hashes = _scan(text, own)
        else:
            found = [(s + at, e + at, h) for at, end_ in _blocks(text)
                     for s, e, h in [_scan(text[at:end_], np.zeros(0, np.int64))]]
            start, end, hashes = (np.concatenate(x) for x in zip(*found))
        doc = np.searchsorted(own, start, side="right") - 1
        yield Part(row, to - row, text, own, start, end, doc, hashes)
        row = to
