"""Words of whole Arrow batches in numpy: offsets, 64-bit hashes and five-word shingles.

Everything works on the UTF-8 bytes of a batch. White space is ASCII, and no byte of a longer UTF-8
character is ASCII, so cutting bytes cuts characters correctly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the splitmix64 finisher)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(n: int, seed: int, first: int = 0) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers, from number ``first`` on."""
    base = (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)
    return mix(np.arange(first + 1, first + n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(base)) | _U(1)


_PLACE = stream(64, 1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if len(_PLACE) < n:
        _PLACE = stream(max(n, 2 * len(_PLACE)), 1)
    return _PLACE


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]] if len(at) else data[:0], at - at[0] if len(at) else at


def pieces(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``most`` bytes, or of one row: first row, bytes, row offsets."""
    if not len(column):
        return
    data, at = utf8(column)
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


@dataclass
class Words:
    data: np.ndarray  # the bytes
    rows: np.ndarray  # byte offsets of rows
    start: np.ndarray  # byte where each word starts
    end: np.ndarray  # and ends
    first: np.ndarray  # index of the first word of each row, and the number of words

    @classmethod
    def of(cls, data: np.ndarray, rows: np.ndarray) -> Words:
        inside = ~_SPACE[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = rows[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        opens[edge] = inside[edge]  # a word never runs from one row into the next
        closes[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return cls(data, rows, start, end, np.searchsorted(start, rows))

    def hashes(self, part: int = 1 << 18) -> np.ndarray:
        """A 64-bit hash of each word: multilinear in its bytes, one random factor a place. Words are taken
        some ``part`` bytes at a time, longer ones alone and by slices, so that memory does not grow with
        the text."""
        size = self.end - self.start
        out, row = np.zeros(len(size), _U), 0
        total = np.concatenate(([0], np.cumsum(size)))
        while row < len(size):
            end = max(row + 1, int(np.searchsorted(total, total[row] + part, "right")) - 1)
            if size[row] > part:
                end = row + 1
                for k in range(0, int(size[row]), part):
                    byte = self.data[self.start[row] + k : min(self.start[row] + k + part, self.end[row])]
                    out[row] += (stream(len(byte), 1, k) * (byte.astype(_U) + _U(1))).sum(dtype=_U)
            else:
                n, begin = size[row:end], total[row:end] - total[row]
                place = np.arange(int(n.sum())) - np.repeat(begin, n)
                index = place + np.repeat(self.start[row:end], n)
                term = _places(int(n.max()))[place] * (self.data[index].astype(_U) + _U(1))
                out[row:end] = np.add.reduceat(term, begin)
            row = end
        return mix(out)


_ORDER = stream(64, 2)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, those across rows included."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    total = np.zeros(len(hashes) - n + 1, _U)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _ORDER[k]
    return mix(total)


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct n-word shingles, sorted; all words where there are fewer than n."""
    h = words.hashes()
    w = windows(h, n)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(w[a : b - n + 1])
        elif b > a:
            yield mix((h[a:b] * _ORDER[: b - a]).sum(dtype=_U, keepdims=True))
        else:
            yield np.zeros(0, _U)
