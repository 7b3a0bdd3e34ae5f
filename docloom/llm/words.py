"""Words of many texts at once, as byte ranges of an Arrow string column.

A UTF-8 byte of 0x80 or more never belongs to an ASCII character, so word classes that
treat all non-ASCII characters alike can be decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def byte_class(pattern: str) -> np.ndarray:
    """For each byte, whether its character is in the class; ``pattern`` is tried on ASCII only."""
    import re

    ascii_part = [bool(re.fullmatch(pattern, chr(b))) for b in range(128)]
    return np.array(ascii_part + [True] * 128)


#: The word classes.
NOT_SPACE = byte_class(r"[^\x20\x09-\x0D]")
LETTER_DIGIT = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = pa.array([], pa.large_binary()) if not len(column) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text has a range of its own."""
    lengths = np.diff(string_bytes(column)[1])
    begin, held = 0, 0
    for row, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield begin, row
            begin, held = row, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


@dataclass
class Words:
    """Words in order: byte range, and for each row the number of its first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()


def split_words(column: pa.Array, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of the class ``inside``, after A-Z became lower case."""
    data, offsets = string_bytes(column)
    data = LOWER[data]
    mask = inside[data]
    before = np.zeros(len(mask), bool)
    before[1:] = mask[:-1]
    begins = offsets[:-1]
    before[begins[begins < len(mask)]] = False
    after = np.zeros(len(mask), bool)
    after[:-1] = mask[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(int(_ODD), -1, 1 << 64)
        tables = []
        for base in (int(_ODD), inverse):
            table = np.ones(n, np.uint64)
            table[1:] = np.uint64(base)
            tables.append(np.multiply.accumulate(table))
        _powers = tables[0], tables[1]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=sums[1:])
    own = (sums[end] - sums[start]) * inverse[start]
    return mixed(own + (end - start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values; the caller drops those that cross rows."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mixed(total + hashes[k : k + n] + np.uint64(k + 1))
    return total
