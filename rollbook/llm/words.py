"""Words of Arrow string columns as numpy arrays.

A word is a maximal run of characters other than space, tab, line feed, vertical
tab, form feed and carriage return. These six are single bytes in UTF-8 and never
part of another character, so words are found on bytes. Hashes are 64-bit
polynomials over bytes (or over word hashes) with a finalising mix; all arithmetic
is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text worked on at once; keeps the temporary arrays in the cache.
CHUNK_BYTES = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            p[1:] = np.uint64(b & _MASK)
            made.append(np.cumprod(p, dtype=np.uint64))
        have = (made[0], made[1])
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span."""
    up, down = _powers_of(base, len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((values + np.uint64(1)) * up[: len(values)], dtype=np.uint64, out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + length * np.uint64(0xA24BAED4963EE407))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans."""
    return _span_hashes(data.astype(np.uint64), starts, ends, _BYTE_BASE)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, given the hash of each word."""
    return _span_hashes(hashes, starts, ends, _WORD_BASE)


@dataclass
class Words:
    """Words of some texts: byte spans in ``data``, and ``first[i]:first[i + 1]`` of text i."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts_of_words(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words that lie in one text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= size)


def text_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def fields_of(row: pa.StructArray | pa.ChunkedArray, names: list[str]) -> pa.StructArray:
    """The named fields of a struct column, all nullable as declared schemas are."""
    if isinstance(row, pa.ChunkedArray):
        row = row.combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
    at = [row.type.get_field_index(n) for n in names]
    return pa.StructArray.from_arrays([row.field(i) for i in at], fields=[row.type.field(i).with_nullable(True) for i in at])


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, upper_to_lower: bool = False, separator: np.ndarray = SEPARATOR) -> Words:
    """Find the words of every text; ``upper_to_lower`` first turns A-Z into a-z.

    ``separator`` marks the bytes that belong to no word.
    """
    if upper_to_lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~separator[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-2] if len(data) > 1 else inside[:0]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside[:-1] & ~before)
    after = inside[1:].copy()
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside[:-1] & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))
