"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow string columns.  Everything here works on their UTF-8
bytes: the separators ``[\\x20\\x09-\\x0D]`` and the letters A-Z are single
bytes that never occur inside a multi-byte character, so word boundaries,
ASCII lower-casing and code point counts are exact on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Ranges longer than this many bytes are hashed one by one.
_LONG = 256


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Chunk:
    """Some whole texts laid end to end as bytes (null texts count as empty)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def lower(self) -> "Chunk":
        return Chunk(_LOWER[self.data], self.offsets, self.first)

    def range_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, equal for equal bytes wherever they stand.

        Every 8 bytes go through the finaliser before the next 8 join, so
        ranges of up to 8 bytes and equal length never collide, and longer ones
        don't by their structure (sums of powers modulo 2**64 would).
        """
        size = ends - starts
        h = mix(size.astype(np.uint64), 4)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        wide = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        live, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
        while len(live):
            left = size[live] - at
            block = wide[starts[live] + at]
            last = left < 8
            block[last] &= (np.uint64(1) << (8 * left[last]).astype(np.uint64)) - np.uint64(1)
            h[live] = mix(h[live] ^ block, 5)
            live, at = live[left > 8], at + 8
        for i in np.flatnonzero(size > _LONG).tolist():
            h[i] = int.from_bytes(blake2b(self.data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return h

    def words(self, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and per text the index of its first word (n + 1 entries).

        ``breaks`` marks the ASCII bytes between words: white space, if not given."""
        if not len(self.data):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.n + 1, dtype=np.int64)
        solid = ~breaks[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty_like(solid)
        before[0] = True
        np.logical_not(solid[:-1], out=before[1:])
        starts = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.empty_like(solid)
        after[-1] = True
        np.logical_not(solid[1:], out=after[:-1])
        ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into runs of whole texts of about ``limit`` bytes (or one longer text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), len(column))
        own = offsets[at : stop + 1]
        yield Chunk(raw[own[0] : own[-1]], own - own[0], at)
        at = stop
