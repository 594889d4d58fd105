"""Words, lines and their hashes of whole text columns, by array operations on the UTF-8 bytes.

Separators are ASCII, so a text can be cut without decoding it. A batch is worked on in slices of
whole texts of about ``SLICE`` bytes (one longer text is a slice of its own), which bounds memory
by the longest text rather than by the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
#: Longer words and lines are hashed by ``hashlib``.
TABLE = 4096
_RANDOM = np.random.default_rng(20260101).integers(0, 1 << 63, TABLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: A to Z as a to z.
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
SAME = np.arange(256, dtype=np.uint64)


@dataclass
class Slice:
    """Consecutive texts of a batch: rows ``first`` to ``first + len(offsets) - 1`` and their bytes."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Pieces:
    """Maximal runs without separator: text index, byte range and 64-bit hash of each."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def slices(texts: pa.Array) -> Iterator[Slice]:
    """Null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        begin, end = int(offsets[first]), int(offsets[last])
        yield Slice(first, offsets[first : last + 1] - begin, data[begin:end])
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pieces(part: Slice, separator: np.ndarray, letters: np.ndarray = SAME) -> Pieces:
    """Cut every text at ``separator``; ``letters`` maps bytes before they are hashed."""
    data, offsets = part.data, part.offsets
    none = np.zeros(0, np.int64)
    if not len(data):
        return Pieces(none, none, none, np.zeros(0, np.uint64))
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    if not len(start):
        return Pieces(none, none, none, np.zeros(0, np.uint64))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    values = letters + np.uint64(1)
    values[separator] = 0
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(data)]))
    np.minimum(place, TABLE - 1, out=place)
    found = mix(np.add.reduceat(values[data] * _RANDOM[place], start))
    for i in np.flatnonzero(end - start > TABLE):
        whole = letters[data[start[i] : end[i]]].astype(np.uint8).tobytes()
        found[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
    return Pieces(np.searchsorted(offsets, start, side="right") - 1, start, end, found)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes, in order; empty when there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total += words[i : i + count] * _RANDOM[i]
    return mix(total)


def bounds(pieces_: Pieces, n: int) -> np.ndarray:
    """Where the pieces of text 0, 1, ... begin, and the end: ``n + 1`` positions."""
    return np.searchsorted(pieces_.text, np.arange(n + 1))
