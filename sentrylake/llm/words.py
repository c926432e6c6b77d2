"""Words of whole texts as 64-bit hashes, a batch at a time.

A word is ``[^\\x20\\x09-\\x0D]+``: the white space of ``bytes.split()``. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACE = np.array([9, 10, 11, 12, 13, 32])
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
_LONG = 64
#: Bytes hashed at a time, so that what a block needs stays in the cache.
_BLOCK = 1 << 19


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about ``limit`` bytes of text each (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def byte_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the order of hashes is unrelated to the words."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _tables() -> dict[bool, np.ndarray]:
    """A number for each byte at each place of a word (tabulation hashing); bytes between words count nothing."""
    table = mix(np.arange(1, _LONG * 256 + 1, dtype=np.uint64) * _BASE).reshape(_LONG, 256)
    table[:, SPACE] = 0
    lower = table.copy()
    lower[:, 65:91] = table[:, 97:123]
    return {False: table.ravel(), True: lower.ravel()}


_TABLES = _tables()
_IS_WORD = np.ones(256, bool)
_IS_WORD[SPACE] = False


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends); a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_places(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and the number of words of each text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begin] = inside[begin]  # a text's first word
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, begin))


def hash_column(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and the number of words of each."""
    data, begin = flat_bytes(column)
    starts, ends, counts = word_places(data, begin)
    return _hash_places(data, starts, ends, lower), counts


def _hash_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out, table, at = np.empty(len(starts), np.uint64), _TABLES[lower], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        lo, hi = int(starts[at]), int(ends[to - 1])
        first = starts[at:to] - lo
        place = np.arange(hi - lo, dtype=np.int32)
        place -= np.repeat(first.astype(np.int32), np.diff(np.r_[first, hi - lo]))
        np.minimum(place, _LONG - 1, out=place)
        place <<= 8
        place |= data[lo:hi]
        out[at:to] = np.add.reduceat(table.take(place), first)
        at = to
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        word = data[starts[i] : ends[i]].tobytes()
        out[i] = xxhash.xxh64_intdigest(word.translate(LOWER) if lower else word)
    return out


def hash_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    return hash_column(pa.array(texts, pa.large_binary()), lower)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring hashes; runs over a text's end are in it too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _BASE + h[j : j + n]
    return mix(out + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
