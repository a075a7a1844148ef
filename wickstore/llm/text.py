"""Words, shingles and byte tables over Arrow string columns; everything here runs inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
SLICE_BYTES = 8 << 20
#: For work that needs many times the bytes of its text.
SMALL_SLICE_BYTES = 2 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_table(lower: bool = True, blank: str = "") -> np.ndarray:
    """256 replacements for UTF-8 bytes: A-Z to a-z, and the ASCII characters in ``blank`` to a space."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    for character in blank:
        table[ord(character)] = 32
    return table


LOWER = byte_table()
#: Lower case, with ASCII punctuation as white space.
PLAIN = byte_table(blank="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def raw(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each value starts (one more at the end)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32) if len(texts) else np.zeros(1, np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.zeros(0, np.uint8) if buffer is None else np.frombuffer(buffer, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def filled(column: pa.Array) -> pa.StringArray:
    """The column with null as the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def translated(texts: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    data, offsets = raw(texts)
    return pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(table[data])
    )


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


class Words(NamedTuple):
    """Words of several texts: ``codes`` into ``vocabulary``; text ``d`` has ``codes[starts[d]:starts[d + 1]]``."""

    codes: np.ndarray
    vocabulary: pa.StringArray
    starts: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word of the texts."""
        return np.take(hashed(self.vocabulary), self.codes)


def hashed(values: pa.StringArray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values.to_pylist()), dtype=np.uint64, count=len(values))


def words(texts: pa.StringArray) -> Words:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    if not full.all():
        flat = flat.filter(pa.array(full))
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    return Words(codes, encoded.dictionary, before[ends.astype(np.int64)])


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def windows(hashes: np.ndarray, starts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows of each text, and where each text's windows start."""
    counts = np.maximum(np.diff(starts) - k + 1, 0)
    window_starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not window_starts[-1]:
        return np.zeros(0, np.uint64), window_starts
    total = len(hashes) - k + 1
    sums = np.zeros(total, np.uint64)
    for j in range(k):
        sums *= _MULTIPLIER
        sums += hashes[j : j + total]
    inside = np.ones(total, bool)
    tails = starts[1:, None] - np.arange(1, k)[None, :]
    tails = tails[(tails >= starts[:-1, None]) & (tails < total)]
    inside[tails] = False
    return mixed(sums[inside]), window_starts


def shingle_sets(texts: pa.StringArray, table: np.ndarray, short: bool, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with 1 to ``k - 1`` words has its whole sequence as one shingle if ``short``, else none; a text
    without words has none.
    """
    found = words(translated(texts, table))
    hashes = found.hashes()
    values, at = windows(hashes, found.starts, k)
    sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    if short:
        counts = np.diff(found.starts)
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            sums = np.uint64(counts[d])
            for h in hashes[found.starts[d] : found.starts[d + 1]]:
                sums = np.uint64((int(sums) * int(_MULTIPLIER) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            sets[d] = mixed(np.array([sums], np.uint64))
    return sets
