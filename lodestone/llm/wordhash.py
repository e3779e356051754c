"""Vectorised word and shingle hashes of whole Arrow text columns (NumPy, no loop over words).

Words are the maximal runs of bytes other than space and \\t..\\r, after lower-casing A-Z. A word of up to PLACES bytes
hashes to the sum of random 64-bit values, one for each pair of place and byte (simple tabulation): two different words
agree with probability 2**-64, whatever their bytes. A longer word hashes to 64 bits of its BLAKE2 digest.
Grams of bytes hash by doubling: the hashes of two neighbouring halves are multiplied and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 3 << 18
_U = np.uint64
PLACES = 64
_rng = np.random.Generator(np.random.PCG64(20240501))
_VALUES = _rng.integers(0, 2**64, PLACES * 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SHINGLE = 5
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | _U(1)
_HALVES = _rng.integers(1, 2**63, (2, 8), dtype=np.uint64) | _U(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size bytes from each place of data on; size is 2**k from 8 to 256."""
    if len(data) < size:
        return np.zeros(0, _U)
    eights = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data).view(np.uint8), (len(data) - 7, 8), (1, 1))
    out = mix64(np.ascontiguousarray(eights).view("<u8").ravel().astype(_U, copy=False))
    half, level = 8, 0
    while half < size:
        left = out[:-half] * _HALVES[0, level]
        left += out[half:] * _HALVES[1, level]
        out = mix64(left)
        half, level = 2 * half, level + 1
    return out


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of about SLICE_BYTES; null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(column))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row offsets into them)."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    ends = np.flatnonzero(ends) + 1
    lengths = ends - starts
    short = np.flatnonzero(lengths <= PLACES)
    at = np.flatnonzero(inside)
    if len(short) < len(starts):
        at = at[np.repeat(lengths <= PLACES, lengths)]
    begins = np.cumsum(lengths[short]) - lengths[short]
    place = np.arange(len(at)) - np.repeat(begins, lengths[short])
    hashes = np.zeros(len(starts), _U)
    if len(short):
        hashes[short] = np.add.reduceat(_VALUES[place * 256 + _LOWER[data[at]]], begins)
    for k in np.flatnonzero(lengths > PLACES).tolist():
        hashes[k] = int.from_bytes(blake2b(_LOWER[data[starts[k] : ends[k]]].tobytes(), digest_size=8).digest(), "little")
    return mix64(hashes + lengths.astype(_U)), np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each SHINGLE-word shingle, row offsets); a row with fewer words has its whole sequence as one."""
    counts = np.diff(offsets)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, counts > 0)
    out_offsets = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(out_offsets[-1], _U)
    rows = np.repeat(np.arange(len(counts)), made)
    at = np.arange(len(out)) - out_offsets[rows] + offsets[rows]
    size = np.minimum(counts, SHINGLE)[rows]
    padded = np.concatenate((hashes, np.zeros(SHINGLE, _U)))
    for k in range(SHINGLE):
        out += np.where(k < size, padded[at + k] * _PLACE[k], _U(0))
    return mix64(out + size.astype(_U)), out_offsets


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row, and row offsets."""
    hashes = hashes.copy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    return hashes[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
