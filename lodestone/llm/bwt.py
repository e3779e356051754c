"""Burrows-Wheeler transforms of many short byte strings, merged shard by shard by interleave refinement.

The alphabet is that of STEP-byte grams (by hash; any fixed order of the grams serves), and a suffix's predecessor is the suffix
STEP bytes before it. Suffixes are ordered by their first DEPTH grams, which is all that repeats of STEP * DEPTH bytes
need. Every string ends in STEP empty suffixes, which come first in the order. A transform lists, in suffix order, the
gram before each suffix (0: none).

Merging two transforms never compares suffixes: a bit per suffix says which shard it comes from. One refinement walks
the bits in order, takes the next gram of the shard each names, and deals the bits stably into the grams' buckets.
After t refinements the bits are those of the order by t grams. The refinement at which two neighbours part gives
their common prefix; runs of neighbours that never part are the repeated intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP, DEPTH = 40, 5
DEAL_BITS = 11
_LOW = np.uint32((1 << DEAL_BITS) - 1)


@dataclass
class Transform:
    """order: suffixes (positions in the padded text) in order; before: rank of the gram before each (0: none); empty: number of
    empty suffixes; common: grams (at most DEPTH) shared with the suffix before, in order."""

    order: np.ndarray
    before: np.ndarray
    empty: int
    common: np.ndarray


def _dealt(symbols: np.ndarray) -> np.ndarray:
    """The stable order of symbols (nonzero ranks), dealt by DEAL_BITS bits at a time; Arrow orders so narrow a range by counting."""
    rest = symbols.astype(np.uint32, copy=False)
    order = pc.array_sort_indices(pa.array(rest & _LOW)).to_numpy().astype(np.int32)
    while (rest := rest >> np.uint32(DEAL_BITS)).any():
        order = order[pc.array_sort_indices(pa.array((rest & _LOW)[order])).to_numpy()]
    return order


def _refined(symbols: np.ndarray, blocks: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices into symbols of the non-empty suffixes in the new order, new blocks, where blocks begin)."""
    has = np.flatnonzero(symbols).astype(np.int32)
    moved = has[_dealt(symbols[has])]
    c, b = symbols[moved], blocks[moved]
    begins = np.ones(empty + len(moved), bool)
    begins[1:empty] = False
    begins[empty + 1 :] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
    return moved, np.cumsum(begins, dtype=np.int32), begins


def transform(ranks: np.ndarray, first: np.ndarray, last: np.ndarray) -> Transform:
    """Of the strings (under 2**31 places in all) ranks[first[k] : last[k]], whose final STEP places are the empty suffixes. ranks: of the grams, from 1."""
    lengths = last - first
    inside = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    position = inside + np.repeat(first, lengths).astype(np.int32)
    is_empty = inside >= np.repeat(lengths, lengths) - STEP
    empty = int(is_empty.sum())
    before = np.where(inside >= STEP, ranks[position - STEP], 0).astype(np.uint32)
    start = np.concatenate((np.flatnonzero(is_empty), np.flatnonzero(~is_empty))).astype(np.int32)
    order = start
    previous = np.where(inside >= STEP, np.arange(len(position), dtype=np.int32) - np.int32(STEP), np.int32(-1))
    blocks, common = np.ones(len(order), np.int32), np.zeros(len(order), np.int8)
    for t in range(DEPTH):
        moved, blocks, begins = _refined(before[order], blocks, empty)
        order = np.concatenate((start[:empty], previous[order[moved]]))
        common[~begins] = t + 1
    return Transform(position[order], before[order], empty, common)


def merge(a: Transform, b: Transform) -> Transform:
    """The transform of both shards' strings, from the shards' transforms alone."""
    head = np.concatenate((np.zeros(a.empty, bool), np.ones(b.empty, bool)))
    bits = np.concatenate((head, np.zeros(len(a.order) - a.empty, bool), np.ones(len(b.order) - b.empty, bool)))
    symbols = np.empty(len(bits), a.before.dtype)
    blocks, common = np.ones(len(bits), np.int32), np.zeros(len(bits), np.int8)
    for t in range(DEPTH):
        symbols[~bits], symbols[bits] = a.before, b.before
        moved, blocks, begins = _refined(symbols, blocks, len(head))
        bits = np.concatenate((head, bits[moved]))
        common[~begins] = t + 1
    order = np.empty(len(bits), a.order.dtype)
    order[~bits], order[bits] = a.order, b.order
    symbols[~bits], symbols[bits] = a.before, b.before
    return Transform(order, symbols, len(head), common)


def repeated(grams: np.ndarray, first: np.ndarray, last: np.ndarray, shards: int) -> np.ndarray:
    """Positions whose STEP * DEPTH bytes also start elsewhere in the strings grams[first[k] : last[k]].

    grams: a 64-bit hash of the STEP bytes from each place on; the places of the final STEP - 1 bytes and one more are
    the empty suffixes, so a string of m bytes has m + 1 places here, of which m - STEP + 1 have a gram.
    """
    return repeated_ranks(np.unique(grams, return_inverse=True)[1].astype(np.int64) + 1, first, last, shards)


def repeated_ranks(ranks: np.ndarray, first: np.ndarray, last: np.ndarray, shards: int) -> np.ndarray:
    """The same from the grams' ranks (under 2**32, from 1) in any order of the grams."""
    cuts = np.searchsorted(np.cumsum(last - first), np.linspace(0, (last - first).sum(), shards + 1)[1:-1])
    parts = [p for p in np.split(np.arange(len(first)), cuts) if len(p)]
    level = [transform(ranks, first[p], last[p]) for p in parts]
    while len(level) > 1:
        level = [merge(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    if not level:
        return np.zeros(0, np.int64)
    whole = level[0].common >= DEPTH
    whole[: level[0].empty] = False
    found = np.sort(level[0].order[whole | np.append(whole[1:], False)])
    return found[found + STEP * DEPTH < last[np.searchsorted(last, found, "right")]]  # shorter suffixes are equal too
