"""Word and byte hashing over Arrow string batches, used inside Spark tasks."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # texts hashed together; a longer text is hashed alone
PIECE_BYTES = 1 << 22  # bytes of a long text whose words are hashed at once

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BASE, _WORD_BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(base: U64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = U64(pow(int(base), -1, 1 << 64))
        have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (base, inverse))
        if size <= 1 << 22:
            _POWERS[int(base)] = have
    return have


def rolling(values: np.ndarray, width: int, base: U64 = _WORD_BASE) -> np.ndarray:
    """Hash of every run of `width` consecutive values; empty when there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets (null counts as empty)."""
    # A task's functions bring a copy of this module; those of earlier tasks are cycles that would pile up in a reused worker.
    gc.collect()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the offsets of each text in them. Words never cross texts."""
    if not len(data):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    if len(data) > PIECE_BYTES:
        return _piecewise(data, offsets, lower)
    return _words(data, offsets, lower)


def _piecewise(data: np.ndarray, offsets: np.ndarray, lower: bool):
    """Words of a long text, hashed piece by piece; pieces end with white space, so a word longer than a piece makes a longer one."""
    parts, first = [], 0
    while first < len(data):
        last = first + PIECE_BYTES
        while last < len(data):
            blank = np.flatnonzero(_SPACE[data[last : last + PIECE_BYTES]])
            last += blank[0] + 1 if len(blank) else PIECE_BYTES
            if len(blank):
                break
        last = min(last, len(data))
        inner = np.concatenate([[first], offsets[(offsets > first) & (offsets < last)], [last]]) - first
        h, starts, ends, _ = _words(data[first:last], inner, lower)
        parts.append((h, starts + first, ends + first))
        first = last
    h, starts, ends = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return h, starts, ends, np.searchsorted(starts, offsets)


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool):
    solid = ~_SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, ~solid[:-1]
    after[-1], after[:-1] = True, ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    # Each byte counts by a hash of itself and its place in the word: unlike powers of a base, these have no pattern that
    # two different words could share.
    size = ends - starts
    solid = np.flatnonzero(solid)
    place = np.arange(len(solid)) - np.repeat(np.cumsum(size) - size, size)
    byte = data[solid]
    total = np.zeros(len(solid) + 1, U64)
    np.cumsum(mix(BYTE[_LOWER[byte] if lower else byte] ^ (place.astype(U64) * _BASE)), out=total[1:])
    upto = np.cumsum(size)
    hashes = mix(total[upto] - total[upto - size])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(column: pa.Array, size: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words, the whole sequence as one."""
    data, offsets = binary(column)
    for a, b in slices(offsets):
        w, _, _, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        runs = rolling(w, size)
        for i in range(b - a):
            n = int(at[i + 1] - at[i])
            if n >= size:
                found = np.unique(runs[at[i] : at[i + 1] - size + 1])
            else:
                found = rolling(w[at[i] : at[i + 1]], n) ^ U64(n) if n else np.empty(0, U64)
            yield found


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value (by its upper 40 bits, then leftmost) in every window."""
    n, most = len(values) - width + 1, 1 << 24
    if n <= 0:
        return np.empty(0, np.int64)
    if len(values) > most:
        step = most - width + 1
        return np.concatenate([sliding_argmin(values[i : i + most], width) + i for i in range(0, n, step)])
    low = U64(most - 1)
    best = (values & ~low) | np.arange(len(values), dtype=U64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[:n], best[width - span : width - span + n])
    return (best[:n] & low).astype(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values."""
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
