"""Repeated byte windows by merging Burrows-Wheeler transforms; runs inside one Spark task, on one bucket of segments."""

from __future__ import annotations

import numpy as np

BLOCK = 8  # bytes of one symbol


def _layout(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (the next BLOCK bytes) at all places of all segments, the place after the last byte included, with the segment of
    each place and the number of bytes from it to the segment's end."""
    length = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(s + bytes(BLOCK) for s in segments), np.uint8)
    symbols = np.lib.stride_tricks.sliding_window_view(data, BLOCK)
    first = np.concatenate([[0], np.cumsum(length + BLOCK)[:-1]])
    segment = np.repeat(np.arange(len(segments)), length + 1)
    place = np.arange(len(segment)) - np.repeat(np.concatenate([[0], np.cumsum(length + 1)[:-1]]), length + 1)
    picked = np.ascontiguousarray(symbols[first[segment] + place]).view(">u8").ravel().astype(np.uint64)
    return picked, segment, length[segment] - place


def _stable_order(values: np.ndarray) -> np.ndarray:
    """Stable sort order of small non-negative numbers, sixteen bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def transform(symbol: np.ndarray, segment: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of one shard, and its transform: for each suffix in order, the symbol BLOCK bytes before it, or -1,
    and the place in the order of the suffix that starts there.

    Suffixes are compared symbol by symbol; one that ends inside a symbol comes before others with that symbol, and such
    suffixes come in the order of their segments. The order is found by doubling the compared length.
    """
    n = len(symbol)
    ends = segment * BLOCK + (BLOCK - 1 - rest % BLOCK)  # where the chain of symbols from a place ends
    above, step = int(ends.max()) + 1, BLOCK
    order = _stable_order(symbol)
    rank, todo = np.empty(n, np.int64), np.arange(n)
    key = symbol[order].astype(np.int64)
    while True:
        # Places todo of the order hold groups of equals; a group's rank is its first place.
        new = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, todo, 0))
        rank[order[todo]] = first
        alone = new & np.append(new[1:], True)
        todo = todo[~alone]
        if not len(todo):
            break
        places = order[todo]
        inside = rest[places] >= step
        then = ends[places]
        then[inside] = rank[places[inside] + step] + above
        key = rank[places] * (above + n) + then
        by_key = np.argsort(key)
        order[todo], key = places[by_key], key[by_key]
        step *= 2
    before, back = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    before[BLOCK:], back[BLOCK:] = symbol[:-BLOCK], rank[:-BLOCK]
    before[np.append(np.full(min(BLOCK, n), True), segment[BLOCK:] != segment[:-BLOCK])[:n]] = -1
    return order, before[order], back[order]


def merge(transforms: list[np.ndarray], backs: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave shard transforms until their intervals hold suffixes with a common prefix of `depth` symbols.

    Returns the suffixes (numbered through the shards) that share such a prefix with another, in merged order, and the
    interval of each. One refinement turns the order by k symbols into the order by k + 1: going through the merged order,
    each suffix's preceding symbol says where the suffix starting there belongs, and equal symbols keep the order. Neighbours
    whose symbol or whose rest's interval differ start a new interval, that is, have a shorter common prefix. An
    interval of one suffix cannot lead to a longer common prefix and is left out from then on.
    """
    start = np.cumsum([0] + [len(t) for t in transforms])[:-1]
    transform, back = np.concatenate(transforms), np.concatenate([b + s for b, s in zip(backs, start)]).astype(np.int32)
    row, interval = np.arange(len(transform), dtype=np.int32), np.zeros(len(transform), np.int32)
    for _ in range(depth):
        symbol = transform[row]
        known = np.flatnonzero(symbol >= 0)
        symbol, row, interval = symbol[known], back[row[known]], interval[known]
        order = _stable_order(symbol)
        symbol, row, interval = symbol[order], row[order], interval[order]
        new = np.append(True, (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]))[: len(row)]
        shared = np.flatnonzero(~(new & np.append(new[1:], True)[: len(row)]))
        row, interval = row[shared], np.cumsum(new, dtype=np.int32)[shared]
    return row, interval


def repeated(segments: list[bytes], counts: np.ndarray, weights: np.ndarray, window: int, shards: int = 4) -> list[np.ndarray]:
    """For each segment, which of its first `counts` windows occur more than once in all segments.

    A segment stands for `weights` equal ones and holds `counts` + `window` - 1 bytes. `window` is a multiple of BLOCK.
    Neighbouring segments go to different shards, so that shards have little to repeat.
    """
    shards = min(shards, len(segments))
    deal = np.concatenate([np.arange(s, len(segments), shards) for s in range(shards)])
    segments, counts, weights = [segments[i] for i in deal], counts[deal], weights[deal]
    symbol, segment, rest = _layout(segments)
    _, symbol = np.unique(symbol, return_inverse=True)
    symbol = symbol.astype(np.int32)
    sizes = [len(range(s, len(deal), shards)) for s in range(shards)]
    cuts = np.searchsorted(segment, np.cumsum([0, *sizes]))
    parts = [transform(symbol[a:b], segment[a:b] - segment[a], rest[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    row, interval = merge([t for _, t, _ in parts], [b for _, _, b in parts], window // BLOCK)
    place = np.concatenate([order + a for (order, _, _), a in zip(parts, cuts)])[row]
    total = np.bincount(interval, weights[segment[place]]) if len(row) else np.zeros(0)
    found = (weights > 1)[segment]
    found[place[total[interval] >= 2]] = True
    first = np.searchsorted(segment, np.arange(len(segments)))
    out: list[np.ndarray] = [None] * len(segments)
    for i, f, c in zip(deal, first, counts):
        out[i] = np.flatnonzero(found[f : f + c])
    return out
