"""Repeated strings of several text shards by merging their Burrows-Wheeler transforms.

Each shard is indexed on its own: suffixes sorted to a fixed depth and the
byte before each of them.  Two shards are merged by refining how their
suffixes interleave: starting from "all of the first, then all of the second",
each round deals the interleave out by the preceding bytes, stably, which makes
it right for strings one byte longer.  A round also marks where neighbours
first differ; what is unmarked after ``depth`` rounds has a common prefix of at
least ``depth`` bytes, so the repeated intervals appear without sorting the
suffixes of both shards again.  A merged pair is a shard for the next merge.
"""

from __future__ import annotations

import numpy as np


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of text sorted by their first depth bytes, ties by position."""
    n = len(text)
    step = min(7, n)
    key = np.zeros(n, np.int64)
    wide = np.concatenate([text, text[:step]]).astype(np.int64)
    for i in range(step):
        key = (key << 8) | wide[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        if step >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        key = rank * n + np.roll(rank, -(step % n))
        step *= 2


def preceding(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    return text[order - 1]


def interleave(a: np.ndarray, b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two transforms: for each merged place whether it is from b, and where a common prefix of depth bytes with the place before ends.

    Stops early when a round changes neither, for then no later round will.
    """
    n = len(a) + len(b)
    from_b = np.zeros(n, bool)
    from_b[len(a) :] = True
    breaks = np.zeros(n, bool)
    breaks[0] = True
    byte = np.empty(n, np.uint8)
    for _ in range(depth):
        byte[~from_b] = a
        byte[from_b] = b
        deal = np.argsort(byte, kind="stable")
        new_b = from_b[deal]
        # places of one block stay together; a new block begins where the old block or the byte changes
        block = np.cumsum(breaks, dtype=np.int32)[deal]
        dealt = byte[deal]
        new_breaks = np.empty(n, bool)
        new_breaks[0] = True
        new_breaks[1:] = (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])
        if np.array_equal(new_b, from_b) and np.array_equal(new_breaks, breaks):
            break
        from_b, breaks = new_b, new_breaks
    return from_b, breaks


def repeats(texts: list[bytes], depth: int, shards: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(place, class) of every depth-byte string of the texts that occurs at least twice; places count in the joined texts.

    Texts hold any bytes; strings across a border of two texts are left out.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.linspace(0, ends[-1], shards + 1)[1:-1], "left") + 1) if len(texts) > 1 else []
    parts = [p for p in np.split(np.arange(len(texts)), cuts) if len(p)]
    merged = []
    for p in parts:
        text = np.frombuffer(b"".join(texts[i] for i in p), np.uint8)
        order = shard_order(text, depth)
        merged.append((preceding(text, order), order + (ends[p[0]] - sizes[p[0]])))
    while len(merged) > 1:
        after = []
        for x, y in zip(merged[::2], merged[1::2], strict=False):
            from_b, breaks = interleave(x[0], y[0], depth)
            byte, order = np.empty(len(from_b), np.uint8), np.empty(len(from_b), np.int64)
            for mask, side in ((~from_b, x), (from_b, y)):
                byte[mask], order[mask] = side[:2]
            after.append((byte, order, breaks))
        merged = after + ([merged[-1]] if len(merged) % 2 else [])
    order = merged[0][1]
    if len(merged[0]) == 2:  # one shard: its own neighbours, compared byte by byte
        text = np.frombuffer(b"".join(texts), np.uint8)
        _, breaks = interleave(preceding(text, order), np.zeros(0, np.uint8), depth)
    else:
        breaks = merged[0][2]
    owner = np.searchsorted(ends, order, "right")
    whole = order + depth <= ends[owner]
    kind = np.cumsum(breaks)[whole]
    order = order[whole]
    many = np.bincount(kind)[kind] > 1
    return order[many], kind[many]
