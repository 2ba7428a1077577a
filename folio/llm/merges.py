"""Deterministic byte-pair machinery shared by the token counter and the piece encoder.

A merge tokenizer is compiled once on the driver into flat integer tables:
which pairs merge and into what, and how every token splits again.  From these
tables alone one can say whether two tokens may stand next to each other in a
canonical encoding.  A prefix of a word then has exactly one last token that
agrees with its left neighbour, so encoding is a left-to-right relaxation over
the word's token edges, run here in lock step over many words at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Bits kept for the right member of a pair key, and for a symbol in a trie key.
PAIR_BITS = 20
#: Words longer than this are relaxed one by one; lock step would idle on them.
LONG_WORD = 2000
START, UNREACHED = -2, -1
#: Answers remembered by a table, as a power of two; a fixed eight megabytes.
KNOWN_BITS = 20
#: Pairs remembered while one very long word is relaxed.
MEMO_PAIRS = 200_000


class IntTable:
    """Open-addressing map from non-negative int64 to int32, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, -1, np.int32)
        pending = np.arange(len(keys))
        slot = self._slot(keys)
        while pending.size:
            at = slot[pending]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[pending[free]]
            placed = self.keys[at] == keys[pending]
            self.values[at[placed]] = values[pending[placed]]
            pending = pending[~placed]
            slot[pending] = (slot[pending] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(24)).astype(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where a key is absent."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        rest = np.nonzero((found != keys) & (found != -1))[0]
        while rest.size:
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out


@dataclass
class MergeTables:
    """rank: -1 for a symbol no merge makes; left/right: the two tokens a merged token was made of."""

    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: IntTable
    #: Remembered answers, one pair a slot: the pair's key, then a bit.
    known: np.ndarray | None = field(default=None, repr=False, compare=False)
    #: The tables as lists and a dictionary, made when single pairs are asked for.
    plain: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": None, "plain": None}

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As valid_pairs, asking only for pairs that are not remembered."""
        if self.known is None:
            self.known = np.full(1 << KNOWN_BITS, -1, np.int64)
        key = (a.astype(np.int64) << PAIR_BITS) | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        held = self.known[slot]
        out = (held & 1).astype(bool)
        new = np.nonzero(held >> 1 != key)[0]
        if new.size:
            out[new] = self.valid_pairs(a[new], b[new])
            self.known[slot[new]] = (key[new] << 1) | out[new]
        return out

    def follows(self, a: int, b: int, memo: dict[tuple[int, int], bool]) -> bool:
        """The same for one pair, where anything may follow START."""
        if a == START:
            return True
        ok = memo.get((a, b))
        if ok is None:
            ok = memo[a, b] = self._valid_pair(a, b)
        return ok

    def _valid_pair(self, a: int, b: int) -> bool:
        if self.plain is None:
            used = self.pairs.keys >= 0
            self.plain = self.rank.tolist(), self.left.tolist(), self.right.tolist(), dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist(), strict=True))
        rank, left, right, pairs = self.plain
        limit = 1 << 62
        while True:
            m = pairs.get((a << PAIR_BITS) | b, -1)
            if m >= 0 and rank[m] < limit:
                return False
            x, y = rank[a], rank[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                a, limit = right[a], x
            else:
                b, limit = left[b], y + 1

    def valid_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the joined text of a and b gives exactly (a, b).

        Undoes the two derivations, latest merge first.  A merge across the
        border spoils the pair when it ranks before the merge just undone;
        at equal rank the leftmost merge goes first.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        act = np.arange(len(a))
        while act.size:
            x, y = a[act], b[act]
            m = self.pairs.get((x.astype(np.int64) << PAIR_BITS) | y)
            bad = (m >= 0) & (self.rank[m] < limit[act])
            ok[act[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            act, x, y, rx, ry = act[go], x[go], y[go], rx[go], ry[go]
            undo = rx > ry
            a[act] = np.where(undo, self.right[x], x)
            b[act] = np.where(undo, y, self.left[y])
            limit[act] = np.where(undo, rx, ry + 1)
        return ok


def relax(tables: MergeTables, starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray, level: np.ndarray, n_nodes: int, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last token and token count of every node reached from the sources.

    Edges run from node to node; level is the distance of an edge's end from
    its word's source.  Every node gets the one edge that agrees with the last
    token of the node it starts from.
    """
    last = np.full(n_nodes, UNREACHED, np.int32)
    count = np.zeros(n_nodes, np.int32)
    last[sources] = START
    order = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
    starts, ends, tokens = starts[order], ends[order], tokens[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(level))]) if len(level) else np.zeros(1, np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if lo == hi:
            continue
        s, e, t = starts[lo:hi], ends[lo:hi], tokens[lo:hi]
        before = last[s]
        ok = before == START
        ask = np.nonzero(before >= 0)[0]
        ok[ask] = tables.agree(before[ask], t[ask])
        last[e[ok]] = t[ok]
        count[e[ok]] = count[s[ok]] + 1
    return last, count


def relax_long(tables: MergeTables, size: int, edges: Callable[[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one very long word, window by window.

    edges(lo, hi) gives (start, length, token) of the edges that start in the window.
    """
    last, count = np.full(size + 1, UNREACHED, np.int32), np.zeros(size + 1, np.int32)
    last[0] = START
    pending: dict[int, list[tuple[int, int]]] = {}
    memo: dict[tuple[int, int], bool] = {}
    for lo in range(0, size, window):
        hi = min(size, lo + window)
        for s, n, t in zip(*(x.tolist() for x in edges(lo, hi)), strict=True):
            pending.setdefault(s + n, []).append((s, t))
        for end in range(lo + 1, hi + 1):  # edges of later windows end behind this one
            for s, t in pending.pop(end, ()):
                if last[s] != UNREACHED and tables.follows(int(last[s]), t, memo):
                    last[end], count[end] = t, count[s] + 1
                    break
        if len(memo) > MEMO_PAIRS:
            memo.clear()
    return last, count
