"""BagMinHash signatures of weighted sets.

Weights are discretised to unit levels, and the levels of an element to the
intervals [0, 1), [1, 2), [2, 4), [4, 8), ...  Each (element, interval) runs a
Poisson process whose rate is the interval's length; each of its points falls
on a random register and a random level within the interval, and counts when
the element's weight reaches above that level.  A register keeps its first
point.  Two registers of different sets agree with probability equal to the
weighted Jaccard similarity, and processes stop at the largest first point of
all registers, so most elements give a few points only.
"""

from __future__ import annotations

import numpy as np

from folio.llm.shingles import mix

#: Points drawn at once for each process, by the number of processes of a set.
DRAWS = ((16, 256), (64, 64), (256, 16), (1 << 62, 2))
#: Points drawn at once; bounds memory only.
POINTS = 400_000
_STEP = np.uint64(0xD1B54A32D192ED03)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """uint64 array [n_docs, registers]; the rows of sets without elements are 0.

    doc, element and weight (at least 1) list the elements of the sets, those of a set together.
    """
    levels = np.frexp(weight.astype(np.float64))[1]
    levels = np.where(weight == 1 << np.maximum(levels - 1, 0), levels - 1, levels) + 1  # intervals that start below the weight
    d = np.repeat(doc, levels)
    j = np.arange(len(d)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(j == 0, 0, 1 << np.maximum(j - 1, 0))
    rate = np.maximum(low, 1)
    w = np.repeat(weight, levels)
    key = mix(np.repeat(element, levels) + (j.astype(np.uint64) + np.uint64(1)) * _STEP)
    size = np.bincount(d, minlength=n_docs)[d] if len(d) else d
    out = np.zeros((n_docs, registers), np.uint64)
    below = 0
    for limit, draws in DRAWS:
        own = (size > below) & (size <= limit)
        below = limit
        rows = np.nonzero(own)[0]
        if not len(rows):
            continue
        edges = np.nonzero(np.concatenate([[True], d[rows][1:] != d[rows][:-1]]))[0]
        part = edges * draws // POINTS
        cuts = edges[np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]].tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(rows)], strict=True):  # whole sets, about POINTS points at once
            some = rows[lo:hi]
            docs, local = np.unique(d[some], return_inverse=True)
            out[docs] = _run(local, key[some], low[some], rate[some], w[some], len(docs), registers, draws)
    return out


def _run(doc, key, low, rate, weight, n_docs, registers, draws) -> np.ndarray:
    first = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    at = np.zeros(len(doc))
    act = np.arange(len(doc))
    number = 0
    while act.size:
        n = np.arange(number, number + draws, dtype=np.uint64) + np.uint64(1)
        number += draws
        h = mix(key[act][:, None] + n[None, :] * _STEP)
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[act][:, None]
        gap[:, 0] += at[act]
        x = np.cumsum(gap, axis=1)
        at[act] = x[:, -1]
        h2 = mix(h + _STEP)
        slot = (h2 % np.uint64(registers)).astype(np.int64) + (doc[act] * registers)[:, None]
        level = low[act][:, None] + ((h2 >> np.uint64(32)) % rate[act].astype(np.uint64)[:, None]).astype(np.int64)
        ok = (level < weight[act][:, None]) & (x < first[slot])
        xs, slots, hs = x[ok], slot[ok], h[ok]
        np.minimum.at(first, slots, xs)
        won = xs == first[slots]
        winner[slots[won]] = hs[won]
        most = first.reshape(n_docs, registers).max(axis=1)
        act = act[at[act] < most[doc[act]]]
    return winner.reshape(n_docs, registers)
