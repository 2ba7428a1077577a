"""Mask refinement of many windows at once: what ``kernels.refine`` does to one box after another, with the same results.

Windows of one size are worked on together.  Components of one candidate are
disjoint, so all of them are painted at once; candidates follow one another.
"""

from __future__ import annotations

import numpy as np

from folio.operators import kernels as k
from folio.operators import stacks

BINS = 255
SQUARE3, PLUS3 = ([(dx, dy) for dy, half in rows for dx in range(-half, half + 1)] for rows in (k.SQUARE3, k.PLUS3))


def components(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eight-connected components of each mask of a stack: (flat places of all set pixels, component of each, window and box area of each component)."""
    n, h, w = masks.shape
    rows = np.pad(masks, ((0, 0), (0, 1), (0, 0))).reshape(n * (h + 1), w)  # a row apart
    step = np.diff(np.pad(rows.view(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    width = w + 2
    lo = np.searchsorted(row * width + stop, (row - 1) * width + start, "left")
    hi = np.searchsorted(row * width + start, (row - 1) * width + stop, "right")
    met = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), met)
    b = np.arange(len(a)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(lo, met)
    root = np.arange(len(row))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    firsts, label = np.unique(root, return_inverse=True)
    box = np.empty((4, len(firsts)), np.int64)
    box[:2], box[2:] = np.iinfo(np.int64).max, 0
    for i, (of, values) in enumerate(((np.minimum, start), (np.minimum, row), (np.maximum, stop), (np.maximum, row + 1))):
        of.at(box[i], label, values)
    size = stop - start
    first = row // (h + 1) * (h * w) + row % (h + 1) * w + start
    flat = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return flat, np.repeat(label, size), row[firsts] // (h + 1), (box[2] - box[0]) * (box[3] - box[1])


def paint(out: np.ndarray, want: np.ndarray, flat: np.ndarray, label: np.ndarray, eligible: np.ndarray) -> None:
    """Set the eligible components that bring the result nearer to what is wanted."""
    goal, now = want.reshape(-1)[flat], out.reshape(-1)[flat]
    n = len(eligible)
    nearer = eligible & (np.bincount(label[~goal], minlength=n) < np.bincount(label[now != goal], minlength=n))
    out.reshape(-1)[flat[nearer[label]]] = True


def hole_limits(area: np.ndarray, window: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of each window the second largest area, that of the rest among them; the only one where there is no other."""
    n = len(rest)
    of, areas = np.concatenate([window, np.arange(n)]), np.concatenate([area, rest])
    order = np.lexsort((-areas, of))
    count = np.bincount(of, minlength=n)
    return areas[order][np.cumsum(count) - count + (count > 1)]


def top_colours(grey: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``kernels.grey_histogram`` and ``kernels.top_colours`` of each window's values under its mask: (colours (n, COLOURS), which of them there are)."""
    n = len(grey)
    some = under.any(axis=(1, 2))
    low, high = np.where(under, grey, 255).min(axis=(1, 2)).astype(float), np.where(under, grey, 0).max(axis=(1, 2)).astype(float)
    one = some & (low == high)
    low, high = np.where(some, low - 0.5 * one, 0.0), np.where(some, high + 0.5 * one, 1.0)
    edges = np.linspace(low, high, BINS + 1, axis=1)
    at = np.nonzero(under)[0]
    v = grey[under].astype(np.float64)
    place = ((v - low[at]) / (high - low)[at] * BINS).astype(np.int64)
    place[place == BINS] -= 1
    place[v < edges[at, place]] -= 1
    place[(v >= edges[at, place + 1]) & (place != BINS - 1)] += 1
    counts = np.bincount(at * BINS + place, minlength=n * BINS).reshape(n, BINS)
    rank = counts * BINS + np.arange(BINS - 1, -1, -1)  # by falling count, then by value
    rows = np.arange(n)
    first = rank.argmax(axis=1)
    ends = np.where(counts < k.COLOUR_SHARE * counts.sum(axis=1, keepdims=True), rank, -1)
    ends[rows, first] = -1
    free = rank >= ends.max(axis=1, keepdims=True)  # the first one below the share is still looked at
    colour, there = np.zeros((n, k.COLOURS)), np.zeros((n, k.COLOURS), bool)
    place = first
    for i in range(k.COLOURS):
        found = free[rows, place] if i else np.ones(n, bool)
        colour[:, i], there[:, i] = edges[rows, place], found
        free &= ~found[:, None] | (np.abs(edges[:, :-1] - colour[:, i, None]) > k.COLOUR_GAP)
        place = np.where(free, rank, -1).argmax(axis=1)
    return colour, there


def nearer(masks: np.ndarray, prediction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``kernels.minimal_xor``, of boolean masks."""
    pos = np.where(masks, 255 - prediction, prediction).sum(axis=(1, 2), dtype=np.int64)
    neg = 255 * masks[0].size - pos
    return masks ^ (neg < pos)[:, None, None], np.minimum(pos, neg)


def otsu_thresholds(channel: np.ndarray) -> np.ndarray:
    """As ``kernels.otsu_threshold``."""
    n = stacks.value_counts(channel).astype(float)
    q, m = np.cumsum(n, axis=1), np.cumsum(n * np.arange(256), axis=1)
    rest = q[:, -1:] - q
    with np.errstate(divide="ignore", invalid="ignore"):
        sigma = np.where((q > 0) & (rest > 0), q * rest * (m / q - (m[:, -1:] - m) / rest) ** 2, 0)
    return np.argmax(np.round(sigma, 6), axis=1)


def refined_windows(image: np.ndarray, grey: np.ndarray, prediction: np.ndarray) -> np.ndarray:
    """The refined masks of windows of one size: colours (n, h, w, 3), their grey values and their predictions."""
    colour, there = top_colours(grey, stacks.extreme(prediction, SQUARE3, "min") > k.GREY_LIMIT)
    high = np.minimum(colour + k.COLOUR_BAND, 255.0)
    low = np.rint(high - 2 * k.COLOUR_BAND).clip(0, 255)
    high = np.rint(high).clip(0, 255)
    made = [nearer((grey >= low[:, i, None, None]) & (grey <= high[:, i, None, None]), prediction) for i in range(k.COLOURS)]
    channels = [nearer(image[..., c] > otsu_thresholds(image[..., c])[:, None, None], prediction) for c in (2, 1, 0)]
    rows = np.arange(len(grey))
    best = np.stack([xor for _, xor in channels]).argmin(axis=0)
    masks = np.stack([*(m for m, _ in made), np.stack([m for m, _ in channels])[best, rows]])
    xor = np.stack([*(np.where(there[:, i], made[i][1], np.iinfo(np.int64).max) for i in range(k.COLOURS)), np.stack([x for _, x in channels])[best, rows]])
    order = np.argsort(xor, axis=0, kind="stable")
    want = stacks.extreme(prediction, PLUS3, "min") > k.PREDICTED
    out = np.zeros(prediction.shape, bool)
    for i in order:
        flat, label, _, box = components(masks[i, rows] & (xor[i, rows] < np.iinfo(np.int64).max)[:, None, None])
        paint(out, want, flat, label, box >= 3)
    flat, label, window, _ = components(~out)
    area = np.bincount(label, minlength=len(window))
    paint(out, want, flat, label, area < hole_limits(area, window, out.sum(axis=(1, 2)))[window])
    return out


def refine(image: np.ndarray, prediction: np.ndarray, at: np.ndarray, rects: np.ndarray, spread: int = 16) -> np.ndarray:
    """As ``kernels.refine`` of every page: a stack of colours (n, h, w, 3), its predictions, and boxes ``rects`` of the pages ``at``."""
    _, h, w = prediction.shape
    out = np.zeros_like(prediction)
    x1, y1, x2, y2 = rects.T
    long, short = np.maximum(x2 - x1, y2 - y1), np.minimum(x2 - x1, y2 - y1)
    pad = np.rint((long * 0.25 + short * 0.75) / spread).astype(np.int64)
    left, top = np.maximum(x1 - pad, 0), np.maximum(y1 - pad, 0)
    ww, wh = np.minimum(x2 + pad, w - 1) - left, np.minimum(y2 + pad, h - 1) - top
    empty = np.nonzero((ww <= 0) | (wh <= 0))[0]
    if len(empty):
        raise ValueError(f"box {tuple(rects[empty[0]].tolist())} has an empty window on a page of {w} x {h}")
    r, g, b = (image[..., c].astype(np.int32) for c in range(3))
    grey = ((r * 9798 + g * 19235 + b * 3735 + (1 << 14)) >> 15).astype(np.uint8)
    size = wh * (w + 1) + ww
    for one in np.unique(size):
        group = np.nonzero(size == one)[0]
        wh_, ww_ = divmod(int(one), w + 1)
        for i in range(0, len(group), 4096):
            some = group[i : i + 4096]
            page, ys, xs = at[some][:, None, None], top[some][:, None, None] + np.arange(wh_)[:, None], left[some][:, None, None] + np.arange(ww_)
            masks = refined_windows(image[page, ys, xs], grey[page, ys, xs], prediction[page, ys, xs])
            out.reshape(-1)[((page * h + ys) * w + xs)[masks]] = 255
    return out
