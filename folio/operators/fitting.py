"""Mask fitting of many regions at once: what ``kernels.fit_region`` does to one, with the same results.

Regions of one crop size are worked on together.  Masks are packed along the
regions, eight to a byte, so a shift or an OR of a mask is one of bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from folio.operators import kernels as k
from folio.operators.raster import kernel_rows


@dataclass
class Fits:
    """The fitted regions, in order: their number among those given, and what ``kernels.Fit`` holds (thickness -1 for the box; ``painted`` the flat places of fitted masks, ``painted_by`` their regions)."""

    region: np.ndarray
    std: np.ndarray
    candidate: np.ndarray
    thickness: np.ndarray
    rescued: np.ndarray
    fits: np.ndarray
    colour: np.ndarray
    covered: np.ndarray
    painted: np.ndarray
    painted_by: np.ndarray


def grown(mask: np.ndarray, rows: list[tuple[int, int]]) -> np.ndarray:
    """Dilation of packed masks (h, w, bytes) by an element given as (dy, half width) rows."""
    h, w = mask.shape[:2]
    wide, now = {0: mask}, mask
    for half in range(1, max(half for _, half in rows) + 1):
        now = now.copy()
        if half < w:
            now[:, half:] |= mask[:, :-half]
            now[:, :-half] |= mask[:, half:]
        wide[half] = now
    out = np.zeros_like(mask)
    for dy, half in rows:
        if abs(dy) < h:
            out[max(dy, 0) : h + min(dy, 0)] |= wide[half][max(-dy, 0) : h + min(-dy, 0)]
    return out


def growth_masks(mask: np.ndarray, first: int = 4, step: int = 2, steps: int = 11) -> list[np.ndarray]:
    """As ``kernels.growth_masks``, of packed masks."""
    pad = 2 * max(first, step)
    now, out = np.pad(mask, ((pad, pad), (pad, pad), (0, 0)), mode="edge"), []
    for i in range(steps):
        now = grown(now, kernel_rows(step if i else first))
        out.append(now[pad:-pad, pad:-pad])
    return out


def border_pixels(mask: np.ndarray) -> np.ndarray:
    """As ``kernels.border_pixels``, of packed masks."""
    inner = mask[1:-1, 1:-1].copy()
    across = mask[:, 1:-1] & mask[:, :-2] & mask[:, 2:]
    inner &= across[:-2] & across[1:-1] & across[2:]
    out = mask.copy()
    out[1:-1, 1:-1] &= ~inner
    return out


def _deviation(crop: np.ndarray, edge: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Deviation of grey values, or of the distance to the mean colour, along borders (pixels, regions); channels come first."""
    count = np.maximum(n, 1)
    if len(crop) == 1:
        v = crop[0] * edge
        s, q = v.sum(axis=0), (v * crop[0]).sum(axis=0)
        return np.sqrt((n * q - s * s).astype(np.float64)) / count
    d = np.zeros(edge.shape)
    for c in crop:
        d += (c - (c * edge).sum(axis=0) / count) ** 2
    np.sqrt(d, out=d)
    gap = np.where(edge, d - (d * edge).sum(axis=0) / count, 0)
    return np.where(n > 1, np.sqrt((gap * gap).sum(axis=0) / np.maximum(n - 1, 1)), 0.0)


def geometric_medians(colours: np.ndarray, count: np.ndarray) -> np.ndarray:
    """As ``kernels.geometric_median`` of ragged sets of colours (samples, 3), one set after another: (sets, 3).

    Sets of one size go together; sums are taken in the order in which the one
    function takes them, as results are truncated.
    """
    out = np.zeros((len(count), 3), np.int64)
    starts = np.cumsum(count) - count
    for m in np.unique(count):
        live = np.nonzero(count == m)[0]
        c = np.ascontiguousarray(colours[starts[live] + np.arange(m)[:, None]].astype(np.float64).transpose(2, 0, 1))  # (3, m, sets)
        at = c.sum(axis=1) / m
        for _ in range(k.MEDIAN_ROUNDS):
            if len(live) == 1:  # numpy sums a lone column in another order
                break
            gap = c - at[:, None]
            gap *= gap
            d = np.sqrt(gap[0] + gap[1] + gap[2])
            hit = (d == 0).any(axis=0)
            if hit.any():  # a sample is left out there
                for i in np.nonzero(hit)[0]:
                    out[live[i]] = k.geometric_median(np.ascontiguousarray(c[:, :, i].T))
                live, c, at, d = live[~hit], np.ascontiguousarray(c[:, :, ~hit]), at[:, ~hit], np.ascontiguousarray(d[:, ~hit])
            new = (c / d).sum(axis=1) / np.ascontiguousarray((1 / d).T).sum(axis=1)
            done = np.sqrt(((new - at) ** 2).sum(axis=0)) < k.MEDIAN_EPS
            at = new
            if done.any():
                out[live[done]] = at[:, done].T.astype(np.int64)
                live, c, at = live[~done], np.ascontiguousarray(c[:, :, ~done]), at[:, ~done]  # else sums go along samples in another order
            if not len(live):
                break
        if len(live) == 1:
            at = k.geometric_median(np.ascontiguousarray(c[:, :, 0].T))[:, None]
        out[live] = at.T.astype(np.int64)
    return out


def central_colours(crop: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The median of grey values, or the majority colour, along each border: (3, regions), and where there is no majority."""
    n = edge.sum(axis=0)
    at = np.arange(len(n))
    if len(crop) == 1:
        values = np.sort(np.where(edge, crop[0], 1 << 20), axis=0)
        return np.repeat(((values[(n - 1) // 2, at] + values[n // 2, at]) // 2)[None], 3, axis=0), n < 0
    code = np.where(edge, (crop[0] << 16) + (crop[1] << 8) + crop[2], 1 << 24)
    middle = np.sort(code, axis=0)[n // 2, at]  # a majority holds the middle
    return np.stack([middle >> 16, middle >> 8 & 255, middle & 255]), ((code == middle) & edge).sum(axis=0) * 2 <= n


def fit_regions(image: np.ndarray, cut: np.ndarray, box_mask: np.ndarray, at: np.ndarray, rects: np.ndarray, margin: int, improvement: float = 0.1, max_std: float = 15.0, colour_failed: bool = True, off_white: int = 240) -> Fits:
    """Regions ``rects`` (n, 4) of the pages ``at`` of a stack (pages, h, w, channels), each with a margin that ends at the page; fallback on, not fast.

    Left out are regions off the page, without a mask, or with a candidate that has no border.
    """
    _, h, w = cut.shape
    x1, y1, x2, y2 = rects.T
    left, top = np.maximum(x1 - margin, 0), np.maximum(y1 - margin, 0)
    cw, ch = np.minimum(x2 + margin, w) - left, np.minimum(y2 + margin, h) - top
    on_page = (np.minimum(x2, w) > np.maximum(x1, 0)) & (np.minimum(y2, h) > np.maximum(y1, 0))
    made = []
    for size in np.unique((ch * (w + 1) + cw)[on_page]):
        group = np.nonzero(on_page & (ch * (w + 1) + cw == size))[0]
        made += [_fit_group(image, cut, box_mask, at, rects, left, top, group[i : i + 4096], divmod(int(size), w + 1), improvement, max_std, colour_failed) for i in range(0, len(group), 4096)]
    if not made:
        none = np.zeros(0, np.int64)
        return Fits(none, none + 0.0, none, none, none > 0, none > 0, none.reshape(3, 0), none, none, none)
    joined = [np.concatenate([m[i] for m in made], axis=-1) for i in range(13)]
    colour, (of, count, samples) = joined[6], joined[10:]
    if len(of):
        by = np.argsort(joined[0])
        colour[:, by[np.searchsorted(joined[0], of, sorter=by)]] = geometric_medians(samples.T, count).T
    joined[6] = np.where(colour.min(axis=0) > off_white, 255, colour)
    order = np.argsort(joined[0])
    pixels = np.lexsort((joined[8], joined[9]))
    return Fits(*(j[..., order] for j in joined[:8]), joined[8][pixels], joined[9][pixels])


def _fit_group(image, cut, box_mask, at, rects, left, top, group, size, improvement, max_std, colour_failed) -> tuple:
    """The fits of regions whose crops have one size, in the order of ``Fits``."""
    h, w = size
    page = at[group]
    ys, xs = top[group] + np.arange(h)[:, None, None], left[group] + np.arange(w)[None, :, None]
    x1, y1, x2, y2 = rects[group].T
    within = (xs >= x1) & (xs < x2) & (ys >= y1) & (ys < y2)
    precise = cut[page, ys, xs] & within
    some = precise.any(axis=(0, 1))
    group, page, ys, xs, within, precise = group[some], page[some], ys[..., some], xs[..., some], within[..., some], precise[..., some]
    n = len(group)
    crop = np.moveaxis(image[page, ys, xs], -1, 0).reshape(image.shape[3], h * w, n).astype(np.int64)
    pack = lambda mask: np.packbits(mask, axis=2)
    unpack = lambda mask: np.unpackbits(mask, axis=2, count=n).view(bool).reshape(h * w, n)
    candidates = [*growth_masks(pack(precise)), pack(box_mask[page, ys, xs] & within)]
    taken, lowest, low = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf)
    std = np.full(n, np.inf)
    bordered = np.ones(n, bool)
    for i, mask in enumerate(candidates):
        edge = unpack(border_pixels(mask))
        count = edge.sum(axis=0)
        bordered &= count > 0
        d = _deviation(crop, edge, count)
        take = d <= std * (1 - improvement) if i else bordered | True
        taken, std = np.where(take, i, taken), np.where(take, d, std)
        lower = d < low
        lowest, low = np.where(lower, i, lowest), np.where(lower, d, low)
    fall = (std > max_std) & (low <= max_std)
    chosen, std = np.where(fall, lowest, taken), np.where(fall, low, std)
    fits = std <= max_std
    mask, edge = np.zeros((h * w, n), bool), np.zeros((h * w, n), bool)
    for i in np.unique(chosen):
        of = chosen == i
        mask[:, of], edge[:, of] = unpack(candidates[i])[:, of], unpack(border_pixels(candidates[i]))[:, of]
    colour = np.zeros((3, n), np.int64)
    coloured = np.nonzero(bordered & (fits | colour_failed))[0]
    if len(coloured):
        colour[:, coloured], none = central_colours(crop[:, :, coloured], edge[:, coloured])
        coloured = coloured[none]
    of, sample = np.nonzero(edge[:, coloured].T)
    samples = crop[:, sample, coloured[of]] if len(crop) == 3 else np.zeros((3, 0), np.int64)
    place, by = np.nonzero(mask & (fits & bordered))
    on = (page[by] * cut.shape[1] + ys.reshape(h, n)[place // w, by]) * cut.shape[2] + xs.reshape(w, n)[place % w, by]
    thickness = np.where(chosen == len(candidates) - 1, -1, 4 + 2 * chosen)
    keep = bordered
    return group[keep], std[keep], chosen[keep], thickness[keep], (chosen != taken)[keep], fits[keep], colour[:, keep], mask.sum(axis=0)[keep], on, group[by], group[coloured], edge[:, coloured].sum(axis=0), samples
