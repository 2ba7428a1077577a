"""Dense numeric operators that columns cannot express: functions from arrays to arrays.

A grey raster is a byte array (h, w), a colour raster (h, w, 3); a mask is
boolean.  ``dense`` runs these functions over pages.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from folio.operators.raster import GREY_LIMIT, kernel_rows

Rect = tuple[int, int, int, int]
#: Refinement limits and the beam search's configuration.
NOISE_STRENGTH, PATCH, SEARCH = 10.0, 7, 21
MEDIAN_ROUNDS, MEDIAN_EPS = 500, 1e-5
COLOURS, COLOUR_GAP, COLOUR_SHARE, COLOUR_BAND = 3, 10, 0.001, 30
BEAMS, MAX_LENGTH, EOS, LENGTH_POWER = 4, 300, 3, 2.0
PREDICTED, UNDETECTED_LIMIT, UNDETECTED_AREA = 60, 30, 50


# -- filters ----------------------------------------------------------------


def gaussian_taps(radius: float) -> np.ndarray:
    half = math.ceil(3 * radius)
    t = np.exp(-(np.arange(-half, half + 1, dtype=np.float64) ** 2) / (2 * radius * radius))
    return t / t.sum()


def blur(image: np.ndarray, radius: float) -> np.ndarray:
    """Separable Gaussian with edges repeated, sums in double and rows kept in single precision."""
    if radius <= 0 or not image.size:
        return image.copy()
    taps = gaussian_taps(radius)
    half = len(taps) // 2
    out = image.astype(np.float64)
    for axis in (1, 0):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in range(2)], mode="edge")
        total = np.zeros(image.shape)
        for i, w in enumerate(taps):
            total += w * np.take(wide, np.arange(i, i + image.shape[axis]), axis=axis)
        out = total.astype(np.float32).astype(np.float64) if axis else total
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def resize_bilinear(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Half-pixel centres, clamped; four taps."""
    y = np.clip((np.arange(h) + 0.5) * image.shape[0] / h - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * image.shape[1] / w - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    f = image.astype(np.float64)
    out = (f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx) * (1 - fy) + (f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx) * fy
    return np.floor(out + 0.5).astype(np.uint8)


def triangle_weights(src: int, dst: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start and 22-bit fixed-point weights of an antialiased triangle filter."""
    scale = src / dst
    support = max(scale, 1.0)
    starts, weights = np.zeros(dst, int), []
    for i in range(dst):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - support + 0.5)), min(src, int(centre + support + 0.5))
        t = np.maximum(0.0, 1.0 - np.abs((np.arange(lo, hi) - centre + 0.5) / support))
        t /= t.sum() or 1.0
        starts[i] = lo
        weights.append(np.where(t < 0, np.ceil(t * (1 << 22) - 0.5), np.floor(t * (1 << 22) + 0.5)).astype(np.int64))
    return starts, weights


def resize_triangle(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Columns, then rows, each rounded to bytes from fixed point."""
    out = image.astype(np.int64)
    for axis, size in ((1, w), (0, h)):
        if out.shape[axis] == size:
            continue
        starts, weights = triangle_weights(out.shape[axis], size)
        rows = [np.tensordot(t, np.take(out, np.arange(s, s + len(t)), axis=axis), axes=([0], [axis])) for s, t in zip(starts, weights, strict=True)]
        out = np.clip((np.stack(rows, axis=axis) + (1 << 21)) >> 22, 0, 255)
    return out.astype(np.uint8)


def mirrored(n: int, pad: int) -> np.ndarray:
    """Source index of every place of an axis widened by pad; the edge itself is not repeated."""
    if n == 1:
        return np.zeros(1 + 2 * pad, int)
    at = np.arange(-pad, n + pad) % (2 * n - 2)
    return np.where(at < n, at, 2 * n - 2 - at)


def non_local_means(image: np.ndarray, strength: float = NOISE_STRENGTH, patch: int = PATCH, search: int = SEARCH) -> np.ndarray:
    """Weighted mean over the search window, weights by patch distance (over all channels); mirrored edges."""
    p, s = patch // 2, search // 2
    f = np.moveaxis(image if image.ndim == 3 else image[:, :, None], 2, 0)
    channels, h, w = f.shape
    exact = np.float32 if channels * patch * patch * 255 * 255 < 1 << 24 else np.float64  # sums of squares are whole numbers
    wide = f[:, mirrored(h, s + p)][:, :, mirrored(w, s + p)].astype(np.float32)
    total, mass = np.zeros(f.shape, np.float32), np.zeros((h, w), np.float32)
    centre = wide[:, s : s + h + 2 * p, None, s : s + w + 2 * p]
    some = max(1, min(search, (1 << 22) // (h * w)))  # shifts of a row compared at once
    for dy in range(search):
        rows = np.lib.stride_tricks.sliding_window_view(wide[:, dy : dy + h + 2 * p], w + 2 * p, axis=2)
        for dx in range(0, search, some):
            other = rows[:, :, dx : dx + some]
            gap = np.zeros(other.shape[1:], exact)
            for c, o in zip(centre, other, strict=True):
                d = o - c
                gap += d * d
            down = sum((gap[i : i + h] for i in range(1, patch)), gap[:h])
            mean = sum((down[:, :, i : i + w] for i in range(1, patch)), down[:, :, :w]).astype(np.float64) / (channels * patch * patch)
            weight = np.exp(-mean / (strength * strength)).astype(np.float32)
            for t, o in zip(total, other, strict=True):
                t += (weight * o[p : p + h, :, p : p + w]).sum(axis=1)
            mass += weight.sum(axis=1)
    return np.moveaxis(np.floor(total / mass + 0.5).clip(0, 255).astype(np.uint8), 0, 2).reshape(image.shape)


def widened(mask: np.ndarray, half: int) -> np.ndarray:
    """Each row grown by half a width to both sides."""
    if half == 0 or not mask.size:
        return mask
    w = mask.shape[1]
    total = np.pad(np.cumsum(mask, axis=1), ((0, 0), (1, 0)))
    at = np.arange(w)
    return total[:, np.minimum(at + half + 1, w)] > total[:, np.maximum(at - half, 0)]


def grow(mask: np.ndarray, rows: list[tuple[int, int]]) -> np.ndarray:
    """Dilation by an element given as (dy, half width) rows, symmetric around its centre."""
    out = np.zeros_like(mask)
    h = mask.shape[0]
    wide = {half: widened(mask, half) for half in {half for _, half in rows}}
    for dy, half in rows:
        if abs(dy) < h:
            out[max(dy, 0) : h + min(dy, 0)] |= wide[half][max(-dy, 0) : h + min(-dy, 0)]
    return out


#: Elements of three by three, as rows.
SQUARE3, PLUS3 = [(-1, 1), (0, 1), (1, 1)], [(-1, 0), (0, 1), (1, 0)]


def eroded(image: np.ndarray, rows: list[tuple[int, int]]) -> np.ndarray:
    """Minimum over the element's places within the raster (three by three)."""
    wide = np.pad(image, 1, constant_values=255)
    h, w = image.shape
    parts = [wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, half in rows for dx in range(-half, half + 1)]
    return np.minimum.reduce(parts)


def fade_mask(mask: np.ndarray, outline: int = 5, fade: float = 1.0) -> np.ndarray:
    """Alpha of a mask that grows by an outline and fades out."""
    return blur(np.where(grow(mask, kernel_rows(outline)), 255, 0).astype(np.uint8), fade)


def cut_by_isolation(alpha: np.ndarray, isolation: np.ndarray) -> np.ndarray:
    return np.where(isolation, alpha, 0).astype(np.uint8)


# -- components ----------------------------------------------------------------------


@dataclass
class Components:
    """Eight-connected components: labels from 1 in order of first pixel by rows, 0 the background, with boxes and areas.

    ``cells`` orders labels by the first two-by-two cell they touch.
    """

    labels: np.ndarray
    boxes: np.ndarray
    areas: np.ndarray
    cells: np.ndarray

    def by_cell(self) -> list[int]:
        return (np.argsort(self.cells[1:], kind="stable") + 1).tolist()

    def hole_limit(self) -> int:
        """The second largest area, the background's among them; the only one where there is no other."""
        return int(np.sort(self.areas)[max(len(self.areas) - 2, 0)])


def components(mask: np.ndarray) -> Components:
    """Runs of pixels, joined with the runs they touch in the row above."""
    h, w = mask.shape
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    width = w + 2
    lo = np.searchsorted(row * width + stop, (row - 1) * width + start, "left")
    hi = np.searchsorted(row * width + start, (row - 1) * width + stop, "right")
    parent = list(range(len(row)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        for j in range(a, b):
            x, y = top(i), top(j)
            parent[max(x, y)] = min(x, y)
    roots = np.array([top(i) for i in range(len(row))], np.int64)
    label = np.unique(roots, return_inverse=True)[1] + 1
    n = int(label.max()) + 1 if len(label) else 1
    labels = np.zeros(h * w, np.int32)
    size = stop - start
    labels[np.repeat(row * w + start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.repeat(label, size)
    areas = np.bincount(label, size, n).astype(np.int64)
    areas[0] = h * w - int(size.sum())
    boxes = np.tile(np.array([w, h, 0, 0]), (n, 1))
    cells = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(boxes[:, 0], label, start)
    np.minimum.at(boxes[:, 1], label, row)
    np.maximum.at(boxes[:, 2], label, stop)
    np.maximum.at(boxes[:, 3], label, row + 1)
    np.minimum.at(cells, label, (row // 2) * width + start // 2)
    if areas[0]:
        y, x = np.nonzero(~mask)
        boxes[0] = x.min(), y.min(), x.max() + 1, y.max() + 1
    else:
        boxes[0] = 0
    return Components(labels.reshape(h, w), boxes, areas, cells)


def painted_regions(alpha: np.ndarray) -> list[Rect]:
    """Boxes of the painted spots of a brush mask; each is a failed region of deviation 0."""
    return [tuple(b) for b in components(alpha > 0).boxes[1:].tolist()]


# -- statistics -----------------------------------------------------------------


def geometric_median(colours: np.ndarray) -> np.ndarray:
    """Weiszfeld's iteration from the mean, truncated to whole samples."""
    at = colours.mean(axis=0)
    for _ in range(MEDIAN_ROUNDS):
        d = np.sqrt(((colours - at) ** 2).sum(axis=1))
        near = d > 0
        if not near.any():
            break
        new = (colours[near] / d[near, None]).sum(axis=0) / (1 / d[near]).sum()
        if np.sqrt(((new - at) ** 2).sum()) < MEDIAN_EPS:
            at = new
            break
        at = new
    return at.astype(int)


def distance_deviation(colours: np.ndarray) -> float:
    """Sample deviation of the distance to the mean colour, 0 for a single one."""
    d = np.sqrt(((colours - colours.mean(axis=0)) ** 2).sum(axis=1))
    return float(d.std(ddof=1)) if len(d) > 1 else 0.0


def central_colour(colours: np.ndarray) -> np.ndarray:
    """The majority colour or else the geometric median."""
    kinds, n = np.unique(colours, axis=0, return_counts=True)
    return kinds[n.argmax()] if n.max() * 2 > len(colours) else geometric_median(colours)


def colour_statistics(colours: np.ndarray) -> tuple[float, np.ndarray]:
    return distance_deviation(colours), central_colour(colours)


def top_colours(counts: np.ndarray, edges: np.ndarray) -> list[float]:
    """Up to COLOURS bin values by falling count, each farther than COLOUR_GAP from those kept; the stop test follows the insertion."""
    first, *order = np.argsort(-counts, kind="stable")
    kept = [float(edges[first])]
    for i in order:
        if all(abs(edges[i] - k) > COLOUR_GAP for k in kept):
            kept.append(float(edges[i]))
        if len(kept) >= COLOURS or counts[i] < COLOUR_SHARE * counts.sum():
            break
    return kept


def otsu_threshold(values: np.ndarray) -> int:
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    q, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = q[-1] - q
    with np.errstate(divide="ignore", invalid="ignore"):
        sigma = np.where((q > 0) & (rest > 0), q * rest * (m / q - (m[-1] - m) / rest) ** 2, 0)
    return int(np.argmax(np.round(sigma, 6)))


# -- mask refinement ----------------------------------------------------------------


def minimal_xor(mask: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, int]:
    """The mask or its negative, whichever is strictly nearer to what is wanted (the mask on a tie)."""
    pos, neg = int((mask ^ want).astype(np.int64).sum()), int(((255 - mask) ^ want).astype(np.int64).sum())
    return (255 - mask, neg) if neg < pos else (mask, pos)


def luma_15(image: np.ndarray) -> np.ndarray:
    r, g, b = (image[:, :, i].astype(np.int64) for i in range(3))
    return ((r * 9798 + g * 19235 + b * 3735 + (1 << 14)) >> 15).astype(np.uint8)


def in_range(image: np.ndarray, low: float, high: float) -> np.ndarray:
    bound = lambda x: min(max(round(x), 0), 255)
    return np.where((image >= bound(low)) & (image <= bound(high)), 255, 0).astype(np.uint8)


def candidate_masks(window: np.ndarray, prediction: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Bands around the top colours under the eroded prediction, then the best channel's Otsu mask (blue, green, red; the first of equals)."""
    grey = luma_15(window)
    under = grey[eroded(prediction, SQUARE3) > GREY_LIMIT]
    counts, edges = grey_histogram(under)
    out = []
    for colour in top_colours(counts, edges[:-1]):
        high = min(colour + COLOUR_BAND, 255.0)
        out.append(minimal_xor(in_range(grey, high - 2 * COLOUR_BAND, high), prediction))
    channels = [window[:, :, i] for i in (2, 1, 0)]
    return [*out, min((minimal_xor(np.where(c > otsu_threshold(c), 255, 0).astype(np.uint8), prediction) for c in channels), key=lambda x: x[1])]


def grey_histogram(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal bins over the values' range; a single value spreads by half a unit, without values the range is 0 to 1."""
    if not values.size:
        low, high = 0.0, 1.0
    elif values.min() == values.max():
        low, high = float(values.min()) - 0.5, float(values.max()) + 0.5
    else:
        low, high = float(values.min()), float(values.max())
    return np.histogram(values, bins=255, range=(low, high))


def merge_components(candidates: list[tuple[np.ndarray, int]], prediction: np.ndarray, least: int = 3) -> np.ndarray:
    """Paint the components that bring the result nearer to the binary prediction, best candidate first; then fill small holes likewise."""
    want = np.where(eroded(prediction, PLUS3) > PREDICTED, 255, 0).astype(np.uint8)
    out = np.zeros_like(prediction)

    def paint(c: Components, labels: list[int]) -> None:
        for label in labels:
            x1, y1, x2, y2 = c.boxes[label]
            window = np.s_[y1:y2, x1:x2]
            own = c.labels[window] == label
            now, goal = out[window][own], want[window][own]
            if int((255 ^ goal).sum(dtype=np.int64)) < int((now ^ goal).sum(dtype=np.int64)):
                out[window][own] = 255

    for mask, _ in sorted(candidates, key=lambda x: x[1]):
        c = components(mask > 0)
        box = (c.boxes[:, 2] - c.boxes[:, 0]) * (c.boxes[:, 3] - c.boxes[:, 1])
        paint(c, [i for i in range(1, len(c.areas)) if box[i] >= least])
    holes = components(out == 0)
    paint(holes, [i for i, area in enumerate(holes.areas.tolist()) if 0 < area < holes.hole_limit()])
    return out


def text_window(rect: Rect, w: int, h: int, spread: int = 16) -> Rect:
    """The box with a margin that follows its sides; its far corner stays on the last pixel."""
    x1, y1, x2, y2 = rect
    sides = sorted((x2 - x1, y2 - y1))
    pad = round((sides[1] * 0.25 + sides[0] * 0.75) / spread)
    return max(x1 - pad, 0), max(y1 - pad, 0), min(x2 + pad, w - 1), min(y2 + pad, h - 1)


def refine(image: np.ndarray, prediction: np.ndarray, boxes: list[Rect]) -> np.ndarray:
    """Each box's window refined on its own; the results are united.  A box whose window is empty is an error."""
    out = np.zeros_like(prediction)
    h, w = prediction.shape
    for box in boxes:
        x1, y1, x2, y2 = text_window(box, w, h)
        if x2 <= x1 or y2 <= y1:
            raise ValueError(f"box {box} has an empty window on a page of {w} x {h}")
        win = np.s_[y1:y2, x1:x2]
        out[win] |= merge_components(candidate_masks(image[win], prediction[win]), prediction[win])
    return out


def shared_area(a: Rect, b: Rect) -> int:
    """Area in both, -1 for boxes apart."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return -1 if w < 0 or h < 0 else w * h


def undetected(prediction: np.ndarray, boxes: list[Rect], limit: int = UNDETECTED_LIMIT, least: int = UNDETECTED_AREA) -> list[Rect]:
    """Boxes of larger components that no box holds to at least half.

    The background counts as the first component, the others follow by their
    first cell, and the first entry that is large enough is passed over,
    background or not.
    """
    c = components(prediction > limit)
    large = [i for i in (0, *c.by_cell()) if c.areas[i] > least]
    out = []
    for label in large[1:]:
        x1, y1, x2, y2 = own = tuple(c.boxes[label].tolist())
        best = max([-1, *(shared_area(b, own) for b in boxes)])
        if best / (x2 - x1) / (y2 - y1) < 0.5:
            out.append(own)
    return out


def refine_undetected(image: np.ndarray, prediction: np.ndarray, refined: np.ndarray, boxes: list[Rect], least: int = UNDETECTED_AREA) -> np.ndarray:
    """The refined mask and what is refined around components of the prediction that it left over."""
    rest = np.where(refined > UNDETECTED_LIMIT, 0, prediction).astype(np.uint8)
    invented = undetected(rest, boxes, least=least)
    return refined | refine(image, rest, invented) if invented else refined.copy()


def page_mask(samples: np.ndarray, pad_w: int, pad_h: int, w: int, h: int) -> np.ndarray:
    """A detector's mask samples as bytes, without the letterbox's padding, at the page's size."""
    if pad_w < 0 or pad_h < 0 or pad_w >= samples.shape[1] or pad_h >= samples.shape[0]:
        raise ValueError("the padding does not fit the mask")
    grey = np.clip(samples.astype(np.float32) * np.float32(255), 0, 255).astype(np.uint8)
    return resize_bilinear(grey[: samples.shape[0] - pad_h, : samples.shape[1] - pad_w], w, h)


# -- mask fitting ------------------------------------------------------------------


def crop_into(mask: np.ndarray, rect: Rect, size: tuple[int, int], at: tuple[int, int]) -> np.ndarray:
    """The part of a mask under a box, placed in an empty mask of a size (w, h)."""
    out = np.zeros((size[1], size[0]), bool)
    x1, y1, x2, y2 = (max(rect[0], 0), max(rect[1], 0), min(rect[2], mask.shape[1]), min(rect[3], mask.shape[0]))
    y, x = np.nonzero(mask[y1:y2, x1:x2]) if x2 > x1 and y2 > y1 else (np.zeros(0, int),) * 2
    x, y = x + x1 - rect[0] + at[0], y + y1 - rect[1] + at[1]
    on = (x >= 0) & (y >= 0) & (x < size[0]) & (y < size[1])
    out[y[on], x[on]] = True
    return out


def growth_masks(mask: np.ndarray, first: int = 4, step: int = 2, steps: int = 11) -> list[np.ndarray]:
    """The mask after each of the cumulative dilations, in a frame whose margin repeats the edge."""
    pad = 2 * max(first, step)
    grown, out = np.pad(mask, pad, mode="edge"), []
    for i in range(steps):
        grown = grow(grown, kernel_rows(step if i else first))
        out.append(grown[pad:-pad, pad:-pad])
    return out


def border_pixels(mask: np.ndarray) -> np.ndarray:
    """Set pixels on the raster's border or beside an unset one."""
    return mask & (eroded(np.where(mask, 255, 0).astype(np.uint8), SQUARE3) == 0) | mask & _frame(mask.shape)


def _frame(shape: tuple[int, int]) -> np.ndarray:
    out = np.ones(shape, bool)
    out[1:-1, 1:-1] = False
    return out


@dataclass
class Fit:
    """A region's fitted mask (None where it fails) with what the choice rests on."""

    mask: np.ndarray | None
    colour: tuple[int, int, int]
    at: tuple[int, int]
    std: float
    candidate: int
    thickness: int | None
    rescued: bool


def border_deviation(image: np.ndarray, mask: np.ndarray) -> float | None:
    """Deviation along a mask's border, None without a border."""
    edge = border_pixels(mask)
    if not edge.any():
        return None
    return distance_deviation(image[edge].astype(float)) if image.ndim == 3 else float(image[edge].std())


def border_colour(image: np.ndarray, mask: np.ndarray, off_white: int = 240) -> tuple[int, int, int]:
    """Median along a mask's border; what is near white snaps to white."""
    values = image[border_pixels(mask)]
    centre = tuple(int(c) for c in central_colour(values.astype(float))) if image.ndim == 3 else (int(np.median(values)),) * 3
    return (255,) * 3 if min(centre) > off_white else centre


def fit_region(image: np.ndarray, cut: np.ndarray, box_mask: np.ndarray, masking: Rect, reference: Rect, improvement: float = 0.1, max_std: float = 15.0, fast: bool = False, fallback: bool = True) -> Fit | None:
    """The candidate mask that fits one region best; None where it lies off the page, holds no mask, or a candidate has no border.

    Candidates are the grown masks and the box's own (first in fast mode, last
    otherwise).  The first is taken, then each that improves on the one taken
    by the given share; if what is taken deviates too much, the lowest
    deviation is, provided that it fits.
    """
    h, w = image.shape[:2]
    on_page = lambda r: min(r[2], w) > max(r[0], 0) and min(r[3], h) > max(r[1], 0)
    if not on_page(masking) or not on_page(reference):
        return None
    crop = image[max(reference[1], 0) : min(reference[3], h), max(reference[0], 0) : min(reference[2], w)]
    size, at = (crop.shape[1], crop.shape[0]), (masking[0] - reference[0], masking[1] - reference[1])
    precise = crop_into(cut, masking, size, at)
    if not precise.any():
        return None
    grown = [(m, 4 + 2 * i) for i, m in enumerate(growth_masks(precise))]
    box = [(crop_into(box_mask, masking, size, at), None)]
    candidates = box + grown if fast else grown + box
    taken = lowest = None
    for i, (mask, _) in enumerate(candidates):
        std = border_deviation(crop, mask)
        if std is None:
            return None
        if taken is None or std <= taken[1] * (1 - improvement):
            taken = (i, std)
        if lowest is None or std < lowest[1]:
            lowest = (i, std)
        if fast and std == 0:
            break
    chosen, std = lowest if fallback and taken[1] > max_std and lowest[1] <= max_std else taken
    mask, thickness = candidates[chosen]
    return Fit(mask if std <= max_std else None, border_colour(crop, mask), (reference[0], reference[1]), std, chosen, thickness, chosen != taken[0])


# -- layers --------------------------------------------------------------------------


def over(canvas: np.ndarray, layer: np.ndarray, at: tuple[int, int] = (0, 0)) -> None:
    """Source-over of a layer (h, w, 4) onto a canvas of the same kind, in place; what lies off it is left out."""
    x, y = at
    h, w = canvas.shape[:2]
    y1, y2, x1, x2 = max(y, 0), min(y + layer.shape[0], h), max(x, 0), min(x + layer.shape[1], w)
    if y2 <= y1 or x2 <= x1:
        return
    under = canvas[y1:y2, x1:x2]
    top = layer[y1 - y : y2 - y, x1 - x : x2 - x].astype(np.float64)
    alpha = top[:, :, 3:] / 255
    rest = under[:, :, 3:] / 255 * (1 - alpha)
    whole = alpha + rest
    mixed = np.concatenate([(top[:, :, :3] * alpha + under[:, :, :3] * rest) / np.where(whole == 0, 1, whole), whole * 255], axis=2)
    mixed = np.floor(mixed + 0.5).clip(0, 255).astype(np.uint8)
    solid = np.where(top[:, :, 3:] == 255, np.concatenate([top[:, :, :3], np.full(alpha.shape, 255.0)], axis=2).astype(np.uint8), mixed)
    canvas[y1:y2, x1:x2] = np.where(top[:, :, 3:] == 0, under, solid)


def combined_mask(fits: list[Fit], w: int, h: int) -> np.ndarray:
    """Fitted masks painted in their colours, in order."""
    canvas = np.zeros((h, w, 4), np.uint8)
    for fit in fits:
        if fit.mask is not None:
            layer = np.zeros((*fit.mask.shape, 4), np.uint8)
            layer[fit.mask] = (*fit.colour, 255)
            over(canvas, layer, fit.at)
    return canvas


def resized_nearest(image: np.ndarray, w: int, h: int) -> np.ndarray:
    return image[np.arange(h) * image.shape[0] // h][:, np.arange(w) * image.shape[1] // w]


def cleaned(page: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The colour page with the mask laid over it, at the page's size."""
    canvas = np.concatenate([page, np.full((*page.shape[:2], 1), 255, np.uint8)], axis=2)
    over(canvas, resized_nearest(mask, page.shape[1], page.shape[0]))
    return canvas[:, :, :3]


def text_layer(page: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """What the mask covers, opaque; all else transparent."""
    shown = resized_nearest(mask, page.shape[1], page.shape[0])[:, :, 3:] > 0
    return np.where(shown, np.concatenate([page, np.full((*page.shape[:2], 1), 255, np.uint8)], axis=2), 0).astype(np.uint8)


def mask_overlay(page: np.ndarray, mask: np.ndarray, tint: tuple[int, int, int, int]) -> np.ndarray:
    """The page with a tint where the mask covers it."""
    shown = resized_nearest(mask, page.shape[1], page.shape[0])[:, :, 3:] > 0
    alpha = tint[3] / 255
    return np.where(shown, np.floor(np.array(tint[:3]) * alpha + page * (1 - alpha) + 0.5), page).clip(0, 255).astype(np.uint8)


def noise_layer(page: np.ndarray, mask: np.ndarray, rects: list[Rect], outline: int = 5, fade: int = 1, strength: float = NOISE_STRENGTH) -> np.ndarray:
    """Denoised crops around regions, each with the faded mask as its alpha, laid over one another."""
    h, w = page.shape[:2]
    out = np.zeros((h, w, 4), np.uint8)
    reach = outline + 3 * fade
    for x1, y1, x2, y2 in rects:
        if min(x2, w) <= max(x1, 0) or min(y2, h) <= max(y1, 0):
            continue
        x, y = max(x1 - reach, 0), max(y1 - reach, 0)
        win = np.s_[y : min(y2 + reach, h), x : min(x2 + reach, w)]
        alpha = fade_mask(mask[win][:, :, 3] > 0, outline, fade)
        over(out, np.concatenate([non_local_means(page[win], strength), alpha[:, :, None]], axis=2), (x, y))
    return out


# -- inpainting ---------------------------------------------------------------------------


@dataclass
class Region:
    """A region of a page with its fit; the fill comes from the raw mask where it failed."""

    rect: Rect
    std: float
    failed: bool
    thickness: int | None


def eligible(regions: list[Region], min_std: float = 15.0, max_thickness: int = 7) -> list[tuple[Region, bool]]:
    """(region, from the raw mask): failed ones first, then thin ones that fit poorly."""
    poor = [r for r in regions if not r.failed and r.std >= min_std and r.thickness is not None and r.thickness <= max_thickness]
    return [(r, True) for r in regions if r.failed] + [(r, False) for r in poor]


def radius_of(std: float, least: int = 7, most: int = 20, per_std: float = 0.2) -> int:
    return max(min(least + (0 if math.isnan(std) else int(min(std * per_std, 1e9))), most), 0)


def merged_rects(rects: list[Rect]) -> list[Rect]:
    """Boxes merged until no two intersect, by rows then columns."""
    todo, done = [r for r in rects if r[2] > r[0] and r[3] > r[1]], []
    while todo:
        own = todo.pop()
        hit = [r for r in [*todo, *done] if own[0] < r[2] and r[0] < own[2] and own[1] < r[3] and r[1] < own[3]]
        if not hit:
            done.append(own)
            continue
        todo, done = [r for r in todo if r not in hit], [r for r in done if r not in hit]
        whole = np.array([own, *hit])
        todo.append((*whole[:, :2].min(axis=0).tolist(), *whole[:, 2:].max(axis=0).tolist()))
    return sorted(set(done), key=lambda r: (r[1], r[0], r[3], r[2]))


def anchors(low: int, high: int, canvas: int, tile: int, fits: bool) -> list[int]:
    """Tile starts along one axis: centred on the span, or a lattice over it; none leaves the canvas."""
    top = max(canvas - tile, 0)
    if fits:
        return [min(max((low + high) // 2 - tile // 2, 0), top)]
    return sorted({min(max(v, 0), top) for v in range(low, high, tile)})


def tiles(rects: list[Rect], w: int, h: int, tile: int) -> list[tuple[int, int]]:
    out = []
    for x1, y1, x2, y2 in rects:
        fits = x2 - x1 <= tile and y2 - y1 <= tile
        out += [(x, y) for y in anchors(y1, y2, h, tile, fits) for x in anchors(x1, x2, w, tile, fits)]
    return out


def inpaint_page(page: np.ndarray, raw: np.ndarray, combined: np.ndarray, regions: list[Region], model: Callable[[np.ndarray, np.ndarray], np.ndarray], noise: np.ndarray | None = None, min_thickness: int = 4, isolation: int = 5, fade: int = 4, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(fill layer with alpha, whole page) of a colour page.

    Eligible regions give a grown fill; it is faded, cut to the isolated
    surroundings, and what has any alpha is covered with tiles.  The model fills
    each tile (edges repeated off the page), and a pixel is written by the first
    tile over it.  The page is then composed: page, mask, noise layer, fill.
    """
    h, w = raw.shape
    full_h, full_w = page.shape[:2]
    fill, near, padded = np.zeros((h, w), bool), np.zeros((h, w), bool), []
    for region, from_raw in eligible(regions):
        x1, y1, x2, y2 = rect = region.rect
        radius = radius_of(region.std)
        reach = radius + isolation
        box = (max(x1 - reach, 0), max(y1 - reach, 0), min(x2 + reach, w), min(y2 + reach, h))
        size = (max(x2 - x1, 0), max(y2 - y1, 0))
        own = crop_into(raw > GREY_LIMIT if from_raw else combined[:, :, 3] > 0, rect, size, (0, 0))
        if from_raw:
            own = grow(own, kernel_rows(min_thickness))
        placed = crop_into(own, (0, 0, *size), (max(box[2] - box[0], 0), max(box[3] - box[1], 0)), (x1 - box[0], y1 - box[1]))
        grown = grow(placed, kernel_rows(radius))
        win = np.s_[box[1] : box[3], box[0] : box[2]]
        fill[win] |= grown
        near[win] |= grow(grown, kernel_rows(isolation))
        padded.append(box)
    fill, near = resized_nearest(fill, full_w, full_h), resized_nearest(near, full_w, full_h)
    alpha = cut_by_isolation(blur(np.where(fill, 255, 0).astype(np.uint8), fade), near)
    to_page = lambda v, n, m: -(-v * n // m)
    scaled = [(to_page(a, full_w, w), to_page(b, full_h, h), to_page(c, full_w, w), to_page(d, full_h, h)) for a, b, c, d in padded]
    filled, owned = page.copy(), alpha == 0
    for x, y in tiles(merged_rects(scaled), max(full_w, tile), max(full_h, tile), tile):
        win = np.s_[y : y + tile, x : x + tile]
        if not (alpha[win] > 0).any():
            continue
        rows, columns = np.minimum(np.arange(y, y + tile), full_h - 1), np.minimum(np.arange(x, x + tile), full_w - 1)
        made = model(page[rows][:, columns], fill[rows][:, columns])
        if made.shape != (tile, tile, 3):
            raise ValueError(f"the model gave a tile of {made.shape}")
        free = ~owned[win]
        filled[win][free] = made[: free.shape[0], : free.shape[1]][free]
        owned[win] = True
    layer = np.concatenate([filled, alpha[:, :, None]], axis=2)
    canvas = np.concatenate([page, np.full((full_h, full_w, 1), 255, np.uint8)], axis=2)
    for top in (resized_nearest(combined, full_w, full_h), noise, layer):
        if top is not None:
            over(canvas, top)
    return layer, canvas[:, :, :3]


# -- decoding --------------------------------------------------------------------------


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def banned(prefix: list[int], n: int = 3) -> set[int]:
    last = prefix[len(prefix) - n + 1 :]
    return {prefix[i + n - 1] for i in range(len(prefix) - n + 1) if prefix[i : i + n - 1] == last} if len(prefix) >= n else set()


def beam_search(logits: Callable[[list[list[int]]], np.ndarray], start: int = 2, beams: int = BEAMS, max_length: int = MAX_LENGTH, eos: int = EOS) -> list[int]:
    """Best finished sequence by score / length ** 2; ends count only among the first ``beams`` candidates."""
    live: list[tuple[float, list[int]]] = [(0.0, [start])]
    done: list[tuple[float, list[int]]] = []
    while live and len(live[0][1]) < max_length and len(done) < beams:
        scores = log_softmax(np.asarray(logits([s for _, s in live]), np.float64))
        options = []
        for b, (score, prefix) in enumerate(live):
            for t in banned(prefix):
                scores[b, t] = -np.inf
            options += [(-(score + s), b, t) for t, s in enumerate(scores[b].tolist()) if s > -np.inf]
        options = sorted(options)[: 2 * beams]
        new = []
        for rank, (cost, b, t) in enumerate(options):
            seq = [*live[b][1], t]
            if t == eos:
                if rank < beams:
                    done.append((-cost / len(seq) ** LENGTH_POWER, seq))
            elif len(new) < beams:
                new.append((-cost, seq))
        live = new
    pool = done or [(s / len(q) ** LENGTH_POWER, q) for s, q in live]
    return max(pool, key=lambda x: x[0])[1] if pool else [start]


# -- tensors and files ---------------------------------------------------------------------


def to_nchw(image: np.ndarray, mean: float = 0.5, std: float = 0.5) -> np.ndarray:
    """Height-width-channel bytes to a normalised batch of one."""
    chw = np.moveaxis(image if image.ndim == 3 else image[:, :, None], 2, 0).astype(np.float32) / np.float32(255)
    return ((chw - np.float32(mean)) / np.float32(std))[None]


def from_nchw(tensor: np.ndarray) -> np.ndarray:
    return np.moveaxis(np.floor(np.clip(tensor[0], 0, 1) * 255 + 0.5).astype(np.uint8), 0, 2)


def encode_png(image: np.ndarray, dpi: int | None = None) -> bytes:
    """PNG of grey, grey-alpha, colour or colour-alpha samples."""
    image = image if image.ndim == 3 else image[:, :, None]
    h, w, c = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    per_metre = round((dpi or 0) / 0.0254)
    density = chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) if dpi else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + density + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def encode_ppm(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    return f"P6\n{w} {h}\n255\n".encode() + rgb[:, :, :3].tobytes()
