"""Rectangle functions on struct columns (x1, y1, x2, y2), all plain expressions.

Corners x1, y1 are inclusive; x2, y2 are exclusive for cropping and inclusive
for ``contains``, as the data model has it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def rect(x1, y1, x2, y2) -> Column:
    named = zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)
    return F.struct(*((c if isinstance(c, Column) else F.lit(c)).cast("int").alias(n) for c, n in named))


def of(prefix: str = "") -> Column:
    """The rectangle in four columns with a common prefix."""
    return rect(*(F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2")))


def width(r: Column) -> Column:
    return r["x2"] - r["x1"]


def height(r: Column) -> Column:
    return r["y2"] - r["y1"]


def area(r: Column) -> Column:
    return width(r).cast("bigint") * height(r).cast("bigint")


def center(r: Column) -> Column:
    """Floor division, also of negative sums."""
    return F.struct(F.shiftright(r["x1"] + r["x2"], 1).alias("x"), F.shiftright(r["y1"] + r["y2"], 1).alias("y"))


def contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x1"], r["x2"]) & y.between(r["y1"], r["y2"])


def contains_rect(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def merge(a: Column, b: Column) -> Column:
    return rect(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def shared_area(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w.cast("bigint") * h.cast("bigint")


def overlaps(a: Column, b: Column, percent: float) -> Column:
    """The shared area exceeds the share of the smaller area; strict."""
    smaller = F.least(area(a), area(b))
    return shared_area(a, b).cast("double") / F.when(smaller == 0, F.lit(1)).otherwise(smaller).cast("double") > percent / 100.0


def overlaps_center(a: Column, b: Column) -> Column:
    return contains(b, center(a)["x"], center(a)["y"]) | contains(a, center(b)["x"], center(b)["y"])


def pad(r: Column, amount, w: int, h: int) -> Column:
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    return rect(F.greatest(r["x1"] - amount, F.lit(0)), F.greatest(r["y1"] - amount, F.lit(0)), F.least(r["x2"] + amount, F.lit(w)), F.least(r["y2"] + amount, F.lit(h)))


def right_pad(r: Column, amount: int, w: int) -> Column:
    return rect(r["x1"], r["y1"], F.least(r["x2"] + amount, F.lit(w)), r["y2"])


def saturated(v: Column) -> Column:
    """Truncated toward zero into 32 bits; not-a-number gives 0."""
    return F.when(F.isnan(v), F.lit(0)).otherwise(F.greatest(F.least(v, F.lit(float(INT_MAX))), F.lit(float(INT_MIN))).cast("int"))


def scale(r: Column, factor) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return rect(*(saturated(r[n].cast("double") * f) for n in ("x1", "y1", "x2", "y2")))


def translate(r: Column, dx: int, dy: int) -> Column:
    return rect(r["x1"] + dx, r["y1"] + dy, r["x2"] + dx, r["y2"] + dy)


def is_empty(r: Column) -> Column:
    return (width(r) <= 0) | (height(r) <= 0)


def to_crop(r: Column, w: int, h: int) -> Column:
    """(x, y, w, h) within the canvas, null when nothing is left."""
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top))
    x1, x2, y1, y2 = clamp(r["x1"], w), clamp(r["x2"], w), clamp(r["y1"], h), clamp(r["y2"], h)
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")))


def iou(a: Column, b: Column) -> Column:
    """Single precision; 0 when the union is not positive."""
    inter, union = shared_area(a, b), area(a) + area(b) - shared_area(a, b)
    return F.when(union <= 0, F.lit(0.0).cast("float")).otherwise((inter.cast("float") / F.greatest(union, F.lit(1)).cast("float")).cast("float"))


def intersection_area(a: Column, b: Column) -> Column:
    """-1 when apart; boxes that touch share 0."""
    x1, x2 = F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])
    y1, y2 = F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"])
    return F.when((y2 < y1) | (x2 < x1), F.lit(-1).cast("bigint")).otherwise((y2 - y1).cast("bigint") * (x2 - x1).cast("bigint"))


def intersects(a: Column, b: Column) -> Column:
    """Open intervals: a common edge does not count."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def expand_text_window(r: Column, ratio: float, w: int, h: int) -> Column:
    """Pads by the half-even rounded (0.25 longer + 0.75 shorter side) / ratio; the high sides stop one short of the canvas."""
    longer, shorter = F.greatest(width(r), height(r)), F.least(width(r), height(r))
    p = F.rint((longer * 0.25 + shorter * 0.75) / ratio).cast("int")
    return rect(F.greatest(r["x1"] - p, F.lit(0)), F.greatest(r["y1"] - p, F.lit(0)), F.least(r["x2"] + p, F.lit(w - 1)), F.least(r["y2"] + p, F.lit(h - 1)))


def scale_up(v: Column, num: int, den: int) -> Column:
    """Ceiling of v * num / den, in whole numbers."""
    top = v.cast("bigint") * num + (den - 1)
    return ((top - F.pmod(top, F.lit(den))) / den).cast("int")


def scale_rect_to(r: Column, src: tuple[int, int], dst: tuple[int, int]) -> Column:
    return rect(scale_up(r["x1"], dst[0], src[0]), scale_up(r["y1"], dst[1], src[1]), scale_up(r["x2"], dst[0], src[0]), scale_up(r["y2"], dst[1], src[1]))


def scale_to_original(r: Column, factor: Column) -> Column:
    """Undo a scale; one that cannot be undone leaves the rectangle."""
    bad = factor.isNull() | F.isnan(factor) | (factor <= 0) | (F.abs(factor) == float("inf"))
    return F.when(bad, r).otherwise(scale(r, F.lit(1.0) / F.when(bad, F.lit(1.0)).otherwise(factor)))


def region_crop(r: Column, factor: float, w: int, h: int) -> Column:
    return to_crop(scale(r, factor), w, h)


def xyxy(r: Column) -> Column:
    return F.array(r["x1"], r["y1"], r["x2"], r["y2"])


def from_xyxy(a: Column) -> Column:
    return rect(F.get(a, 0), F.get(a, 1), F.get(a, 2), F.get(a, 3))


def subtract(a: Column, b: Column) -> Column:
    return rect(*(a[n] - b[n] for n in ("x1", "y1", "x2", "y2")))


def round_half_away(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("double")


def round3(v: Column) -> Column:
    return (round_half_away(v.cast("double") * 1000) / 1000).cast("float")


def new_size_and_scale(w: Column, h: Column, lower: int, upper: int) -> Column:
    """Target-height policy: (w, h, scale).

    Heights up to upper, or an unset target, stay.  Without a range (lower not
    below upper) the height becomes upper.  Otherwise the smallest whole divisor
    that gets below upper is used if it stays above lower; failing that, the
    multiple of 4 just below upper, or upper itself where that is under lower.
    """
    high = h.cast("double")
    out = lambda new_h, factor: F.struct(round_half_away(w * factor).cast("int").alias("w"), new_h.cast("int").alias("h"), factor.alias("scale"))
    same = F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"), F.lit(1.0).alias("scale"))
    if lower == 0 or upper == 0:
        return same
    if lower >= upper:
        return F.when(h <= upper, same).otherwise(out(F.lit(upper), F.lit(float(upper)) / high))
    divisor = F.ceil(high / upper)
    whole = F.lit(1.0) / divisor
    four = upper // 4 * 4
    target = F.lit(four if four >= lower else upper)
    return F.when(h <= upper, same).when(divisor <= high / lower, out(round_half_away(h * whole), whole)).otherwise(out(target, target.cast("double") / high))


def letterbox(w: Column, h: Column, side: int = 1024) -> Column:
    """(ratio, new_w, new_h, pad_right, pad_bottom) of a fit into a square."""
    ratio = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    nw, nh = round_half_away(w * ratio).cast("int"), round_half_away(h * ratio).cast("int")
    return F.struct(ratio.alias("ratio"), nw.alias("new_w"), nh.alias("new_h"), (F.lit(side) - nw).alias("pad_right"), (F.lit(side) - nh).alias("pad_bottom"))
