"""Column functions over boxes (x1, y1, x2, y2), masks and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def intersects(a: Box, b: Box, margin: float = 0.0) -> Column:
    """Closed intervals: touching counts; the margin widens the second box."""
    return (a[0] <= b[2] + margin) & (a[2] >= b[0] - margin) & (a[1] <= b[3] + margin) & (a[3] >= b[1] - margin)


def overlap_area(a: Box, b: Box) -> Column:
    """G3."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(a: Box) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def overlap_percent(a: Box, b: Box) -> Column:
    """Of the smaller box; 0 where it is empty."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, 100.0 * overlap_area(a, b) / small).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """G4."""
    both = overlap_area(a, b)
    return both / (area(a) + area(b) - both)


def ring_box(ring: Column) -> Column:
    """Bounds of a polygon ring, an array of [x, y]."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def inclusive_area(a: Box) -> Column:
    """Pixels of a box whose ends both belong to it."""
    return (a[2] - a[0] + 1) * (a[3] - a[1] + 1)


def crop_window(a: Box, width: Column, height: Column, context: float = 1.2) -> Column:
    """Square window around a box with context, shifted and cut to stay inside the slide."""
    side = F.least((F.greatest(a[2] - a[0], a[3] - a[1]) * context).cast("int"), width.cast("int"), height.cast("int"))
    left = ((a[0] + a[2]) / 2 - side / 2).cast("int")
    top = ((a[1] + a[3]) / 2 - side / 2).cast("int")
    left = F.greatest(F.lit(0), F.least(left, width.cast("int") - side))
    top = F.greatest(F.lit(0), F.least(top, height.cast("int") - side))
    return F.struct(left.alias("left"), top.alias("top"), side.alias("side"))


def margin_window(a: Box, width: Column, height: Column, margin: int) -> Column:
    """Box with a margin; low edges clamp to 0, sizes end at the slide."""
    left, top = F.greatest(a[0] - margin, F.lit(0)), F.greatest(a[1] - margin, F.lit(0))
    return F.struct(left.alias("left"), top.alias("top"), F.least(a[2] + margin, width).alias("right"), F.least(a[3] + margin, height).alias("bottom"))


def token_window(tok_x: Column, tok_y: Column, size: int, stride: int = 14) -> Column:
    """Patch around a token's centre; the top-left corner is clamped at 0."""
    at = lambda t: F.greatest(t * stride + stride // 2 - size // 2, F.lit(0))
    return F.struct(at(tok_x).alias("left"), at(tok_y).alias("top"))


def size_class(polar: Column, equatorial: Column) -> Column:
    """By the mean axis: small below 20, medium-sized below 50, else large."""
    mean = (polar + equatorial) / 2
    return F.when(mean < 20, "small").when(mean < 50, "medium-sized").otherwise("large")


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 where both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    """Rounded to four places, 0 where there is no whole (A4)."""
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0)), 4)
