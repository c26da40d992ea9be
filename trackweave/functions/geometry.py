"""Boxes as Column expressions: (x, y, w, h) integers in a frame of given size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def as_box(box: Box) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in zip(box, "xywh")])


def parts(column: str) -> Box:
    return tuple(F.col(f"{column}.{n}") for n in "xywh")


def normalized(struct: Column, listed: Column) -> Column:
    """A box given as a struct or as a list of four; the struct wins."""
    return F.coalesce(struct, F.when(F.size(listed) == 4, F.struct(*[F.get(listed, i).cast("int").alias(n) for i, n in enumerate("xywh")])))


def clamp(box: Box, width, height) -> Box:
    """Corner into the frame first, then sides cut to it, one pixel at least."""
    x, y, w, h = box
    x, y = F.greatest(F.lit(0), F.least(F.lit(width - 1), x)), F.greatest(F.lit(0), F.least(F.lit(height - 1), y))
    return x, y, F.greatest(F.lit(1), F.least(F.lit(width) - x, w)), F.greatest(F.lit(1), F.least(F.lit(height) - y, h))


def clamp_or_null(box: Box, width, height) -> Column:
    """Intersection with the frame, or null where it is empty."""
    x, y, w, h = box
    x0, y0 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    x1, y1 = F.least(F.lit(width), x + w), F.least(F.lit(height), y + h)
    return F.when((x1 > x0) & (y1 > y0), as_box((x0, y0, x1 - x0, y1 - y0)))


def shift_inside(box: Box, width, height, least: int = 8) -> Box:
    """Sides between ``least`` and the frame's, then the box moved inside."""
    x, y, w, h = box
    w, h = F.greatest(F.lit(least), F.least(w, F.lit(width))), F.greatest(F.lit(least), F.least(h, F.lit(height)))
    return F.greatest(F.lit(0), F.least(F.lit(width) - w, x)), F.greatest(F.lit(0), F.least(F.lit(height) - h, y)), w, h


def expand(box: Box, margin: float, width, height) -> Box:
    """Widened by a share of each side (half-even rounding) on both ends, then clamped."""
    x, y, w, h = box
    mx, my = F.bround(w * F.lit(float(margin))).cast("int"), F.bround(h * F.lit(float(margin))).cast("int")
    return clamp((x - mx, y - my, w + 2 * mx, h + 2 * my), width, height)


def centre(box: Box) -> tuple[Column, Column]:
    x, y, w, h = box
    return x + w / F.lit(2.0), y + h / F.lit(2.0)


def intersection(a: Box, b: Box) -> Column:
    across = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    down = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return (F.greatest(F.lit(0), across) * F.greatest(F.lit(0), down)).cast("double")


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return intersection(a, b) / F.greatest(F.lit(1), F.least(a[2] * a[3], b[2] * b[3]))


def touches_edge(box: Box, width: float, height: float, share: float) -> Column:
    x, y, w, h = box
    return (x <= width * share) | (y <= height * share) | (x + w >= width * (1 - share)) | (y + h >= height * (1 - share))


def edge_artifact(box: Box, width: int | Column, height: int | Column) -> Column:
    """A candidate too small, too large, too wide, or tiny and at the edge."""
    _, _, w, h = box
    whole = (F.lit(width) * F.lit(height)).cast("double")
    share = (w * h) / whole
    small = w * h < F.greatest(F.lit(12.0), whole * 0.000015)
    wide = (w > width * 0.65) | (h > height * 0.65)
    near = (box[0] <= width * 0.025) | (box[1] <= height * 0.025) | (box[0] + w >= width - width * 0.025) | (box[1] + h >= height - height * 0.025)
    return small | (share > 0.18) | wide | (near & (share < 0.0003))


def grid_cells(box: Box, size: int) -> Column:
    """The square grid cells that a box covers, as an array of (cx, cy): an equi-join key for overlap joins."""
    x, y, w, h = box
    across, down = F.sequence(F.floor(x / size), F.floor((x + w - 1) / size)), F.sequence(F.floor(y / size), F.floor((y + h - 1) / size))
    return F.flatten(F.transform(across, lambda i: F.transform(down, lambda j: F.struct(i.alias("i"), j.alias("j")))))
