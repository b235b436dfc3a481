"""Box arithmetic on columns. A box is four corner columns, top-left origin."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    """The box held in columns `{prefix}x1 .. {prefix}y2`."""
    return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def field_box(struct: Column) -> Box:
    """The box held in fields of a struct column."""
    return Box(*(struct[c] for c in ("x1", "y1", "x2", "y2")))


def as_columns(b: Box, prefix: str = "") -> dict[str, Column]:
    """For `withColumns`."""
    return {f"{prefix}{n}": c for n, c in zip(Box._fields, b)}


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return width(b) * height(b)


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / 2


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / 2


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def contains_point(b: Box, x: Column, y: Column) -> Column:
    """Bounds are inclusive."""
    return (b.x1 <= x) & (x <= b.x2) & (b.y1 <= y) & (y <= b.y2)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the boxes do not overlap or the union is
    not positive. NULL coordinates give 0."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), F.try_divide(inter, union)).otherwise(0.0)


def exceeds_iou(a: Box, b: Box, threshold: float, inclusive: bool = False) -> Column:
    """The suppression test, with `>` or `>=`. Compares the quotient, so results
    agree with a scalar implementation at the boundary."""
    value = iou(a, b)
    return value >= threshold if inclusive else value > threshold


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 unless both areas are positive."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, F.try_divide(intersection(a, b), smaller)).otherwise(0.0)


def expand_ratio(b: Box, ratio: float = 1.0) -> Box:
    """Grow each side by a share of the box, clamped at the page origin."""
    dx, dy = width(b) * ratio, height(b) * ratio
    zero = F.lit(0.0)
    return Box(F.greatest(zero, b.x1 - dx), F.greatest(zero, b.y1 - dy), b.x2 + dx, b.y2 + dy)


def expand_within(b: Box, ratio: float, image_w: Column, image_h: Column) -> Box:
    """Grow by a whole number of pixels and clip to the image."""
    dx = (width(b) * ratio).cast("int")
    dy = (height(b) * ratio).cast("int")
    zero = F.lit(0)
    return Box(
        F.greatest(zero, b.x1 - dx),
        F.greatest(zero, b.y1 - dy),
        F.least(image_w, b.x2 + dx),
        F.least(image_h, b.y2 + dy),
    )


def pad(b: Box, amount: float) -> Box:
    return Box(b.x1 - amount, b.y1 - amount, b.x2 + amount, b.y2 + amount)


def shift(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def scale(b: Box, sx: Column, sy: Column) -> Box:
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def ordered(b: Box) -> Box:
    """Swap corners so that x1 <= x2 and y1 <= y2."""
    return Box(
        F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2)
    )


def clip(b: Box, w: Column, h: Column) -> Box:
    zero = F.lit(0.0)
    return Box(
        F.greatest(zero, b.x1), F.greatest(zero, b.y1), F.least(w, b.x2), F.least(h, b.y2)
    )


def rotate(b: Box, rotation: Column, media_w: Column, media_h: Column) -> Box:
    """Map a box seen on a rotated page onto the unrotated media box. Angles other
    than 90, 180 and 270 leave it unchanged."""

    def pick(quarter, half, three_quarters, unchanged):
        return (
            F.when(rotation == 90, quarter)
            .when(rotation == 180, half)
            .when(rotation == 270, three_quarters)
            .otherwise(unchanged)
        )

    turned = ordered(Box(b.y1, media_h - b.x2, b.y2, media_h - b.x1))
    return Box(
        pick(turned.x1, media_w - b.x2, media_w - b.y2, b.x1),
        pick(turned.y1, media_h - b.y2, b.x1, b.y1),
        pick(turned.x2, media_w - b.x1, media_w - b.y1, b.x2),
        pick(turned.y2, media_h - b.y1, b.x2, b.y2),
    )


def turn_counterclockwise(b: Box, image_w, image_h, page_w: Column, page_h: Column) -> Box:
    """Scale an image box to the page, then rotate it 90 degrees counter-clockwise."""
    s = scale(b, page_w / image_w, page_h / image_h)
    return ordered(Box(s.y1, page_w - s.x1, s.y2, page_w - s.x2))


def polygon_box(points: Column) -> Box:
    """Enclosing box of `array<array<double>>` points."""
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def has_box(b: Box) -> Column:
    return b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull()
