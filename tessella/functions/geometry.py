"""Geometry as column expressions: boxes, rings, affine transforms and rotated rectangles.

A box is four columns (xmin, ymin, xmax, ymax); a ring is an array of struct<x, y>; an affine transform is the six numbers
a..f of x' = a x + b y + c, y' = d x + e y + f.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int
Affine = Sequence[Number]


def lit(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def overlaps(a: Sequence[Number], b: Sequence[Number]) -> Column:
    """Closed boxes that share a point; the four comparisons reach a scan as pushed filters when b is constant."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = map(lambda box: [lit(v) for v in box], (a, b))
    return (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)


def inside(a: Sequence[Number], b: Sequence[Number]) -> Column:
    """Box a lies in box b; touching edges count as inside."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = map(lambda box: [lit(v) for v in box], (a, b))
    return (ax0 >= bx0) & (ay0 >= by0) & (ax1 <= bx1) & (ay1 <= by1)


def clip_box(a: Sequence[Number], b: Sequence[Number]) -> list[Column]:
    """Corners of the intersection of two boxes; empty where a minimum is above its maximum."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = map(lambda box: [lit(v) for v in box], (a, b))
    return [F.greatest(ax0, bx0), F.greatest(ay0, by0), F.least(ax1, bx1), F.least(ay1, by1)]


def box_area(box: Sequence[Number]) -> Column:
    x0, y0, x1, y1 = map(lit, box)
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def apply_affine(t: Affine, x: Number, y: Number) -> tuple[Column, Column]:
    a, b, c, d, e, f = map(lit, t)
    return a * lit(x) + b * lit(y) + c, d * lit(x) + e * lit(y) + f


def inverse_affine(t: Affine, x: Number, y: Number) -> tuple[Column, Column]:
    """Pixel coordinates of a point, without rounding."""
    a, b, c, d, e, f = map(lit, t)
    det = a * e - b * d
    dx, dy = lit(x) - c, lit(y) - f
    return (e * dx - b * dy) / det, (a * dy - d * dx) / det


def rotated_corners(cx: Number, cy: Number, height: Number, width: Number, angle: Number) -> list[tuple[Column, Column]]:
    """Corners TL, TR, BR, BL of a rectangle turned counter-clockwise about its centre."""
    cx, cy, h, w = lit(cx), lit(cy), lit(height), lit(width)
    cos, sin = F.cos(F.radians(lit(angle))), F.sin(F.radians(lit(angle)))
    out = []
    for sx, sy in ((-1, 1), (1, 1), (1, -1), (-1, -1)):
        dx, dy = w * (sx / 2), h * (sy / 2)
        out.append((dx * cos - dy * sin + cx, dx * sin + dy * cos + cy))
    return out


def rotated_pixel_box(height: Number, width: Number, angle: Number) -> tuple[Column, Column]:
    """Whole pixels of the box around a rotated crop: its width and height."""
    h, w = lit(height), lit(width)
    cos, sin = F.abs(F.cos(F.radians(lit(angle)))), F.abs(F.sin(F.radians(lit(angle))))
    return (h * sin + w * cos).cast("int"), (h * cos + w * sin).cast("int")


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace rule, closed or not, in either direction."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_envelope(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def ring_contains(ring: Column, x: Number, y: Number) -> Column:
    """Even-odd rule, with edges half-open in y."""
    x, y = lit(x), lit(y)
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    crossed = F.zip_with(
        ring,
        following,
        lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def _edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def edges_cross(e: Column, g: Column) -> Column:
    """Two edges cross in a point inside both."""
    side = lambda e, x, y: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    return (side(e, g["ax"], g["ay"]) * side(e, g["bx"], g["by"]) < 0) & (side(g, e["ax"], e["ay"]) * side(g, e["bx"], e["by"]) < 0)


def ring_in_ring(inner: Column, outer: Column) -> Column:
    """All corners of the inner ring are in the outer one, and no edges cross."""
    corners = F.forall(inner, lambda p: ring_contains(outer, p["x"], p["y"]))
    return corners & ~F.exists(_edges(inner), lambda e: F.exists(_edges(outer), lambda g: edges_cross(e, g)))


def box_ring(box: Sequence[Number]) -> Column:
    x0, y0, x1, y1 = map(lit, box)
    corners = ((x0, y1), (x1, y1), (x1, y0), (x0, y0))
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def turn_back(cx: Number, cy: Number, x: Number, y: Number, angle: Number) -> tuple[Column, Column]:
    """A point turned by minus the angle about a centre."""
    cos, sin = F.cos(F.radians(lit(angle))), F.sin(F.radians(lit(angle)))
    dx, dy = lit(x) - lit(cx), lit(y) - lit(cy)
    return dx * cos + dy * sin + lit(cx), dy * cos - dx * sin + lit(cy)
