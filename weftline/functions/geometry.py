"""Intervals, boxes and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length over joint length; of two points 1 if equal, else 0."""
    shared = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    joint = (e1 - s1) + (e2 - s2) - shared
    return F.when(joint > 0, shared / joint).otherwise(F.when((s1 == s2) & (e1 == e2), 1.0).otherwise(0.0))


def box_iou(a: Box, b: Box) -> Column:
    """Boxes are x, y, width, height; empty ones share nothing."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    joint = aw * ah + bw * bh - w * h
    return F.when(joint > 0, w * h / joint).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, of arrays of one length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def hellinger(a: Column, b: Column) -> Column:
    """Distance of two histograms, each made to sum to one."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x) / F.sqrt(total(a) * total(b))
    return F.sqrt(F.greatest(F.lit(1.0) - shared, F.lit(0.0)))


def midpoints(start: Column, end: Column, n: int) -> Column:
    """Middles of ``n`` equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (i + 0.5) * (end - start) / n)


def box_contains(a: Box, x: Column, y: Column) -> Column:
    """Whether a point lies in a box, its left and upper edges included."""
    ax, ay, aw, ah = a
    return (x >= ax) & (x < ax + aw) & (y >= ay) & (y < ay + ah)


def box_padded(a: Box, margin: float, width: Column, height: Column) -> Box:
    """A box grown by a share of its size on each side and clipped to the frame."""
    x, y, w, h = a
    left, top = F.greatest(x - w * margin, F.lit(0.0)), F.greatest(y - h * margin, F.lit(0.0))
    right, bottom = F.least(x + w * (1 + margin), width), F.least(y + h * (1 + margin), height)
    return left, top, F.greatest(right - left, F.lit(0.0)), F.greatest(bottom - top, F.lit(0.0))


def box_hull(a: Box, b: Box) -> Box:
    """The least box around two."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    x, y = F.least(ax, bx), F.least(ay, by)
    return x, y, F.greatest(ax + aw, bx + bw) - x, F.greatest(ay + ah, by + bh) - y


def box_between(a: Box, b: Box, share: Column) -> Box:
    """The box a share of the way from one to the other."""
    return tuple(p + (q - p) * share for p, q in zip(a, b, strict=True))


def in_wearer(a: Box, hands: Column, margin: float, frame_height: Column, bottom_share: float) -> Column:
    """Whether a box is the camera wearer's own body: it reaches the lowest ``bottom_share`` of the frame and holds a hand, its box grown by ``margin``. ``hands`` is an array of x, y structs."""
    x, y, w, h = a
    near = F.exists(hands, lambda p: (p["x"] >= x - w * margin) & (p["x"] <= x + w * (1 + margin)) & (p["y"] >= y - h * margin) & (p["y"] <= y + h * (1 + margin)))
    return (y + h >= frame_height * (1 - bottom_share)) & F.coalesce(near, F.lit(False))


Vector = tuple[Column, Column, Column]


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def inner(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def surface_place(corner: Vector, right: Vector, down: Vector, point: Vector) -> tuple[Column, Column, Column]:
    """A point in the frame of a surface, given by one corner and its neighbours: shares along both edges, and the distance off the plane (null for a surface without area)."""
    u, v, d = minus(right, corner), minus(down, corner), minus(point, corner)
    n = cross(u, v)
    length = F.sqrt(inner(n, n))
    return inner(d, u) / F.nullif(inner(u, u), F.lit(0.0)), inner(d, v) / F.nullif(inner(v, v), F.lit(0.0)), F.abs(inner(d, n)) / F.nullif(length, F.lit(0.0))


def projected(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 projective transform, an array of nine by rows; null at infinity."""
    at = lambda i: F.element_at(matrix, i)
    w = F.nullif(at(7) * x + at(8) * y + at(9), F.lit(0.0))
    return (at(1) * x + at(2) * y + at(3)) / w, (at(4) * x + at(5) * y + at(6)) / w


def composed(a: Column, b: Column) -> Column:
    """The transform that does ``b`` first and then ``a``."""
    at = lambda m, r, c: F.element_at(m, 3 * r + c + 1)
    return F.array(*(sum((at(a, r, k) * at(b, k, c) for k in range(1, 3)), at(a, r, 0) * at(b, 0, c)) for r in range(3) for c in range(3)))


def inverted(m: Column) -> Column:
    """The inverse transform, but for a factor; null if there is none."""
    a, b, c, d, e, f, g, h, i = (F.element_at(m, k) for k in range(1, 10))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return F.when(det != 0, F.array(e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d))
