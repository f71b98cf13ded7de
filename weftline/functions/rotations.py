"""Rotations as column expressions: unit quaternions are arrays [w, x, y, z], vectors arrays [x, y, z].

Arguments are bound to a name before their parts are taken, so that expressions of expressions
stay as large as their sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is evaluated once."""
    return F.element_at(F.transform(F.array(column), use), 1)


def _parts(a: Column, n: int) -> list[Column]:
    return [F.element_at(a, i + 1) for i in range(n)]


def times(a: Column, b: Column) -> Column:
    """The rotation that does ``b`` first and then ``a``."""

    def product(a: Column, b: Column) -> Column:
        (w, x, y, z), (s, p, q, r) = _parts(a, 4), _parts(b, 4)
        return F.array(w * s - x * p - y * q - z * r, w * p + x * s + y * r - z * q, w * q - x * r + y * s + z * p, w * r + x * q - y * p + z * s)

    return bound(a, lambda a: bound(b, lambda b: product(a, b)))


def inverse(q: Column) -> Column:
    def turned_back(q: Column) -> Column:
        w, x, y, z = _parts(q, 4)
        return F.array(w, -x, -y, -z)

    return bound(q, turned_back)


def unit(q: Column) -> Column:
    """Made of length one; null for a zero quaternion."""
    return bound(q, lambda q: bound(F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, v: s + v * v)), lambda n: F.when(n > 0, F.transform(q, lambda v: v / n))))


def rotated(q: Column, v: Column) -> Column:
    """A vector turned by a unit quaternion."""

    def turned(q: Column, v: Column) -> Column:
        (w, x, y, z), (a, b, c) = _parts(q, 4), _parts(v, 3)
        s, t, u = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
        return F.array(a + w * s + y * u - z * t, b + w * t + z * s - x * u, c + w * u + x * t - y * s)

    return bound(q, lambda q: bound(v, lambda v: turned(q, v)))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def exponential(v: Column) -> Column:
    """The rotation by the length of ``v``, in radians, around it."""

    def raised(v: Column, angle: Column) -> Column:
        k = F.when(angle > 1e-12, F.sin(angle / 2) / F.nullif(angle, F.lit(0.0))).otherwise(0.5)
        return bound(k, lambda k: F.array(F.cos(angle / 2), *(k * x for x in _parts(v, 3))))

    return bound(v, lambda v: bound(_length(v), lambda angle: raised(v, angle)))


def logarithm(q: Column) -> Column:
    """The vector that a rotation is the exponential of, of a length up to pi."""

    def lowered(w: Column, v: Column, length: Column) -> Column:
        sign = F.when(w < 0, -1.0).otherwise(1.0)
        k = sign * F.when(length > 1e-12, 2 * F.atan2(length, w * sign) / F.nullif(length, F.lit(0.0))).otherwise(2.0)
        return bound(k, lambda k: F.transform(v, lambda x: k * x))

    return bound(q, lambda q: bound(F.slice(q, 2, 3), lambda v: bound(_length(v), lambda n: lowered(F.element_at(q, 1), v, n))))


def angle(a: Column, b: Column) -> Column:
    """Radians between two rotations, 0 to pi."""
    return _length(logarithm(times(inverse(a), b)))


def slerp(a: Column, b: Column, share: Column) -> Column:
    """The rotation a share of the way from one to the other, the short way round."""
    return bound(a, lambda a: times(a, exponential(F.transform(logarithm(times(inverse(a), b)), lambda v: v * share))))


def from_matrix(m: Column) -> Column:
    """The quaternion of a rotation matrix, an array of nine by rows, from its largest component."""

    def read(m: Column) -> Column:
        a, b, c, d, e, f, g, h, i = _parts(m, 9)
        w, x, y, z = a + e + i, a - e - i, e - a - i, i - a - e
        most = F.greatest(w, x, y, z)
        of = lambda s: (
            F.when(most == w, F.array(s / 4, (h - f) / s, (c - g) / s, (d - b) / s)).when(most == x, F.array((h - f) / s, s / 4, (b + d) / s, (c + g) / s))
            .when(most == y, F.array((c - g) / s, (b + d) / s, s / 4, (f + h) / s)).otherwise(F.array((d - b) / s, (c + g) / s, (f + h) / s, s / 4))
        )
        return bound(2 * F.sqrt(F.greatest(most + 1, F.lit(0.0))), of)

    return bound(m, read)


def to_matrix(q: Column) -> Column:
    """The rotation matrix of a unit quaternion, nine by rows."""

    def spread(q: Column) -> Column:
        w, x, y, z = _parts(q, 4)
        return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))

    return bound(q, spread)
