"""Plane and space geometry as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def vector(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> list[Column]:
    """Zero vectors give null."""
    size = norm(a)
    return [F.when(size > 0, x / size) for x in a]


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    """Half the cross product: no cancellation on slivers, never NaN for finite corners."""
    return norm(cross(minus(b, a), minus(c, a))) / 2


def project(point: Vector, base: Vector, normal: Vector) -> list[Column]:
    """Onto the plane or line through ``base`` with unit normal."""
    away = dot(minus(point, base), normal)
    return [p - n * away for p, n in zip(point, normal, strict=True)]


def overlap_length(a: Vector, b: Vector, p: Vector, q: Vector) -> Column:
    """Length of segment a-b that segment p-q covers when projected onto it; 0 for a base shorter than 1e-20."""
    along = minus(b, a)
    size = dot(along, along)
    tp, tq = (dot(minus(x, a), along) / size for x in (p, q))
    cover = F.least(F.lit(1.0), F.greatest(tp, tq)) - F.greatest(F.lit(0.0), F.least(tp, tq))
    return F.when(size > 1e-40, F.greatest(F.lit(0.0), cover) * F.sqrt(size)).otherwise(F.lit(0.0))


def longest_side(a: Vector, b: Vector, c: Vector) -> Column:
    """0, 1 or 2: the side a-b, b-c or c-a; the first of equals."""
    sides = [norm(minus(y, x)) for x, y in ((a, b), (b, c), (c, a))]
    most = F.greatest(*sides)
    return F.when(sides[0] == most, 0).when(sides[1] == most, 1).otherwise(2)


def clip_to_plane(p: Vector, q: Vector, normal: Vector, base: Vector, eps: float = 0.0) -> tuple[Column, Column, list[Column]]:
    """Whether p and q lie on the inner side (against the normal, within eps), and where the segment meets the plane."""
    dp, dq = dot(minus(p, base), normal), dot(minus(q, base), normal)
    t = F.when(dp != dq, dp / (dp - dq)).otherwise(F.lit(0.0))
    return dp < eps, dq < eps, [x + (y - x) * t for x, y in zip(p, q, strict=True)]


def shoelace(points: Column) -> Column:
    """Area of a polygon given as an array of structs with x and y, in either direction; 0 for fewer than 3 points."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(F.lit(0.0))
