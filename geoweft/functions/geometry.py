"""Column expressions of vectors and boxes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def cols(names: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in names]


def add(a: Vector, b: Vector) -> list[Column]:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a: Vector, s: Column) -> list[Column]:
    return [x * s for x in a]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda s, t: s + t, (x * y for x, y in zip(a, b, strict=True)))


def squared_distance(a: Vector, b: Vector) -> Column:
    d = sub(a, b)
    return dot(d, d)


def cross2(a: Vector, b: Vector) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def cross3(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def box_distance_sq(q: Vector, lo: Vector, hi: Vector) -> Column:
    """Least squared distance from a point to a box, 0 inside."""
    gap = [F.greatest(a - x, F.lit(0.0), x - b) for x, a, b in zip(q, lo, hi, strict=True)]
    return dot(gap, gap)


def box_distance_max_sq(q: Vector, lo: Vector, hi: Vector) -> Column:
    """Greatest squared distance from a point to a box."""
    far = [F.greatest(F.abs(x - a), F.abs(b - x)) for x, a, b in zip(q, lo, hi, strict=True)]
    return dot(far, far)


def ray_meets_box(o: Vector, d: Vector, lo: Vector, hi: Vector, t_min: Column, t_max: Column) -> Column:
    """Slab test, bounds included; along an axis without direction the origin must be inside."""
    near, far, inside = t_min, t_max, F.lit(True)
    for x, v, a, b in zip(o, d, lo, hi, strict=True):
        moves = v != 0
        t0, t1 = F.when(moves, (a - x) / v), F.when(moves, (b - x) / v)
        near = F.greatest(near, F.least(t0, t1))  # null without direction: ignored by greatest
        far = F.least(far, F.greatest(t0, t1))
        inside = inside & (moves | ((x >= a) & (x <= b)))
    return inside & (near <= far)
