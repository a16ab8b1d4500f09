"""Vectors as structs of doubles x, y, z, w; every function builds a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyzw"


def vec(*parts: Column | float) -> Column:
    """A vector of 2 to 4 components."""
    return F.struct(*[(p if isinstance(p, Column) else F.lit(p)).cast("double").alias(n) for n, p in zip(AXES, parts, strict=False)])


def splat(value: Column | float, n: int) -> Column:
    return vec(*[value] * n)


def zero(n: int) -> Column:
    return splat(0.0, n)


def parts(v: Column, n: int) -> list[Column]:
    return [v[a] for a in AXES[:n]]


def combine(f: Callable[..., Column], n: int, *vs: Column) -> Column:
    return vec(*[f(*p) for p in zip(*[parts(v, n) for v in vs], strict=True)])


def add(a: Column, b: Column, n: int) -> Column:
    return combine(lambda p, q: p + q, n, a, b)


def sub(a: Column, b: Column, n: int) -> Column:
    return combine(lambda p, q: p - q, n, a, b)


def scale(a: Column, s: Column | float, n: int) -> Column:
    return combine(lambda p: p * s, n, a)


def divide(a: Column, s: Column | float, n: int) -> Column:
    return combine(lambda p: p / s, n, a)


def dot(a: Column, b: Column, n: int) -> Column:
    products = [p * q for p, q in zip(parts(a, n), parts(b, n), strict=True)]
    return sum(products[1:], products[0])


def length_squared(a: Column, n: int) -> Column:
    return dot(a, a, n)


def length(a: Column, n: int) -> Column:
    return F.sqrt(dot(a, a, n))


def norm(a: Column, n: int) -> Column:
    """Unit vector; the first axis for the zero vector."""
    size = length(a, n)
    return vec(*[F.when(size != 0, p / size).otherwise(1.0 if i == 0 else 0.0) for i, p in enumerate(parts(a, n))])


def swizzle(v: Column, order: str) -> Column:
    """Components by name, as 'zyx' or 'xx'; one component alone is a number."""
    return v[order] if len(order) == 1 else vec(*[v[c] for c in order])


def extend(v: Column, n: int, *more: Column | float) -> Column:
    """v with further components."""
    return vec(*parts(v, n), *more)


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    """Linear interpolation of numbers, exact at both ends."""
    t = t if isinstance(t, Column) else F.lit(t)
    return F.when(t < 0.5, a + (b - a) * t).otherwise(b + (a - b) * (F.lit(1.0) - t))


def lerp_vec(a: Column, b: Column, t: Column | float, n: int) -> Column:
    return combine(lambda p, q: lerp(p, q, t), n, a, b)
