"""Three-vectors as tuples of columns: everything stays a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    """The columns x, y, z with a prefix and suffix."""
    return tuple(F.col(f"{prefix}{k}{suffix}") for k in "xyz")


def const(values) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Vec, least: float = 1e-12) -> Vec:
    """Unit vector; a vector shorter than ``least`` is an error."""
    length = norm(a)
    safe = F.when(length < least, F.raise_error(F.lit("cannot normalise a zero vector")).cast("double")).otherwise(length)
    return tuple(p / safe for p in a)


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def named(a: Vec, prefix: str = "", suffix: str = "") -> dict[str, Column]:
    return {f"{prefix}{k}{suffix}": p for k, p in zip("xyz", a, strict=True)}
