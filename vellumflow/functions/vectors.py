"""Numeric, bit and lane functions.  Vectors are float arrays; lanes are positions from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAREST = (4, 8, 16, 32, 64)

# Reciprocal constants for fractions and for scaling 8- and 16-bit integers.
CONSTANTS = {"2/3": 2 / 3, "1/3": 1 / 3, "1/6": 1 / 6, "1/127": 1 / 127, "1/128": 1 / 128, "1/255": 1 / 255, "1/256": 1 / 256, "1/32767": 1 / 32767, "1/32768": 1 / 32768, "1/65535": 1 / 65535, "1/65536": 1 / 65536}


def minimum(a: Column, b: Column) -> Column:
    """The smaller; ``b`` if either is NaN (unlike ``least``)."""
    return F.when(~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")) & (a < b), a).otherwise(b)


def maximum(a: Column, b: Column) -> Column:
    """The larger; ``b`` if either is NaN (unlike ``greatest``)."""
    return F.when(~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")) & (a > b), a).otherwise(b)


def lane_max(v: Column, lanes: int | None = None) -> Column:
    """The largest of all lanes, or of the first ``lanes``."""
    return F.array_max(v if lanes is None else F.slice(v, 1, lanes))


def scale3(v: Column, factor: Column) -> Column:
    """The first three lanes scaled; others unchanged."""
    return F.transform(v, lambda x, i: F.when(i < 3, x * factor).otherwise(x))


def fused(a: Column, b: Column, c: Column, kind: str = "fmadd") -> Column:
    """Lane-wise ab+c (fmadd), ab-c (fmsub) or c-ab (fnmadd)."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    combine = {"fmadd": lambda p, z: p + z, "fmsub": lambda p, z: p - z, "fnmadd": lambda p, z: z - p}[kind]
    return F.zip_with(products, c, combine)


def absolute(v: Column) -> Column:
    return F.transform(v, F.abs)


def sincos(angle: Column) -> Column:
    return F.struct(F.sin(angle).alias("sin"), F.cos(angle).alias("cos"))


def move_along(x: Column, y: Column, angle: Column, distance: Column) -> Column:
    """x - d sin, y + d cos."""
    return F.struct((x - distance * F.sin(angle)).alias("x"), (y + distance * F.cos(angle)).alias("y"))


def rotate(x: Column, y: Column, angle: Column, origin_x: Column | float = 0.0, origin_y: Column | float = 0.0) -> Column:
    """The point turned by an angle about an origin."""
    ox, oy = (o if isinstance(o, Column) else F.lit(o) for o in (origin_x, origin_y))
    dx, dy = x - ox, y - oy
    return F.struct((ox + dx * F.cos(angle) - dy * F.sin(angle)).alias("x"), (oy + dx * F.sin(angle) + dy * F.cos(angle)).alias("y"))


def all_true(source: Column, compare: Column) -> Column:
    """Every bit of ``compare`` is set in ``source``."""
    return source.bitwiseAND(compare) == compare


def all_false(source: Column, compare: Column) -> Column:
    """No bit of ``compare`` is set in ``source``."""
    return source.bitwiseAND(compare) == 0


def round_down(x: Column, n: int) -> Column:
    """To the multiple of a power of two at or below, for negatives too."""
    return x.bitwiseAND(F.lit(-n))


def round_up(x: Column, n: int) -> Column:
    """To the multiple of a power of two at or above; raises on overflow."""
    return (x + F.lit(n - 1)).bitwiseAND(F.lit(-n))


def low24(x: Column) -> Column:
    """The low three bytes, little-endian."""
    be = F.unhex(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))
    return F.concat(F.substr(be, F.lit(3), F.lit(1)), F.substr(be, F.lit(2), F.lit(1)), F.substr(be, F.lit(1), F.lit(1)))


def splat(value: Column, lanes: Column | int) -> Column:
    """A vector with the value in every lane."""
    return F.array_repeat(value, lanes)


def filled(value: Column, *dims: Column | int) -> Column:
    """An array of the given dimensions, outermost first, that holds the value everywhere."""
    for n in reversed(dims):
        value = F.array_repeat(value, n)
    return value


def swapped(a: str, b: str) -> list[Column]:
    """A projection that exchanges two columns."""
    return [F.col(b).alias(a), F.col(a).alias(b)]
