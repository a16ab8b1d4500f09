"""Colour arithmetic on Columns: normalised and 8-bit channels, packed 5-6-5, YIQ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of the RGB to YIQ matrix and of its counterpart (fixed values).
TO_YIQ = ((0.299, 0.587, 0.114), (0.5959, -0.2746, -0.3213), (0.2115, -0.5227, 0.3112))
FROM_YIQ = ((1.0, 0.956, 0.619), (1.0, -0.272, -0.647), (1.0, -1.106, 1.703))
#: Weights of channels in a pixel's hash (fixed values).
HASH = {"r": 43, "g": 31, "b": 29, "a": 83}
CHANNELS = "rgba"


def normalise(c: Column, top: int = 255) -> Column:
    return c.cast("double") / F.lit(float(top))


def quantise(c: Column, top: int = 255) -> Column:
    """Clamp to 0..1 and truncate to 0..top."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * F.lit(float(top))).cast("long")


def pack565(r: Column, g: Column, b: Column) -> Column:
    """16 bits: 5 of red on top, 6 of green, 5 of blue. Channels must be in range."""
    fits = r.between(0, 31) & g.between(0, 63) & b.between(0, 31)
    return F.when(fits, r * 2048 + g * 32 + b).otherwise(F.raise_error("5-6-5 channel out of range")).cast("long")


def unpack565(bits: Column) -> tuple[Column, Column, Column]:
    bits = bits.cast("long")
    return F.shiftright(bits, 11).bitwiseAND(31), F.shiftright(bits, 5).bitwiseAND(63), bits.bitwiseAND(31)


def from_565(bits: Column) -> tuple[Column, Column, Column]:
    """Normalised channels of packed bits."""
    return tuple(normalise(c, top) for c, top in zip(unpack565(bits), (31, 63, 31), strict=True))


def to_565(r: Column, g: Column, b: Column) -> Column:
    """Packed bits of normalised channels."""
    return pack565(quantise(r, 31), quantise(g, 63), quantise(b, 31))


def interleave565(bits: Column) -> Column:
    """Bits of green, blue and red in turns, from the lowest."""
    r, g, b = unpack565(bits)
    total = F.lit(0).cast("long")
    for k in range(6):
        total = total + F.shiftleft(F.shiftright(g, k).bitwiseAND(1), 3 * k)
        if k < 5:
            total = total + F.shiftleft(F.shiftright(b, k).bitwiseAND(1), 3 * k + 1) + F.shiftleft(F.shiftright(r, k).bitwiseAND(1), 3 * k + 2)
    return total


def deinterleave565(bits: Column) -> Column:
    """The packed bits whose interleaving this is."""
    bits = bits.cast("long")

    def gather(first: int, n: int) -> Column:
        return sum((F.shiftleft(F.shiftright(bits, 3 * k + first).bitwiseAND(1), k) for k in range(1, n)), F.shiftright(bits, first).bitwiseAND(1))

    return pack565(gather(2, 5), gather(0, 6), gather(1, 5))


def wrap_add(a: Column, b: Column, modulus: int = 256) -> Column:
    return F.pmod(a + b, F.lit(modulus)).cast("long")


def wrap_sub(a: Column, b: Column, modulus: int = 256) -> Column:
    return F.pmod(a - b, F.lit(modulus)).cast("long")


def _rows(matrix: tuple, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    return tuple(x * m[0] + y * m[1] + z * m[2] for m in matrix)


def to_yiq(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return _rows(TO_YIQ, r, g, b)


def from_yiq(y: Column, i: Column, q: Column) -> tuple[Column, ...]:
    return _rows(FROM_YIQ, y, i, q)


def perceptual(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of two YIQ colours, chroma weighted a quarter."""
    dy, di, dq = (p - q for p, q in zip(a, b, strict=True))
    return F.sqrt(dy * dy + (di * di + dq * dq) * 0.25)


def pixel_hash(**channels: Column) -> Column:
    return sum((c * HASH[k] for k, c in channels.items()), F.lit(0)).cast("long")


def distance_squared(a: list[Column], b: list[Column]) -> Column:
    d = [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]
    return sum(d[1:], d[0])


def distance(a: list[Column], b: list[Column], mode: str = "faithful") -> Column:
    """Euclidean; of one channel the signed difference, unless mode is 'corrected'."""
    if len(a) == 1:
        return a[0] - b[0] if mode == "faithful" else F.abs(a[0] - b[0])
    return F.sqrt(distance_squared(a, b))
