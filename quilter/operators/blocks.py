"""Decoding of compressed 4 by 4 blocks, their bytes and constants, by plain expressions: no lambdas, so all of it is compiled.

Decoders turn a table of blocks into a table of texels: the block's columns, k (0 to 15 in row order) and the channels.
A block's palette and its packed indices are columns before its texels are told apart, so both are computed once a block.

Blocks are columns: c0, c1 (16-bit colours) and t0..t3 (a byte of four 2-bit indices for each row);
d0, d1 (8-bit ends) and u0..u5 (16 3-bit indices, lowest first); a0..a7 (16 4-bit alphas).
Palettes are in linear order from the first end to the second.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilter.functions.colour import from_565, normalise
from quilter.functions.vector import lerp

TEXELS = 16
#: Blocks of one colour: ends, index of every texel (fixed values).
WHITE565, BLACK565 = 0xFFFF, 0x0000
CONSTANTS = {
    "bc1_black": {"c0": 0xFFFF, "c1": 0x0000, "index": 3},
    "bc1_white": {"c0": 0xFFFF, "c1": 0x0000, "index": 0},
    "bc1_transparent": {"c0": 0x0000, "c1": 0x0000, "index": 3},
    "bc4_black": {"c0": 255, "c1": 0, "index": 7},
    "bc4_white": {"c0": 255, "c1": 0, "index": 0},
}
#: Blocks of one colour made of two halves: a constant, or eight equal bytes of alpha (fixed values).
COMPOSED = {
    "bc2_black": (0xFF, "bc1_black"),
    "bc2_white": (0xFF, "bc1_white"),
    "bc2_transparent": (0x00, "bc1_transparent"),
    "bc3_black": ("bc4_white", "bc1_black"),
    "bc3_white": ("bc4_white", "bc1_white"),
    "bc3_transparent": ("bc4_black", "bc1_black"),
    "bc5_black": ("bc4_black", "bc4_black"),
    "bc5_white": ("bc4_white", "bc4_white"),
}


def constant_bytes(name: str | int) -> bytes:
    """A constant as its block's bytes."""
    if isinstance(name, int):
        return bytes([name] * 8)
    if name in COMPOSED:
        return b"".join(map(constant_bytes, COMPOSED[name]))
    c = CONSTANTS[name]
    end, bits = (2, 2) if name.startswith("bc1") else (1, 3)
    index = sum(c["index"] << bits * k for k in range(TEXELS))
    return c["c0"].to_bytes(end, "little") + c["c1"].to_bytes(end, "little") + index.to_bytes(TEXELS * bits // 8, "little")


def palette4(c0: Column, c1: Column) -> list[list[Column]]:
    """Four colours from the first end to the second."""
    a, b = from_565(c0), from_565(c1)
    return [list(a), [lerp(p, q, 1 / 3) for p, q in zip(a, b, strict=True)], [lerp(p, q, 2 / 3) for p, q in zip(a, b, strict=True)], list(b)]


def palette3(c0: Column, c1: Column) -> list[list[Column]]:
    """Three colours and black."""
    a, b = from_565(c0), from_565(c1)
    return [list(a), [lerp(p, q, 0.5) for p, q in zip(a, b, strict=True)], list(b), [F.lit(0.0)] * 3]


def _struct(parts: Sequence[Column], names: str = "rgba") -> Column:
    return F.struct(*[p.alias(n) for n, p in zip(names, parts, strict=False)])


def colour_palette(c0: Column, c1: Column, alpha: bool = False, four_only: bool = False) -> Column:
    """Array of four colours; in the mode of three the last is black, and transparent if there is alpha."""
    four = F.array(*[_struct([*p, F.lit(1.0)] if alpha else p) for p in palette4(c0, c1)])
    if four_only:
        return four
    three = palette3(c0, c1)
    three = F.array(*[_struct([*p, F.lit(0.0 if i == 3 else 1.0)] if alpha else p) for i, p in enumerate(three)])
    return F.when(c0 > c1, four).otherwise(three)


def scalar_palette(d0: Column, d1: Column) -> Column:
    """Array of eight values; if the first end is not larger, six and then 0 and 1."""
    a, b = normalise(d0), normalise(d1)
    eight = F.array(*[lerp(a, b, k / 7) if 0 < k < 7 else (a if k == 0 else b) for k in range(8)])
    six = F.array(*[lerp(a, b, k / 5) if 0 < k < 5 else (a if k == 0 else b) for k in range(6)], F.lit(0.0), F.lit(1.0))
    return F.when(d0 > d1, eight).otherwise(six)


def field(name: str) -> Callable[[Column], Column]:
    """For transform: a struct's field."""
    return lambda t: t[name]


def join_bytes(parts: Sequence[Column]) -> Column:
    """Bytes as one number, the first lowest."""
    return sum((F.shiftleft(p.cast("long"), 8 * i) for i, p in enumerate(parts[1:], 1)), parts[0].cast("long"))


def _index(packed: str, bits: int, k: Column | None = None) -> Column:
    """Index of texel k in a column of packed indices."""
    shift = ((F.col("k") if k is None else k) * bits).cast("int")
    return F.call_function("shiftright", F.col(packed), shift).bitwiseAND((1 << bits) - 1)


def _entry(palette: str, packed: str, bits: int) -> Column:
    """Palette entry of texel k."""
    return F.element_at(palette, _index(packed, bits).cast("int") + 1)


def _texels(df: DataFrame, parts: dict[str, Column], channels: dict[str, Column]) -> DataFrame:
    d = df.withColumns(parts).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TEXELS - 1).cast("long"))))
    return d.withColumns(channels).drop(*parts)


def _colours(c0: Column, c1: Column, rows: Sequence[Column], alpha: bool = False, four_only: bool = False) -> dict[str, Column]:
    return {"palette_": colour_palette(c0, c1, alpha, four_only), "packed_": join_bytes(rows)}


def _values(d0: Column, d1: Column, packed: Sequence[Column], prefix: str = "v") -> dict[str, Column]:
    return {f"{prefix}_palette_": scalar_palette(d0, d1), f"{prefix}_packed_": join_bytes(packed)}


def _picked(channels: str) -> dict[str, Column]:
    return {c: _entry("palette_", "packed_", 2)[c] for c in channels}


def decode_bc1(df: DataFrame, c0: Column, c1: Column, rows: Sequence[Column], alpha: bool = False) -> DataFrame:
    """Colours r, g, b and, with alpha, a."""
    return _texels(df, _colours(c0, c1, rows, alpha), _picked("rgba" if alpha else "rgb"))


def decode_bc2(df: DataFrame, c0: Column, c1: Column, rows: Sequence[Column], alpha_bytes: Sequence[Column], mode: str = "faithful") -> DataFrame:
    """Colours with 4-bit alpha: always four colours, or as without alpha if mode is 'corrected'."""
    # two numbers of 32 bits, as 64 bits have a sign
    parts = _colours(c0, c1, rows, four_only=mode == "faithful") | {"low_": join_bytes(alpha_bytes[:4]), "high_": join_bytes(alpha_bytes[4:])}
    k = F.col("k")
    alpha = F.when(k < 8, _index("low_", 4)).otherwise(_index("high_", 4, k - 8))
    return _texels(df, parts, _picked("rgb") | {"a": alpha.cast("double") / 15.0})


def decode_bc3(df: DataFrame, c0: Column, c1: Column, rows: Sequence[Column], d0: Column, d1: Column, packed: Sequence[Column]) -> DataFrame:
    """Colours of the first kind of block with alphas of the fourth."""
    return _texels(df, _colours(c0, c1, rows) | _values(d0, d1, packed), _picked("rgb") | {"a": _entry("v_palette_", "v_packed_", 3)})


def decode_bc4(df: DataFrame, d0: Column, d1: Column, packed: Sequence[Column]) -> DataFrame:
    """Values v."""
    return _texels(df, _values(d0, d1, packed), {"v": _entry("v_palette_", "v_packed_", 3)})


def decode_bc5(df: DataFrame, red: tuple, green: tuple) -> DataFrame:
    """Values r and g."""
    return _texels(df, _values(*red, "red") | _values(*green, "green"), {c: _entry(f"{n}_palette_", f"{n}_packed_", 3) for c, n in (("r", "red"), ("g", "green"))})


def hex_bytes(parts: Sequence[tuple[Column, int]]) -> Column:
    """Numbers of so many bytes each, lowest byte first, as upper-case hexadecimal."""
    out = [F.lpad(F.hex(F.shiftright(p.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for p, size in parts for i in range(size)]
    return F.concat(*out)


def number_at(data: Column, at: int, size: int) -> Column:
    """Number of so many bytes, lowest first, at a byte of a hexadecimal string."""
    one = lambda i: F.conv(F.substring(data, 2 * (at + i) + 1, 2), 16, 10).cast("long")
    return sum((F.shiftleft(one(i), 8 * i) for i in range(1, size)), one(0))
