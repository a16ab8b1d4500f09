"""Scalar functions of colours and vectors over pixel grids (M01 to M27)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilter.functions import colour as C
from quilter.functions import vector as V
from quilter.plans.registry import Registry
from quilter.sources.grids import GRID_SQL, pixels

SCALAR = Registry()
KEYS = ("image_id", "x", "y")
col = F.col


def over_pixels(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """A projection of the pixel grid, built from Columns and, for the oracle, from SQL. Columns need a session, so they are made when asked for."""
    oracle = GRID_SQL + "SELECT image_id, x, y, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + " FROM px"
    SCALAR.add(name, lambda spark, sf_dir: pixels(spark, sf_dir).select(*KEYS, *[c.alias(n) for n, c in columns().items()]), oracle)


def vec_cols(prefix: str, v: Column, n: int, digits: int = 9) -> dict[str, Column]:
    return {f"{prefix}_{a}": F.round(v[a], digits) for a in V.AXES[:n]}


def vec_sql(prefix: str, parts: list[str], digits: int = 9) -> dict[str, str]:
    return {f"{prefix}_{a}": f"round({p}, {digits})" for a, p in zip(V.AXES, parts, strict=False)}


def unorm(c: str, top: int = 255) -> str:
    return f"(CAST({c} AS DOUBLE) / {top}.0::DOUBLE)"


def NP() -> list[Column]:
    return [C.normalise(col(c)) for c in "rgba"]


def NQ() -> list[Column]:
    return [C.normalise(col(c + "2")) for c in "rgba"]


def P() -> Column:
    return V.vec(*NP())


def Q() -> Column:
    return V.vec(*NQ())


SP, SQ = ([unorm(c + s) for c in "rgba"] for s in ("", "2"))


def lerp_sql(a: str, b: str, t: str = "t") -> str:
    return f"(CASE WHEN {t} < 0.5 THEN {a} + ({b} - {a}) * {t} ELSE {b} + ({a} - {b}) * (1.0::DOUBLE - {t}) END)"


over_pixels("M01", lambda: {"value": F.round(V.lerp(NP()[0], NQ()[0], col("t")), 9)}, {"value": f"round({lerp_sql(SP[0], SQ[0])}, 9)"})


def _m02() -> dict[str, Column]:
    out = {}
    for n in (2, 3, 4):
        a, b = (V.vec(*V.parts(v, n)) for v in (P(), Q()))
        for op, made in (("add", V.add(a, b, n)), ("sub", V.sub(a, b, n)), ("mul", V.scale(a, col("t"), n)), ("div", V.divide(a, col("t") + 1.0, n))):
            out |= vec_cols(f"{op}{n}", made, n)
    return out


_s02 = {}
for n in (2, 3, 4):
    for op, text in (
        ("add", [f"{p} + {q}" for p, q in zip(SP[:n], SQ[:n], strict=True)]),
        ("sub", [f"{p} - {q}" for p, q in zip(SP[:n], SQ[:n], strict=True)]),
        ("mul", [f"{p} * t" for p in SP[:n]]),
        ("div", [f"{p} / (t + 1.0::DOUBLE)" for p in SP[:n]]),
    ):
        _s02 |= vec_sql(f"{op}{n}", text)
over_pixels("M02", _m02, _s02)


def dot_sql(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


over_pixels(
    "M03",
    lambda: {f"{k}{n}": F.round(f, 8) for n in (2, 3, 4) for k, f in (("dot", V.dot(P(), Q(), n)), ("length", V.length(P(), n)), ("square", V.length_squared(P(), n)))},
    {f"{k}{n}": f"round({f}, 8)" for n in (2, 3, 4) for k, f in (("dot", dot_sql(SP[:n], SQ[:n])), ("length", f"sqrt({dot_sql(SP[:n], SP[:n])})"), ("square", dot_sql(SP[:n], SP[:n])))},
)


def _m04() -> dict[str, Column]:
    out = {}
    for n in (2, 3, 4):
        out |= vec_cols(f"norm{n}", V.norm(V.vec(*V.parts(P(), n)), n), n, 8)
    return out


_s04 = {}
for n in (2, 3, 4):
    size = f"sqrt({dot_sql(SP[:n], SP[:n])})"
    _s04 |= vec_sql(f"norm{n}", [f"CASE WHEN {size} <> 0 THEN {p} / {size} ELSE {1.0 if i == 0 else 0.0}::DOUBLE END" for i, p in enumerate(SP[:n])], 8)
over_pixels("M04", _m04, _s04)

over_pixels(
    "M05",
    lambda: vec_cols("new", V.vec(*NP()), 4) | vec_cols("splat", V.splat(NP()[0], 3), 3) | vec_cols("zero", V.zero(2), 2),
    vec_sql("new", SP) | vec_sql("splat", [SP[0]] * 3) | vec_sql("zero", ["0.0::DOUBLE"] * 2),
)


def swizzles(n: int) -> list[str]:
    """All orders of 2 to n components of a vector of n, or of 4 of a vector of 2 and 3 as well."""
    from itertools import product

    return ["".join(p) for size in (2, 3, 4) for p in product(V.AXES[:n], repeat=size)]


#: All 4**2 + 4**3 + 4**4 orders of four components; those of two and three are among them.
_orders = swizzles(4)


def _swizzled(v: dict[str, object], order: str):
    return [v[c] for c in order]


def _weighed(part: int, column: int) -> list[tuple[str, int, int]]:
    """(order, component, weight) of the orders of one column of one part: between them, part and column name every order."""
    return [(o, j, i * 7 + j + 1) for i, o in enumerate(_orders) if i % 16 == 4 * part + column for j in range(len(o))]


def _total(terms: list[Column]) -> Column:
    """Their sum, as a tree of least depth."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) - len(terms) % 2 :]
    return terms[0]


def _swizzles(spark, sf_dir):
    """Sums over all 336 orders in four parts of four columns (one part is as much as compiles to one method), and all orders of two."""
    d, v, parts = pixels(spark, sf_dir).select(*KEYS, P().alias("v")), col("v"), []
    for p in range(4):
        sums = {f"swizzled_{k}": F.round(_total([V.swizzle(v, o)[V.AXES[j]] * w for o, j, w in _weighed(p, k)]), 6) for k in range(4)}
        twos = {f"sw_{k}": F.round(V.swizzle(v, o)["x"] - V.swizzle(v, o)["y"], 9) for k, o in enumerate(x for i, x in enumerate(o for o in _orders if len(o) == 2) if i % 4 == p)}
        cols = sums | twos | vec_cols("zyx", V.swizzle(v, "zyx"), 3) | vec_cols("wwxy", V.swizzle(v, "wwxy"), 4)
        parts.append(d.select(*KEYS, F.lit(p).cast("long").alias("part"), *[c.alias(n) for n, c in cols.items()]))
    return reduce(DataFrame.union, parts)


def _swizzles_sql() -> str:
    parts = []
    for p in range(4):
        cols = {f"swizzled_{k}": "round(" + " + ".join(f"{SP['xyzw'.index(o[j])]} * {w}" for o, j, w in _weighed(p, k)) + ", 6)" for k in range(4)}
        cols |= {f"sw_{k}": f"round({SP['xyzw'.index(o[0])]} - {SP['xyzw'.index(o[1])]}, 9)" for k, o in enumerate(x for i, x in enumerate(o for o in _orders if len(o) == 2) if i % 4 == p)}
        cols |= vec_sql("zyx", [SP[2], SP[1], SP[0]]) | vec_sql("wwxy", [SP[3], SP[3], SP[0], SP[1]])
        parts.append(f"SELECT image_id, x, y, {p}::BIGINT AS part, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM px")
    return GRID_SQL + " UNION ALL ".join(parts)


SCALAR.add("M06", _swizzles, _swizzles_sql())
over_pixels(
    "M07",
    lambda: vec_cols("with_z", V.extend(V.vec(*NP()[:2]), 2, NQ()[2]), 3) | vec_cols("with_zw", V.extend(V.vec(*NP()[:2]), 2, NQ()[2], NQ()[3]), 4) | vec_cols("with_w", V.extend(V.vec(*NP()[:3]), 3, NQ()[3]), 4),
    vec_sql("with_z", [*SP[:2], SQ[2]]) | vec_sql("with_zw", [*SP[:2], *SQ[2:]]) | vec_sql("with_w", [*SP[:3], SQ[3]]),
)
over_pixels("M08", lambda: vec_cols("lerp", V.lerp_vec(P(), Q(), col("t"), 4), 4), vec_sql("lerp", [lerp_sql(p, q) for p, q in zip(SP, SQ, strict=True)]))


def _bytes(*cs: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in cs])


def _byte(text: Column, i: int) -> Column:
    return F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("long")


def _px():
    return F.struct(*[col(c) for c in "rgba"])


over_pixels(
    "M09",
    lambda: {"bytes": _bytes(*[col(c) for c in "rgba"]), "back_g": _byte(_bytes(*[col(c) for c in "rgba"]), 1), "set_g": _px().withField("g", col("g2"))["g"], "r8": col("r"), "get_a": _px()["a"]},
    {"bytes": "printf('%02X%02X%02X%02X', r, g, b, a)", "back_g": "CAST('0x' || substr(printf('%02X%02X%02X%02X', r, g, b, a), 3, 2) AS BIGINT)", "set_g": "g2", "r8": "r", "get_a": "a"},
)


def _rgb():
    return F.struct(*[col(c) for c in "rgb"])


over_pixels(
    "M10",
    lambda: {"alpha": F.struct(_rgb()["r"], _rgb()["g"], _rgb()["b"], col("a2").alias("a"))["a"], "opaque": _px().withField("a", F.lit(255).cast("long"))["a"], "rgb_b": _px().dropFields("a")["b"], "with_g": F.struct(col("r"), col("g2").alias("g"))["g"], "with_b": F.struct(col("r"), col("g"), col("b2").alias("b"))["b"]},
    {"alpha": "a2", "opaque": "255::BIGINT", "rgb_b": "b", "with_g": "g2", "with_b": "b2"},
)
over_pixels("M11", lambda: {f"f_{c}": F.round(C.normalise(col(c)), 9) for c in "rgba"}, {f"f_{c}": f"round({unorm(c)}, 9)" for c in "rgba"})


def _wide():
    return [C.normalise(col(c)) * 1.5 - 0.2 for c in "rgba"]


_swide = [f"({unorm(c)} * 1.5::DOUBLE - 0.2::DOUBLE)" for c in "rgba"]


def quant_sql(c: str, top: int = 255) -> str:
    return f"CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c})) * {top}.0::DOUBLE) AS BIGINT)"


over_pixels("M12", lambda: {f"q_{c}": C.quantise(v) for c, v in zip("rgba", _wide(), strict=True)}, {f"q_{c}": quant_sql(v) for c, v in zip("rgba", _swide, strict=True)})


def R5():
    return col("r") % 32


def G6():
    return col("g") % 64


def B5():
    return col("b") % 32


def BITS():
    return C.pack565(R5(), G6(), B5())


SBITS = "((r % 32) * 2048 + (g % 64) * 32 + b % 32)"


def _un():
    return C.unpack565(BITS())


over_pixels(
    "M13",
    lambda: {"bits": BITS(), "r5": _un()[0].cast("long"), "g6": _un()[1].cast("long"), "b5": _un()[2].cast("long"), "low": BITS() % 256, "high": F.shiftright(BITS(), 8), "set_g": C.pack565(R5(), col("g2") % 64, B5())},
    {"bits": SBITS, "r5": "r % 32", "g6": "g % 64", "b5": "b % 32", "low": f"{SBITS} % 256", "high": f"{SBITS} // 256", "set_g": "((r % 32) * 2048 + (g2 % 64) * 32 + b % 32)"},
)


def _bit_sql(c: str, k: int, to: int) -> str:
    return f"((({c}) >> {k}) & 1) * {1 << to}"


_inter = " + ".join([_bit_sql("g % 64", k, 3 * k) for k in range(6)] + [_bit_sql("b % 32", k, 3 * k + 1) for k in range(5)] + [_bit_sql("r % 32", k, 3 * k + 2) for k in range(5)])
over_pixels("M14", lambda: {"interleaved": C.interleave565(BITS()), "back": C.deinterleave565(C.interleave565(BITS()))}, {"interleaved": f"CAST({_inter} AS BIGINT)", "back": SBITS})


def _f565():
    return C.from_565(BITS())


over_pixels(
    "M15",
    lambda: {"f_r": F.round(_f565()[0], 9), "f_g": F.round(_f565()[1], 9), "f_b": F.round(_f565()[2], 9), "bits": C.to_565(*NP()[:3])},
    {"f_r": f"round({unorm('r % 32', 31)}, 9)", "f_g": f"round({unorm('g % 64', 63)}, 9)", "f_b": f"round({unorm('b % 32', 31)}, 9)", "bits": f"{quant_sql(SP[0], 31)} * 2048 + {quant_sql(SP[1], 63)} * 32 + {quant_sql(SP[2], 31)}"},
)


def mod_sql(e: str, m: int = 256) -> str:
    return f"((({e}) % {m}) + {m}) % {m}"


over_pixels(
    "M16",
    lambda: {f"add_{c}": C.wrap_add(col(c), col(c + "2")) for c in "rgba"} | {f"sub_{c}": C.wrap_sub(col(c), col(c + "2")) for c in "rgba"} | {"sub_r5": C.wrap_sub(R5(), col("r2") % 32, 32), "sub_g6": C.wrap_sub(G6(), col("g2") % 64, 64)},
    {f"add_{c}": mod_sql(f"{c} + {c}2") for c in "rgba"} | {f"sub_{c}": mod_sql(f"{c} - {c}2") for c in "rgba"} | {"sub_r5": mod_sql("r % 32 - r2 % 32", 32), "sub_g6": mod_sql("g % 64 - g2 % 64", 64)},
)


def d2_sql(n: int) -> str:
    return "(" + " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(SP[:n], SQ[:n], strict=True)) + ")"


over_pixels(
    "M17",
    lambda: {"diff": F.round(NP()[0] - NQ()[0], 9), "signed": F.round(C.distance(NP()[:1], NQ()[:1]), 9), "absolute": F.round(C.distance(NP()[:1], NQ()[:1], "corrected"), 9), "d2": F.round(C.distance_squared(NP()[:2], NQ()[:2]), 8), "d3": F.round(C.distance(NP()[:3], NQ()[:3]), 8), "bytes_r": col("r") - col("r2")},
    {"diff": f"round({SP[0]} - {SQ[0]}, 9)", "signed": f"round({SP[0]} - {SQ[0]}, 9)", "absolute": f"round(abs({SP[0]} - {SQ[0]}), 9)", "d2": f"round({d2_sql(2)}, 8)", "d3": f"round(sqrt({d2_sql(3)}), 8)", "bytes_r": "r - r2"},
)
over_pixels("M18", lambda: vec_cols("offset", V.add(V.vec(*NP()[:3]), V.vec(*NQ()[:3]), 3), 3), vec_sql("offset", [f"{p} + {q}" for p, q in zip(SP[:3], SQ[:3], strict=True)]))
over_pixels(
    "M19",
    lambda: {f"l_{c}": F.round(V.lerp(p, q, col("t")), 9) for c, p, q in zip("rgba", NP(), NQ(), strict=True)},
    {f"l_{c}": f"round({lerp_sql(p, q)}, 9)" for c, p, q in zip("rgba", SP, SQ, strict=True)},
)


def matrix_sql(matrix: tuple, v: list[str]) -> list[str]:
    return ["(" + " + ".join(f"{p} * ({m}::DOUBLE)" for p, m in zip(v, row, strict=True)) + ")" for row in matrix]


def YIQ():
    return C.to_yiq(*NP()[:3])


def YIQ2():
    return C.to_yiq(*NQ()[:3])


SYIQ = matrix_sql(C.TO_YIQ, SP[:3])
SYIQ2 = matrix_sql(C.TO_YIQ, SQ[:3])


def _back():
    return C.from_yiq(*YIQ())


over_pixels(
    "M20",
    lambda: {n: F.round(c, 8) for n, c in zip(("yy", "ii", "qq", "rr", "gg", "bb"), (*YIQ(), *_back()), strict=True)},
    {n: f"round({c}, 8)" for n, c in zip(("yy", "ii", "qq", "rr", "gg", "bb"), (*SYIQ, *matrix_sql(C.FROM_YIQ, SYIQ)), strict=True)},
)


def perceptual_sql(a: list[str], b: list[str]) -> str:
    d = [f"({p} - {q})" for p, q in zip(a, b, strict=True)]
    return f"sqrt({d[0]} * {d[0]} + ({d[1]} * {d[1]} + {d[2]} * {d[2]}) * 0.25::DOUBLE)"


over_pixels("M21", lambda: {"distance": F.round(C.perceptual(YIQ(), YIQ2()), 8)}, {"distance": f"round({perceptual_sql(SYIQ, SYIQ2)}, 8)"})
over_pixels("M22", lambda: vec_cols("vec", V.vec(*NP()[:3]), 3) | vec_cols("yiq", V.vec(*YIQ()), 3, 8), vec_sql("vec", SP[:3]) | vec_sql("yiq", SYIQ, 8))
over_pixels("M23", lambda: {f"v_{c}": C.quantise(C.normalise(col(c))) for c in "rgb"}, {f"v_{c}": quant_sql(unorm(c)) for c in "rgb"})
over_pixels("M24", lambda: {f"e_{c}": C.quantise(V.lerp(p, q, F.lit(0.5))) for c, p, q in zip("rgb", NP(), NQ(), strict=False)}, {f"e_{c}": quant_sql(lerp_sql(p, q, "0.5::DOUBLE")) for c, p, q in zip("rgb", SP, SQ, strict=False)})
over_pixels("M25", lambda: vec_cols("sum", V.add(V.vec(*NP()[:3]), V.zero(3), 3), 3), vec_sql("sum", SP[:3]))
over_pixels("M26", lambda: {"rgb": C.pixel_hash(r=col("r"), g=col("g"), b=col("b")), "rgba": C.pixel_hash(r=col("r"), g=col("g"), b=col("b"), a=col("a"))}, {"rgb": "r * 43 + g * 31 + b * 29", "rgba": "r * 43 + g * 31 + b * 29 + a * 83"})

#: Kinds of pixels: name, channels, bits and the value outside an image (fixed values).
PIXEL_TYPES = (("rgb8", 3, 24, "0,0,0"), ("rgba8", 4, 32, "0,0,0,255"))


@SCALAR.query("M27", " UNION ALL ".join(f"SELECT '{n}' AS name, {c}::BIGINT AS channels, {b}::BIGINT AS bits, '{d}' AS outside" for n, c, b, d in PIXEL_TYPES))
def m27(spark, sf_dir):
    return spark.createDataFrame(PIXEL_TYPES, "name string, channels long, bits long, outside string")
