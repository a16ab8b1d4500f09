"""Fit statistics of tiles from exact moments, principal axes, and image metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilter.functions import colour as C
from quilter.functions import vector as V

AXES = "rgb"
ROUNDS = 10
#: Signs of the box's extents along its four diagonals.
DIAGONALS = ((1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1))


def moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, bounds, sums and products of 8-bit channels by keys: whole numbers, so exact in any order."""
    sums = [F.sum(c).alias(f"s_{c}") for c in AXES]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    bounds = [f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products, *bounds)


def product(a: str, b: str) -> Column:
    return F.col(f"p_{min(a, b, key=AXES.index)}{max(a, b, key=AXES.index)}")


def box(df: DataFrame) -> dict[str, Column]:
    """Box predicates and accessors over bounds lo_*, hi_* of 8-bit channels."""
    lo, hi = ([C.normalise(F.col(f"{n}_{c}")) for c in AXES] for n in ("lo", "hi"))
    extent = [h - low for low, h in zip(lo, hi, strict=True)]
    some = lambda f: f[0] | f[1] | f[2]
    every = lambda f: f[0] & f[1] & f[2]
    return {
        "is_empty": some([low > h for low, h in zip(lo, hi, strict=True)]),
        "is_singular": every([low == h for low, h in zip(lo, hi, strict=True)]),
        "is_real": every([low <= h for low, h in zip(lo, hi, strict=True)]),
        **{f"center_{c}": (low + h) * 0.5 for c, low, h in zip(AXES, lo, hi, strict=True)},
        "volume": extent[0] * extent[1] * extent[2],
        "volume_faithful": F.least(extent[0], F.lit(0.0)) * F.least(extent[1], F.lit(0.0)) * F.least(extent[2], F.lit(0.0)),
    }


def diagonal_axes() -> list[Column]:
    """Unit vectors along the four diagonals of the box."""
    extent = [C.normalise(F.col(f"hi_{c}") - F.col(f"lo_{c}")) for c in AXES]
    return [V.norm(V.vec(*[e * float(s) for e, s in zip(extent, signs, strict=True)]), 3) for signs in DIAGONALS]


def about_center(a: str, b: str) -> Column:
    """Sum of products of deviations from the box's center, in quarters of squared 8-bit steps: exact."""
    ca, cb = (F.col(f"lo_{c}") + F.col(f"hi_{c}") for c in (a, b))
    return product(a, b) * 4 - F.col(f"s_{a}") * cb * 2 - F.col(f"s_{b}") * ca * 2 + F.col("n") * ca * cb


def _form(axis: Column, entry) -> Column:
    v = V.parts(axis, 3)
    total = F.lit(0.0)
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES):
            total = total + v[i] * v[j] * entry(a, b)
    return total


def with_diagonal(df: DataFrame) -> DataFrame:
    """Adds diagonal: the box's diagonal along which the samples vary most, the first among equals."""
    d = df.withColumns({f"diag{i}": a for i, a in enumerate(diagonal_axes())})
    d = d.withColumns({f"var{i}": _form(F.col(f"diag{i}"), about_center) for i in range(4)})
    best = F.col("diag0")
    top = F.col("var0")
    for i in range(1, 4):
        best = F.when(F.col(f"var{i}") > top, F.col(f"diag{i}")).otherwise(best)
        top = F.greatest(top, F.col(f"var{i}"))
    return d.withColumn("diagonal", best).drop(*[f"{n}{i}" for n in ("diag", "var") for i in range(4)])


def with_axis(df: DataFrame) -> DataFrame:
    """Adds axis: the principal axis by power iteration on the population covariance, from the diagonal."""
    d = with_diagonal(df)
    n = F.col("n")
    entry = lambda a, b: (n * product(a, b) - F.col(f"s_{a}") * F.col(f"s_{b}")).cast("double") / (n * n * 65025).cast("double")
    d = d.withColumns({f"v_{a}{b}": entry(a, b) for i, a in enumerate(AXES) for b in AXES[i:]})
    v = lambda a, b: F.col(f"v_{min(a, b, key=AXES.index)}{max(a, b, key=AXES.index)}")

    def turned(v_: Column) -> Column:
        size = V.length(v_, 3)
        return F.when(size > 1e-6, V.divide(v_, size, 3)).otherwise(F.col("diagonal"))

    def step(axis: Column, _: Column) -> Column:
        p = V.parts(axis, 3)
        moved = V.vec(*[v(a, "r") * p[0] + v(a, "g") * p[1] + v(a, "b") * p[2] for a in AXES])
        return F.element_at(F.transform(F.array(moved), turned), 1)

    d = d.withColumn("axis", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("diagonal"), step))
    return d.drop(*[f"v_{a}{b}" for i, a in enumerate(AXES) for b in AXES[i:]])


def image_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, pixels and mean perceptual error over the root of three, of 8-bit images joined by place."""
    other = b.select("image_id", "x", "y", *[F.col(c).alias(f"o_{c}") for c in AXES])
    d = a.join(other, ["image_id", "x", "y"])
    one, two = (C.to_yiq(*[C.normalise(F.col(p + c)) for c in AXES]) for p in ("", "o_"))
    return d.groupBy("image_id").agg(F.count("*").alias("pixels"), (F.avg(C.perceptual(one, two)) / F.sqrt(F.lit(3.0))).alias("error"))
