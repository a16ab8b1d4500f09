"""Encoders against exhaustive search in plain Python: ends, indices, alpha bytes, and what blocks decode to."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_codecs import apart, brute_force, unpack

from quilter.operators import cluster_fit, encode, tiling

RGB = "rgb"


def tiles(spark, n, alpha=None, seed=0):
    """n tiles side by side: noise, a slope, few colours and one colour in turn."""
    rng = np.random.default_rng(seed)
    px = np.empty((4, 4 * n, 4), int)
    for t in range(n):
        kind = t % 4
        tile = rng.integers(0, 256, (4, 4, 3))
        if kind == 1:
            tile = np.stack([np.add.outer(np.arange(4), np.arange(4)) * s + o for s, o in ((9, 20), (5, 90), (2, 200))], axis=2)
        elif kind == 2:
            tile = rng.integers(0, 256, (2, 3))[rng.integers(0, 2, (4, 4))]
        elif kind == 3:
            tile = np.broadcast_to(rng.integers(0, 256, 3), (4, 4, 3))
        px[:, 4 * t : 4 * t + 4, :3] = tile
    px[..., 3] = 255 if alpha is None else alpha(rng, px.shape[:2])
    rows = [(0, x, y, *map(int, px[y, x])) for y in range(4) for x in range(4 * n)]
    df = spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long, a long")
    return df, {t: px[:, 4 * t : 4 * t + 4].reshape(16, 4) for t in range(n)}


def by_tile(df):
    return {r["bx"]: r for r in df.collect()}


def colour_index(row):
    return [row[f"t{i}"] >> 2 * j & 3 for i in range(4) for j in range(4)]


def value_index(row, prefix=""):
    whole = sum(row[f"{prefix}u{i}"] << 8 * i for i in range(6))
    return [whole >> 3 * k & 7 for k in range(16)]


def colour_palette(c0, c1):
    a, b = unpack(c0), unpack(c1)
    return [a, a * 2 / 3 + b / 3, a / 3 + b * 2 / 3, b] if c0 > c1 else [a, (a + b) / 2, b, np.zeros(3)]


def check_colours(row, samples):
    """Ends and indices reach the exhaustive minimum, each texel with its nearest entry."""
    assert row["c0"] > row["c1"]
    pal = colour_palette(row["c0"], row["c1"])
    apart_of = [[apart(s, p) for p in pal] for s in samples]
    index = colour_index(row)
    assert sum(d[i] for d, i in zip(apart_of, index, strict=True)) == pytest.approx(brute_force(samples, 4), abs=2e-4)
    assert all(d[i] <= min(d) + 1e-5 for d, i in zip(apart_of, index, strict=True))


def brute_values(v, signed):
    """(ends, total error) of the best cut into eight runs, ends by least squares; the box's own ends come first."""

    def quant(x):
        return int(np.floor(min(1.0, max(0.0, x)) * 255))

    def judge(a, b):
        a, b = quant(a), quant(b)
        if a == b:
            b = 255 - a
        a, b = max(a, b), min(a, b)
        pal = a / 255 * (1 - np.arange(8) / 7) + b / 255 * (np.arange(8) / 7)
        d = v[:, None] - pal
        return (a, b), float((d if signed else np.abs(d)).min(axis=1).sum())

    s = np.sort(v)
    best = judge(s[0], s[-1])
    for places in combinations(range(16), 7):
        w = (np.arange(16)[:, None] > np.array(places)).sum(axis=1) / 7
        u = 1 - w
        a, b, c = (u * u).sum(), (u * w).sum(), (w * w).sum()
        d = a * c - b * b
        if abs(d) < 1e-8:
            continue
        x, y = (s * u).sum(), (s * w).sum()
        got = judge((x * c - y * b) / d, (y * a - x * b) / d)
        if got[1] < best[1] - 1e-12:
            best = got
    return best


def values_of(d0, d1):
    assert d0 > d1
    return d0 / 255 * (1 - np.arange(8) / 7) + d1 / 255 * (np.arange(8) / 7)


def test_bc1(spark):
    df, px = tiles(spark, 4)
    for t, row in by_tile(encode.encode_bc1(tiling.tiles(df, RGB))).items():
        check_colours(row, px[t][:, :3] / 255)


def test_bc1_alpha(spark):
    for mode in ("faithful", "corrected"):
        df, px = tiles(spark, 6, lambda rng, shape: rng.choice([0, 127, 128, 255], shape), seed=5)
        for t, row in by_tile(encode.encode_bc1_alpha(tiling.tiles(df, "rgba"), mode=mode)).items():
            s, opaque = px[t][:, :3] / 255, px[t][:, 3] / 255 > 0.5
            assert row["c0"] <= row["c1"] and 0 < opaque.sum() < 16
            want = brute_force(s[opaque], 3)
            pal = colour_palette(row["c0"], row["c1"])
            index = colour_index(row)
            # the mode 'faithful' has the opaque texels' indices in a row, and those of the others where marks left room
            order = np.flatnonzero(opaque) if mode == "corrected" else np.arange(opaque.sum())
            marked = ~opaque
            assert all(index[k] == 3 for k in np.flatnonzero(marked))
            if mode == "corrected":
                assert sum(apart(s[k], pal[index[k]]) for k in order) == pytest.approx(want, abs=2e-4)
            else:
                fit = [min(range(3), key=lambda e: apart(x, pal[e])) for x in s[opaque]]
                assert sum(apart(x, pal[e]) for x, e in zip(s[opaque], fit, strict=True)) == pytest.approx(want, abs=2e-4)
                near = lambda x, e: apart(x, pal[e]) <= min(apart(x, p) for p in pal[:3]) + 1e-5
                assert all(near(s[opaque][k], index[k]) for k in range(int(opaque.sum())) if not marked[k])


def test_bc2(spark):
    df, px = tiles(spark, 4, lambda rng, shape: rng.integers(0, 256, shape), seed=2)
    for t, row in by_tile(encode.encode_bc2(tiling.tiles(df, "rgba"))).items():
        check_colours(row, px[t][:, :3] / 255)
        alphas = [row[f"a{k // 2}"] >> 4 * (k % 2) & 15 for k in range(16)]
        assert alphas == [int(np.floor(a / 255 * 15 + 0.5)) for a in px[t][:, 3]]
    opaque = by_tile(encode.encode_bc2(tiling.tiles(df, RGB), opaque=True))
    assert all(row[f"a{i}"] == 255 for row in opaque.values() for i in range(8))


@pytest.mark.parametrize("mode", ["faithful", "corrected"])
def test_values(mode):
    rng = np.random.default_rng(7)
    v = np.stack([rng.random(16), np.linspace(0.1, 0.9, 16) ** 2, rng.choice([0.2, 0.7], 16)])
    d0, d1, index = cluster_fit.fit_values(v, mode)
    for k in range(len(v)):
        (a, b), error = brute_values(v[k], mode == "faithful")
        pal = values_of(int(d0[k]), int(d1[k]))
        d = v[k][:, None] - pal
        if mode == "faithful":
            assert (d0[k] == a) and (index[k] == d.argmin(axis=1)).all()
            assert float(d.min(axis=1).sum()) == pytest.approx(error, abs=1e-9)
        else:
            assert np.abs(d)[np.arange(16), index[k]].sum() == pytest.approx(error, abs=1e-9)
            assert (index[k] == np.abs(d).argmin(axis=1)).all()


@pytest.mark.parametrize("mode", ["faithful", "corrected"])
def test_bc3_bc4_bc5(spark, mode):
    df, px = tiles(spark, 4, lambda rng, shape: rng.integers(0, 256, shape), seed=3)
    bc3 = by_tile(encode.encode_bc3(tiling.tiles(df, "rgba"), mode))
    bc5 = by_tile(encode.encode_bc5(tiling.tiles(df, "rgba"), mode))
    numbers = spark.createDataFrame([(t, [float(x) for x in px[t][:, 1] / 255]) for t in px], "tile_id long, texels array<double>")
    bc4 = {r["tile_id"]: r for r in encode.encode_bc4(numbers, mode).collect()}
    for t in px:
        check_colours(bc3[t], px[t][:, :3] / 255)
        for row, prefix, channel in ((bc3[t], "", 3), (bc4[t], "", 1), (bc5[t], "r_", 0), (bc5[t], "g_", 1)):
            d0, d1, index = cluster_fit.fit_values(px[t][None, :, channel] / 255, mode)
            assert (row[f"{prefix}d0"], row[f"{prefix}d1"]) == (d0[0], d1[0]) and value_index(row, prefix) == index[0].tolist()
    opaque = by_tile(encode.encode_bc3(tiling.tiles(df, RGB), opaque=True))
    assert all((r["d0"], r["d1"], value_index(r)) == (255, 0, [0] * 16) for r in opaque.values())


def test_end_to_end_error(spark):
    """The round trip's error is that of the blocks, decoded by hand."""
    from quilter.functions import colour as C
    from quilter.operators import blocks, statistics

    df, px = tiles(spark, 5, seed=9)
    coded = encode.encode_bc1(tiling.tiles(df, RGB))
    back = tiling.place(blocks.decode_bc1(coded, F.col("c0"), F.col("c1"), [F.col(f"t{i}") for i in range(4)]).select("image_id", "bx", "by", "width", "height", "k", *RGB))
    shown = back.select("image_id", "x", "y", *[C.quantise(F.col(c)).alias(c) for c in RGB])
    got = statistics.image_error(df, shown).head()
    total = 0.0
    for t, row in by_tile(coded).items():
        pal = colour_palette(row["c0"], row["c1"])
        for s, i in zip(px[t][:, :3], colour_index(row), strict=True):
            total += apart(s / 255, np.floor(np.clip(pal[i], 0, 1) * 255 + 1e-9) / 255)
    assert got["pixels"] == 80 and got["error"] == pytest.approx(total / 80 / np.sqrt(3), abs=2e-3)
