"""Encoders against exhaustive search, decoders against encoders, container and coders round trip."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quilter.functions import colour as C
from quilter.operators import blocks, cluster_fit, coders, encode, filters, graph, tiling
from quilter.sources import container, images


def yiq(c):
    m = np.array(C.TO_YIQ)
    return m @ c


def apart(a, b):
    d = yiq(np.asarray(a)) - yiq(np.asarray(b))
    return float(np.sqrt(d[0] ** 2 + 0.25 * (d[1] ** 2 + d[2] ** 2)))


def unpack(bits):
    return np.array([(bits >> 11) / 31, (bits >> 5 & 63) / 63, (bits & 31) / 31])


def pack(c):
    q = [int(np.floor(min(1, max(0, v)) * n)) for v, n in zip(c, (31, 63, 31))]
    return q[0] << 11 | q[1] << 5 | q[2]


def brute_force(samples, entries):
    """Least total error over all cuts, one by one in plain Python."""
    axis = cluster_fit.principal_axis(samples[None])[0]
    order = sorted(range(len(samples)), key=lambda i: (float(samples[i] @ axis), i))

    def judge(c0, c1):
        a, b = pack(c0), pack(c1)
        if a == b:
            b = a ^ 0xFFFF
        a, b = (max(a, b), min(a, b)) if entries == 4 else (min(a, b), max(a, b))
        pal = [unpack(a) * (1 - k / (entries - 1)) + unpack(b) * (k / (entries - 1)) for k in range(entries)]
        return sum(min(apart(s, p) for p in pal) for s in samples)

    best = judge(samples.min(axis=0), samples.max(axis=0))
    for places in combinations(range(len(samples)), entries - 1):
        w = np.zeros(len(samples))
        for r, i in enumerate(order):
            w[i] = sum(r > p for p in places) / (entries - 1)
        u = 1 - w
        a, b, c = (u * u).sum(), (u * w).sum(), (w * w).sum()
        if abs(a * c - b * b) < 1e-8:
            continue
        x, y = samples.T @ u, samples.T @ w
        d = a * c - b * b
        best = min(best, judge((x * c - y * b) / d, (y * a - x * b) / d))
    return best


@pytest.mark.parametrize("n,entries", [(16, 4), (5, 3), (2, 3), (1, 3)])
def test_fit_is_the_exhaustive_minimum(n, entries):
    rng = np.random.default_rng(n)
    for _ in range(2):
        s = rng.integers(0, 256, (n, 3)) / 255
        _, _, _, error = cluster_fit.fit_colours(s[None], entries)
        assert error[0] == pytest.approx(brute_force(s, entries), abs=1e-4)


def test_values_faithful_is_constant_and_corrected_is_closer():
    s = np.random.default_rng(3).random((6, 16))
    a, b, i = cluster_fit.fit_values(s)
    assert not i.any() and (a > b).all()
    a2, b2, i2 = cluster_fit.fit_values(s, "corrected")
    steps = np.linspace(0, 1, 8)
    shown = a2[:, None] / 255 * (1 - steps[i2]) + b2[:, None] / 255 * steps[i2]
    assert np.abs(shown - s).sum() < np.abs(a[:, None] / 255 - s).sum() / 4


def board(spark):
    """A checkerboard tile."""
    rows = [(0, x, y, *(3 * [255 * ((x + y) % 2)]), 255) for y in range(4) for x in range(4)]
    return spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long, a long")


def decoded(df, alpha=False):
    names = "rgba" if alpha else "rgb"
    t = blocks.decode_bc1(df, F.col("c0"), F.col("c1"), [F.col(f"t{i}") for i in range(4)], alpha)
    return tiling.place(t.select("image_id", "bx", "by", "width", "height", "k", *[C.quantise(F.col(c)).alias(c) for c in names]))


def test_checkerboard_round_trip_and_container(spark):
    blk = encode.encode_bc1(tiling.tiles(board(spark), "rgb"))
    back = decoded(blk)
    want = board(spark).drop("a")
    assert sorted(back.collect()) == sorted(want.collect())
    files = container.files(container.pack(blk))
    head = container.read_header(files.head()["data"])
    assert (head["width"], head["height"], head["format"]) == (1, 1, "BC1")
    assert container.unpack(container.parse(files)).drop("z", "bx", "by").collect() == blk.select("image_id", "c0", "c1", "t0", "t1", "t2", "t3").collect()


@pytest.mark.parametrize("opaque", [0, 1, 15, 16])
def test_alpha_block(opaque):
    rng = np.random.default_rng(opaque)
    s, alpha = rng.integers(0, 256, (1, 16, 3)) / 255, np.zeros((1, 16))
    alpha[0, :opaque] = 1
    c0, c1, index = encode.bc1_alpha_arrays(s, alpha, 0.5, "corrected")
    if opaque == 16:
        assert c0 > c1
    else:
        assert c0 <= c1 and (index[0, opaque:] == 3).all() and (index[0, :opaque] < 3).all()


def test_alpha_at_threshold_differs_by_mode():
    s, alpha = np.full((1, 16, 3), 0.5), np.full((1, 16), 1.0)
    alpha[0, 3] = 0.5
    assert encode.bc1_alpha_arrays(s, alpha, 0.5, "faithful")[2][0, 3] != 3
    assert encode.bc1_alpha_arrays(s, alpha, 0.5, "corrected")[2][0, 3] == 3


@pytest.mark.parametrize("bad", [{"magic": 1}, {"levels": 0}, {"format": 6}, {"exp": 16}, {"third": 2}])
def test_header_errors(bad):
    import struct

    data = struct.pack(container.HEADER, bad.get("magic", container.MAGIC), bad.get("levels", 1), bad.get("format", 0), bad.get("exp", 4), 4, 1, 5, 6, bad.get("third", 1)) + b"\0\0"
    with pytest.raises(container.HeaderError):
        container.read_header(data)


@given(st.lists(st.integers(0, 40), max_size=300))
@settings(max_examples=60, deadline=None)
def test_coders_round_trip(symbols):
    assert coders.lz78_decode(coders.lz78_encode(symbols)) == symbols
    assert coders.lzw_decode(coders.lzw_encode(symbols, 8), 8) == symbols


def plain_lz78(symbols, bits):
    """Phrases as tuples, codes as a string of bits, lowest first."""
    known, out, phrase = {(): 0}, "", ()
    put = lambda v, n: format(v, f"0{n}b")[::-1][:n] if n else ""
    for s in symbols:
        if (*phrase, s) in known:
            phrase = (*phrase, s)
            continue
        out += put(known[phrase], (len(known) - 1).bit_length()) + put(s, bits)
        known[(*phrase, s)] = len(known)
        phrase = ()
    out += put(known[phrase], (len(known) - 1).bit_length())
    return bytes(int(out[i : i + 8][::-1], 2) for i in range(0, len(out), 8))


def plain_lzw(symbols, bits):
    known, out, phrase = {(s,): s for s in range(1 << bits)}, "", ()
    put = lambda v: format(v, f"0{(len(known) - 1).bit_length()}b")[::-1]
    for s in symbols:
        if (*phrase, s) in known:
            phrase = (*phrase, s)
            continue
        out += put(known[phrase])
        known[(*phrase, s)] = len(known)
        phrase = (s,)
    out += put(known[phrase]) if phrase else ""
    return len(symbols).to_bytes(8, "little") + bytes(int(out[i : i + 8][::-1], 2) for i in range(0, len(out), 8))


@given(st.lists(st.integers(0, 5), max_size=200))
@settings(max_examples=60, deadline=None)
def test_coded_bytes_match_plain_coders(symbols):
    assert coders.lz78_encode(symbols, 16) == plain_lz78(symbols, 16)
    assert coders.lzw_encode(symbols, 8) == plain_lzw(symbols, 8)


#: Values and bytes (fixed values).
def test_bit_writer_vector():
    w = coders.BitWriter()
    for value, bits in ((bytes([1, 2, 3, 4]), 27), (bytes([5]), 3), (bytes([6, 7]), 16), (bytes([8, 9, 10]), 22), (bytes([11, 12, 13, 14]), 30)):
        w.write(int.from_bytes(value, "little"), bits)
    assert w.bytes().hex() == "010203acc1014282b2c0d0e000"
    r = coders.BitReader(w.bytes())
    assert [r.read(n) for n in (27, 3, 16, 22, 30)] == [0x04030201 & (1 << 27) - 1, 5, 0x0706, 0x0A0908 & (1 << 22) - 1, 0x0E0D0C0B & (1 << 30) - 1]


def test_morton_vectors(spark):
    # (fixed values)
    want = {0: (0, 0), 2: (0, 1), 3: (1, 1), 0b10101010: (0, 15), 0b01010101: (15, 0), 0b11011000: (0b1100, 0b1010), 0xAAAAAAAA: (0, 65535)}
    x, y = tiling.morton_split(F.col("i"))
    rows = spark.createDataFrame([(k,) for k in want], "i long").select("i", x.alias("x"), y.alias("y")).collect()
    assert {r["i"]: (r["x"], r["y"]) for r in rows} == want


def test_z_order_is_complete_on_long_rectangles(spark):
    d = tiling.z_order(spark.createDataFrame([(2, 100), (4, 4), (1, 1)], "w long, h long"))
    assert d.count() == 217 and d.select("w", "h", "x", "y").distinct().count() == 217
    four = [(r["x"], r["y"]) for r in d.where("w = 4").orderBy("place").collect()]
    assert four[:5] == [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0)]


def test_paeth_against_loop(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (7, 5, 3))
    rows = [(0, x, y, *map(int, img[y, x])) for y in range(7) for x in range(5)]
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in filters.paeth_residual(spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long"), "rgb").collect()}
    at = lambda x, y: img[y, x] if x >= 0 and y >= 0 else np.zeros(3, int)
    for y in range(7):
        for x in range(5):
            a, b, c = at(x - 1, y), at(x, y - 1), at(x - 1, y - 1)
            d = [((a + b - c - v) ** 2).sum() for v in (a, b, c)]
            p = (a, b, c)[int(np.argmin(d))]
            assert got[x, y] == tuple((img[y, x] - p + 128) % 256)


def test_graph_checks(spark):
    g = graph.Graph({"a": board(spark)})
    src, lzp, paeth = g.add("source", "a"), g.add("lzp"), g.add("paeth")
    g.connect(src, lzp)
    with pytest.raises(TypeError):
        g.connect(lzp, paeth)
    assert graph.Graph.load(g.save(), g.sources).output(lzp).collect() == g.output(lzp).collect()
    assert g.output(paeth) is None


def test_images_of_other_channels_are_an_error(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1, bytearray(b"x"))], "image_id long, width int, height int, channels int, data binary")
    with pytest.raises(Exception, match="3 or 4 channels"):
        images.to_pixels(rows).collect()


def test_super_block_sides(spark):
    sizes = [1, 63, 64, 127, 128, 255, 256, 511, 512, 513]
    rows = spark.createDataFrame([(s,) for s in sizes], "s long").select(tiling.super_block_side(F.col("s"))).collect()
    assert [r[0] for r in rows] == [16, 16, 64, 64, 128, 128, 256, 256, 512, 512]
