"""Containers of several planes, their files, image files, and headers that are refused."""

import struct

import pytest
from pyspark.sql import functions as F

from quilter.operators import coders
from quilter.sources import container, images


def texture(spark, image, dim, wide, high, planes):
    rows = [(image, dim, planes, z, x, y, 4 * wide, 4 * high, (x * 31 + y * 7 + z) % 65536, (x + z * 5) % 65536, x % 256, y % 256, z % 256, (x ^ y) % 256) for z in range(planes) for y in range(high) for x in range(wide)]
    return spark.createDataFrame(rows, "image_id long, dim string, planes long, z long, bx long, by long, width long, height long, c0 long, c1 long, t0 long, t1 long, t2 long, t3 long")


COLS = ["image_id", "z", "bx", "by", "c0", "c1", "t0", "t1", "t2", "t3"]


def test_planes_round_trip(spark, tmp_path):
    df = texture(spark, 1, "D2Array", 16, 16, 2).union(texture(spark, 2, "D3", 17, 33, 3)).union(texture(spark, 3, "D1Array", 5, 40, 1)).union(texture(spark, 4, "D2", 3, 2, 1)).union(texture(spark, 5, "D1", 70, 1, 1))
    written = container.write(container.pack(df), f"file://{tmp_path}/out")
    assert [n for n, _ in written] == [f"{i}.blk" for i in range(1, 6)]
    packed = container.read_files(spark, f"{tmp_path}/out")
    assert {r["image_id"]: (r["n"], r["d"]) for r in packed.groupBy("image_id").agg(F.count("*").alias("n"), F.first("dim").alias("d")).collect()} == {1: (2, "D2Array"), 2: (2 * 3 * 3, "D3"), 3: (3, "D1Array"), 4: (1, "D2"), 5: (2, "D1")}
    assert sorted(container.unpack(packed).select(COLS).collect()) == sorted(df.select(COLS).collect())
    one = container.unpack(packed.where("image_id = 2 and z = 1 and sy = 2")).select(COLS)
    assert sorted(one.collect()) == sorted(df.where("image_id = 2 and z = 1 and by >= 32").select(COLS).collect())


def test_files_of_missing_planes_are_not_written(spark):
    with pytest.raises(Exception, match="super-blocks"):
        container.files(container.pack(texture(spark, 1, "D3", 2, 2, 3).where("z < 2"))).collect()


@pytest.mark.parametrize("change", [{"fmt": "BC3"}, {"levels": 2}])
def test_other_formats_are_refused(spark, change):
    data = container.write_header(4, 4, **change) + struct.pack("<Q", 34)
    with pytest.raises(Exception, match="one of BC1 is read"):
        container.parse(spark.createDataFrame([(1, bytearray(data))], "image_id long, data binary")).collect()


def test_cut_off_tables_are_an_error(spark):
    data = container.write_header(64, 64, 3, dim="D3") + struct.pack("<Q", 34)
    with pytest.raises(Exception, match="cut off"):
        container.parse(spark.createDataFrame([(1, bytearray(data))], "image_id long, data binary")).collect()


@pytest.mark.parametrize("channels", ["rgb", "rgba"])
def test_image_files(spark, tmp_path, channels):
    px = spark.range(7 * 5).select(F.lit(3).cast("long").alias("image_id"), (F.col("id") % 7).alias("x"), F.floor(F.col("id") / 7).alias("y"), *[(F.col("id") * (11 + i) % 256).alias(c) for i, c in enumerate(channels)])
    images.write_images(images.to_rows(px, channels), f"{tmp_path}/png")
    (tmp_path / "png" / "9.png").write_bytes(b"no image")
    back = images.to_pixels(images.read_images(spark, f"{tmp_path}/png"))
    assert sorted(back.select(px.columns).collect()) == sorted(px.collect())
    assert images.reload(spark, f"{tmp_path}/png", None).count() == 1
    old = spark.range(1)
    assert images.reload(spark, f"{tmp_path}/none", old) is old


def test_matches_that_do_not_fit_have_no_code(spark):
    rows = [(0, 511), (0, 512), (31, 511), (32, 127), (32, 128), (512, 7), (512, 8), (2047, 7), (2048, 0)]
    d = spark.createDataFrame(rows, "d long, l long").select("d", "l", coders.pack_match(F.col("d"), F.col("l")).alias("code"))
    got = d.select("*", *[c.alias(n) for n, c in zip(("d2", "l2"), coders.unpack_match(F.col("code")), strict=True)]).collect()
    for r in got:
        fits = r["l"] < {0: 512, 31: 512, 32: 128, 512: 8, 2047: 8, 2048: 0}[r["d"]]
        assert (r["code"] is not None) == fits
        assert not fits or (r["d2"], r["l2"]) == (r["d"], r["l"])


def test_bits_across_bytes():
    parts = [(i * 2654435761 % (1 << b), b) for i, b in enumerate([1, 7, 13, 3, 30, 16, 5, 21] * 40)]
    w = coders.BitWriter()
    for v, b in parts:
        w.write(v, b)
    r = coders.BitReader(w.bytes())
    assert [r.read(b) for _, b in parts] == [v for v, _ in parts]
    assert r.read(8) is None
