from quilter.operators import encode, tiling
from quilter.sources.grids import smooth_pixels
from quilter.streaming.encode import encode_stream, read_tiles


def test_stream_gives_the_batch_result(spark, data, tmp_path):
    tiles = tiling.tiles(smooth_pixels(spark, data).drop("a"), "rgb").selectExpr("image_id", "cast(bx as long) bx", "cast(by as long) by", "cast(width as long) width", "cast(height as long) height", "cast(texels as array<struct<r: long, g: long, b: long>>) texels")
    tiles.write.parquet(str(tmp_path / "in"))
    encode_stream(read_tiles(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    key = ["image_id", "bx", "by", "c0", "c1", "t0"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(key).collect()) == sorted(encode.encode_bc1(tiles).select(key).collect())
