"""Tiles of 4 by 4 texels, rasters, super-blocks and scan orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE = 4
#: Super-block sides by extent in blocks: under the first number, the second (fixed values).
SUPER_BLOCKS = ((64, 16), (128, 64), (256, 128), (512, 256))
LARGEST_SUPER_BLOCK = 512


def dimensions(df: DataFrame) -> DataFrame:
    """image_id, width, height."""
    return df.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def padded(df: DataFrame) -> DataFrame:
    """Pixels with those of the last column and row repeated up to whole tiles; adds width and height of the image."""
    d = df.join(dimensions(df), "image_id")

    def reach(c: str, size: str) -> Column:
        last = F.ceil(F.col(size) / TILE) * TILE - 1
        return F.explode(F.sequence(F.col(c), F.when(F.col(c) == F.col(size) - 1, last).otherwise(F.col(c))))

    return d.withColumn("x", reach("x", "width")).withColumn("y", reach("y", "height"))


def tiles(df: DataFrame, channels: str) -> DataFrame:
    """image_id, bx, by, width, height and texels: 16 structs in row order. One shuffle, by tile."""
    d = padded(df).withColumns({"bx": F.floor(F.col("x") / TILE), "by": F.floor(F.col("y") / TILE), "k": F.col("y") % TILE * TILE + F.col("x") % TILE})
    listed = F.sort_array(F.collect_list(F.struct("k", *channels)))
    d = d.groupBy("image_id", "bx", "by").agg(F.first("width").alias("width"), F.first("height").alias("height"), listed.alias("texels"))
    return d.withColumn("texels", F.transform("texels", lambda t: F.struct(*[t[c].alias(c) for c in channels])))


def stitch(df: DataFrame, texels: str = "texels") -> DataFrame:
    """Tiles back to pixels; padding beyond width and height is cut off."""
    d = df.select("image_id", "bx", "by", "width", "height", F.posexplode(texels).alias("k", "t"))
    return place(d.select("image_id", "bx", "by", "width", "height", "k", "t.*"))


def place(texels: DataFrame) -> DataFrame:
    """Texels (image_id, bx, by, width, height, k and channels) to pixels; padding is cut off."""
    d = texels.withColumns({"x": F.col("bx") * TILE + F.col("k") % TILE, "y": F.col("by") * TILE + F.floor(F.col("k") / TILE)})
    return d.where("x < width and y < height").select("image_id", "x", "y", *[c for c in texels.columns if c not in ("image_id", "bx", "by", "width", "height", "k")])


def super_block_side(extent: Column) -> Column:
    out = F.lit(LARGEST_SUPER_BLOCK)
    for under, side in reversed(SUPER_BLOCKS):
        out = F.when(extent < under, side).otherwise(out)
    return out.cast("long")


def super_block_grid(width: Column, height: Column) -> dict[str, Column]:
    """Sides of super-blocks and how many lie along each axis."""
    w, h = super_block_side(width), super_block_side(height)
    return {"sbw": w, "sbh": h, "across": F.ceil(width / w).cast("long"), "down": F.ceil(height / h).cast("long")}


def in_super_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (image_id, bx, by, blocks_wide, blocks_high, and z if there are planes) with their super-block (sx, sy) and rank in its row scan."""
    side = {"sbw": super_block_side(F.col("blocks_wide")), "sbh": super_block_side(F.col("blocks_high"))}
    d = blocks.withColumns(side).withColumns({"sx": F.floor(F.col("bx") / F.col("sbw")), "sy": F.floor(F.col("by") / F.col("sbh"))})
    scan = Window.partitionBy("image_id", *(["z"] if "z" in blocks.columns else []), "sy", "sx").orderBy("by", "bx")
    return d.withColumn("rank", (F.row_number().over(scan) - 1).cast("long"))


def squash(bits: Column) -> Column:
    """The even bits of a 32-bit number, moved together."""
    v = bits.bitwiseAND(0x55555555)
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(mask)
    return v


def morton_split(index: Column) -> tuple[Column, Column]:
    """x and y of a place on the Z curve."""
    index = index.cast("long")
    return squash(index), squash(F.shiftright(index, 1))


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Place of (x, y) on the Z curve."""
    total = F.lit(0).cast("long")
    for k in range(bits):
        total = total + F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(1), 2 * k) + F.shiftleft(F.shiftright(y.cast("long"), k).bitwiseAND(1), 2 * k + 1)
    return total


def grid(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """All cells of each row's rectangle as x and y."""
    cells = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    return df.where((width > 0) & (height > 0)).withColumn("x", F.explode(cells(width))).withColumn("y", F.explode(cells(height)))


def z_order(df: DataFrame) -> DataFrame:
    """All cells of rectangles (w, h) in Z order: columns w, h, x, y, place."""
    d = grid(df.select("w", "h"), F.col("w"), F.col("h"))
    scan = Window.partitionBy("w", "h").orderBy(morton(F.col("x"), F.col("y")))
    return d.select("w", "h", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), (F.row_number().over(scan) - 1).cast("long").alias("place"))
