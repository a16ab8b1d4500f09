"""Neighbour filters and the predictor-based size estimate over pixel grids.

Neighbours are found inside bands of rows, each with a copy of the row above it, so one large image is
as many tasks as it has bands; one shuffle by image and band serves both windows. The size estimate is sequential by
definition (a pixel's prediction is the last pixel of its context, wherever in the image): its windows share one shuffle by image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quilter.functions.colour import HASH, distance_squared, wrap_add, wrap_sub

#: Value of a channel outside the image: black, opaque.
OUTSIDE = {"r": 0, "g": 0, "b": 0, "a": 255}
BUCKETS = 256
#: Rows of pixels in a band.
BAND = 64


def by_image(df: DataFrame) -> DataFrame:
    return df.repartition("image_id")


def neighbours(df: DataFrame, channels: str) -> DataFrame:
    """Columns a_, b_ and c_ of each channel: the pixel to the left, above, and above left."""
    own = F.floor(F.col("y") / BAND)
    bands = F.when(F.col("y") % BAND == BAND - 1, F.array(own, own + 1)).otherwise(F.array(own))
    left = Window.partitionBy("image_id", "band_", "y").orderBy("x")
    above = Window.partitionBy("image_id", "band_", "x").orderBy("y")
    d = df.withColumn("band_", F.explode(bands)).repartition("image_id", "band_")
    d = d.withColumns({f"a_{c}": F.coalesce(F.lag(c).over(left), F.lit(OUTSIDE[c])) for c in channels})
    d = d.withColumns({f"b_{c}": F.lag(c).over(above) for c in channels} | {f"c_{c}": F.lag(f"a_{c}").over(above) for c in channels})
    d = d.where(F.col("band_") == own).drop("band_")
    return d.withColumns({f"{n}_{c}": F.coalesce(f"{n}_{c}", F.lit(OUTSIDE[c])) for n in "bc" for c in channels})


def nearest(a: Column, b: Column, c: Column, da: Column, db: Column, dc: Column) -> Column:
    """The value whose distance is least, a before b before c."""
    return F.when((da <= db) & (da <= dc), a).when(db <= dc, b).otherwise(c)


def paeth_predictor(a: Column, b: Column, c: Column) -> Column:
    """Of one channel: the neighbour nearest to a + b - c."""
    p = a + b - c
    return nearest(a, b, c, F.abs(p - a), F.abs(p - b), F.abs(p - c))


def paeth_residual(df: DataFrame, channels: str) -> DataFrame:
    """Pixels less the neighbour jointly nearest to a + b - c, plus 128, modulo 256."""
    d = neighbours(df, channels)
    at = {n: [F.col(f"{n}_{c}") for c in channels] for n in "abc"}
    p = [x + y - z for x, y, z in zip(at["a"], at["b"], at["c"], strict=True)]
    d = d.withColumns({f"d_{n}": distance_squared(p, at[n]) for n in "abc"})
    out = {c: wrap_add(wrap_sub(F.col(c), nearest(*[F.col(f"{n}_{c}") for n in "abc"], *[F.col(f"d_{n}") for n in "abc"])), F.lit(128)) for c in channels}
    return d.select("image_id", "x", "y", *[v.alias(c) for c, v in out.items()])


def strip_alpha(df: DataFrame) -> DataFrame:
    """Without the alpha channel; a grid that has none is unchanged."""
    return df.drop("a")


def channels_of(df: DataFrame) -> str:
    return "rgba" if "a" in df.columns else "rgb"


def lzp_costs(df: DataFrame, channels: str | None = None) -> DataFrame:
    """Bits each pixel takes if the last pixel of its context's bucket predicts it, columns scanned first."""
    channels = channels or channels_of(df)
    scan = Window.partitionBy("image_id").orderBy("x", "y")
    blank = sum(OUTSIDE[c] * HASH[c] for c in channels)
    h = sum((F.col(c) * HASH[c] for c in channels), F.lit(0))
    d = by_image(df).withColumn("h_", h)
    back = [F.coalesce(F.lag("h_", k).over(scan), F.lit(blank)) for k in (3, 2, 1)]
    d = d.withColumn("bucket_", (back[0] * 7 + back[1] * 13 + back[2] * 17) % BUCKETS)
    last = Window.partitionBy("image_id", "bucket_").orderBy("x", "y")
    same = F.lit(True)
    for c in channels:
        same = same & (F.col(c) == F.coalesce(F.lag(c).over(last), F.lit(OUTSIDE[c])))
    return d.select("image_id", "x", "y", F.when(same, 1).otherwise(1 + 8 * len(channels)).cast("long").alias("bits"))


def lzp_size(df: DataFrame, channels: str | None = None) -> DataFrame:
    """image_id and the image's bits."""
    return lzp_costs(df, channels).groupBy("image_id").agg(F.sum("bits").alias("bits"))
