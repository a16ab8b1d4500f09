"""Images as rows of Spark's image source, and as pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quilter.sources.store import write_files


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id and the fields of Spark's image source; files that are no image are left out. image_id is the number that names the file, or else a hash of its path."""
    d = spark.read.format("image").option("dropInvalid", True).load(path)
    number = F.regexp_extract("image.origin", r"([0-9]+)\.[A-Za-z]+$", 1)
    return d.select(F.when(number != "", number.cast("long")).otherwise(F.xxhash64("image.origin")).alias("image_id"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def to_rows(pixels: DataFrame, channels: str = "rgb") -> DataFrame:
    """Pixels to image rows: bytes in the order b, g, r and, if there is one, a, row by row."""
    stored = "bgr" + ("a" if "a" in channels else "")
    one = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in stored])
    d = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sort_array(F.collect_list(F.struct("y", "x", one.alias("p")))).alias("ps"))
    return d.select("image_id", "width", "height", F.lit(len(stored)).alias("channels"), F.unhex(F.array_join(F.transform("ps", lambda p: p["p"]), "")).alias("data"))


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("long")


def to_pixels(rows: DataFrame) -> DataFrame:
    """Image rows to pixels r, g, b, a (null without alpha). Images of other than 3 or 4 channels are an error."""
    ok = F.col("channels").isin(3, 4)
    n = F.when(ok, F.col("width") * F.col("height")).otherwise(F.raise_error("only images of 3 or 4 channels of 8 bits"))
    d = rows.select("image_id", "width", "channels", "data", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("k"))
    at = (F.col("k") * F.col("channels")).cast("int")
    get = lambda i: _byte(F.col("data"), at + i)
    return d.select("image_id", (F.col("k") % F.col("width")).alias("x"), F.floor(F.col("k") / F.col("width")).alias("y"), get(2).alias("r"), get(1).alias("g"), get(0).alias("b"), F.when(F.col("channels") == 4, get(3)).alias("a"))


def _png(width: int, height: int, channels: int, data: bytes) -> bytes:
    """A PNG of rows of b, g, r(, a) bytes, without a filter."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    px = px[..., [2, 1, 0, 3][:channels]]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), px.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _pngs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_png(r["width"], r["height"], r["channels"], r["data"]) for r in rows], pa.binary())], ["image_id", "data"])


def write_images(rows: DataFrame, path: str) -> list[tuple[str, int]]:
    """Writes image rows as PNG files, named by image_id, under a path of any store; (name, bytes) of each."""
    d = rows.select(F.col("image_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), F.col("channels").cast("int"), "data")
    return write_files(d.mapInArrow(_pngs, "image_id long, data binary"), "image_id", "data", path, ".png")


def reload(spark: SparkSession, path: str, old: DataFrame | None) -> DataFrame | None:
    """The images under path, or the old ones if the path is missing or holds none. Other errors are errors."""
    try:
        new = read_images(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return old
    return old if new.isEmpty() else new
