"""Pixel grids and bands of numbers derived from tables by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width and height of an image cut from a table's rows.
SIDE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel for each order: image_id, x, y and channels r, g, b, a, with a second colour r2..a2 and a step t."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    n = F.col("o_orderkey")
    base = o.select(
        n.alias("n"),
        F.floor(n / (SIDE * SIDE)).alias("image_id"),
        (n % SIDE).alias("x"),
        (F.floor(n / SIDE) % SIDE).alias("y"),
        (F.col("o_custkey") % 256).alias("r"),
        (F.floor("o_totalprice") % 256).alias("g"),
        (n % 256).alias("b"),
        F.when(n % 5 == 0, 0).when(n % 5 == 1, 127).when(n % 5 == 2, 128).otherwise(255).cast("long").alias("a"),
    )
    return base.select(
        "*",
        ((F.col("r") * 7 + 13) % 256).alias("r2"),
        ((F.col("g") * 5 + 101) % 256).alias("g2"),
        ((F.col("b") * 3 + 57) % 256).alias("b2"),
        ((F.col("a") + 100) % 256).alias("a2"),
        ((F.col("n") % 11) / F.lit(10.0)).alias("t"),
    )


def flat_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid in few colours."""
    p = pixels(spark, sf_dir)
    return p.select("image_id", "x", "y", (F.floor(F.col("n") / 5) % 3 * 85).alias("r"), (F.col("n") % 2 * 255).alias("g"), F.lit(0).cast("long").alias("b"), F.lit(255).cast("long").alias("a"))


def smooth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid as gentle slopes, as in photographs."""
    p = pixels(spark, sf_dir)
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    return p.select("image_id", "x", "y", ((x * 2 + n % 7) % 256).alias("r"), ((y * 2 + n % 5) % 256).alias("g"), ((x + y + F.col("image_id")) % 256).alias("b"), "a")


#: The grids as DuckDB SQL, in front of a SELECT.
GRID_SQL = f"""
WITH px0 AS (
  SELECT o_orderkey AS n, o_orderkey // {SIDE * SIDE} AS image_id, o_orderkey % {SIDE} AS x, (o_orderkey // {SIDE}) % {SIDE} AS y,
         o_custkey % 256 AS r, CAST(floor(o_totalprice) AS BIGINT) % 256 AS g, o_orderkey % 256 AS b,
         CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 127 WHEN 2 THEN 128 ELSE 255 END AS BIGINT) AS a
  FROM orders),
px AS (SELECT *, (r * 7 + 13) % 256 AS r2, (g * 5 + 101) % 256 AS g2, (b * 3 + 57) % 256 AS b2, (a + 100) % 256 AS a2, CAST(n % 11 AS DOUBLE) / 10.0::DOUBLE AS t FROM px0),
flat AS (SELECT image_id, x, y, ((n // 5) % 3) * 85 AS r, (n % 2) * 255 AS g, 0::BIGINT AS b, 255::BIGINT AS a FROM px0),
smooth AS (SELECT image_id, x, y, (x * 2 + n % 7) % 256 AS r, (y * 2 + n % 5) % 256 AS g, (x + y + image_id) % 256 AS b, a FROM px0)
"""


def tiles_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tiles of 16 numbers in 0..1: tile_id and texels array<double>."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "embedding")
    texels = F.transform(F.slice("embedding", F.col("k") * 16 + 1, 16), lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double") + 0.5)))
    return rows.select((F.col("vec_id") * 4 + F.col("k")).alias("tile_id"), texels.alias("texels"))


def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up block bytes for decoders: block_id, colours c0 and c1 of 16 bits, d0 and d1 of 8, t0..t5 and u0..u7 of 8 bits."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("k"))
    n, k = F.col("n"), F.col("k")
    cols = [n.alias("block_id"), ((n * 40503 + k) % 65536).alias("c0"), ((k * 30011 + n * 7) % 65536).alias("c1"), ((n * 151 + k) % 256).alias("d0"), ((k * 83 + n) % 256).alias("d1")]
    cols += [((n * (31 + 2 * i) + k * (i + 1)) % 256).alias(f"t{i}") for i in range(6)]
    cols += [((n * (57 + 2 * i) + k * (i + 3)) % 256).alias(f"u{i}") for i in range(8)]
    return o.select(*cols)


BLOCK_SQL = (
    "SELECT o_orderkey AS block_id, (o_orderkey * 40503 + o_custkey) % 65536 AS c0, (o_custkey * 30011 + o_orderkey * 7) % 65536 AS c1, "
    "(o_orderkey * 151 + o_custkey) % 256 AS d0, (o_custkey * 83 + o_orderkey) % 256 AS d1, "
    + ", ".join(f"(o_orderkey * {31 + 2 * i} + o_custkey * {i + 1}) % 256 AS t{i}" for i in range(6))
    + ", "
    + ", ".join(f"(o_orderkey * {57 + 2 * i} + o_custkey * {i + 3}) % 256 AS u{i}" for i in range(8))
    + " FROM orders"
)
