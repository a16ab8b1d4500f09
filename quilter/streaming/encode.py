"""Block encoding of a stream of tiles.

Encoding needs one tile at a time and no state, so the batch encoders run on streams as they
are: tiles come in as rows (image_id, bx, by, width, height, texels), blocks go out in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quilter.operators.encode import encode_bc1


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of tiles as they arrive under a path."""
    return spark.readStream.schema("image_id long, bx long, by long, width long, height long, texels array<struct<r: long, g: long, b: long>>").parquet(path)


def encode_stream(tiles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Encoded blocks as Parquet under a path, each tile once; ends when what has arrived is done."""
    return encode_bc1(tiles).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
