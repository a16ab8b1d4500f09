"""The block container: header, table of offsets, and super-blocks whose columns are compressed one after another.

Layout (little-endian): magic, levels, format, exponents of the super-block's sides, dimensions,
three sizes and two spare bytes, 26 in all; for each super-block, in order of z, y, x, the absolute
offset of its payload; the payloads. z counts slices of depth or layers; lines of a ``D1Array`` lie along y. A payload holds all first ends of the super-block's blocks in row
order, then all second ends, then all index bytes, under Brotli. Files of one level of BC1 blocks are read, others refused.

Packing makes one shuffle by super-block; files go to and come from any store, and super-blocks can be read one by one by their offsets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quilter.operators.tiling import in_super_blocks
from quilter.sources.store import write_files

MAGIC, HEADER_BYTES, OFFSET_BYTES, BLOCK_BYTES = 0x494C4B4A, 26, 8, 8
#: Codes of formats and of dimensions in the header (fixed values).
FORMATS = ("BC1", "BC3", "BC4", "BC5", "BC6", "BC7")
DIMENSIONS = ("D1", "D2", "D3", "D1Array", "D2Array")
HEADER = "<IHHBBHIII"
ROWS = ["t0", "t1", "t2", "t3"]
SUFFIX = ".blk"


class HeaderError(ValueError):
    """The bytes are no valid header."""


def write_header(width: int, height: int = 1, third: int = 1, *, dim: str = "D2", fmt: str = "BC1", levels: int = 1, side: tuple[int, int] = (16, 16)) -> bytes:
    for s in side:
        if s < 1 or s & (s - 1) or s.bit_length() > 16:
            raise HeaderError("a super-block's side must be a power of two under 2**16")
    bits = [s.bit_length() - 1 for s in side]
    return struct.pack(HEADER, MAGIC, levels, FORMATS.index(fmt), *bits, DIMENSIONS.index(dim), width, height, third) + b"\0\0"


def read_header(data: bytes) -> dict:
    """Fields of a header; HeaderError if anything in it cannot be."""
    if len(data) < HEADER_BYTES:
        raise HeaderError("too short")
    magic, levels, fmt, ew, eh, dim, *size = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise HeaderError("wrong magic number")
    if not levels:
        raise HeaderError("no levels")
    if fmt >= len(FORMATS) or dim >= len(DIMENSIONS):
        raise HeaderError("unknown format or dimensions")
    if ew > 15 or eh > 15:
        raise HeaderError("a super-block is too large")
    kind = DIMENSIONS[dim]
    ones = {"D1": (1, 2), "D2": (2,), "D1Array": (2,)}.get(kind, ())
    if any(size[i] != 1 for i in ones):
        raise HeaderError("sizes do not fit the dimensions")
    return {"levels": levels, "format": FORMATS[fmt], "sbw": 1 << ew, "sbh": 1 << eh, "dim": kind} | extent(kind, size)


def extent(kind: str, size: list[int]) -> dict:
    """Width, height, depth and layers of a raw size."""
    w, second, third = size
    flat = kind in ("D1", "D1Array")
    layers = {"D1Array": second, "D2Array": third}.get(kind, 1)
    return {"width": w, "height": 1 if flat else second, "depth": third if kind == "D3" else 1, "layers": layers}


def raw_size(head: dict) -> tuple[int, int, int]:
    """Blocks along x, y and z of a header's extent."""
    return head["width"], head["layers"] if head["dim"] == "D1Array" else head["height"], {"D3": head["depth"], "D2Array": head["layers"]}.get(head["dim"], 1)


def shred(c0: np.ndarray, c1: np.ndarray, texels: np.ndarray) -> bytes:
    """Aspects of blocks one after another."""
    return c0.astype("<u2").tobytes() + c1.astype("<u2").tobytes() + texels.astype(np.uint8).tobytes()


def unshred(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.frombuffer(data, "<u2", 2 * n).astype(np.int64)
    return ends[:n], ends[n:], np.frombuffer(data, np.uint8, 4 * n, 4 * n).reshape(n, 4).astype(np.int64)


def _codec() -> pa.Codec:
    return pa.Codec("brotli", compression_level=11)


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by("rank")
    get = lambda c: table.column(c).to_numpy()
    raw = shred(get("c0"), get("c1"), np.stack([get(t) for t in ROWS], axis=1))
    payload = _codec().compress(raw, asbytes=True)
    first = lambda c: table.column(c)[0].as_py()
    keys = ("image_id", "z", "sy", "sx", "sbw", "sbh", "blocks_wide", "blocks_high", "planes")
    return pa.table({k: pa.array([first(k)], pa.int64()) for k in keys} | {"dim": pa.array([first("dim")], pa.string()), "n_blocks": pa.array([table.num_rows], pa.int64()), "payload": pa.array([payload], pa.binary())})


PACKED = "image_id long, z long, sy long, sx long, sbw long, sbh long, blocks_wide long, blocks_high long, planes long, dim string, n_blocks long, payload binary"


def pack(blocks: DataFrame) -> DataFrame:
    """Blocks (image_id, bx, by, width, height in pixels, c0, c1, t0..t3) to one row for each super-block, with its payload.

    Textures of several planes also have z, planes (their number) and dim, of ``DIMENSIONS``; else blocks are those of one ``D2`` plane.
    """
    default = {"z": F.lit(0), "planes": F.lit(1), "dim": F.lit("D2")}
    d = blocks.withColumns({c: v for c, v in default.items() if c not in blocks.columns})
    d = d.withColumns({"blocks_wide": F.ceil(F.col("width") / 4).cast("long"), "blocks_high": F.ceil(F.col("height") / 4).cast("long")})
    d = in_super_blocks(d).select("image_id", "dim", *[F.col(c).cast("long").alias(c) for c in ("z", "sy", "sx", "sbw", "sbh", "blocks_wide", "blocks_high", "planes", "rank", "c0", "c1", *ROWS)])
    return d.groupBy("image_id", "z", "sy", "sx").applyInArrow(_pack, PACKED)


def with_offsets(packed: DataFrame) -> DataFrame:
    """Adds each payload's absolute offset in its image's file."""
    every = Window.partitionBy("image_id")
    before = every.orderBy("z", "sy", "sx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(HEADER_BYTES) + F.count("*").over(every) * OFFSET_BYTES
    return packed.withColumn("offset", start + F.coalesce(F.sum(F.length("payload")).over(before), F.lit(0)))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n_blocks"]
            raw = _codec().decompress(row["payload"], decompressed_size=n * BLOCK_BYTES, asbytes=True)
            c0, c1, t = unshred(raw, n)
            wide = min(row["sbw"], row["blocks_wide"] - row["sx"] * row["sbw"])
            k = np.arange(n)
            cols = {"image_id": np.full(n, row["image_id"]), "z": np.full(n, row["z"]), "bx": row["sx"] * row["sbw"] + k % wide, "by": row["sy"] * row["sbh"] + k // wide, "c0": c0, "c1": c1}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in (cols | {r: t[:, i] for i, r in enumerate(ROWS)}).items()})


BLOCKS = "image_id long, z long, bx long, by long, c0 long, c1 long, t0 long, t1 long, t2 long, t3 long"


def unpack(packed: DataFrame) -> DataFrame:
    """Super-blocks back to blocks. Filter the rows first to read only some super-blocks."""
    return packed.select("image_id", "z", "sy", "sx", "sbw", "sbh", "blocks_wide", "n_blocks", "payload").mapInArrow(_unpack, BLOCKS)


def _file(table: pa.Table) -> pa.Table:
    rows = table.sort_by([(c, "ascending") for c in ("z", "sy", "sx")]).to_pylist()
    r = rows[0]
    across, down = -(-r["blocks_wide"] // r["sbw"]), -(-r["blocks_high"] // r["sbh"])
    if len(rows) != across * down * r["planes"]:
        raise ValueError(f"image {r['image_id']} has {len(rows)} super-blocks of {across * down * r['planes']}")
    head = write_header(r["blocks_wide"], r["blocks_high"], r["planes"], dim=r["dim"], side=(r["sbw"], r["sbh"]))
    at, offsets = HEADER_BYTES + OFFSET_BYTES * len(rows), []
    for x in rows:
        offsets.append(at)
        at += len(x["payload"])
    data = head + struct.pack(f"<{len(rows)}Q", *offsets) + b"".join(x["payload"] for x in rows)
    return pa.table({"image_id": pa.array([r["image_id"]], pa.int64()), "data": pa.array([data], pa.binary())})


def files(packed: DataFrame) -> DataFrame:
    """One row for each image: the bytes of its file."""
    return packed.groupBy("image_id").applyInArrow(_file, "image_id long, data binary")


def read_offsets(data: bytes, count: int) -> list[int]:
    return list(struct.unpack_from(f"<{count}Q", data, HEADER_BYTES))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = read_header(data)
            if h["format"] != "BC1" or h["levels"] != 1:
                raise HeaderError(f"{h['levels']} levels of {h['format']} blocks; one of BC1 is read")
            wide, high, planes = raw_size(h)
            across, down = -(-wide // h["sbw"]), -(-high // h["sbh"])
            if len(data) < HEADER_BYTES + OFFSET_BYTES * across * down * planes:
                raise HeaderError("the table of offsets is cut off")
            at = read_offsets(data, across * down * planes)
            rows = []
            for k, (a, b) in enumerate(zip(at, [*at[1:], len(data)], strict=True)):
                z, sy, sx = k // (across * down), k // across % down, k % across
                n = min(h["sbw"], wide - sx * h["sbw"]) * min(h["sbh"], high - sy * h["sbh"])
                rows.append({"image_id": image, "z": z, "sy": sy, "sx": sx, "sbw": h["sbw"], "sbh": h["sbh"], "blocks_wide": wide, "blocks_high": high, "planes": planes, "dim": h["dim"], "n_blocks": n, "payload": data[a:b]})
            kind = {"payload": pa.binary(), "dim": pa.string()}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, kind.get(c, pa.int64())) for c in rows[0]]))


def parse(file_rows: DataFrame) -> DataFrame:
    """Rows (image_id, data) of whole files to rows of super-blocks, as ``pack`` gives them."""
    return file_rows.select(F.col("image_id").cast("long"), "data").mapInArrow(_parse, PACKED)


def write(packed: DataFrame, path: str) -> list[tuple[str, int]]:
    """Writes each image's file under ``path`` of any store; (name, bytes) of each."""
    return write_files(files(packed), "image_id", "data", path, SUFFIX)


def read_files(spark, path: str) -> DataFrame:
    """Super-blocks of files under a path of any store; image_id is the number that names the file, or else a hash of its path."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    number = F.regexp_extract("path", rf"([0-9]+)\{SUFFIX}$", 1)
    return parse(d.select(F.when(number != "", number.cast("long")).otherwise(F.xxhash64("path")).alias("image_id"), F.col("content").alias("data")))
