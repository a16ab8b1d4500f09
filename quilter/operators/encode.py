"""Block encoders: tiles in, block columns out, by Arrow batches of tiles. Narrow: no shuffle beyond tiling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import quilter
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.operators.blocks import field
from quilter.operators.cluster_fit import fit_colours, fit_values

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(quilter)

KEY = ["image_id", "bx", "by", "width", "height"]
KEY_SCHEMA = ", ".join(f"{k} long" for k in KEY)
ROWS = [f"t{i}" for i in range(4)]


def _flat(tiles: DataFrame, channels: str) -> DataFrame:
    """Each channel's 16 values as an array."""
    return tiles.select(*[F.col(k).cast("long") for k in KEY], *[F.transform("texels", field(c)).cast("array<int>").alias(c) for c in channels])


def _channel(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 16)


def _colours(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([_channel(batch, c) for c in "rgb"], axis=2) / 255.0


def pack_rows(index: np.ndarray) -> np.ndarray:
    """Four bytes of 2-bit indices."""
    return (index.reshape(-1, 4, 4) << np.array([0, 2, 4, 6])).sum(axis=2)


def pack_values(index: np.ndarray) -> np.ndarray:
    """Six bytes of 3-bit indices."""
    whole = (index.astype(np.uint64) << np.arange(0, 48, 3, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return (whole[:, None] >> np.arange(0, 48, 8, dtype=np.uint64) & np.uint64(255)).astype(np.int64)


def _out(batch: pa.RecordBatch, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    keys = {k: batch.column(i) for i, k in enumerate(KEY)}
    return pa.RecordBatch.from_pydict(keys | {k: pa.array(v) for k, v in columns.items()})


def _bc1_columns(c0, c1, index) -> dict[str, np.ndarray]:
    rows = pack_rows(index)
    return {"c0": c0, "c1": c1} | {f"t{i}": rows[:, i] for i in range(4)}


def _encode_bc1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c0, c1, index, error = fit_colours(_colours(batch))
        yield _out(batch, _bc1_columns(c0, c1, index) | {"fit_error": error})


def encode_bc1(tiles: DataFrame) -> DataFrame:
    """Tiles of r, g, b to c0, c1, t0..t3 and the fit's error."""
    return _flat(tiles, "rgb").mapInArrow(_encode_bc1, KEY_SCHEMA + ", c0 long, c1 long, t0 long, t1 long, t2 long, t3 long, fit_error double")


def bc1_alpha_arrays(s: np.ndarray, alpha: np.ndarray, threshold: float, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and indices of tiles [tiles, 16, 3] where texels of alpha not over the threshold are left out of the fit.

    In the mode 'faithful' the fit's indices are read by texel although they were made for the opaque texels
    in a row, and a texel whose alpha is the threshold is not marked transparent.
    """
    n = len(s)
    c0, c1, index = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full((n, 16), 3, np.int64)
    opaque = alpha > threshold
    marked = alpha < threshold if mode == "faithful" else ~opaque
    count = opaque.sum(axis=1)
    for k in np.unique(count).tolist():
        own = np.flatnonzero(count == k)
        if not k:
            continue  # wholly transparent
        sub = s[own][opaque[own]].reshape(len(own), k, 3)
        a, b, idx, _ = fit_colours(sub, 4 if k == 16 else 3)
        c0[own], c1[own] = a, b
        if k == 16:
            index[own] = idx
            continue
        spread = np.zeros((len(own), 16), np.int64)
        if mode == "faithful":
            spread[:, :k] = idx
        else:
            spread[opaque[own]] = idx.ravel()
        index[own] = np.where(marked[own], 3, spread)
    return c0, c1, index


def _encode_bc1_alpha(batches: Iterator[pa.RecordBatch], threshold: float, mode: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _out(batch, _bc1_columns(*bc1_alpha_arrays(_colours(batch), _channel(batch, "a") / 255.0, threshold, mode)))


def encode_bc1_alpha(tiles: DataFrame, threshold: float = 0.5, mode: str = "faithful") -> DataFrame:
    return _flat(tiles, "rgba").mapInArrow(partial(_encode_bc1_alpha, threshold=threshold, mode=mode), KEY_SCHEMA + ", c0 long, c1 long, t0 long, t1 long, t2 long, t3 long")


def _encode_bc2(batches: Iterator[pa.RecordBatch], opaque: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c0, c1, index, _ = fit_colours(_colours(batch))
        a = np.full(index.shape, 15) if opaque else np.floor(_channel(batch, "a") / 255.0 * 15 + 0.5).astype(np.int64)
        pairs = (a.reshape(-1, 8, 2) << np.array([0, 4])).sum(axis=2)
        yield _out(batch, {f"a{i}": pairs[:, i] for i in range(8)} | _bc1_columns(c0, c1, index))


def encode_bc2(tiles: DataFrame, opaque: bool = False) -> DataFrame:
    """Colour block and 4-bit alphas, rounded."""
    schema = KEY_SCHEMA + ", " + ", ".join(f"a{i} long" for i in range(8)) + ", c0 long, c1 long, t0 long, t1 long, t2 long, t3 long"
    return _flat(tiles, "rgb" if opaque else "rgba").mapInArrow(partial(_encode_bc2, opaque=opaque), schema)


def _value_columns(values: np.ndarray, mode: str, prefix: str = "") -> dict[str, np.ndarray]:
    d0, d1, index = fit_values(values, mode)
    packed = pack_values(index)
    return {f"{prefix}d0": d0, f"{prefix}d1": d1} | {f"{prefix}u{i}": packed[:, i] for i in range(6)}


def _value_schema(prefix: str = "") -> str:
    return f"{prefix}d0 long, {prefix}d1 long, " + ", ".join(f"{prefix}u{i} long" for i in range(6))


def _encode_bc3(batches: Iterator[pa.RecordBatch], mode: str, opaque: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c0, c1, index, _ = fit_colours(_colours(batch))
        if opaque:  # the constant of full alpha
            alpha = {"d0": np.full(len(c0), 255), "d1": np.zeros(len(c0), np.int64)} | {f"u{i}": np.zeros(len(c0), np.int64) for i in range(6)}
        else:
            alpha = _value_columns(_channel(batch, "a") / 255.0, mode)
        yield _out(batch, alpha | _bc1_columns(c0, c1, index))


def encode_bc3(tiles: DataFrame, mode: str = "faithful", opaque: bool = False) -> DataFrame:
    """Colour block and a value block of alphas."""
    return _flat(tiles, "rgb" if opaque else "rgba").mapInArrow(partial(_encode_bc3, mode=mode, opaque=opaque), KEY_SCHEMA + ", " + _value_schema() + ", c0 long, c1 long, t0 long, t1 long, t2 long, t3 long")


def _encode_bc5(batches: Iterator[pa.RecordBatch], mode: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _out(batch, _value_columns(_channel(batch, "r") / 255.0, mode, "r_") | _value_columns(_channel(batch, "g") / 255.0, mode, "g_"))


def encode_bc5(tiles: DataFrame, mode: str = "faithful") -> DataFrame:
    """Value blocks of red and of green."""
    return _flat(tiles, "rg").mapInArrow(partial(_encode_bc5, mode=mode), KEY_SCHEMA + ", " + _value_schema("r_") + ", " + _value_schema("g_"))


def _encode_values(batches: Iterator[pa.RecordBatch], mode: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 16)
        yield pa.RecordBatch.from_pydict({"tile_id": batch.column(0)} | {k: pa.array(v) for k, v in _value_columns(values, mode).items()})


def encode_bc4(tiles: DataFrame, mode: str = "faithful") -> DataFrame:
    """Tiles (tile_id, texels array<double>) to value blocks."""
    return tiles.select(F.col("tile_id").cast("long"), "texels").mapInArrow(partial(_encode_values, mode=mode), "tile_id long, " + _value_schema())
