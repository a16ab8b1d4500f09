"""Texts as bytes in numpy, without a Python object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240501)
#: A random 64-bit number for each byte value.
BYTE_KEYS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_column(raw: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of a binary column from all bytes and n + 1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def joined_bytes(column: pa.Array) -> bytes:
    """All values of a binary column, one after another."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return b"" if not len(column) else bytes(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]])


#: A digest of 128 bits. Numpy leaves out trailing zero bytes of single values, never of arrays.
DIGEST = np.dtype("S16")


def digest_column(names: np.ndarray) -> pa.Array:
    return binary_column(np.ascontiguousarray(names).tobytes(), np.arange(len(names) + 1) * DIGEST.itemsize)


def digest_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(joined_bytes(column), DIGEST)


def halves(names: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each digest."""
    return np.ascontiguousarray(names).view("<u8").reshape(-1, 2)
