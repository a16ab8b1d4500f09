"""The search over cuts step by step, for tiles of sixteen numbers and a palette of four: tiles in, one row a tile out. Narrow: no shuffle.

Ends of all cuts live in a block of tiles at a time, as arrays of [cuts, tiles]. Sums are taken in the order of
the samples, as in the SQL, so that ends on the edge of a level or of a rounding are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.operators.cluster_fit import SINGULAR, ordered_ends

N, ENTRIES = 16, 4
WEIGHTS = [k / 3.0 for k in range(ENTRIES)]
#: Tiles searched at once.
BLOCK = 32


def cut_sums(s: np.ndarray, weights: list[float]) -> np.ndarray:
    """Sums of samples [16, tiles] times the weight of their run, for all cuts (p0 < p1 < p2) in the order of p2, p1, p0.

    A cut's sum up to a place is that of the shorter cut before it, so each is one addition.
    """
    tiles = s.shape[1]
    one, two, out = np.empty((N, tiles)), np.empty((N * (N - 1) // 2, tiles)), np.empty((N * (N - 1) * (N - 2) // 6, tiles))
    none, pairs, cuts = np.zeros(tiles), 0, 0
    for p in range(N):
        w = [s[p] * g for g in weights]
        out[:cuts] += w[3]
        two[:pairs] += w[2]
        out[cuts : cuts + pairs] = two[:pairs]  # cut after p the third time
        cuts += pairs
        one[:p] += w[1]
        two[pairs : pairs + p] = one[:p]
        pairs += p
        none = none + w[0]
        one[p] = none
    return out


def normal_equations() -> tuple[np.ndarray, ...]:
    """Of all solvable cuts, in the order of cut_sums: their places there, their places in the order of p0, p1, p2, and aa, bb, cc, dd."""
    places = np.array([(a, b, c) for c in range(N) for b in range(c) for a in range(b)])
    w = (np.arange(N)[:, None, None] > places).sum(axis=2) / 3.0
    zero = np.zeros(len(places))
    aa, bb, cc = (sum(f, zero) for f in ((1 - w) * (1 - w), (1 - w) * w, w * w))
    dd = aa * cc - bb * bb
    own = np.flatnonzero(np.abs(dd) >= SINGULAR)
    rank = np.lexsort(places.T[::-1]).argsort()
    return own, rank[own], *(x[own, None] for x in (aa, bb, cc, dd))


EQUATIONS = normal_equations()


def solved_ends(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends by least squares [cuts, tiles] of ordered samples [16, tiles], for every solvable cut."""
    own, _, aa, bb, cc, dd = EQUATIONS
    x, y = cut_sums(s, [1 - w for w in WEIGHTS]), cut_sums(s, WEIGHTS)
    if len(own) < len(x):
        x, y = x[own], y[own]
    return (x * cc - y * bb) / dd, (y * aa - x * bb) / dd


def quantised(v: np.ndarray) -> np.ndarray:
    return (np.clip(v, 0.0, 1.0) * 255.0).astype(np.int64)


def to_six_places(v: np.ndarray) -> np.ndarray:
    """Rounded, halves up, as in the SQL."""
    v = v * 1e6
    low = np.floor(v)
    return (low + (v - low >= 0.5)) / 1e6


def best_ends(s: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised ends of least total absolute error to six places, the first cut among equals, and that error. ``held`` [16, tiles]: samples that there are."""
    hi, lo = ordered_ends(*(quantised(e) for e in solved_ends(s)), 255)
    palette = [hi / 255.0 * (1 - i / 3) + lo / 255.0 * (i / 3) for i in range(ENTRIES)]
    error, near, far = np.zeros(hi.shape), np.empty(hi.shape), np.empty(hi.shape)
    whole = held.all()
    for k in range(N):
        np.abs(np.subtract(s[k], palette[0], out=near), out=near)
        for p in palette[1:]:
            np.minimum(near, np.abs(np.subtract(s[k], p, out=far), out=far), out=near)
        error += near if whole else near * held[k]
    error = to_six_places(error)
    least = error.min(axis=0)
    rank = EQUATIONS[1]
    won = np.where(error == least, rank[:, None], len(rank) + N**3).argmin(axis=0)
    at = np.arange(s.shape[1])
    return hi[won, at], lo[won, at], least


def ordered_samples(texels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Samples [16, tiles] in order, and which of them there are: short or missing tiles have fewer, with 0 in their place."""
    n = pc.fill_null(pc.list_value_length(texels), 0).to_numpy(zero_copy_only=False)
    held = np.arange(N) < n[:, None]
    s = np.full((len(n), N), np.inf)
    s[held] = texels.flatten().to_numpy(zero_copy_only=False)
    s.sort(axis=1)
    s[~held] = 0.0
    return np.ascontiguousarray(s.T), held.T


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        s, held = ordered_samples(batch.column(1))
        for i in range(0, batch.num_rows, BLOCK):
            yield batch.column(0).slice(i, BLOCK), s[:, i : i + BLOCK], held[:, i : i + BLOCK]


def _known(values: np.ndarray, held: np.ndarray) -> pa.Array:
    """Null for tiles without samples."""
    return pa.array(values, pa.float64(), mask=~held[0])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, s, held in _blocks(batches):
        a, b = solved_ends(s)
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), len(a)), pa.int64()), _known(a.min(axis=0), held), _known(b.max(axis=0), held)], ["tile_id", "cuts", "least", "most"])


def bounds_of_ends(tiles: DataFrame) -> DataFrame:
    """Tiles (tile_id, texels array<double>) to the number of solvable cuts, the least first end and the largest second end over them."""
    return tiles.select(F.col("tile_id").cast("long"), "texels").mapInArrow(_bounds, "tile_id long, cuts long, least double, most double")


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, s, held in _blocks(batches):
        hi, lo, error = best_ends(s, held)
        known = held[0]  # tiles without samples have the ends of an unknown value
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.where(known, hi, 255)), pa.array(np.where(known, lo, 0)), _known(error, held)], ["tile_id", "hi", "lo", "error"])


def search_ends(tiles: DataFrame) -> DataFrame:
    """Tiles (tile_id, texels array<double>) to the best quantised ends of a palette of four over all cuts, and their error."""
    return tiles.select(F.col("tile_id").cast("long"), "texels").mapInArrow(_best, "tile_id long, hi long, lo long, error double")
