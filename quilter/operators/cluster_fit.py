"""Cluster fit: best two ends of a palette for a tile, over all cuts of its sorted samples.

Samples are ordered along an axis; each way to cut the order into as many runs as
the palette has entries gives ends by least squares; ends are quantised; the cut of least
total error wins, the first among equals, and only if it beats the box's own ends. Tiles are
searched many at a time in numpy: ends for all cuts of all tiles are one matrix product.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

from quilter.functions.colour import TO_YIQ

SINGULAR = 1e-8
#: To a space whose Euclidean distance is the perceptual one: chroma counts a half.
PERCEPTUAL = np.array(TO_YIQ).T * np.array([1.0, 0.5, 0.5])
LEVELS565 = np.array([31.0, 63.0, 31.0])


@lru_cache(maxsize=64)
def cuts(n: int, entries: int) -> np.ndarray:
    """Labels of n ordered samples for every cut, in lexicographic order of the places cut after."""
    places = np.array(list(combinations(range(n), entries - 1)), np.int64).reshape(-1, entries - 1)
    return (np.arange(n)[None, :, None] > places[:, None, :]).sum(axis=2)


@lru_cache(maxsize=64)
def solver(n: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights on ordered samples that give both ends for every solvable cut, and the cuts' numbers."""
    w = cuts(n, entries) / (entries - 1)
    u = 1 - w
    a, b, c = (u * u).sum(axis=1), (u * w).sum(axis=1), (w * w).sum(axis=1)
    d = a * c - b * b
    own = np.flatnonzero(np.abs(d) >= SINGULAR)
    inv = 1 / d[own, None]
    return (u[own] * c[own, None] - w[own] * b[own, None]) * inv, (w[own] * a[own, None] - u[own] * b[own, None]) * inv, own


def principal_axis(s: np.ndarray) -> np.ndarray:
    """Axis of each tile of samples [tiles, n, 3]: ten power iterations from the best diagonal of its box."""
    lo, hi = s.min(axis=1), s.max(axis=1)
    signs = np.array([[1, 1, 1], [1, 1, -1], [1, -1, 1], [-1, 1, 1]], float)
    diag = (hi - lo)[:, None, :] * signs
    size = np.linalg.norm(diag, axis=2, keepdims=True)
    diag = np.where(size > 0, diag / np.where(size > 0, size, 1), np.array([1.0, 0, 0]))
    spread = (np.einsum("tnc,tdc->tnd", s - ((lo + hi) / 2)[:, None], diag) ** 2).sum(axis=1)
    start = diag[np.arange(len(s)), spread.argmax(axis=1)]
    dev = s - s.mean(axis=1, keepdims=True)
    cov = np.einsum("tni,tnj->tij", dev, dev) / s.shape[1]
    axis = start
    for _ in range(10):
        step = np.einsum("tij,tj->ti", cov, axis)
        size = np.linalg.norm(step, axis=1, keepdims=True)
        axis = np.where(size > 1e-6, step / np.where(size > 1e-6, size, 1), start)
    return axis


def quantise565(c: np.ndarray) -> np.ndarray:
    """Packed bits of colours."""
    q = np.floor(np.clip(c, 0, 1) * LEVELS565).astype(np.int64)
    return q[..., 0] << 11 | q[..., 1] << 5 | q[..., 2]


def expand565(bits: np.ndarray) -> np.ndarray:
    return np.stack([bits >> 11 & 31, bits >> 5 & 63, bits & 31], axis=-1) / LEVELS565


def ordered_ends(a: np.ndarray, b: np.ndarray, top: int, descending: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ends in order: an equal second end becomes the first's complement."""
    b = np.where(a == b, a ^ top, b)
    hi, lo = np.maximum(a, b), np.minimum(a, b)
    return (hi, lo) if descending else (lo, hi)


def fit_colours(s: np.ndarray, entries: int = 4, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends (packed), indices and error of tiles of samples [tiles, n, 3]."""
    parts = [_fit_colours(s[i : i + block], entries) for i in range(0, len(s), block)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, s.shape[1]), np.int64), np.zeros(0))


def _fit_colours(s: np.ndarray, entries: int):
    tiles, n, _ = s.shape
    order = np.argsort(np.einsum("tnc,tc->tn", s, principal_axis(s)), axis=1, kind="stable")
    ranked = np.take_along_axis(s, order[..., None], axis=1)
    steps = np.linspace(0, 1, entries)
    target = (ranked @ PERCEPTUAL).astype(np.float32)

    a, b = ordered_ends(quantise565(s.min(axis=1)), quantise565(s.max(axis=1)), 0xFFFF, entries == 4)
    ends = [a[:, None], b[:, None]]
    if n >= 2 and len((solved := solver(n, entries))[2]):
        ca, cb = (np.einsum("kn,tnc->tkc", w, ranked) for w in solved[:2])
        a, b = ordered_ends(quantise565(ca), quantise565(cb), 0xFFFF, entries == 4)
        ends = [np.concatenate([ends[0], a], axis=1), np.concatenate([ends[1], b], axis=1)]
    cuts_ = ends[0].shape[1]
    code = (np.arange(tiles)[:, None] << 32 | ends[0] << 16 | ends[1]).ravel()
    code, first = np.unique(code, return_index=True)
    tile = code >> 32
    ea, eb = (expand565(x) @ PERCEPTUAL for x in (code >> 16 & 0xFFFF, code & 0xFFFF))
    own = target[tile]
    best = idx = None
    for e, w in enumerate(steps):
        d = own - (ea * (1 - w) + eb * w).astype(np.float32)[:, None]
        d = np.einsum("knc,knc->kn", d, d)
        idx = np.zeros(d.shape, np.int8) if best is None else np.where(d < best, np.int8(e), idx)
        best = d if best is None else np.minimum(best, d)
    error = np.sqrt(best).sum(axis=1, dtype=np.float64)
    order_ = np.lexsort((first, error, tile))  # the first among equals, the box's ends before all cuts
    won = order_[np.searchsorted(tile[order_], np.arange(tiles))]
    out = np.empty((tiles, n), np.int64)
    np.put_along_axis(out, order, idx[won].astype(np.int64), axis=1)
    assert (first[won] // cuts_ == np.arange(tiles)).all()
    return code[won] >> 16 & 0xFFFF, code[won] & 0xFFFF, out, error[won]


#: In levels: over twice what single precision can be off in a tile's total error (0.02), far less than pairs of ends differ by.
ROUGHLY = 0.05


def _rough_errors(v: np.ndarray, hi: np.ndarray, lo: np.ndarray, entries: int) -> np.ndarray:
    """Total absolute error of values [n] in palettes between different ends, in levels, in single precision: distances to the nearest of evenly spaced entries."""
    low, step = lo.astype(np.float32), (hi - lo).astype(np.float32) / np.float32(entries - 1)
    place = (v * 255).astype(np.float32)[:, None] - low
    place /= step
    near = np.rint(place)
    np.clip(near, 0, entries - 1, out=near)
    place -= near
    np.abs(place, out=place)
    return place.sum(axis=0) * step


def _levels(v: np.ndarray) -> np.ndarray:
    """Quantised in place."""
    v *= 255
    return np.clip(v, 0, 255, out=v).astype(np.uint8)


def fit_values(s: np.ndarray, mode: str = "faithful", block: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends (0..255) and indices of tiles of values [tiles, 16] in a palette of eight.

    'faithful' takes the signed difference for the error: the largest entry is always nearest, and the
    search raises the first end as far as it goes. 'corrected' takes its size: each pair of ends that some cut gives is
    judged in single precision, and those as good as the best by that, within what it may be off, in double.
    """
    wa, wb, _ = solver(16, 8)
    ends, index, steps = np.zeros((2, len(s)), np.int64), np.zeros((len(s), 16), np.int64), np.linspace(0, 1, 8)
    solved = [np.empty((min(block, len(s)), len(wa))) for _ in range(2)]
    for i in range(0, len(s), block):
        part = np.asarray(s[i : i + block], float)
        ranked = np.sort(part, axis=1)
        for w, x in zip((wa, wb), solved, strict=True):
            np.matmul(ranked, w.T, out=x[: len(part)])
        for t in range(len(part)):
            # the box's ends come before those of the cuts
            a, b = ordered_ends(*(np.concatenate([_levels(ranked[t, k]), _levels(x[t])]) for k, x in zip(([0], [15]), solved, strict=True)), 255)
            if mode == "faithful":
                k = a.argmax()
                ends[:, i + t] = a[k], b[k]
                continue
            pairs = a.astype(np.uint16) << 8 | b
            code = np.sort(pairs, kind="stable")
            code = code[np.append(True, code[1:] != code[:-1])].astype(np.int64)
            rough = _rough_errors(ranked[t], code >> 8, code & 255, 8)
            code = code[rough <= rough.min() + ROUGHLY]
            palette = (code >> 8)[:, None] / 255 * (1 - steps) + (code & 255)[:, None] / 255 * steps
            apart = np.abs(part[t][None, :, None] - palette[:, None, :])
            error = apart.min(axis=2).sum(axis=1)
            best = np.flatnonzero(error == error.min())
            k = best[0] if len(best) == 1 else min(best, key=lambda k: (pairs == code[k]).argmax())  # the first cut among equals
            ends[:, i + t] = code[k] >> 8, code[k] & 255
            index[i + t] = apart[k].argmin(axis=1)
    return ends[0], ends[1], index
