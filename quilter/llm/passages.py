"""Documents that hold a passage of many words which stands in another document too.

Words are runs of bytes other than ASCII white space, compared as they are. As for byte strings (``suffix_dedup``), each window
of ``WORDS`` words has an anchor, the 8-gram of words of least hash (leftmost among equals), and windows need
comparing only where their anchors' grams are equal. A document is told by one shared window, so this takes two rounds:

1. Of the anchors shared by two places or more, each document's ``FEW`` of smallest key give up to
   three windows each, at fixed distances, as hashes of 128 bits. Documents whose hash is another's too are settled; near
   copies and long passages nearly all are.
2. The anchors of the documents left, and those of any document with the same grams, give all their windows.

Hashes are counted by partial aggregates, and a frequent one's documents are told without being brought together. No window is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.llm.bytes_np import BASE, BYTE_KEYS, INVERSE, digest_column, mix, powers
from quilter.llm.common import Staged, arrow_map, spread_join

WORDS, GRAM = 51, 8
FEW, AT = 8, (0, 22, 43)
CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
GRAM_KEYS = mix(np.arange(1, GRAM + 1, dtype=np.uint64) + np.uint64(900)) | np.uint64(1)
#: Two bases of rolling hashes, and their inverses.
ROLLING = ((BASE, INVERSE), (np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))))


def minimizers(key: np.ndarray, offsets: np.ndarray, length: int, gram: int, place_bits: int) -> tuple[np.ndarray, ...]:
    """(row, place in the row, key, lo, hi) of each anchor of the windows of ``length`` units in rows of units.

    key: of the gram that begins at each unit, rows aside; windows start from place - hi to place - lo.
    """
    none = np.zeros(0, np.int64)
    size = len(key) + gram - 1
    if size < length:
        return none, none, none.astype(np.uint64), none, none
    low = (key & ~np.uint64((1 << place_bits) - 1)) | np.arange(len(key), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & np.uint64((1 << place_bits) - 1)).astype(np.int64)  # anchor of the window at each start
    inside = np.zeros(size - length + 2, np.int32)
    first, last = offsets[:-1], offsets[1:] - length
    own = last >= first
    np.add.at(inside, first[own], 1)
    np.add.at(inside, last[own] + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    at = at[start]
    if not len(at):
        return none, none, none.astype(np.uint64), none, none
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    end = np.append(cut[1:], len(at)) - 1
    place = at[cut]
    row = np.searchsorted(offsets, place, "right") - 1
    return row, place - offsets[row], key[place], place - start[end], place - start[cut]


def joined(pieces: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(place, key, lo, hi) of one row's anchors from those of its pieces: an anchor's windows may begin in two."""
    place, key, lo, hi = (np.concatenate(x) for x in zip(*pieces, strict=True))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
    if not len(first):
        return place, key, lo, hi
    return place[first], key[first], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)


class Words:
    """Hashes of the words of many texts at once."""

    def __init__(self):
        self.up, self.down = powers(CHUNK_BYTES), powers(CHUNK_BYTES, INVERSE)

    def read(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, n + 1 offsets of the rows' words, first byte of each word)."""
        size = len(raw)
        if size >= len(self.up):
            self.up, self.down = powers(size), powers(size, INVERSE)
        solid = ~SPACE[raw]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:size]
        end[:-1] &= ~solid[1:] | edge[1:size]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        running = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE_KEYS[raw] * self.up[:size], out=running[1:])
        words = mix((running[stop] - running[start]) * self.down[start])
        return words, np.searchsorted(start, offsets), start

    def pieces(self, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first word, hashes) of a long text in pieces that overlap by a window less one word."""
        at = base = 0
        width = CHUNK_BYTES
        while True:
            piece = raw[at : at + width]
            last = at + width >= len(raw)
            if not last:
                gaps = np.flatnonzero(SPACE[piece])
                piece = piece[: gaps[-1]] if len(gaps) else piece[:0]
            words, _, start = self.read(piece, np.array([0, len(piece)]))
            if last or len(words) >= WORDS:
                yield base, words
                if last:
                    return
                keep = len(words) - WORDS + 1
                at, base, width = at + int(start[keep]), base + keep, CHUNK_BYTES
            else:
                width *= 2


class WordAnchors:
    """Anchors of many texts at once, in words."""

    def __init__(self):
        self.words = Words()

    def _find(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        n = max(0, len(words) - GRAM + 1)
        key = np.zeros(n, np.uint64)
        for k in range(GRAM):
            key += words[k : k + n] * GRAM_KEYS[k]
        return minimizers(mix(key), offsets, WORDS, GRAM, 28)

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        if len(offsets) == 2 and len(raw) > 2 * CHUNK_BYTES:
            found = []
            for base, words in self.words.pieces(raw):
                _, place, *rest = self._find(words, np.array([0, len(words)]))
                found.append((place + base, *rest))
            place, key, lo, hi = joined(found)
            return np.zeros(len(place), np.int64), place, key, lo, hi
        words, rows, _ = self.words.read(raw, offsets)
        return self._find(words, rows)


def window_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit hashes of the windows that begin at some words."""
    out = np.empty((len(starts), 2), "<u8")
    n = len(words)
    for i, (base, inverse) in enumerate(ROLLING):
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words ^ base) * powers(n, base)[:n], out=running[1:])
        out[:, i] = mix((running[starts + WORDS] - running[starts]) * powers(n, inverse)[starts])
    return out.view("S16").ravel()


def _windows(batches: Iterator[pa.RecordBatch], anchor: np.dtype, few: bool) -> Iterator[pa.RecordBatch]:
    """(h, doc) of each document's windows."""
    reader = Words()
    for batch in batches:
        names, hashes = [], []
        for doc, text, lists in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            rec = np.frombuffer(b"".join(lists.as_py()), anchor)
            at, lo, hi = (rec[c].astype(np.int64) for c in ("at", "lo", "hi"))
            if few:
                pick = np.argsort(rec["key"], kind="stable")[:FEW]
                at, lo, hi = at[pick], lo[pick], hi[pick]
                starts = np.concatenate([(at - d)[(lo <= d) & (d <= hi)] for d in AT])
            else:
                n = hi - lo + 1
                starts = np.repeat(at - hi, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = np.unique(starts)
            raw = np.frombuffer(text.as_py().encode(), np.uint8)
            whole = [(0, reader.read(raw, np.array([0, len(raw)]))[0])] if len(raw) <= 2 * CHUNK_BYTES else reader.pieces(raw)
            for base, words in whole:
                own = starts[(starts >= base) & (starts <= base + len(words) - WORDS)] - base
                if len(own):
                    h = np.unique(window_hashes(words, own))
                    hashes.append(h)
                    names.append(np.full(len(h), doc.as_py(), "S16"))
        if hashes:
            yield pa.RecordBatch.from_arrays([digest_column(np.concatenate(hashes)), digest_column(np.concatenate(names))], ["h", "doc"])


def _keys(batches: Iterator[pa.RecordBatch], anchor: np.dtype) -> Iterator[pa.RecordBatch]:
    """(key, doc, place) of every anchor."""
    for batch in batches:
        for doc, data in zip(batch.column(0), batch.column(1), strict=True):
            rec = np.frombuffer(data.as_py(), anchor)
            ends = np.arange(len(rec) + 1, dtype=np.int32) * anchor.itemsize
            places = pa.Array.from_buffers(pa.binary(), len(rec), [None, pa.py_buffer(ends), pa.py_buffer(rec.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(rec["key"].view(np.int64)), digest_column(np.full(len(rec), doc.as_py(), "S16")), places], ["key", "doc", "place"])


def _settled(windows: DataFrame, staged: Staged, name: str) -> DataFrame:
    """The documents with a window that another has."""
    windows = staged.put(windows, f"{name}_windows")
    shared = windows.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("times")).where("least <> most")
    shared = staged.put(shared.select("h", "times"), f"{name}_shared")
    return staged.put(spread_join(windows, shared, "h", "times", windows.count(), "inner").select("doc").distinct(), f"{name}_settled")


def sharing(suspects: DataFrame, live: DataFrame, anchor: np.dtype, staged: Staged, broadcast_ids: int) -> DataFrame:
    """doc of every document that shares a passage of WORDS words or more with another.

    suspects: (doc, text_, places), places being lists of anchors of the kind ``anchor``; live: (doc, anchors), the same by parts.
    """
    schema = "h binary, doc binary"
    first = _settled(arrow_map(suspects.where(F.size("places") > 0).select("doc", "text_", "places"), partial(_windows, anchor=anchor, few=True), schema), staged, "few")
    places = staged.put(arrow_map(live, partial(_keys, anchor=anchor), "key long, doc binary, place binary").distinct(), "places")
    open_ = staged.put(places.join(first, "doc", "left_anti").select("key").distinct(), "open_keys")
    if open_.isEmpty():
        return first
    asked = staged.put(places.join(open_, "key", "left_semi").groupBy("doc").agg(F.collect_list("place").alias("places")), "asked")
    texts = suspects.select("doc", "text_")
    ids = asked.select(F.xxhash64("doc").alias("pre_")).distinct()
    if ids.count() <= broadcast_ids:
        texts = texts.join(F.broadcast(ids), F.xxhash64("doc") == F.col("pre_"), "left_semi")
    every = texts.join(asked, "doc").select("doc", "text_", "places")
    second = _settled(arrow_map(every, partial(_windows, anchor=anchor, few=False), schema), staged, "all")
    return first.union(second).distinct()
