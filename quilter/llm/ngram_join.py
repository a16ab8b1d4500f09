"""Exact self-join of documents by Jaccard of word n-grams, and its groups.

A document's set holds its distinct shingles of ``WORDS`` words as 64-bit hashes. Documents
of equal sets are one node, named by a digest of 128 bits. Nodes at or over the
threshold link; a group is a connected component.

1. One pass gives each document's set size, digest and bitmap, and counts the shingles that
   recur inside a task; those that recur in many documents are hot (``HOT_MOST`` of them at most).
2. A second pass emits each set's prefix: the first ``n - ceil(t n) + 1`` shingles in the order
   (not hot, hash). Two sets at or over the threshold share one of them, whatever the
   order; putting hot shingles last only keeps shared passages out of the index.
   Records are packed by key range, so a shuffle moves 20 bytes a record; half a digest and the size name a node there.
3. Nodes with a key in common are united into tiles of bounded size, and a tile is cut
   wherever sizes differ by more than the threshold allows. Tiles that overlap become one
   as long as that is within the bound. The members of a key that is too frequent for that become pieces,
   each a tile of its own, and a bridge, a tile of members from every piece.
4. A tile first gets a bitmap of hashed shingles for each member. The bits in which two
   bitmaps differ bound the sets' difference from below, so a popcount rules out most
   pairs; what it leaves connected are smaller tiles. Only those get the sets
   themselves: pairs are settled by intersecting sorted arrays. Both look at members that are not
   yet connected only, so a group of near copies takes one row of comparisons, not all pairs.
   No pairs leave a tile, only one link for each member that is connected.
5. Components of the links, by alternating stars. Frequent keys whose pieces are by now one component are done;
   for the others each pair of pieces of compatible sizes becomes a tile, steps 4 and 5 again.

No link between different sets is lost: prefixes, size bands and bitmaps only rule out
what cannot reach the threshold. (Hashes of 64 bits are taken for the shingles.)

Defined results: null, empty or blank text has size 0, links with nothing and is its own
group; a text of fewer words than ``WORDS`` is one shingle; rows that repeat an id are
judged by their own texts; a null id takes part, and a group's name is its smallest
id that is not null; a pair just at the threshold links; an empty table gives an empty result; other columns are ignored, or
kept by ``keep_one``, and result columns get an underscore where the id column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quilter.llm.bytes_np import BASE, BYTE_KEYS, INVERSE, binary_column, digest_array, digest_column, halves, joined_bytes, mix, powers, text_bytes
from quilter.llm.common import Staged, arrow_map, free, spread_join
from quilter.llm.components import components

WORDS = 5
#: Threshold as a ratio of whole numbers.
NUM, DEN = 80, 100
CHUNK_BYTES = 1 << 20
#: A tile's sets hold at most this many shingles, unless two members alone hold more.
TILE_SHINGLES = 1 << 21
#: The bound for tiles that were merged: 64 MB of hashes in one task.
MERGED_SHINGLES = 1 << 23
#: A shingle is hot in more documents than this, or than one in HOT_SHARE of all.
HOT_LEAST, HOT_SHARE = 16, 1 << 14
#: At most so many shingles, the most frequent, are taken for hot: 16 MB to each worker.
HOT_MOST = 1 << 21
#: Part of the hash space in which hot shingles are sought: prefixes hold the smallest hashes.
HOT_BELOW = np.uint64(int(0.3 * 2**64))
HOT_BUFFER, HOT_LOCAL = 1 << 21, 2
#: At most so many ids are broadcast to pick the texts whose sets are needed.
BROADCAST_IDS = 500_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SHINGLE_KEYS = mix(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)
RECORD = np.dtype([("key", "<u8"), ("short", "<u8"), ("n", "<u4")])
SALT = np.uint64(0x5851F42D4C957F2D)


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK_BYTES, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


class Shingler:
    """Sets of many texts at once; keeps the power tables."""

    def __init__(self):
        self.up, self.down = powers(CHUNK_BYTES), powers(CHUNK_BYTES, INVERSE)

    def sets(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of each row, flat, and n + 1 offsets."""
        rows, size = len(offsets) - 1, len(raw)
        if size >= len(self.up):
            self.up, self.down = powers(size), powers(size, INVERSE)
        low = LOWER[raw]
        solid = ~SPACE[raw]
        first = np.zeros(size + 1, bool)
        first[offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:size]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | first[1:size]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        running = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE_KEYS[low] * self.up[:size], out=running[1:])
        words = mix((running[stop] - running[start]) * self.down[start])
        row = np.searchsorted(offsets, start, "right") - 1
        count = np.bincount(row, minlength=rows)
        base = np.cumsum(count) - count
        keys = SHINGLE_KEYS
        full = np.flatnonzero(np.arange(len(words)) + WORDS <= (base + count)[row]) if len(words) else np.zeros(0, np.int64)
        hashes = np.zeros(len(full), np.uint64)
        for k in range(WORDS):
            hashes += words[full + k] * keys[k]
        hashes, owner = mix(hashes), row[full]
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            few = np.array([int(np.sum(words[base[r] : base[r] + count[r]] * keys[: count[r]])) + int(keys[WORDS]) * int(count[r]) & 0xFFFFFFFFFFFFFFFF for r in short], np.uint64)
            hashes, owner = np.concatenate([hashes, mix(few)]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
        ends = np.cumsum(np.bincount(owner, minlength=rows))
        at = 0
        for e in ends.tolist():
            hashes[at:e].sort()
            at = e
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        return hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=rows))])

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, hashes, offsets) by chunks."""
        raw, offsets = text_bytes(texts)
        for a, b in _chunks(offsets):
            yield a, b, *self.sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def digests(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A digest of 128 bits of each set."""
    out = np.empty((len(offsets) - 1, 2), "<u8")
    for i, salt in enumerate((BASE, SALT)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ salt))])
        out[:, i] = mix(total[offsets[1:]] - total[offsets[:-1]] + (np.diff(offsets).astype(np.uint64) << np.uint64(40)) + salt)
    return out.view("S16").ravel()


def shorts(names: np.ndarray) -> np.ndarray:
    """The first half of each digest."""
    return np.ascontiguousarray(halves(names)[:, 0])


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two not under twice its size."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def bitmaps(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each set's bitmap, flat, and n + 1 offsets. Bit h mod width is set for each hash h."""
    n = np.diff(offsets)
    width = widths(n)
    start = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(n)), n)
    bits = np.zeros(start[-1], bool)
    bits[start[owner] + (hashes & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little"), start // 8


def _measure(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, node) of documents and rows (key, times) of shingles seen again and again in this task."""
    shingler, kept, held = Shingler(), [], 0
    seen: set[int] = set()  # sets counted since the last rows of shingles
    id_type, names = None, [id_col, "n", "node", "short", "bits", "key", "times"]

    def recurring() -> pa.RecordBatch:
        key, times = np.unique(np.concatenate(kept), return_counts=True)
        key, times = key[times >= HOT_LOCAL], times[times >= HOT_LOCAL]
        none = pa.nulls(len(key), pa.int64())
        blank = pa.nulls(len(key), pa.binary())
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), id_type), none, blank, none, blank, pa.array(key.view(np.int64)), pa.array(times)], names)

    for batch in batches:
        id_type = batch.column(0).type
        n, node, bits = [], [], []
        for _, _, hashes, offsets in shingler.column(batch.column(1)):
            data, ends = bitmaps(hashes, offsets)
            bits.append(binary_column(data, ends))
            n.append(np.diff(offsets))
            node.append(digests(hashes, offsets))
            fresh = np.zeros(len(offsets) - 1, bool)
            for i, name in enumerate(node[-1].tolist()):
                fresh[i] = name not in seen
                seen.add(name)
            kept.append(hashes[(hashes < HOT_BELOW) & np.repeat(fresh, n[-1])])
            held += len(kept[-1])
            if held > HOT_BUFFER:
                yield recurring()
                kept, held = [], 0
                seen.clear()
        if n:
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), digest_column(names_ := np.concatenate(node)), pa.array(shorts(names_).view(np.int64)), pa.concat_arrays(bits), none, none], names)
    if held:
        yield recurring()


def prefixes(hashes: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Mask of the shingles in their set's prefix."""
    n = np.diff(offsets)
    want = n - (NUM * n + DEN - 1) // DEN + (n > 0)
    owner = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(hashes), bool)
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
    rank = np.empty(len(hashes), np.int64)
    early_before = np.cumsum(~late) - ~late
    early = np.bincount(owner, ~late, len(n)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(~late)])[offsets[:-1]]
    rank = np.where(late, early[owner] + (np.arange(len(hashes)) - offsets[:-1][owner]) - (early_before - base[owner]), early_before - base[owner])
    return rank < want[owner]


def _index(batches: Iterator[pa.RecordBatch], hot, parts_log: int) -> Iterator[pa.RecordBatch]:
    shingler, late = Shingler(), hot.value
    for batch in batches:
        out = []
        for _, _, hashes, offsets in shingler.column(batch.column(0)):
            n = np.diff(offsets)
            pick = prefixes(hashes, offsets, late)
            owner = np.repeat(np.arange(len(n)), n)[pick]
            rec = np.empty(len(owner), RECORD)
            rec["key"], rec["short"], rec["n"] = hashes[pick], shorts(digests(hashes, offsets))[owner], n[owner]
            out.append(rec)
        if out and len(rec := np.concatenate(out)):
            part = (mix(rec["key"]) >> np.uint64(64 - parts_log)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, rec = part[order], rec[order]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cut, len(rec))
            data = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((ends * RECORD.itemsize).astype(np.int32)), pa.py_buffer(rec.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), data], ["part", "data"])


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def tiles_of(rec: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """(nodes, sizes, key) of tiles that cover every pair of records with a key in common and compatible sizes.

    With a key, the tile is one piece of a frequent key, whose pieces are yet to be paired with one another.
    """
    rec = rec[np.lexsort((rec["n"], rec["short"], rec["key"]))]
    rec = rec[np.concatenate([[True], rec[1:] != rec[:-1]])] if len(rec) else rec
    key = rec["key"]
    first = np.concatenate([[True], key[1:] != key[:-1]])[: len(rec)]
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    rec, group = rec[size[group] > 1], group[size[group] > 1]
    if not len(rec):
        return
    order = np.lexsort((rec["n"], rec["short"]))
    fresh = np.ones(len(rec), bool)
    fresh[1:] = (rec["short"][order][1:] != rec["short"][order][:-1]) | (rec["n"][order][1:] != rec["n"][order][:-1])
    at = np.empty(len(rec), np.int64)
    at[order] = np.cumsum(fresh) - 1
    nodes = rec["short"][order[fresh]]
    n = np.zeros(len(nodes), np.int64)
    n[at] = rec["n"]
    union = Union(len(nodes))
    same = np.flatnonzero(group[1:] == group[:-1])
    for a, b in np.unique(np.stack([at[same], at[same + 1]], axis=1), axis=0).tolist():
        union.join(a, b)
    root = np.array([union.find(i) for i in range(len(nodes))])
    weight = np.bincount(root, n, len(nodes))
    small = weight[root] <= TILE_SHINGLES
    members = np.flatnonzero(small)
    order = members[np.argsort(root[members], kind="stable")]
    for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        yield from _bands(own, n, nodes, 0)
    wide = ~small[at]
    keys = rec["key"][wide]
    cuts = np.flatnonzero(np.diff(group[wide])) + 1
    for own, k in zip(np.split(at[wide], cuts), np.split(keys, cuts), strict=True) if wide.any() else []:
        yield from _bands(own, n, nodes, int(k[0]))


def _bands(own: np.ndarray, n: np.ndarray, nodes: np.ndarray, key: int) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """Cut members where sizes part, and into pieces and a bridge where they are too many."""
    own = own[np.argsort(n[own], kind="stable")]
    gap = np.flatnonzero(DEN * n[own][:-1] < NUM * n[own][1:]) + 1
    for band in np.split(own, gap):
        if len(band) < 2:
            continue
        total = int(n[band].sum())
        if total <= TILE_SHINGLES:
            yield nodes[band], n[band], None
            continue
        half = (np.cumsum(n[band]) // (TILE_SHINGLES // 2)).astype(np.int64)
        for piece in np.split(band, np.flatnonzero(np.diff(half)) + 1):
            yield nodes[piece], n[piece], key
        step = -(-total // (TILE_SHINGLES // 2))
        yield nodes[band[::step]], n[band[::step]], None


def _by_run(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Consecutive rows with the same value, which may span batches."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and values[a] != name:
                yield name, held
                held = []
            name = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield name, held


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, nodes, key, low, high): low and high are a piece's smallest and largest set."""
    for _, held in _by_run(batches, 0):
        data = b"".join(joined_bytes(h.column(1)) for h in held)
        found = [t for t in tiles_of(np.frombuffer(data, RECORD)) if len(t[0]) > 1 or t[2] is not None]
        for i in range(0, len(found), 1000):
            part = found[i : i + 1000]
            names = np.array([[mix(nodes).sum(), mix(nodes ^ SALT).sum()] for nodes, _, _ in part], "<u8")  # the same nodes under several keys are one tile
            flat = pa.array(np.concatenate([t for t, _, _ in part]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(t) for t, _, _ in part)]), pa.int32()), flat)
            keys = [None if k is None else k - (1 << 64) if k >= 1 << 63 else k for _, _, k in part]
            low, high = ([int(f(n)) for _, n, _ in part] for f in (np.min, np.max))
            cols = [digest_column(mix(names.ravel()).view("S16")), lists, pa.array(keys, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["tile", "nodes", "key", "low", "high"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for _, _, hashes, offsets in shingler.column(batch.column(0)):
            data = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(hashes.tobytes())])
            yield pa.RecordBatch.from_arrays([digest_column(digests(hashes, offsets)), pa.array(np.diff(offsets)), data], ["node", "n", "set"])


class Groups:
    """Which of 0..n-1 are connected, as an array of labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def others(self, i: int, end: int) -> np.ndarray:
        """Those from i + 1 to the end that are not connected with i."""
        return np.flatnonzero(self.label[i + 1 : end] != self.label[i]) + i + 1

    def join(self, i: int, more: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[more], self.label[i]))
        if len(labels) == 2:
            self.label[self.label == labels[1]] = labels[0]
        elif len(labels) > 2:
            at = np.minimum(np.searchsorted(labels, self.label), len(labels) - 1)
            self.label[labels[at] == self.label] = labels[0]


class Bits:
    """Bitmaps of sets ordered by size.

    Of compatible sets the larger has a bitmap of the same width or twice it; twice it is folded.
    """

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray]):
        self.sizes = sizes
        self.width = np.array(list(map(len, bits)))
        first = np.searchsorted(self.width, np.unique(self.width))
        self.of: dict[int, tuple[int, np.ndarray]] = {}
        self.folded: dict[int, np.ndarray] = {}
        for at, end in zip(first.tolist(), [*first[1:].tolist(), len(self.width)], strict=True):
            rows = np.stack(bits[at:end]).view(np.uint64)
            self.of[int(self.width[at])] = at, rows
            if rows.shape[1] > 1:
                self.folded[int(self.width[at]) // 2] = rows[:, : rows.shape[1] // 2] | rows[:, rows.shape[1] // 2 :]

    def end(self, i: int) -> int:
        """After the last set whose size may reach the threshold with i's."""
        return int(np.searchsorted(self.sizes, self.sizes[i] * DEN // NUM, "right"))

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of the other sets, in order and of compatible sizes, those the bitmaps cannot rule out, nearest first.

        J >= t means |A xor B| <= (1 - t) / (1 + t) (|A| + |B|), and differing bits are at most that many.
        """
        at, rows = self.of[int(self.width[i])]
        own, wide = rows[i - at], int(np.searchsorted(others, at + len(rows)))
        apart = np.bitwise_count(rows[others[:wide] - at] ^ own).sum(axis=1, dtype=np.int64)
        if wide < len(others):
            more = self.folded[int(self.width[i])][others[wide:] - at - len(rows)]
            apart = np.concatenate([apart, np.bitwise_count(more ^ own).sum(axis=1, dtype=np.int64)])
        keep = np.flatnonzero(apart * (DEN + NUM) <= (DEN - NUM) * (self.sizes[others] + self.sizes[i]))
        return others[keep[np.argsort(apart[keep], kind="stable")]]


def screened(sizes: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Labels of what the bitmaps leave connected."""
    groups, table = Groups(len(bits)), Bits(sizes, bits)
    for i in range(len(bits) - 1):
        others = groups.others(i, table.end(i))
        if len(others):
            groups.join(i, table.near(i, others))
    return groups.label


def links_of(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets ordered by size that connect whatever is connected, each to the first of its group."""
    sizes = np.array(list(map(len, sets)))
    flat, ends = bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    groups, table = Groups(len(sets)), Bits(sizes, np.split(flat, ends[1:-1]))
    for i in range(len(sets) - 1):
        others = groups.others(i, table.end(i))
        near = table.near(i, others) if len(others) else others
        linked: list[int] = []
        settled = {int(groups.label[i])}
        for j in near.tolist():
            if (label := int(groups.label[j])) not in settled:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if DEN * both >= NUM * (len(sets[i]) + len(sets[j]) - both):
                    settled.add(label)
                    linked.append(j)
        if linked:
            groups.join(i, np.array(linked))
    label = groups.label.tolist()
    return [(r, i) for i, r in enumerate(label) if r != i]


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile, the groups of nodes that bitmaps leave connected, as smaller tiles."""
    for _, held in _by_run(batches, 0):
        nodes = np.concatenate([digest_array(h.column(1)) for h in held])
        sizes = np.concatenate([h.column(2).to_numpy() for h in held])
        bits = [np.frombuffer(x, np.uint8) for h in held for x in h.column(3).to_pylist()]
        nodes, own = np.unique(nodes, return_index=True)
        order = np.argsort(sizes[own], kind="stable")
        nodes, sizes, bits = nodes[order], sizes[own][order], [bits[k] for k in own[order]]
        root = screened(sizes, bits)
        many = np.bincount(root, minlength=len(nodes))[root] > 1
        if many.any():
            yield pa.RecordBatch.from_arrays([digest_column(nodes[root[many]]), digest_column(nodes[many])], ["tile", "node"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held in _by_run(batches, 0):
        nodes = np.concatenate([digest_array(h.column(1)) for h in held])
        sets = [np.frombuffer(x, np.uint64) for h in held for x in h.column(2).to_pylist()]
        nodes, own = np.unique(nodes, return_index=True)
        sets = [sets[k] for k in own]
        order = np.argsort(list(map(len, sets)), kind="stable")
        links = links_of([sets[i] for i in order])
        if links:
            a, b = np.array(links).T
            yield pa.RecordBatch.from_arrays([digest_column(nodes[order[a]]), digest_column(nodes[order[b]])], ["a", "b"])


def merged(tiles: DataFrame, classes: DataFrame, staged: Staged, name: str) -> DataFrame:
    """Tiles that overlap become one, where that one is within a tile's size; so most sets travel once."""
    # 64 bits name a node in this graph; where two share them their tiles merge, which is no harm
    vertex = F.xxhash64("node").alias("v")
    star = tiles.select(vertex, F.min(vertex).over(Window.partitionBy("tile")).alias("first"))
    around = staged.put(components(star.select(F.col("v").alias("a"), F.col("first").alias("b")), staged, f"{name}_cc"), f"{name}_around")
    nodes = tiles.select("node").distinct().join(classes.select("node", "n"), "node").withColumn("v", vertex)
    rooted = nodes.join(around, nodes["v"] == around["node"], "left").select(nodes["node"], "n", F.coalesce("root", "v").alias("root"))
    nodes = staged.put(rooted, f"{name}_nodes")
    weight = nodes.groupBy("root").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("members"))
    fits = spread_join(nodes, staged.put(weight, f"{name}_weight"), "root", "members", nodes.count(), "inner")
    fits = staged.put(fits.select("node", "root", (F.col("weight") <= MERGED_SHINGLES).alias("fits")), f"{name}_fits")
    one = fits.where("fits").select(F.unhex(F.lpad(F.hex("root"), 16, "0")).alias("tile"), "node")
    apart = tiles.join(fits.where("not fits"), "node", "left_semi").select("tile", "node")
    return staged.put(one.union(apart), f"{name}_merged")


def links(tiles: DataFrame, docs: DataFrame, measured: DataFrame, classes: DataFrame, staged: Staged, name: str) -> DataFrame:
    """Links (a, b) that connect the nodes of each tile (tile, node) as far as their sets are alike."""
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = merged(tiles, classes, staged, f"{name}_tiles")
    signed = measured.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    signed = tiles.join(signed, "node").select("tile", "node", "n", "bits")
    signed = signed.repartition(shuffles, "tile").sortWithinPartitions("tile")
    tiles = staged.put(arrow_map(signed, _screen, "tile binary, node binary").distinct(), f"{name}_screened")
    tiles = merged(tiles, classes, staged, f"{name}_near")
    # one row stands for a node's copies; other rows of its id may give other sets, or a set twice, and a tile takes what it names once
    chosen = staged.put(classes.join(tiles.select("node").distinct(), "node", "left_semi").select(F.struct("low_").alias("chosen_")).distinct(), f"{name}_chosen")
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    texts = docs.join(chosen, F.struct(F.col("id_").alias("low_")) == F.col("chosen_"), "left_semi").select("text_")
    members = tiles.join(arrow_map(texts, _sets, "node binary, n long, set binary"), "node").select("tile", "node", "set")
    members = members.repartition(shuffles, "tile").sortWithinPartitions("tile")
    return staged.put(arrow_map(members, _link, "a binary, b binary"), f"{name}_links")


def unpaired(pieces: DataFrame, tiles: DataFrame, roots: DataFrame, staged: Staged) -> DataFrame:
    """(tile, node) of every pair of compatible pieces of a frequent key that is not one component by now."""
    own = tiles.join(pieces.select("tile").distinct(), "tile", "left_semi")
    rooted = own.join(roots, "node", "left").select("tile", F.coalesce("root", "node").alias("root"))
    ends = rooted.groupBy("tile").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    pieces = staged.put(pieces.join(ends, "tile"), "piece_ends")
    open_ = pieces.groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("key")
    left = pieces.join(open_, "key", "left_semi")
    right = left.select("key", *(F.col(c).alias(f"{c}_") for c in ("tile", "low", "high", "least", "most")))
    pairs = left.join(right, "key").where("tile < tile_")
    pairs = pairs.where(f"{DEN} * least(high, high_) >= {NUM} * greatest(low, low_)").where("not (least = most and least_ = most_ and least = least_)")
    pairs = staged.put(pairs.select(F.md5(F.concat("tile", "tile_")).cast("binary").alias("pair"), F.explode(F.array("tile", "tile_")).alias("tile")).distinct(), "piece_pairs")
    return pairs.join(own, "tile").select(F.col("pair").alias("tile"), "node").distinct()


def join(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, n_shingles, component_id of every row."""
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    staged = Staged(spark)
    docs = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    both = staged.put(arrow_map(docs, partial(_measure, id_col="id_"), f"id_ {kind}, n long, node binary, short long, bits binary, key long, times long"), "measured")
    measured = both.where("n is not null").select("id_", "n", "node", "short", "bits")
    total = measured.count()
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot = both.where("key is not null").groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") > limit)
    hot = hot.orderBy(F.desc("times"), "key").limit(HOT_MOST).select("key").toPandas()["key"]
    hot = spark.sparkContext.broadcast(np.sort(hot.to_numpy(np.int64).view(np.uint64)))
    classes = both.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("short").alias("short"), F.min("id_").alias("low_"), F.count(F.lit(1)).alias("rows_"))
    classes = staged.put(classes, "classes")

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_log = max(6, (4 * shuffles - 1).bit_length())
    index = arrow_map(docs.select("text_").where("text_ is not null"), partial(_index, hot=hot, parts_log=parts_log), "part int, data binary")
    index = index.repartition(shuffles, "part").sortWithinPartitions("part")
    found = staged.put(arrow_map(index, _tile, "tile binary, nodes array<long>, key long, low long, high long"), "found")
    tiles = found.dropDuplicates(["tile"]).select("tile", F.explode("nodes").alias("short"))
    # where two sets share half a digest both come into the tile
    tiles = staged.put(tiles.join(classes.select("short", "node"), "short").select("tile", "node"), "tiles")
    linked = links(tiles, docs, measured, classes, staged, "all")
    roots = staged.put(components(linked, staged, "links"), "roots")
    pieces = staged.put(found.where("key is not null").select("tile", "key", "low", "high").distinct(), "pieces")
    if not pieces.isEmpty():
        more = staged.put(unpaired(pieces, tiles, roots, staged), "unpaired")
        if not more.isEmpty():
            linked = linked.union(links(more, docs, measured, classes, staged, "more"))
            roots = staged.put(components(linked, staged, "every"), "every_root")

    rooted = staged.put(classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low_", "rows_"), "rooted")
    named = rooted.groupBy("root").agg(F.min("low_").alias("component_id"), F.count(F.lit(1)).alias("nodes_"))
    named = spread_join(rooted, staged.put(named, "named"), "root", "nodes_", total, "inner").select("node", "component_id", "rows_")
    out = spread_join(measured.select("id_", "n", "node"), staged.put(named, "classes_named"), "node", "rows_", total)
    return out.select(
        F.col("id_").alias(id_col),
        F.col("n").alias(free("n_shingles", (id_col,))),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id_")).alias(free("component_id", (id_col,))),
    )


def keep_one(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each group, of the smallest id (a null one last), then digest of the text; columns unchanged.

    Rows are told apart by id and text, so repeated and null ids are no exception; texts without a shingle are groups of their own.
    Only rows that go, or that stand more than once, are shuffled; the others stay where they are.
    """
    staged = Staged(df.sparkSession)
    text = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)), 1, 16)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(text_col).isNull().alias("blank"), text.alias("text"))
    groups = join(df.select(key.alias("key_"), F.col(text_col).alias("own_")), "key_", "own_")
    odd = groups.groupBy("key_").agg(F.first(F.col("key_").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("times"))
    odd = staged.put(odd.where("not stays or times > 1").withColumn("pre_", F.xxhash64("key_")), "odd")
    some = odd.select("pre_").distinct()
    if some.count() <= BROADCAST_IDS:
        some = F.broadcast(some)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row_"), key.alias("key_"))
    asked = F.xxhash64("key_") == F.col("pre_")
    plain = rows.join(some, asked, "left_anti").select("row_")
    asked_rows = rows.join(some, asked, "left_semi").groupBy("key_").agg(F.first("row_").alias("row_"))
    gone = odd.where("not stays").select(F.col("key_").alias("gone_"))
    again = asked_rows.join(gone, F.col("key_").eqNullSafe(F.col("gone_")), "left_anti").select("row_")
    return plain.union(again).select("row_.*")
