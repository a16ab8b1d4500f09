"""Removal of long byte strings that occur more than once, by a distributed suffix sort.

Removed is each byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else in the corpus. A full suffix array of the corpus would be many times its size, so
only anchored suffixes are sorted: in each window of LENGTH bytes the q-gram with the
smallest hash (leftmost among equals) is its anchor. Equal windows have their anchor
at the same place, whatever stands around them, so windows need comparing only where
their anchors' q-grams are equal: nothing is sampled and nothing is missed.

1. One pass emits (q-gram, document, position) of each anchor, about one in 185 bytes,
   packed by key range. Where a q-gram recurs inside a batch all its anchors there are known to be shared;
   one of them travels, so a frequent q-gram sends one record a batch. Other anchors whose q-gram is anchor nowhere else are dropped.
2. The documents that still have anchors are read again, copies merged on the way. Each task sorts the suffixes at
   its anchors and sends them as front-coded runs (what a suffix shares with the one
   before is not repeated; equal contexts are sent once) to the parts that own their q-grams.
3. A part merges its runs with a loser tree that compares beyond known prefixes only, and so
   has the sorted suffixes and what neighbours share. Equal contexts are settled at sight. A window that starts d bytes before
   its anchor occurs twice if another suffix of the q-gram shares LENGTH - d bytes to
   the right and d bytes to the left.
4. Windows found twice are united by document and cut out.

Beside the bytes, documents are told that share a passage of over 50 words with another, however short in bytes (``passages``); the
anchors in words are found in the same way, and their texts travel with those of step 2.

Documents of equal text are one document with copies, known by 128 bits of their SHA-256; if there are copies and LENGTH
bytes, the whole text goes. Texts of any length are read in pieces of ``CHUNK_BYTES`` that overlap by a window.

Defined results: null text is empty (nothing removed); texts under LENGTH bytes stay; rows
that repeat an id are judged by their own texts, and equal texts under one id are copies of each other; there are no ties, as all of
a repeated string's places lose it; an empty table gives an empty result; other columns are ignored, and result columns get an
underscore where the id column has their name. shares_passage counts copies of a text of over 50 words as sharing it, and a passage twice in one document alone not.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.llm.bytes_np import BYTE_KEYS, INVERSE, mix, powers, text_bytes
from quilter.llm.common import Staged, arrow_map, free, spread_join
from quilter.llm.loser_tree import common_prefix, front_code, merge
from quilter.llm.ngram_join import _by_run, _chunks
from quilter.llm.passages import WordAnchors, joined, minimizers, sharing

LENGTH, GRAM = 400, 32
CHUNK_BYTES = 1 << 20
#: Bits of a hash and of a position in one sort key of a window's minimum.
PLACE_BITS = 28
#: Groups of more suffixes than this are settled depth by depth, not pair by pair.
PAIRWISE = 48
BROADCAST_IDS = 500_000
#: A task's suffixes are sent when they hold so many bytes.
RUN_BYTES = 24 << 20
#: a, b: the document's digest; at: anchor; lo, hi: windows start from at - hi to at - lo
ANCHOR = np.dtype([("key", "<u8"), ("a", "<u8"), ("b", "<u8"), ("at", "<u4"), ("lo", "<u2"), ("hi", "<u2")])
DIGEST = 16
#: A text of over 50 words.
WORDY = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){50}[^\x20\x09-\x0D]"


class Anchors:
    """Anchors of many texts at once."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up, self.down = powers(CHUNK_BYTES), powers(CHUNK_BYTES, INVERSE)

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, position in the row, key, lo, hi) of each anchor, in order. Long rows are taken in pieces."""
        if len(offsets) == 2 and len(raw) > CHUNK_BYTES + self.length:
            pieces = []
            for at in range(0, len(raw) - self.length + 1, CHUNK_BYTES):
                piece = raw[at : at + CHUNK_BYTES + self.length - 1]
                _, place, key, lo, hi = self._find(piece, np.array([0, len(piece)]))
                pieces.append((place + at, key, lo, hi))
            place, key, lo, hi = joined(pieces)
            return np.zeros(len(place), np.int64), place, key, lo, hi
        return self._find(raw, offsets)

    def _find(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size, none = len(raw), np.zeros(0, np.int64)
        if size < self.length:
            return none, none, none.astype(np.uint64), none, none
        if size >= len(self.up):
            self.up, self.down = powers(size), powers(size, INVERSE)
        running = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE_KEYS[raw] * self.up[:size], out=running[1:])
        n = size - self.gram + 1
        key = mix((running[self.gram :] - running[:n]) * self.down[:n])
        return minimizers(key, offsets, self.length, self.gram, PLACE_BITS)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = text_bytes(batch.column(column))
    for a, b in _chunks(offsets):
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _part(key: np.ndarray, parts_log: int) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - parts_log)).astype(np.int64)


def _unique(rec: np.ndarray) -> np.ndarray:
    """Records in order of key and document, each place once."""
    rec = rec[np.lexsort((rec["at"], rec["b"], rec["a"], rec["key"]))]
    same = np.ones(max(0, len(rec) - 1), bool)
    for name in ("key", "a", "b", "at"):
        same &= rec[name][1:] == rec[name][:-1]
    return rec[np.concatenate([[True], ~same])] if len(rec) else rec


def _by_doc(rec: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(digest, records) of each document among the records."""
    rec = rec[np.lexsort((rec["b"], rec["a"]))]
    cut = np.flatnonzero(np.concatenate([[True], (rec["a"][1:] != rec["a"][:-1]) | (rec["b"][1:] != rec["b"][:-1])]))
    names = np.stack([rec["a"][cut], rec["b"][cut]], axis=1).tobytes()
    return _binary(names, np.arange(len(cut) + 1) * DIGEST), _binary(rec.tobytes(), np.append(cut, len(rec)) * ANCHOR.itemsize)


def _anchors(batches: Iterator[pa.RecordBatch], make, parts_log: int) -> Iterator[pa.RecordBatch]:
    """(part, records) of anchors to be compared with those of other batches; (doc, records) of anchors shared inside a batch."""
    finder, names = make(), ["part", "doc", "data"]
    for batch in batches:
        docs = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(-1, 2)
        out = []
        for a, _, raw, offsets in _texts(batch, 1):
            row, at, key, lo, hi = finder.find(raw, offsets)
            rec = np.empty(len(row), ANCHOR)
            rec["key"], rec["a"], rec["b"], rec["at"], rec["lo"], rec["hi"] = key, docs[a + row, 0], docs[a + row, 1], at, lo, hi
            out.append(rec)
        if not out or not len(rec := _unique(np.concatenate(out))):
            continue
        first = np.concatenate([[True], rec["key"][1:] != rec["key"][:-1]])
        group = np.cumsum(first) - 1
        shared = np.bincount(group)[group] > 1
        if shared.any():
            doc, data = _by_doc(rec[shared])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int32()), doc, data], names)
        rec = rec[first]
        part = _part(rec["key"], parts_log)
        order = np.argsort(part, kind="stable")
        part, rec = part[order], rec[order]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        data = _binary(rec.tobytes(), np.append(cut, len(rec)) * ANCHOR.itemsize)
        yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.nulls(len(cut), pa.binary()), data], names)


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.asarray(ends, np.int32)), pa.py_buffer(data)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part, the anchors whose key occurs at two places, by document."""
    for _, held in _by_run(batches, 0):
        rec = _unique(np.frombuffer(b"".join(x for h in held for x in h.column(1).to_pylist()), ANCHOR))
        if not len(rec):
            continue
        group = np.cumsum(np.concatenate([[True], rec["key"][1:] != rec["key"][:-1]])) - 1
        rec = rec[np.bincount(group)[group] > 1]
        if len(rec):
            yield pa.RecordBatch.from_arrays(list(_by_doc(rec)), ["doc", "anchors"])


ENTRY = "<HHH16sIHB"  # shared prefix, length of the rest, of the left side, doc, at, lo, whether the context is that of the entry before


def _runs(batches: Iterator[pa.RecordBatch], length: int, parts_log: int) -> Iterator[pa.RecordBatch]:
    """For each part, front-coded runs of the anchored suffixes (q-gram key first), with what stands to their left."""
    by_part: dict[int, list[tuple[bytes, bytes, int, bytes, int]]] = {}
    held = 0

    def send() -> pa.RecordBatch:
        parts, runs = [], []
        for p, entries in by_part.items():
            entries = sorted(set(entries))  # a place may be known from a batch and from its part
            out, last = [], None
            for (n, rest), e in zip(front_code([e[0] for e in entries]), entries, strict=True):
                suffix, left, lo, doc, at = e
                again = last == (suffix, left)
                last = suffix, left
                out.append(struct.pack(ENTRY, n, len(rest), 0 if again else len(left), doc, at, lo, again))
                out += [rest] if again else [rest, left]
            parts.append(p)
            runs.append(b"".join(out))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(runs, pa.binary())], ["part", "run"])

    for batch in batches:
        for doc, text, lists in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            raw, doc = text.as_py().encode(), doc.as_py()
            for data in lists.as_py():
                rec = np.frombuffer(data, ANCHOR)
                part = _part(rec["key"], parts_log).tolist()
                for p, (key, _, _, at, lo, hi) in zip(part, rec.tolist(), strict=True):
                    suffix = key.to_bytes(8, "big") + raw[at : at + length - lo]
                    by_part.setdefault(p, []).append((suffix, raw[at - hi : at], lo, doc, at))
                    held += len(suffix) + hi + 300
                if held > RUN_BYTES:
                    yield send()
                    by_part, held = {}, 0
    if by_part:
        yield send()


def _read_run(data: bytes) -> Iterator[tuple[int, bytes, object]]:
    at, size, before = 0, struct.calcsize(ENTRY), b""
    while at < len(data):
        n, rest, left, doc, place, lo, again = struct.unpack_from(ENTRY, data, at)
        at += size
        side = before if again else data[at + rest : at + rest + left]
        yield n, data[at : at + rest], (side, doc, place, lo)
        at += rest + left
        before = side


def _pair(shared: int, left: int, lo: int, hi: int, length: int) -> tuple[int, int]:
    return max(lo, length - shared), min(hi, left)


def settle(group: list[tuple[int, bytes, bytes, int]], length: int) -> list[tuple[int, int, int]]:
    """(member, from, to): distances before the anchor at which its window occurs twice.

    group: (prefix shared with the suffix before, suffix, left side, lo), sorted by suffix.
    """
    out: list[tuple[int, int, int]] = []
    g = len(group)
    if g == 2:
        (_, _, la, loa), (shared, _, lb, lob) = group
        left = common_prefix(la[::-1], lb[::-1])
        for i, lo, hi in ((0, loa, len(la)), (1, lob, len(lb))):
            a, b = _pair(shared, left, lo, hi, length)
            if a <= b:
                out.append((i, a, b))
        return out
    lo = np.array([x[3] for x in group])
    hi = np.array([len(x[2]) for x in group])
    by_left = sorted(range(g), key=lambda i: group[i][2][::-1])
    rank = np.empty(g, np.int64)
    rank[by_left] = np.arange(g)
    backs = [group[i][2][::-1] for i in by_left]
    left = np.array([0, *(common_prefix(a, b) for a, b in zip(backs[:-1], backs[1:], strict=True))])
    right = np.array([x[0] for x in group])
    if g <= PAIRWISE:
        for i in range(g):
            r = np.empty(g, np.int64)
            r[i + 1 :] = np.minimum.accumulate(right[i + 1 :])
            r[:i] = np.minimum.accumulate(right[i:0:-1])[::-1]
            k = rank[i]
            back = np.empty(g, np.int64)
            back[k + 1 :] = np.minimum.accumulate(left[k + 1 :])
            back[:k] = np.minimum.accumulate(left[k:0:-1])[::-1]
            a, b = np.maximum(lo[i], length - r), np.minimum(hi[i], back[rank])
            a[i], b[i] = 1, 0
            out += [(i, x, y) for x, y in set(zip(a[a <= b].tolist(), b[a <= b].tolist(), strict=True))]
        return out
    for d in range(int(lo.min()), int(hi.max()) + 1):
        own = np.flatnonzero((lo <= d) & (hi >= d))
        if len(own) < 2:
            continue
        right_class = np.cumsum(right < length - d)
        left_class = np.cumsum(left < d)[rank]
        both = right_class[own] * np.int64(g + 1) + left_class[own]
        _, inverse, times = np.unique(both, return_inverse=True, return_counts=True)
        out += [(i, d, d) for i in own[times[inverse] > 1].tolist()]
    return out


def _found(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc, from, to) of bytes to remove, from the merged runs of each part."""

    def spans(group: list[tuple[int, bytes, bytes, bytes, int, int]]) -> list[tuple[bytes, int, int]]:
        if len(group) < 2:
            return []
        got = settle([(n, s, left, lo) for n, s, left, _, _, lo in group], length)
        return [(group[i][3], group[i][4] - b, group[i][4] - a + length) for i, a, b in got]

    for _, held in _by_run(batches, 0):
        runs = [_read_run(x) for h in held for x in h.column(1).to_pylist()]
        out: list[tuple[bytes, int, int]] = []
        group: list[tuple[int, bytes, bytes, bytes, int, int]] = []
        lefts: dict[bytes, tuple[bytes, int]] = {}  # left sides of the suffixes equal to the last one
        seen: set[tuple[bytes, int]] = set()
        least = 0  # what the group's next member shares with its last
        for shared, suffix, (left, doc, at, lo) in merge(runs):
            if shared < 8:
                out += spans(group)
                group, seen, least = [], set(), 0
                lefts = {}
            elif shared < len(suffix) or not group or len(group[-1][1]) != len(suffix):
                lefts = {}
            least = shared if not group or least < 0 else min(least, shared)
            if (doc, at) in seen:
                continue  # the same document came from several rows
            seen.add((doc, at))
            if left in lefts:  # the same context: each window of it occurs twice
                if lefts[left] is not None:
                    first, place = lefts[left]
                    out.append((first, place - len(left), place - lo + length))
                    lefts[left] = None
                out.append((doc, at - len(left), at - lo + length))
            else:
                lefts[left] = doc, at
                group.append((max(0, least - 8), suffix, left, doc, at, lo))
                least = -1
            if len(out) > 100_000:
                yield _spans_batch(out)
                out = []
        out += spans(group)
        if out:
            yield _spans_batch(out)


def _spans_batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    doc, a, b = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc", "lo", "hi"])


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, count, sha, kept = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw, at, pieces = text.as_py().encode(), 0, []
            runs = union_spans([(s["lo"], s["hi"]) for s in spans.as_py()])
            for a, b in runs:
                pieces.append(raw[at:a])
                at = b
            rest = b"".join([*pieces, raw[at:]])
            removed.append(len(raw) - len(rest))
            count.append(len(runs))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        out = {"doc": batch.column(0), "removed": pa.array(removed, pa.int64()), "spans": pa.array(count, pa.int64()), "sha": pa.array(sha, pa.string())}
        if with_text:
            out["kept"] = pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_pydict(out)


def dedup(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, shares_passage of every row, and on request the kept bytes (null where the text stays whole)."""
    spark = df.sparkSession
    staged = Staged(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    digest = F.substring(F.unhex(F.col("sha_")), 1, DIGEST)
    docs = df.select(text.alias("text_"), sha.alias("sha_")).select("text_", digest.alias("doc"))
    rows = df.select(F.col(id_col).alias("id_"), sha.alias("sha_"), F.octet_length(text).cast("long").alias("n_bytes"), text.rlike(WORDY).alias("wordy_"))
    rows = staged.put(rows.withColumn("doc", digest), "rows")
    total = rows.count()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_log = max(6, (4 * shuffles - 1).bit_length())
    long_ = docs.where(F.octet_length("text_") >= length)

    def shared(texts: DataFrame, make, name: str) -> DataFrame:
        """(doc, anchors) of the anchors that stand at two places or more."""
        every = staged.put(arrow_map(texts.select("doc", "text_"), partial(_anchors, make=make, parts_log=parts_log), "part int, doc binary, data binary"), f"{name}_anchors")
        travel = every.where("part is not null").select("part", "data").repartition(shuffles, "part").sortWithinPartitions("part")
        live = arrow_map(travel, _shared, "doc binary, anchors binary").union(every.where("part is null").select("doc", F.col("data").alias("anchors")))
        live = staged.put(live, f"{name}_live")
        staged.drop(f"{name}_anchors")
        return live

    live = shared(long_, partial(Anchors, length), "bytes")
    worded = shared(docs.where(F.col("text_").rlike(WORDY)), WordAnchors, "words")
    # texts without anchors need not travel; that some share 64 bits with one that has is no harm
    ids = live.select("doc").union(worded.select("doc")).select(F.xxhash64("doc").alias("pre_")).distinct()
    asked = docs.where((F.octet_length("text_") >= length) | F.col("text_").rlike(WORDY))
    if ids.count() <= BROADCAST_IDS:
        asked = asked.join(F.broadcast(ids), F.xxhash64("doc") == F.col("pre_"), "left_semi")
    none = F.lit(None)
    texts = asked.select("doc", "text_", none.cast("binary").alias("anchors"), none.cast("binary").alias("places"))
    both = texts.union(live.select("doc", none.cast("string"), "anchors", none.cast("binary"))).union(worded.select("doc", none.cast("string"), none.cast("binary"), "anchors"))
    # one shuffle brings texts and anchors together and makes one text of all copies; anchors are as long as the text at most
    suspects = both.groupBy("doc").agg(F.first("text_", ignorenulls=True).alias("text_"), F.collect_list("anchors").alias("anchors"), F.collect_list("places").alias("places"))
    suspects = staged.put(suspects.where((F.size("anchors") > 0) | (F.size("places") > 0)), "suspects")

    runs = arrow_map(suspects.where(F.size("anchors") > 0).select("doc", "text_", "anchors"), partial(_runs, length=length, parts_log=parts_log), "part int, run binary")
    runs = runs.repartition(shuffles, "part").sortWithinPartitions("part")
    spans = staged.put(arrow_map(runs, partial(_found, length=length), "doc binary, lo int, hi int"), "spans")
    spans = spans.distinct().groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = arrow_map(suspects.join(spans, "doc").select("doc", "text_", "spans"), partial(_cut, with_text=with_text), "doc binary, removed long, spans long, sha string" + ", kept binary" * with_text)

    copies = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("copies_"))
    told = sharing(suspects, worded, ANCHOR, staged, BROADCAST_IDS).withColumn("shares_", F.lit(True))
    facts = copies.join(cut, "doc", "left").join(told, "doc", "left").where("copies_ > 1 or sha is not null or shares_")
    facts = staged.put(facts, "facts")
    out = spread_join(rows, facts, "doc", "copies_", total)
    gone = (F.col("copies_") > 1) & (F.col("n_bytes") >= length)
    taken = (id_col,)
    cols = [
        F.col("id_").alias(id_col),
        F.col("n_bytes").alias(free("n_bytes", taken)),
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias(free("n_removed", taken)),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias(free("n_spans", taken)),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", "sha_")).alias(free("kept_sha256", taken)),
        (F.col("wordy_") & ((F.coalesce("copies_", F.lit(1)) > 1) | F.coalesce("shares_", F.lit(False)))).alias(free("shares_passage", taken)),
    ]
    return out.select(*cols, *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias(free("kept", taken))] if with_text else []))
