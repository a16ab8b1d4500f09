"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash (hash and displace) over the vocabulary: a
pre-token that is a vocabulary entry is one id at once. Tier two, for the misses,
merges the lowest-ranked pair first with a heap of pairs over linked bytes, which
is O(n log n) in the length of a pre-token; the ranks of parts come from a plain dictionary. Each worker remembers the ids of
pre-tokens it has seen twice, in a dictionary emptied when it reaches a fixed size.

Defined results: null text is the empty text (no ids); equal texts give equal
ids; ids decode to exactly the text's bytes; of pairs of equal rank the leftmost is merged first; rows that repeat an id
are encoded each by its own text; an empty table gives an empty result; texts of any length are encoded whole, in
linear memory; other columns are ignored, and result columns get an underscore where the id column has their name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.llm.common import arrow_map, free

MEMO_ENTRIES = 250_000
#: Marks of pre-tokens seen, by hash: what is seen once is not remembered.
SEEN_BITS = 21
EMPTY = -1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: ``find`` gives a key's value or -1."""

    def __init__(self, items: dict[bytes, int], load: int = 2):
        keys = list(items)
        self.size = n = max(1, len(keys))
        self.n_buckets = max(1, -(-n // load))
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, b in enumerate((hashes % np.uint64(self.n_buckets)).tolist()):
            buckets[b].append(i)
        self.displacement = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [EMPTY] * n
        plain = hashes.tolist()
        free = set(range(n))
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # any free slot will do: the displacement names it
                slot = free.pop()
                self.displacement[b], slots = -slot - 1, [slot]
            else:
                d = 0
                while True:
                    slots = [self._slot(plain[i], d) for i in own]
                    if len(set(slots)) == len(slots) and all(s in free for s in slots):
                        break
                    d += 1
                self.displacement[b] = d
                free.difference_update(slots)
            for i, s in zip(own, slots, strict=True):
                self.keys[s], self.values[s] = keys[i], items[keys[i]]

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 20) ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.size

    def find(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.n_buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else EMPTY


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table = PerfectHash(ranks)
        self.rank = dict(ranks)  # for the parts of misses, which are looked up far more often than whole pre-tokens
        # \s in the pattern means Unicode white space
        self.pattern = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        #: Ranks of all pairs of bytes, where every merge begins.
        self.pairs = [self.rank.get(bytes((a, b)), EMPTY) for a in range(256) for b in range(256)]

    def ids(self, piece: bytes) -> list[int]:
        whole = self.table.find(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, by a heap over linked parts."""
        n = len(piece)
        rank, pairs = self.rank.get, self.pairs
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i, (a, b) in enumerate(pairwise(piece)) if (r := pairs[a << 8 | b]) >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, stop = pop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                after = end[stop]
                if (r := rank(piece[i:after])) is not None:
                    push(heap, (r, i, after))
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                push(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : end[i]]])
            i = end[i]
        return out

    def encoder(self) -> Callable[[str], bytes]:
        """Text to ids packed as little-endian unsigned 32-bit integers."""
        ids, split = self.ids, regex.compile(self.pattern).findall

        seen, mask = bytearray(1 << SEEN_BITS), (1 << SEEN_BITS) - 1

        class Memo(dict):
            def __missing__(self, token: str) -> bytes:
                found = ids(token.encode())
                packed = struct.pack(f"<{len(found)}I", *found)
                mark = hash(token) & mask
                if not seen[mark]:
                    seen[mark] = 1
                elif len(token) <= 64:
                    if len(self) >= MEMO_ENTRIES:
                        self.clear()
                        seen[:] = bytes(len(seen))
                    self[token] = packed
                return packed

        memo = Memo()
        return lambda text: b"".join(map(memo.__getitem__, split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _encode_batches(batches: Iterator[pa.RecordBatch], codec: Codec, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = codec.encoder()
    for batch in batches:
        n_tokens, ids_sha, text_sha, ids = [], [], [], []
        for text in batch.column(1):
            packed = encode(text.as_py() or "")
            n_tokens.append(len(packed) // 4)
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            if with_ids:
                ids.append(packed)
        out = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        if with_ids:
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_tokens]), pa.int32()), flat))
        yield pa.RecordBatch.from_arrays(out, names)


def encode_texts(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int], pattern: str, with_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, digests of the ids and of the decoded bytes, and the ids themselves; one narrow pass."""
    codec = Codec(ranks, pattern)
    types = [dict(df.dtypes)[id_col], "long", "string", "string", *["array<int>"] * with_ids]
    names = [id_col, *(free(n, (id_col,)) for n in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")[: 3 + with_ids])]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(codec)  # as large as the vocabulary, not the data
    return arrow_map(df.select(F.col(id_col), F.col(text_col)), partial(_encode_shared, shared=shared, names=names, with_ids=with_ids), schema)


def _encode_shared(batches: Iterator[pa.RecordBatch], shared, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    return _encode_batches(batches, shared.value, names, with_ids)
