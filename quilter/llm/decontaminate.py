"""Benchmark decontamination by canonical templates.

Words of items and documents are put in canonical form: numbers, units after numbers and names
(capitalised words inside a sentence) become typed placeholders, other words are
lower-cased. Windows of ``WINDOW`` canonical words are hashed and joined with those of all items. On a
common diagonal (document position less item position) a match must be consistent: equal
slot values of the item correspond to equal values in the document and different ones
to different ones, so a re-parameterised question is caught and chance likeness is not. Beside
its template each window is known by the hash of its words' values, slots or not; equal values match
as they are, so a verbatim copy is found whatever it is made of and wherever it stands. A
document is contaminated by an item if the matching windows cover ``COVER`` of the item's words, or
if it holds ``RUN`` of its words in a row as they are, whatever share of the item that is.

The items' hashes are shipped to the workers in blocks of at most ``BLOCK_CHARS`` characters of items (or one
longer item); each block is one pass over the documents. One block, as for most benchmarks, is matched where the documents are
read, without a shuffle. Of several only one is held at a time: its result is written before the next is built, and it is
taken from the workers again; so what is broadcast has a fixed bound, and any number of items is joined in full.

Defined results: null or empty text is clean; items without a word are never found; items of
fewer words than a window are one window, matched by values alone; a template must hold ``LITERALS``
words that are not placeholders, values need none (an item that is one number is found wherever
that number stands); equal items are each reported, and of shares just at ``COVER`` the item is; rows that repeat an id are judged each by its own text
and count as one in the report; an empty table of documents gives an empty result, one of items makes every document clean; other columns are ignored by
``contaminated`` and kept by ``keep_clean``; result columns get an underscore where the id column has their name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.llm.bytes_np import mix
from quilter.llm.common import Staged, arrow_map, free

WINDOW, LITERALS, COVER, RUN = 8, 4, 0.5, 13
BLOCK_CHARS, MEMO_WORDS = 16 << 20, 300_000

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*|[.!?\n]")
#: Words that are units when they follow a number (fixed values).
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degrees degree celsius fahrenheit kelvin mph kmh watt watts kw volt volts amp amps hz khz mhz ghz kb mb gb tb "
    "dollar dollars cent cents euro euros usd eur".split()
)
WORD, NUMBER, TITLE, UNIT, MARK = range(5)
PLACEHOLDERS = mix(np.array([101, 102, 103], np.uint64))  # number, unit, name
KEYS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) + np.uint64(7000)) | np.uint64(1)


class Reader:
    """Texts to canonical words; what is known of a token is remembered in a table emptied when full."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.literal, self.value, self.kind = (np.zeros(1 << 16, t) for t in (np.uint64, np.uint64, np.int8))

    def _learn(self, token: str) -> int:
        i = self.known[token] = len(self.known)
        if i >= len(self.kind):
            self.literal, self.value, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.literal, self.value, self.kind))
        low = token.lower()
        self.literal[i] = self.value[i] = xxhash.xxh3_64_intdigest(low)
        self.kind[i] = MARK if token in ".!?\n" else NUMBER if token[0].isdigit() else UNIT if low in UNITS else TITLE if len(token) > 1 and token.istitle() else WORD
        return i

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(canonical hash, hash of the value, whether a slot) of each word."""
        tokens = TOKEN.findall(text)
        if len(self.known) + len(tokens) > MEMO_WORDS:
            self.known.clear()
        known = self.known
        for t in set(tokens).difference(known):
            self._learn(t)
        at = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        kind = self.kind[at]
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        before = np.concatenate([[MARK], kind[:-1]])
        number, unit, name = kind == NUMBER, (kind == UNIT) & (before == NUMBER), (kind == TITLE) & (before != MARK)
        canonical = np.where(number, PLACEHOLDERS[0], np.where(unit, PLACEHOLDERS[1], np.where(name, PLACEHOLDERS[2], self.literal[at])))
        words = kind != MARK
        return canonical[words], self.value[at][words], (number | unit | name)[words]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window that begins at each word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * KEYS[k]
    return mix(total + np.uint64(width))


def templates(canonical: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the full window that begins at each word, and whether it has enough literals."""
    h = window_hashes(canonical, WINDOW)
    before = np.concatenate([[0], np.cumsum(~slot)])
    return h, before[WINDOW:] - before[: len(h)] >= LITERALS


class Places:
    """Where in the items a window of some hash begins."""

    def __init__(self):
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, item: int, hashes: np.ndarray, at: np.ndarray) -> None:
        for p in at.tolist():
            self.places[int(hashes[p])].append((item, p))

    def close(self) -> None:
        self.known = np.sort(np.fromiter(self.places, np.uint64, len(self.places)))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.known >> np.uint64(42)).astype(np.int64)] = True
        self.places = dict(self.places)

    def find(self, hashes: np.ndarray, good: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(position, item, item's position) of the windows that are known."""
        maybe = self.bits[(hashes >> np.uint64(42)).astype(np.int64)]
        maybe = np.flatnonzero(maybe if good is None else maybe & good)
        if not len(maybe):
            return
        near = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        for p in maybe[self.known[near] == hashes[maybe]].tolist():
            for item, q in self.places[int(hashes[p])]:
                yield p, item, q


class Index:
    """Windows of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        reader = Reader()
        self.items, self.values, self.slots = [], [], []
        self.templates, self.exact = Places(), Places()
        self.widths: set[int] = set()
        for item, text in items:
            canonical, value, slot = reader.read(text or "")
            if not len(canonical):
                continue
            width = min(WINDOW, len(canonical))
            self.widths.add(width)
            h, good = templates(canonical, slot)
            self.templates.add(len(self.items), h, np.flatnonzero(good))
            h = window_hashes(value, width)
            self.exact.add(len(self.items), h, np.arange(len(h)))
            self.items.append(item)
            self.values.append(value)
            self.slots.append(slot)
        self.templates.close()
        self.exact.close()

    def match(self, canonical: np.ndarray, value: np.ndarray, slot: np.ndarray, cover: float) -> list[tuple[object, float]]:
        """(item, covered share of its words) of the items that contaminate a text."""
        covered: dict[int, np.ndarray] = {}

        def mark(item: int, q: int, width: int) -> None:
            if item not in covered:
                covered[item] = np.zeros(len(self.values[item]), bool)
            covered[item][q : q + width] = True

        ends: dict[tuple[int, int], tuple[int, int]] = {}  # run of equal words on a diagonal: (begin, end) in the item
        quoted: set[int] = set()
        for width in self.widths:
            for p, item, q in self.exact.find(window_hashes(value, width)):
                mark(item, q, width)
                begin, end = ends.get((item, p - q), (q, q))
                if q > end:
                    begin = q
                ends[item, p - q] = begin, q + width
                if q + width - begin >= RUN:
                    quoted.add(item)
        lines: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for p, item, q in self.templates.find(*templates(canonical, slot)):
            lines[item, p - q].append((p, q))
        for (item, _), hits in sorted(lines.items()):
            there, back = {}, {}
            for p, q in hits:
                pairs = [(int(self.values[item][q + k]), int(value[p + k])) for k in range(WINDOW) if self.slots[item][q + k]]
                if all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs) and len(dict(pairs)) == len({b: a for a, b in pairs}):
                    there.update(pairs)
                    back.update((b, a) for a, b in pairs)
                    mark(item, q, WINDOW)
        shares = [(i, float(m.mean())) for i, m in sorted(covered.items())]
        return [(self.items[i], s) for i, s in shares if s >= cover or i in quoted]


def _match(batches: Iterator[pa.RecordBatch], index, cover: float, keep: str | None) -> Iterator[pa.RecordBatch]:
    """Contaminated rows as (id, item, cover); with keep, the clean rows as they are."""
    reader, block = Reader(), index.value
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(keep) if keep else 1)
        found = [block.match(*reader.read(t), cover) if (t := v.as_py()) else [] for v in texts]
        if keep:
            yield batch.filter(pa.array([not f for f in found], pa.bool_()))
            continue
        rows = [i for i, f in enumerate(found) for _ in f]
        flat = [x for f in found for x in f]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([x for x, _ in flat]), pa.array([s for _, s in flat], pa.float64())], ["id_", "item", "cover"])


class Blocks:
    """Items in blocks of bounded size."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str):
        # none of the two is named as the user's table names it, so nothing clashes
        self.items = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
        size = self.items.agg(F.sum(F.length("text") + 16)).head()[0] or 0
        self.count = max(1, -(-size // BLOCK_CHARS))

    def broadcast(self, k: int):
        """Block k, at the workers."""
        part = self.items if self.count == 1 else self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.count)) == k)
        index = Index([tuple(r) for r in part.orderBy("item", "text").collect()])
        return self.items.sparkSession.sparkContext.broadcast(index)

    def each(self, staged: Staged, name: str, match) -> Iterator[DataFrame]:
        """What ``match`` makes of each block, written, while no other block is held; of a single block it is lazy."""
        for k in range(self.count):
            index = self.broadcast(k)
            if self.count == 1:
                yield match(index)
                return
            yield staged.put(match(index), f"{name}_{k}")
            index.destroy()


def contaminated(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, cover: float = COVER) -> DataFrame:
    """One row for each contaminated document: id_col, items (sorted), n_items, cover (the largest share)."""
    kinds = f"id_ {dict(docs.dtypes)[id_col]}, item {dict(items.dtypes)[item_id]}, cover double"
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    blocks = Blocks(items, item_id, item_text)
    parts = blocks.each(Staged(docs.sparkSession), "hits", lambda index: arrow_map(rows, partial(_match, index=index, cover=cover, keep=None), kinds))
    hits = reduce(DataFrame.unionByName, parts).groupBy("id_").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("cover").alias("cover"))
    named = [F.col("items"), F.size("items").cast("long").alias("n_items"), F.col("cover")]
    return hits.select(F.col("id_").alias(id_col), *[c.alias(free(n, (id_col,))) for c, n in zip(named, ("items", "n_items", "cover"), strict=True)])


def keep_clean(docs: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str, cover: float = COVER) -> DataFrame:
    """The rows no item contaminates, columns unchanged."""
    staged, blocks = Staged(docs.sparkSession), Blocks(items, item_id, item_text)
    clean = docs

    def match(index) -> DataFrame:
        return arrow_map(clean, partial(_match, index=index, cover=cover, keep=text_col), docs.schema)

    for k, part in enumerate(blocks.each(staged, "clean", match)):
        clean = part
        if k > 0:
            staged.drop(f"clean_{k - 1}")
    return clean
