"""op4 against comparing all windows of all items and documents word by word; blocks; names. op1's table against explicit permutations."""

import hashlib
import random
import re

import pytest

from quilter.llm import decontaminate, sharding

W, LITERALS, COVER, RUN = decontaminate.WINDOW, decontaminate.LITERALS, decontaminate.COVER, decontaminate.RUN


def read(text):
    """(canonical word, value, whether a slot) of each word."""
    out, before = [], "mark"
    for t in re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*|[.!?\n]", text or ""):
        if t in ".!?\n":
            before = "mark"
            continue
        low = t.lower()
        if t[0].isdigit():
            out.append(("<number>", low, True))
            before = "number"
        elif low in decontaminate.UNITS:
            unit = before == "number"
            out.append(("<unit>" if unit else low, low, unit))
            before = "unit"
        elif len(t) > 1 and t.istitle() and before != "mark":
            out.append(("<name>", low, True))
            before = "name"
        else:
            out.append((low, low, False))
            before = "word"
    return out


def plain(item, text):
    """Covered share of the item if it contaminates the text, else None."""
    a, b = read(item), read(text)
    if not a:
        return None
    n, covered, quoted = len(a), [False] * len(a), False
    width = min(W, n)
    for d in range(-n, len(b)):  # position in the text less position in the item
        run, there, back = 0, {}, {}
        for q in range(n):
            p = q + d
            same = 0 <= p < len(b) and a[q][1] == b[p][1]
            run = run + 1 if same else 0
            if run >= width:
                covered[q - width + 1 : q + 1] = [True] * width
                quoted |= run >= RUN
        for q in range(n - W + 1):
            p = q + d
            if p < 0 or p + W > len(b) or [x[0] for x in a[q : q + W]] != [x[0] for x in b[p : p + W]] or sum(not x[2] for x in b[p : p + W]) < LITERALS:
                continue
            pairs = [(a[q + k][1], b[p + k][1]) for k in range(W) if a[q + k][2]]
            if all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(set(pairs)):
                there |= dict(pairs)
                back |= {y: x for x, y in pairs}
                covered[q : q + W] = [True] * W
    share = sum(covered) / n
    return share if share >= COVER or quoted else None


def made_up(seed):
    rng = random.Random(seed)
    common = [f"{a}{b}" for a in ("be", "da", "fo", "gi") for b in ("lan", "mur", "nep")]

    def word():
        kind = rng.random()
        if kind < 0.15:
            return str(rng.randint(1, 9))
        if kind < 0.2:
            return f"{rng.randint(1, 5)} {rng.choice(['km', 'kg'])}"
        if kind < 0.3:
            return rng.choice(["Anna", "Berg", "Oslo"])
        return rng.choice(common)

    items = [" ".join(word() for _ in range(rng.choice([1, 3, 8, 9, 15, 30]))) + rng.choice(["", "?", ". Is it " + word()]) for _ in range(12)]
    texts = []
    for _ in range(30):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(items).split()
            cut = words[rng.randint(0, len(words) // 2) :]
            swap = {w: rng.choice([w, w, str(rng.randint(1, 9))]) for w in cut if w.isdigit()}
            parts += [" ".join(swap.get(w, w) for w in cut), " ".join(word() for _ in range(rng.randint(0, 4)))]
        texts.append(rng.choice([" ", ". "]).join(parts))
    return items, [*texts, "", None]


@pytest.mark.parametrize("seed", range(8))
def test_all_windows(seed):
    items, texts = made_up(seed)
    index, reader = decontaminate.Index(list(enumerate(items))), decontaminate.Reader()
    for t in texts:
        want = {i: s for i, x in enumerate(items) if (s := plain(x, t)) is not None}
        got = dict(index.match(*reader.read(t), COVER)) if t else {}
        assert got == pytest.approx(want), t


def test_the_given_tables(spark, data):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 3000")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    index, reader = decontaminate.Index(sorted(items.items())), decontaminate.Reader()
    hits = 0
    for t in texts.values():
        want = {i: s for i, x in items.items() if (s := plain(x, t)) is not None}
        assert dict(index.match(*reader.read(t), COVER)) == pytest.approx(want)
        hits += bool(want)
    assert hits


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    items, texts = made_up(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "item long, cover string").selectExpr("item", "cover", "item as items", "item as item_id")
    table = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "text long, item string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, "item", "cover", table, "text", "item").collect()))
    clean = sorted(r["item"] for r in decontaminate.keep_clean(docs, "cover", table, "text", "item").collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert decontaminate.Blocks(table, "text", "item").count > 3
    assert sorted(map(tuple, decontaminate.contaminated(docs, "item", "cover", table, "text", "item").collect())) == whole
    assert sorted(r["item"] for r in decontaminate.keep_clean(docs, "cover", table, "text", "item").collect()) == clean
    assert {r[0] for r in whole} | set(clean) == set(range(len(texts))) and whole
    assert decontaminate.keep_clean(docs, "cover", table, "text", "item").schema == docs.schema
    none = table.where("text < 0")
    assert decontaminate.contaminated(docs, "item", "cover", none, "text", "item").count() == 0


def test_claims_in_turn():
    names, size = [f"s{i}" for i in range(7)], 101
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = []
    for s in names:
        offset, skip = number(f"{s}/offset") % size, number(f"{s}/skip") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            if len(owner) < size:
                owner[next(x for x in order if x not in owner)] = i
    assert sharding.fill_table(names, size) == [owner[k] for k in range(size)]
