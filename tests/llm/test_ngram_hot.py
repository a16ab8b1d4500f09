"""op9 on large groups of near copies, on frequent keys in pieces, and its components, against plain versions."""

import random
import time

import numpy as np
import pytest
from test_brute_force import components as plain_components
from test_brute_force import shingles

from quilter.llm import components, ngram_join
from quilter.llm.common import Staged


def run(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, "doc_id", "text").collect()}


def near_copies(rng, n, words=80, base=None):
    base = base or [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("tile", [1 << 21, 700, 250])
def test_groups_match_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", tile)
    monkeypatch.setattr(ngram_join, "MERGED_SHINGLES", 2 * tile)
    rng = random.Random(tile)
    passage = [f"p{i}" for i in range(30)]
    texts = near_copies(rng, 40, 60) + near_copies(rng, 25, 40)
    for n in (45, 50, 55, 60):  # a shared passage, and tails that are shared by some
        tail = [f"t{n}_{i}" for i in range(n - 30)]
        texts += [" ".join(passage + tail[: rng.randrange(len(tail) - 6, len(tail))]) for _ in range(12)]
    chain = [f"c{i}" for i in range(90)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 30, 2)]  # alike only from one to the next
    texts += texts[:5]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    assert run(spark, texts) == plain_components({i: shingles(t) for i, t in texts.items()})


def test_fifty_thousand_near_copies_in_a_tile():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = []
    for _ in range(50_000):
        own = base.copy()
        own[rng.integers(0, 60, 3)] = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
        sets.append(np.unique(own))
    sets.sort(key=len)
    start = time.time()
    links = ngram_join.links_of(sets)
    assert time.time() - start < 60
    assert len(links) == len(sets) - 1 and {a for a, _ in links} == {0}


def test_links_connect_what_all_pairs_connect():
    rng = random.Random(8)
    sets = []
    for _ in range(300):
        n = rng.randrange(3, 40)
        own = set(range(n)) if rng.random() < 0.6 else {rng.randrange(60) for _ in range(n)}
        sets.append(np.array(sorted(own ^ {rng.randrange(60)} if rng.random() < 0.7 else own | {1}), np.uint64))
    sets = sorted((s for s in sets if len(s)), key=len)
    alike = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i].tolist(), sets[j].tolist()):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = list(range(len(sets)))
    for a, b in ngram_join.links_of(sets):
        got[b] = a
    assert got == label


@pytest.mark.parametrize("hot", [1000, 5])
def test_components_of_hubs_chains_and_cliques(spark, monkeypatch, hot):
    from quilter.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    edges = [(500, i) for i in range(501, 700)] + [(i, 0) for i in range(1, 60)] + [(i, i + 1) for i in range(1000, 1080)] + [(59, 700)] + [(2000 + i, 2000 + j) for i in range(9) for j in range(i)] + [(3000, 3000)]
    label = {}
    for a, b in edges:
        if a == b:
            continue
        ra, rb = label.setdefault(a, a), label.setdefault(b, b)
        if ra != rb:
            label = {k: min(ra, rb) if v in (ra, rb) else v for k, v in label.items()}
    df = spark.createDataFrame(edges, "a long, b long")
    got = components.components(df, Staged(spark)).collect()
    assert len(got) == len(label) and {r["node"]: r["root"] for r in got} == label
    assert components.components(df.where("a < 0"), Staged(spark), "none").count() == 0


def test_names_that_clash(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a", 1, "b"), (2, text, "c", 2, "d"), (2, text, "c", 2, "d"), (3, "other words", "e", 3, None), (3, "other words", "f", 4, None), (None, None, "g", 5, "h")]
    df = spark.createDataFrame(rows, "component_id long, kept_ string, again_ string, key_ int, row_ string")
    out = ngram_join.join(df, "component_id", "kept_")
    assert out.columns == ["component_id", "n_shingles", "component_id_"] and out.count() == len(rows)
    kept = ngram_join.keep_one(df, "component_id", "kept_")
    assert kept.schema == df.schema
    assert sorted((str(r[0]), r["again_"] in "aefg") for r in kept.collect()) == [("1", True), ("3", True), ("None", True)]
