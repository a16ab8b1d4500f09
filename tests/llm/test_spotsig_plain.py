"""op3's signatures, fingerprints and likenesses against plain loops over words."""

import re

import pytest
from pyspark.sql import functions as F

from quilter.llm import spotsig

ANCHORS = set(spotsig.ANCHORS.split())
TEXTS = [
    "The cat sat on the mat, and the dog of the house ran to a town by the river",
    " ".join(f"menu{i} home{i % 7}" for i in range(60)),
    " ".join(f"alpha{i}" for i in range(80)),
    "the of and",
    "", None, " ... ", "one", "the one", "^ the $ a~b ~the~ x",
    "Über die Brücke ging der Mann, und das Haus war leer; été où l'on dort",
]


def pairs(text, hashes):
    """(anchor, chain) of every signature; hashes gives the class of a word."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [(i, w) for i, w in enumerate(words) if w not in ANCHORS]
    if not content:
        return set()
    out, n = [], 0
    for at, lead in [(-1, "^"), *((i, w) for i, w in enumerate(words) if w in ANCHORS)]:
        follow = [w for i, w in content if i > at][: spotsig.CHAIN]
        if follow:
            out.append((lead, " ".join(follow)))
            n += 1
    if n * spotsig.SPARSE < len(content):
        bare = [w for _, w in content]
        out += [("*", " ".join(bare[i + 1 : i + 1 + spotsig.CHAIN])) for i, w in enumerate(bare) if hashes[w] % spotsig.SPARE == 0 and i + 1 < len(bare)]
    return set(out)


def hash_pairs(spark, all_pairs):
    rows = spark.createDataFrame(sorted(all_pairs), "a string, f string").select("a", "f", F.hash("a", "f").alias("h")).collect()
    return {(r["a"], r["f"]): r["h"] for r in rows}


def expected(spark, texts):
    vocabulary = {w for t in texts for w in re.split(r"[\W_]+", (t or "").lower()) if w}
    classes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in sorted(vocabulary)], "w string").select("w", F.hash("w").alias("h")).collect()}
    own = [pairs(t, classes) for t in texts]
    known = hash_pairs(spark, set().union(*own))
    return [sorted({known[p] for p in ps}) for ps in own]


def test_signatures(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", spotsig.signatures(F.col("t")).alias("s"))
    got = {r["i"]: r["s"] for r in df.collect()}
    want = expected(spark, TEXTS)
    assert [got[i] for i in range(len(TEXTS))] == want
    assert len(want[1]) > 1 and len(want[2]) > 1  # texts without anchors are not known by their start alone


def test_whole_query(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(docs)
    after = {a: docs[b] for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    edited = {i: docs[i][: len(docs[i]) - len(docs[i]) // 2] + after[i][: len(docs[i]) // 2] for i in ids}
    texts = [docs[i] for i in ids] + [edited[i] for i in ids]
    sigs = expected(spark, texts)
    own, changed = dict(zip(ids, sigs, strict=False)), dict(zip(ids, sigs[len(ids) :], strict=True))
    follows = dict(zip(ids, [own[i] for i in ids[1:] + ids[:1]], strict=True))

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0

    def text(s):
        return ",".join(f"{x & 0xFFFFFFFF:x}" for x in s)

    got = spotsig.fingerprints(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text").collect()
    assert len(got) == len(ids)
    for r in got:
        i = r["doc_id"]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text(own[i]), text(changed[i]))
        assert r["near_edited"] == pytest.approx(alike(own[i], changed[i])) and r["near_next"] == pytest.approx(alike(own[i], follows[i]))


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "n_chars long, text_ string")
    out = spotsig.fingerprints(df, "n_chars", "text_")
    assert out.columns[:2] == ["n_chars", "n_chars_"] and out.count() == 2
