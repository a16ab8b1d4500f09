"""op10 against all windows by hand: pieces of long texts, hot q-grams, equal contexts, names that clash."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quilter.llm import suffix_dedup


def plain(texts, length):
    """(removed, spans, sha) of each text, from a table of all windows."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def check(spark, texts, length=400):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, "doc_id", "text", length).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, length)
    return got


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def test_passages_in_many_documents(spark):
    rng = random.Random(4)
    passages = [words(rng, 80), words(rng, 90), words(rng, 300), "ab" * 300]
    texts = []
    for i in range(260):
        parts = [words(rng, rng.randint(0, 60)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), passages[0] if i % 3 else passages[i % 4])
        texts.append(" ".join(parts))
    texts += texts[:4] + [texts[7] + "x", "y" + texts[7], None, "", "z" * 900, "é" * 450]
    got = check(spark, texts)
    assert sum(n > 0 for n, _, _ in got.values()) > 200


@pytest.mark.parametrize("seed", range(3))
def test_short_windows(spark, seed):
    rng = random.Random(seed)
    check(spark, [words(rng, rng.randint(0, 40)) + " " + " ".join(rng.choices([words(random.Random(k), 12) for k in range(4)], k=2)) for _ in range(60)], 48)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 50_000).astype(np.uint8)
    whole = suffix_dedup.Anchors()._find(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1 << 12)
    pieces = suffix_dedup.Anchors().find(raw, np.array([0, len(raw)]))
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))


def test_a_text_of_300_megabytes():
    import resource

    raw = np.frombuffer(np.random.default_rng(2).bytes(300 << 20), np.uint8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    row, place, key, lo, hi = suffix_dedup.Anchors().find(raw, np.array([0, len(raw)]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600 << 10
    # every window has its anchor: those of one anchor begin where those of the one before end
    assert place[0] - hi[0] == 0 and place[-1] - lo[-1] == len(raw) - suffix_dedup.LENGTH
    assert np.array_equal((place - hi)[1:], (place - lo)[:-1] + 1)
    assert len(row) == len(key) > len(raw) / 250


def test_names_that_clash(spark):
    text = "the house of the river " * 30
    df = spark.createDataFrame([(1, text, "x"), (2, text, "y")], "n_bytes long, sha_ string, doc string")
    out = suffix_dedup.dedup(df, "n_bytes", "sha_", with_text=True)
    assert out.columns == ["n_bytes", "n_bytes_", "n_removed", "n_spans", "kept_sha256", "shares_passage", "kept"]
    assert [(r["n_removed"], bytes(r["kept"])) for r in out.collect()] == [(len(text), b"")] * 2


def shares(texts):
    """Whether each text has a run of 51 words that another has too."""
    runs = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs.append({tuple(w[i : i + 51]) for i in range(len(w) - 50)})
    of = Counter(r for own in runs for r in own)
    return [any(of[r] > 1 for r in own) for own in runs]


def test_passages_of_over_fifty_words(spark):
    rng = random.Random(6)
    few = "the of to a in on at by".split()
    passage = [[rng.choice(few) if k % 2 else words(rng, 1) for _ in range(n)] for k, n in enumerate([50, 51, 52, 60, 51, 70, 150])]
    texts = []
    for i in range(160):
        parts = [words(rng, rng.randint(0, 90)) for _ in range(2)]
        own = passage[i % 9] if i % 9 < len(passage) else []
        cut = own[rng.randint(0, 3) :] if i % 5 == 0 else own
        parts.insert(1, rng.choice([" ", "  ", "\n"]).join(cut))
        texts.append(" ".join(parts))
    lone = words(rng, 55)
    texts += [f"{lone} {lone}", texts[3], words(rng, 50), "x", None, " ", texts[4] + " end", " ".join(few * 30), "b " + " ".join(few * 30)]
    texts += [texts[-3 - 9]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["shares_passage"] for r in suffix_dedup.dedup(df, "doc_id", "text").collect()}
    want = shares(texts)
    assert [got[i] for i in range(len(texts))] == want and 40 < sum(want) < len(want) - 20


def test_words_of_long_texts_come_in_pieces(monkeypatch):
    from quilter.llm import passages

    rng = random.Random(7)
    raw = np.frombuffer((" ".join(words(rng, rng.randint(1, 60)) + " " * rng.randint(0, 3) for _ in range(500)) + " " + "q" * 9000 + " " + words(rng, 200)).encode(), np.uint8)
    whole = passages.WordAnchors().find(raw, np.array([0, len(raw)]))
    hashes = passages.Words().read(raw, np.array([0, len(raw)]))[0]
    monkeypatch.setattr(passages, "CHUNK_BYTES", 2000)
    pieces = passages.WordAnchors().find(raw, np.array([0, len(raw)]))
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))
    for base, part in passages.Words().pieces(raw):
        assert np.array_equal(part, hashes[base : base + len(part)])


def test_given_tables(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(docs)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"], r["shares_passage"]) for r in suffix_dedup.dedup(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text").collect()}
    want = [(*a, b) for a, b in zip(plain([docs[i] for i in ids], 400), shares([docs[i] for i in ids]), strict=True)]
    assert [got[i] for i in ids] == want
