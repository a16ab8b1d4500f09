"""Forward-backward against enumeration of all label sequences, the sample against a plain one, texts without letters."""

import itertools
import zlib

import numpy as np
import pytest

from quilter.llm import langid


@pytest.mark.parametrize("length", [1, 2, 5])
def test_marginals_match_enumeration(length):
    rng = np.random.default_rng(length)
    crf = langid.Crf(["a", "b", "c"])
    crf.transitions = rng.normal(size=(3, 3))
    emit = rng.normal(size=(2, 5, 3))
    mask = np.arange(5) < np.array([[length], [5]])
    got, expected = crf.marginals(emit, mask, pairs=True)
    pairs = np.zeros((3, 3))
    for chain, n in ((0, length), (1, 5)):
        weight, of = 0.0, np.zeros((n, 3))
        own = np.zeros((3, 3))
        for tags in itertools.product(range(3), repeat=n):
            w = np.exp(sum(emit[chain, i, t] for i, t in enumerate(tags)) + sum(crf.transitions[a, b] for a, b in itertools.pairwise(tags)))
            weight += w
            for i, t in enumerate(tags):
                of[i, t] += w
            for a, b in itertools.pairwise(tags):
                own[a, b] += w
        assert np.allclose(got[chain, :n], of / weight)
        pairs += own / weight
    assert np.allclose(expected, pairs)


def test_emissions_are_sums_of_a_words_weights():
    crf = langid.Crf(["a", "b"])
    crf.weights = np.random.default_rng(1).normal(size=crf.weights.shape)
    words = ["the", "über", "x", "garden", "the"]
    got = crf.emissions(words)
    assert np.allclose(got[0], got[4])
    for i, w in enumerate(words):
        f, _ = langid.word_features([w])
        assert np.allclose(got[i], crf.weights[f].sum(axis=0))


def test_texts_without_a_letter():
    crf = langid.fit([("the house of the garden " * 9, "en"), ("das haus und der garten " * 9, "de")])
    odd = ["½", "²³", "Ⅷ ①", "12 345", "_ - !", "", None, " \n"]
    assert langid._predict(odd, langid.Labeller(crf)) == (["und"] * len(odd), [0.0] * len(odd))
    assert langid._predict(["½ the house"], langid.Labeller(crf))[0] == ["en"]


def test_sample_is_the_smallest_hashes(spark, data, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_PER_LANG", 12)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    twice = docs.union(docs).union(docs.selectExpr("null as doc_id", "null as text", "lang", "source", "n_chars"))
    got = langid.training_sample(twice, "doc_id", "text", "lang", ~langid.held_out("doc_id"))
    keyed = [(r["lang"], r["k"], r["text"]) for r in docs.selectExpr("*", "xxhash64(cast(doc_id as string), text) k").collect() if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = [(t[: langid.SAMPLE_CHARS], lang) for lang in sorted({k[0] for k in keyed}) for _, _, t in sorted(k for k in keyed if k[0] == lang)[:12]]
    assert got == want


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "the old house of the river", "en"), (2, "das alte haus am fluss", "de")], "score long, lang_pred string, held_out string")
    out = langid.label(df, "score", "lang_pred", "held_out")
    assert out.columns == ["score", "held_out", "lang_pred", "score_"] and out.count() == 2
