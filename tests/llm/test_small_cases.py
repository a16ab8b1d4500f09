"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib

import pytest

from quilter.llm import bpe, decontaminate, html_text, langid, ngram_join, pii, sharding, spotsig, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, node string, n int, text_ string, doc string, part int"
LONG = "the house of the old garden and a river " * 4000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (7, "A b c d e f"), (7, "other text under the same id entirely"),
    (8, "the cat sat on the mat and the dog ran to the town"), (8, "the cat sat on the mat and the dog ran to the town"), (None, "a null id and its text of some words"), (9, "12345 !!! 987"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i != 5 else None, "x", 1, "y", "z", 0) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer():
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def operators(spark):
    ranks, pattern = tokenizer()
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran to the town"), (2, None), (3, "")], "item_id long, text string")
    return {
        "sharding": lambda d: sharding.place(d, "doc_id"),
        "url_filter": lambda d: url_filter.judge_urls(d, "doc_id", "text"),
        "spotsig": lambda d: spotsig.fingerprints(d, "doc_id", "text"),
        "decontaminate": lambda d: decontaminate.contaminated(d, "doc_id", "text", items, "item_id", "text"),
        "keep_clean": lambda d: decontaminate.keep_clean(d, "text", items, "item_id", "text"),
        "pii": lambda d: pii.detect(d, "doc_id", "text", redacted=True),
        "redact": lambda d: pii.redact_documents(d, "text"),
        "bpe": lambda d: bpe.encode_texts(d, "doc_id", "text", ranks, pattern),
        "html": lambda d: html_text.extract(d, "doc_id", "node", "text"),
        "langid": lambda d: langid.label(d, "doc_id", "text", "lang"),
        "keep_identified": lambda d: langid.keep_identified(d, "doc_id", "text", "lang"),
        "ngram": lambda d: ngram_join.join(d, "doc_id", "text"),
        "keep_one": lambda d: ngram_join.keep_one(d, "doc_id", "text"),
        "suffix": lambda d: suffix_dedup.dedup(d, "doc_id", "text"),
    }


NAMES = ["sharding", "url_filter", "spotsig", "decontaminate", "keep_clean", "pii", "redact", "bpe", "html", "langid", "keep_identified", "ngram", "keep_one", "suffix"]
EVERY_ROW = {"sharding", "url_filter", "spotsig", "pii", "redact", "bpe", "html", "langid", "ngram", "suffix"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(operators, docs, name):
    rows = operators[name](docs).collect()
    if name in EVERY_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, none, name):
    assert operators[name](none).collect() == []


def test_defined_results(operators, docs):
    by = lambda name: {r["doc_id"]: r for r in operators[name](docs).collect()}
    lang = by("langid")
    assert lang[1]["lang_pred"] == lang[9]["lang_pred"] == "und" and lang[5]["lang_pred"] == "en"
    assert {r["doc_id"] for r in operators["decontaminate"](docs).collect()} == {8}
    assert 8 not in {r["doc_id"] for r in operators["keep_clean"](docs).collect()}
    near = by("ngram")
    assert near[1]["n_shingles"] == 0 and near[1]["component_id"] == 1 and near[6]["component_id"] == 5
    kept = [r["doc_id"] for r in operators["keep_one"](docs).collect()]
    assert kept.count(8) == 1 and kept.count(7) == 2 and 6 not in kept
    gone = by("suffix")
    assert gone[5]["n_removed"] == gone[5]["n_bytes"] and gone[5]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and gone[4]["n_removed"] == 0
    assert by("spotsig")[1]["fingerprint"] == ""
    assert by("url_filter")[1]["host"] == ""
    assert by("bpe")[1]["n_tokens"] == 0


CLASHES = "text_ id_ key_ own_ row_ doc node part n sha_ kept_ again_ copies_ shares_ slot shard host path rule ruled score url_ u lang_pred held_out item items cover n_chars n_tokens ids spans n_email n_bytes n_removed kept n_shingles component_id fingerprint pre_ bits tile short".split()


def test_extra_columns_of_any_name_do_no_harm(operators, docs, spark):
    extra = docs.select("doc_id", "text", "lang", "node", *[docs.lang.alias(c) for c in CLASHES if c != "node"])
    for name in NAMES:
        if name in ("sharding", "html"):
            continue
        want, got = operators[name](docs.select("doc_id", "text", "lang")), operators[name](extra)
        both = [c for c in want.columns if c in got.columns]
        assert len(both) == len(want.columns)
        assert sorted(map(str, want.select(both).collect())) == sorted(map(str, got.select(both).collect())), name
        if name in ("keep_clean", "redact", "keep_identified", "keep_one"):
            assert got.schema == extra.schema


@pytest.mark.parametrize("clash", ["text_", "key_", "n_tokens", "lang_pred", "item", "n_bytes", "component_id", "fingerprint", "spans", "verdict"])
def test_the_id_may_have_any_name(spark, clash):
    ranks, pattern = tokenizer()
    df = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran to the town", "en")], f"{clash} long, body string, tongue string")
    items = spark.createDataFrame([(5, "the cat sat on the mat and the dog ran to the town")], "item long, cover string")
    for out in (
        sharding.place(df, clash), url_filter.judge_urls(df, clash, "body"), spotsig.fingerprints(df, clash, "body"),
        decontaminate.contaminated(df, clash, "body", items, "item", "cover"), pii.detect(df, clash, "body", True), bpe.encode_texts(df, clash, "body", ranks, pattern),
        langid.label(df, clash, "body", "tongue"), ngram_join.join(df, clash, "body"), suffix_dedup.dedup(df, clash, "body"),
    ):
        (row,) = out.collect()
        assert row[0] == 1 and out.columns[0] == clash and len(set(map(str.lower, out.columns))) == len(out.columns)
