"""The pipeline against its stages done plainly, one text after another."""

import hashlib

import corpus_pipeline
from test_brute_force import components, shingles

from test_decontaminate_plain import plain as contaminates
from test_pii_spans import plain as spans_of

from quilter.llm import langid, pii


def test_pipeline(spark, data):
    import base64

    import numpy as np
    import public_tokenizers as pt
    import tiktoken

    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    crf = langid.fit(langid.training_sample(df, "doc_id", "text", "lang", ~langid.held_out("doc_id")))
    ids = sorted(rows)
    langs, scores = langid._predict([rows[i] for i in ids], langid.Labeller(crf))
    kept = {i: rows[i] for i, lang, s in zip(ids, langs, scores, strict=True) if lang != "und" and s >= corpus_pipeline.LEAST_SCORE}
    group = components({i: shingles(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if group[i] == i}
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if all(contaminates(x, t) is None for x in items)}
    kept = {i: pii.redact(t, spans_of(t)) for i, t in kept.items()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(pt.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in kept.items()}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
