"""One row of each group where ids repeat or are null."""

from quilter.llm import ngram_join

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))
C = " ".join(f"c{i}" for i in range(60))
D = " ".join(f"d{i}" for i in range(60))
ROWS = [
    (1, A), (2, A + " more"), (2, B),  # a near copy under an id whose other row names its own group
    (3, C), (3, C + " more"),  # near but unequal texts under one id
    (None, D), (None, D + " more"), (None, B + " more"), (None, "alone in its group with no id"),
    (4, ""), (4, None), (4, ""), (5, ""),
]


def test_repeated_and_null_ids(spark):
    kept = [tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(ROWS, "doc_id long, text string"), "doc_id", "text").collect()]
    groups = [sorted([(i, t) for i, t in kept if (t or "").startswith(x)], key=repr) for x in ("a0", "b0")]
    assert groups == [[(1, A)], [(2, B)]]
    assert [i for i, t in kept if (t or "").startswith("c0")] == [3]
    assert [i for i, t in kept if (t or "").startswith("d0")] == [None]
    assert (None, "alone in its group with no id") in kept
    assert sorted((i, str(t)) for i, t in kept if not t) == [(4, ""), (4, "None"), (5, "")]
    assert len(kept) == 8
