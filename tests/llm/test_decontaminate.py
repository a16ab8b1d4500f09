"""Verbatim copies of items rich in slots, and what the limit on literals still guards."""

import pytest

from quilter.llm import decontaminate

ITEMS = [
    "What is 15 times 4?",
    "Sum 3, 8, 21, 34, 55, 89, 144, 233 and 377",
    "Did Anna Berg meet Carl Dahl, Eva Falk, Gus Holm, Ida Jung or Karl Lind in Oslo",
    "Janet sells eggs",
]


def found(items, text, cover=decontaminate.COVER):
    return decontaminate.Index(list(enumerate(items))).match(*decontaminate.Reader().read(text), cover)


@pytest.mark.parametrize("item", range(len(ITEMS)))
@pytest.mark.parametrize("frame", ["{}", "Some words. {} Other words", "he asked {} of all"])
def test_verbatim_copies_are_found(item, frame):
    assert found(ITEMS, frame.format(ITEMS[item])) == [(item, 1.0)]


def test_other_values_need_literals():
    assert not found(ITEMS, "What is 16 times 4?")
    assert not found(ITEMS, "Sum 4, 9, 22, 35, 56, 90, 145, 234 and 378")


def test_a_run_of_words_is_enough():
    words = [f"{a}{b}" for a in ("be", "da", "fo", "gi", "hu", "ko") for b in ("lan", "mur", "nep", "ros", "sif", "tav", "vel", "wim", "xon", "zed")][:59]
    item = " ".join(words)
    assert [i for i, _ in found([item], "so " + " ".join(words[20:45]) + " it is")] == [0]
    assert [i for i, _ in found([item], " ".join(words[-decontaminate.RUN :]))] == [0]
    assert not found([item], " ".join(words[: decontaminate.RUN - 1]))
    # words next to one another in the item alone, or in the text alone, are no run
    assert not found([item], " ".join([*words[:9], "then", *words[9:18]]))
    assert not found([item], " ".join([*words[:9], *words[30:39]]))


def test_rows_in_spark(spark):
    docs = spark.createDataFrame([(1, "Quiz: What is 15 times 4?"), (2, "What is 15 times 5?"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEMS[0])], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, "doc_id", "text", items, "item_id", "text").collect()] == [(1, [7], 1, 1.0)]
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, "text", items, "item_id", "text").collect()} == {2, 3}
