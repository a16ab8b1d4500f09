"""Candidates beyond the base patterns: which are added, held against plain loops over all spans."""

import numpy as np
import pytest

from quilter.llm import pii

MODEL = pii.train()
PLANTED = [
    'the river token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" of the old house',
    "please call (212) 555-0187 or write to jane.roe [at] garden [dot] org today",
    "server 192[.]168[.]7[.]21 of the house; pay by card 4929.3483.8514.6306 and go",
    "commit 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e of the build, order 2669109448945250, ref 473696257",
    "mail a@b.example.com or +1 (974) 555-3436 or 4845168114407329 or 10.2.3.4 in one line",
    "1.2.3.4a5.6.7.8b9.10.11.12c13.14.15.16d17.18.19.20e21.22.23.24f25.26.27.28g29.30.31.32h33.34.35.36i37.38.39.40j41.42.43.44k45.46.47.48l(212)555-0187@host.example.com",
    'key = "4929348385146306abcdefABCD12" and key: 4929348385146306x',
    "",
]


def plain(text):
    base = pii.base_spans(text)
    trees, cuts = MODEL

    def clash(a, b):
        return a[1] < b[2] and b[1] < a[2]

    def open_(c):
        hit = [b for b in base if clash(b, c)]
        inside = all(c[1] <= b[1] and b[2] <= c[2] and (b[1], b[2]) != (c[1], c[2]) for b in hit)
        return not hit or c[0] == "secret" and inside and not any(clash(b, o) and not (c[1] <= o[1] and o[2] <= c[2]) for b in hit for o in base)

    judged = [(-float(trees.predict(np.array([pii.features(text, c)]))[0]), c[1], c[2], pii.EVERY_KIND.index(c[0]), c) for c in pii.candidates(text) if open_(c)]
    chosen = []
    for q, *_, c in sorted(judged):
        if -q >= cuts[c[0]] and not any(clash(c, o) for o in chosen):
            chosen.append(c)
    return sorted([*base, *chosen], key=lambda x: (pii.EVERY_KIND.index(x[0]), x[1]))


def test_spans_match_plain_loops(spark, data):
    texts = [*PLANTED, " and ".join(PLANTED), *[r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()]]
    found = pii.spans_of(texts, MODEL)
    assert [every for _, every in found] == [plain(t) for t in texts]
    assert sum(len(every) > len(base) for base, every in found) >= 4


def test_trees_add_what_they_should_and_leave_the_rest():
    added = [[(k, t[s:e]) for k, s, e in every if (k, s, e) not in base] for t, (base, every) in zip(PLANTED, pii.spans_of(PLANTED, MODEL), strict=True)]
    assert added[0] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert added[1] == [("email", "jane.roe [at] garden [dot] org"), ("phone", "(212) 555-0187")]
    assert added[2] == [("ip", "192[.]168[.]7[.]21"), ("card", "4929.3483.8514.6306")]
    assert added[3] == [] and added[4] == [] and added[7] == []


def test_an_address_full_of_numbers_hides_its_candidates():
    whole = "1.1.1.1_" * 12 + "212.555.0187@host.example.com"
    base = pii.base_spans(whole)
    assert ("email", 0, len(whole)) in base and sum(k == "ip" for k, _, _ in base) >= 12
    assert ("phone", 96, 108) in pii.candidates(whole)
    assert not [c for c in pii.open_candidates(whole, base) if c[0] != "secret"]
    assert pii.open_candidates(whole, base) == []  # the key-like run is inside the address, not around it


@pytest.mark.parametrize("kind", pii.EVERY_KIND)
def test_precision_and_recall_on_unseen_families(kind):
    precision, recall = pii.measure()[kind]
    assert precision >= 0.97 and recall >= 0.35


def test_redaction_covers_unions():
    text = 'token = "4929348385146306abcdefABCD12x9" end'
    assert pii.redact(text, pii.find_spans(text, MODEL)) == 'token = "[SECRET]" end'


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, PLANTED[0], 5)], "n_email long, spans string, n_spans int")
    (row,) = pii.detect(df, "n_email", "spans").collect()
    assert row["n_email"] == 1 and row["n_email_"] == 0 and row["spans"].startswith("secret:") and row["n_added"] == 1
