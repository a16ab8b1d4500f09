"""Operators against plain versions of their contracts over a whole small table."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quilter.llm import decontaminate, html_text, loser_tree, queries, sharding, suffix_dedup
from quilter.llm.spotsig import duplicates


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def rows(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


def test_sharding(spark, data):
    owner = sharding.fill_table(sharding.SHARDS, sharding.TABLE_SIZE)
    size = Counter(owner)
    assert max(size.values()) - min(size.values()) <= 1 and len(size) == len(sharding.SHARDS)
    less = sharding.fill_table(sharding.SHARDS[:-1], sharding.TABLE_SIZE)
    moved = sum(a != b for a, b in zip(owner, less, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.05 * len(owner)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(map(tuple, rows(spark, data, "op1_sharding"))) == sorted(con.execute(queries.ORACLES["op1_sharding"]).fetchall())


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_url_rules(spark, data):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    seen = Counter()
    for r in rows(spark, data, "op2_url_filter"):
        rest = urls[r["page_id"]].partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [(h + p, v) for v, h, p in RULES if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
        seen[verdict] += 1
    assert len(seen) >= 3


def test_url_model_separates(spark, data):
    bad = re.compile(r"(^|[.-])(adult|ads|bets|casino|pills|spam|track)([.-]|$)")
    got = [(bool(bad.search(r["host"])), r["verdict"]) for r in rows(spark, "/root/testdata/sf0.01", "op2_url_filter") if r["rule"] is None]
    assert sum(b == (v == "block") for b, v in got) >= 0.95 * len(got)


def test_fingerprints(spark, data, docs):
    ids = sorted(docs)
    for r in rows(spark, data, "op3_fingerprints"):
        t, nxt = docs[r["doc_id"]], docs[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        a, b = (set(filter(None, r[c].split(","))) for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_spotsig_duplicates(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    pairs, members = duplicates(df, "doc_id", "text")
    sets = {r["doc_id"]: frozenset(filter(None, r["fingerprint"].split(","))) for r in rows(spark, data, "op3_fingerprints")}
    classes = {}
    for i in sorted(sets):
        if sets[i]:
            classes.setdefault(sets[i], i)
    want = {(min(i, j), max(i, j)) for a, i in classes.items() for b, j in classes.items() if i < j and len(a & b) >= 0.8 * len(a | b)}
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in pairs.collect()} == want
    assert {r["doc_id"]: r["class_"] for r in members.collect()} == {i: classes[s] for i, s in sets.items() if s}


def test_decontamination(spark, data, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    found = {r["doc_id"]: set(r["items"]) for r in rows(spark, data, "op4_decontamination")}
    for d, t in docs.items():
        assert {i for i, x in items.items() if x in t} <= found.get(d, set())
    index, reader = decontaminate.Index([(1, "A train leaves Boston at 5 pm and travels 60 miles to reach the town of Springfield before 5 pm today")]), decontaminate.Reader()
    same = "Note. A train leaves Denver at 7 pm and travels 80 miles to reach the town of Aurora before 7 pm today"
    assert index.match(*reader.read(same), 0.9) == [(1, 1.0)]
    assert not index.match(*reader.read(same.replace("before 7", "before 9")), 0.9)
    assert not index.match(*reader.read("A train of thought that leaves no one at the station today"), 0.1)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, data, docs):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in s.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    for r in rows(spark, data, "op5_pii"):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in pats.items() for m in re.finditer(p, docs[r["doc_id"]]) if good(k, m.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}
        assert r["n_card"] == sum(s.startswith("card") for s in spans)


def test_bpe(spark, data, docs):
    import base64

    import numpy as np
    import public_tokenizers as pt
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(pt.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, data, "op6_bpe"):
        t = docs[r["doc_id"]]
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_html(spark, data):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in rows(spark, data, "op7_html_text"):
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert r["text"] == "\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])


def test_html_boilerplate():
    page = '<header>Site</header><nav>a b</nav><main><article><h1>T</h1><p>a <a href="x>y">b</a> &lt;c</p><aside>ad</aside><ul><li>x</li></ul><form><p>q</p></form><section class="comments"><p>no</p></section><p>short</article></main><script>if(a<b){"</p>"}</script>'
    assert html_text.main_text(page) == "T\na b <c\nx\nshort"
    plain = "<div class='sidebar'>x y z</div><div><p>Hello &amp; bye" + " word" * 30 + "</p><p>two<br>lines</p></div><div id=comments><p>nice" + " wow" * 30 + "</p></div><footer>c</footer>"
    assert html_text.main_text(plain) == "Hello & bye" + " word" * 30 + "\ntwo lines"


def test_language(spark, data):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = rows(spark, "/root/testdata/sf0.01", "op8_language")
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in held if lang[r["doc_id"]]]
    assert sum(right) >= 0.98 * len(right) and all(0 <= r["score"] <= 1 for r in got)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    return {i: find(i) for i in sets}


def test_ngram_join(spark, data, docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    want = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, data, "op9_ngram_join")}
    assert got == {i: (len(sets[i]), want[i]) for i in docs}


def test_ngram_join_chains_and_tiles(spark, monkeypatch):
    """A chain of copies, each a little off the one before, with tiles so small that they must be split."""
    import random

    from quilter.llm import ngram_join

    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 600)
    monkeypatch.setattr(ngram_join, "MERGED_SHINGLES", 600)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 4)
    rng = random.Random(4)
    words, texts = [f"w{rng.randrange(500)}" for _ in range(120)], {}
    for i in range(60):
        texts[i] = " ".join(words)
        words[rng.randrange(120)] = f"x{i}"
        if i % 20 == 19:
            words = [f"w{rng.randrange(500)}" for _ in range(120)]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, "doc_id", "text").collect()}
    assert got == components({i: shingles(t) for i, t in texts.items()})


def removed(texts, size=400):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    for t in texts:
        runs = []
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + size
                else:
                    runs.append([i, i + size])
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        yield len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(spark, data, docs):
    import random

    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, extra = some(700), ["a" * 1500, "ab" * 600, "b" + "a" * 900 + "c", "x" * 399, "é" * 700]
    extra += [some(rng.randint(0, 400)) + passage[rng.randint(0, 150) : rng.randint(500, 700)] + some(rng.randint(0, 400)) for _ in range(60)]
    every = dict(docs) | {10**6 + i: t for i, t in enumerate(extra)}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, "doc_id", "text").collect()}
    want = dict(zip(every, removed([t.encode() for t in every.values()]), strict=True))
    assert got == want


def test_loser_tree():
    import random

    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 7))]
        got = list(loser_tree.merge([iter([(n, s, None) for n, s in loser_tree.front_code(r)]) for r in runs]))
        want = sorted(s for r in runs for s in r)
        assert [s for _, s, _ in got] == want
        assert all(n == loser_tree.common_prefix(a, b) for (n, b, _), a in zip(got[1:], want, strict=False))
