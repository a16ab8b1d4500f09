"""op2's models, scores and cut-off against plain counting; labels, names that clash."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from quilter.llm import url_filter as uf


def symbols(url):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub(r"^[^:]*://", "", url))
    return "^^^" + "".join(c if c in "abcdefghijklmnopqrstuvwxyz.-/" else "0" if c in "0123456789" else "_" for c in low)


def plain(urls, rules):
    """{url: (score, verdict)} by counting over strings."""
    label, free, out = {}, {}, {}
    for u in set(urls):
        rest = u.partition("://")[2] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled = max(fits, key=lambda f: len(f[0]), default=(None, None))[1]
        seed = None if not host else "reject" if set(re.split(r"[.\-]", host)) & set(uf.SEED_WORDS) else "accept"
        label[u] = {"block": "reject", "allow": "accept", None: seed}[ruled]
        free[u] = ruled
    apart = {u: int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % uf.HELD_OUT == 0 for u in label}
    models = {}
    for kind in ("accept", "reject"):
        grams = [Counter() for _ in range(5)]
        for u in label:
            if label[u] == kind and not apart[u]:
                s = symbols(u)
                for i in range(4, len(s) + 1):
                    for n in range(1, 5):
                        grams[n][s[i - n : i]] += 1
        seen, kinds = defaultdict(int), defaultdict(int)
        for n in range(1, 5):
            for g, c in grams[n].items():
                seen[n, g[:-1]] += c
                kinds[n, g[:-1]] += 1

        def p(g, grams=grams, seen=seen, kinds=kinds):
            out = 1 / 32
            for n in range(1, 5):
                own = g[4 - n :]
                c = n, own[:-1]
                if seen[c]:
                    out = (grams[n][own] + kinds[c] * out) / (seen[c] + kinds[c])
            return out

        models[kind] = p
    score = {}
    for u in label:
        s = symbols(u)
        llr = [math.log(models["reject"](s[i - 4 : i])) - math.log(models["accept"](s[i - 4 : i])) for i in range(4, len(s) + 1)]
        score[u] = sum(llr) / len(llr) if llr else 0.0
    own = [(math.floor(score[u] / uf.HISTOGRAM_STEP), label[u]) for u in label if apart[u] and free[u] is None and label[u] and len(symbols(u)) > 3]
    a, r = (sum(x == k for _, x in own) for k in ("accept", "reject"))
    cut = math.inf
    if a and r:
        gain = {b: sum(x == "accept" for c, x in own if c < b) / a - sum(x == "reject" for c, x in own if c < b) / r for b, _ in own}
        best = max(gain, key=lambda b: (round(gain[b], 12), b))
        cut = (best + max((b + 1 for b in gain if b < best), default=best)) / 2 * uf.HISTOGRAM_STEP
    return {u: (score[u], free[u] or ("block" if score[u] >= cut else "allow")) for u in label}


def compare(df, id_col, url_col, rules=uf.RULES):
    urls = {r[0]: r[1] or "" for r in df.select(id_col, url_col).collect()}
    want = plain(list(urls.values()), rules)
    got = uf.judge_urls(df, id_col, url_col, rules).collect()
    assert len(got) == df.count()
    for r in got:
        score, verdict = want[urls[r[id_col]]]
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["verdict"] == verdict
    return got


def test_pages(spark, data):
    got = compare(spark.read.parquet(f"{data}/pages.parquet"), "page_id", "url")
    assert {"allow", "block"} <= {r["verdict"] for r in got if r["rule"] is None}


def test_model_finds_what_the_seed_words_do_not_name(spark):
    good = [f"https://www.garden-{w}.org/{w}/{i}" for i, w in enumerate(["rose", "tulip", "oak", "fern", "moss", "herb"] * 12)]
    bad = [f"http://{w}-casino-bonus.net/win/jackpot-{i}" for i, w in enumerate(["big", "hot", "top"] * 14)]
    extra = ["http://big-cazino-bonus.net/win/jackpot-99", "https://www.garden-lily.org/lily/1", None, "", "no address", "HTTP://BIG-CASINO-BONUS.net/win", "x://é" + "ab/" * 5000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + extra)], "page_id long, url string")
    got = {r["page_id"]: r for r in compare(df, "page_id", "url", ())}
    n = len(good + bad)
    assert got[n]["verdict"] == "block" and got[n + 1]["verdict"] == "allow" and got[n + 3]["score"] == 0


def test_names_that_clash(spark):
    from quilter.llm import sharding

    df = spark.createDataFrame([("a", "http://x.org/es/1", 1)], "host string, key string, u int")
    (row,) = uf.judge_urls(df, "host", "key").collect()
    assert (row["host"], row["host_"], row["path"], row["verdict"]) == ("a", "x.org", "/es/1", "block")
    for name in ("path", "rule", "ruled", "score", "url_", "verdict"):
        (row,) = uf.judge_urls(spark.createDataFrame([(5, "http://x.org/es/1")], f"{name} long, url string"), name, "url").collect()
        assert row[name] == 5
    for name in ("slot", "shard", "own_"):
        (row,) = sharding.place(spark.createDataFrame([(5,)], f"{name} long"), name).collect()
        assert row[name] == 5 and len(row) == 3
