"""URL filter: host/path rules, then a character language-model ratio. Built-in functions only.

Two smoothed variable-order Markov models (interpolated Witten-Bell, contexts of
0 to 3 characters) are counted over accepted and rejected URLs. A URL's score is
the mean per character of ``log p_rejected - log p_accepted``. Labels are weak: a URL that a rule
decides has the rule's verdict; of the others those with a seed word in their host are
rejected and the rest accepted. One URL in ``HELD_OUT``, by its digest, is left out of the counts; of these,
the ones that no rule decides (as it is only there that the model is asked) set the cut-off: halfway from the
bin of scores with the largest true-accept plus true-reject rate to the next bin under it that is not empty.
Counting and scoring read each URL once and shuffle partial sums; what is broadcast is one row per distinct 4-gram over 32 symbols, so at
most 32**4 rows whatever the input, and the scores of frequent URLs, 4,096 at most.

Defined results: a null URL or one without ``://`` has empty host and path, no
rule, and is judged by the model on the empty string (score 0) or on its text; the same URL
always gets the same verdict, so repeated rows and ids do; bins of equal rates: the highest; with no labelled URL of either kind every score is
0 and the verdict is allow; without held-out URLs of both kinds the model blocks nothing; an empty table gives an empty result. Other columns of the input are ignored, and result
columns get an underscore where the id column has their name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quilter.llm.common import Staged, free, spread_join

#: (verdict, host, path): fits the host and its subdomains under paths that start so.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words in a host that mark a URL as a rejected training example (weak labels).
SEED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "track", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols: 0 start, 1-26 letters, 27 digit, 28 '.', 29 '-', 30 '/', 31 any other.
BITS, ORDER = 5, 4
HISTOGRAM_STEP = 0.02
#: One labelled URL in so many calibrates and is not counted.
HELD_OUT = 5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def rule_string(host: str, path: str) -> str:
    return host + path


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule string, verdict); nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, rule_string(h, p)).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _symbols(text: Column) -> Column:
    """Text over the 32 symbols, written as letters, '0', '.', '-', '/' and '_', after three start marks '^'."""
    low = F.translate(text, UPPER, LOWER)
    low = F.regexp_replace(F.regexp_replace(low, "[0-9]", "0"), r"[^a-z0.\-/]", "_")
    return F.concat(F.lit("^" * (ORDER - 1)), low)


def _code(ch: Column) -> Column:
    """Symbol number of one character."""
    return F.instr(F.lit("^" + LOWER + "0.-/_"), ch) - 1


def _grams(text: Column) -> Column:
    """The 4-gram number that ends at each character; symbols are looked up once for each character."""
    codes = F.transform(F.split(_symbols(text), ""), _code)

    def of(codes: Column) -> Column:
        n = F.size(codes) - (ORDER - 1)

        def gram(i: Column) -> Column:
            total = F.lit(0)
            for k in range(ORDER):
                total = F.shiftleft(total, BITS) + F.element_at(codes, i + k)
            return total

        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), gram)).otherwise(F.array().cast("array<int>"))

    return F.element_at(F.transform(F.array(codes), of), 1)


def _model(counts: DataFrame) -> DataFrame:
    """From counts (gram, a, r) over all 4-grams to (gram, llr): the difference of interpolated log-probabilities."""
    out = counts.withColumns({"pa": F.lit(1.0 / (1 << BITS)), "pr": F.lit(1.0 / (1 << BITS))})
    for n in range(1, ORDER + 1):  # n-grams: contexts of n - 1 symbols, shortest first
        key = F.col("gram").bitwiseAND((1 << (BITS * n)) - 1)
        g, c = f"g{n}", f"c{n}"
        out = out.withColumns({g: key, c: F.shiftright(key, BITS)})
        by_g, by_c = Window.partitionBy(g), Window.partitionBy(c)
        first = F.row_number().over(Window.partitionBy(g).orderBy("gram")) == 1
        out = out.withColumns({"na": F.sum("a").over(by_g), "nr": F.sum("r").over(by_g), "first": first})
        kinds = lambda x: F.sum(F.when(F.col("first") & (F.col(x) > 0), 1).otherwise(0)).over(by_c)
        out = out.withColumns({"ta": kinds("na"), "tr": kinds("nr"), "ca": F.sum("a").over(by_c), "cr": F.sum("r").over(by_c)})
        for p, k, t, total in (("pa", "na", "ta", "ca"), ("pr", "nr", "tr", "cr")):
            out = out.withColumn(p, F.when(F.col(total) > 0, (F.col(k) + F.col(t) * F.col(p)) / (F.col(total) + F.col(t))).otherwise(F.col(p)))
        out = out.select("gram", "a", "r", "pa", "pr")
    return out.select("gram", (F.log("pr") - F.log("pa")).alias("llr"))


def held_out(key: Column) -> Column:
    """Whether a URL, by its digest, is kept for calibration."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % HELD_OUT == 0


def seed_label(host: Column) -> Column:
    """'reject' for hosts with a seed word between dots or hyphens, else 'accept'; null for no host."""
    words = "|".join(SEED_WORDS)
    bad = host.rlike(rf"(^|[.\-])({words})([.\-]|$)")
    return F.when(host == "", None).when(bad, "reject").otherwise("accept")


def score_urls(one: DataFrame, staged: Staged) -> tuple[DataFrame, float]:
    """Score of each distinct URL and the calibrated cut-off.

    one: (key, u, label, free), a row for each URL; label is 'accept', 'reject' or null (tells nothing), free says that no rule decides it.
    Returns (key, score), without rows for texts of no characters.
    """
    bare = F.regexp_replace(F.col("u"), r"^[^:]*://", "")
    counted = F.when(~held_out(F.col("key")), F.col("label"))
    judged = F.when(held_out(F.col("key")) & F.col("free"), F.col("label"))
    # digests stand for URLs, which may be long, in all that has a row for each character
    grams = one.select("key", counted.alias("counted"), judged.alias("judged"), _grams(bare).alias("grams")).select("key", "counted", "judged", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(
        F.count(F.when(F.col("counted") == "accept", 1)).alias("a"),
        F.count(F.when(F.col("counted") == "reject", 1)).alias("r"),
    )
    model = staged.put(_model(counts), "url_model")  # at most 32**4 rows
    scored = grams.join(F.broadcast(model), "gram").groupBy("key", "judged").agg(F.avg("llr").alias("score"))
    scored = staged.put(scored, "url_scores")
    step = F.floor(F.col("score") / HISTOGRAM_STEP)
    bins = scored.where("judged is not null").groupBy(step.alias("bin")).agg(
        F.count(F.when(F.col("judged") == "accept", 1)).alias("a"),
        F.count(F.when(F.col("judged") == "reject", 1)).alias("r"),
    )
    # Scores are differences of logs of probabilities not under 2**-60 or so: a few thousand bins at most.
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    best = (
        bins.withColumns({"a_low": F.coalesce(F.sum("a").over(below), F.lit(0)), "r_low": F.coalesce(F.sum("r").over(below), F.lit(0)), "at": F.sum("a").over(everything), "rt": F.sum("r").over(everything), "under": F.lag("bin").over(Window.orderBy("bin"))})
        .where("at > 0 and rt > 0")
        .withColumn("gain", F.col("a_low") / F.col("at") - F.col("r_low") / F.col("rt"))
        .orderBy(F.desc("gain"), F.desc("bin"))
        .select("bin", F.coalesce(F.col("under") + 1, "bin").alias("under"))
        .head()
    )
    cut = (best["bin"] + best["under"]) / 2 * HISTOGRAM_STEP if best else float("inf")
    return scored.select("key", "score"), cut


def judge_urls(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """id_col, host, path, rule, verdict and score of every row."""
    staged = Staged(pages.sparkSession)
    rows = pages.select(F.struct(F.col(id_col).alias("id_")).alias("own_"), F.coalesce(F.col(url_col), F.lit("")).alias("u"))
    rows = rows.withColumn("key", F.md5("u"))
    one = rows.groupBy("key").agg(F.first("u").alias("u"), F.count(F.lit(1)).alias("times"))
    host, path = host_path(F.col("u"))
    one = one.withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    one = staged.put(one.withColumns({"rule": rule, "ruled": verdict}), "urls")
    label = F.when(F.col("ruled") == "block", "reject").when(F.col("ruled") == "allow", "accept").otherwise(seed_label(F.col("host")))
    scores, cut = score_urls(one.select("key", "u", label.alias("label"), F.col("ruled").isNull().alias("free")), staged)
    facts = one.drop("u").join(scores, "key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    facts = staged.put(facts.withColumn("verdict", F.coalesce("ruled", F.when(F.col("score") >= cut, "block").otherwise("allow"))), "url_facts")
    out = spread_join(rows.select("own_", "key"), facts, "key", "times", pages.count(), "inner")
    return out.select(F.col("own_.id_").alias(id_col), *(F.col(c).alias(free(c, (id_col,))) for c in ("host", "path", "rule", "verdict", "score")))
