"""Document fingerprints from spot signatures. Built-in functions only.

Anchors are common words. Each anchor begins a signature: the anchor and the chain of
the next ``CHAIN`` content words (words that are not anchors), hashed to 32 bits. The
start of the text is an anchor too, so any text with a content word has a signature. Where
a text has under one signature in ``SPARSE`` content words (a menu, another language), content words
whose hash falls in one class of ``SPARE`` are anchors of it as well.
A fingerprint is the text's sorted set of signatures; likeness is Jaccard, with the
bound ``smaller / larger set`` tested before sets are intersected where a threshold is given.

Anchors are glued to the content word that follows them, after which a chain is a
window over the array of content words: linear in the text's length, no rows per word.

``next_ids`` finds the next document by id from range-partitioned ids alone, and ``with_next``
brings the texts together. ``duplicates`` finds pairs of likeness
``threshold`` or more between distinct fingerprints: partitions by set length, a prefix
index of rare signatures inside them, then pruned Jaccard.

``fingerprints`` reports every likeness as it is, so no threshold prunes there; partitions by length and pruning are ``duplicates``' way.

Defined results: null text is the empty text; a text without content words has the
empty fingerprint, which has likeness 1 to itself and 0 to any other; the row after
the last is the first; rows with the same id share their next row, and of several rows
with the next id the one of the smallest head (then fingerprint) counts; a null id comes first; an empty table gives an empty
result; other columns are ignored, and result columns get an underscore where the id column has their name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quilter.llm.common import Staged, free

CHAIN, THRESHOLD = 3, 0.8
SPARSE, SPARE = 20, 4
#: Common words of English, German, French and Spanish (fixed values).
ANCHORS = (
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the they this to was we were which will with you "
    "als am auch auf aus bei das dem den der des die dies ein eine einem einen einer er es für hat ich im ist mit nicht sich sie sind und von war wie wir zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella este esta los las lo más me mi no nos o para pero por se su sus una y ya"
)


START, END, SPARE_MARK = "^", "$", "*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def glued_words(text: Column, anchors: str = ANCHORS) -> Column:
    """Content words in order, each led by the anchors right before it, as 'the~of~cat'.

    The start of the text is the first anchor; the last element is an end mark, led by the anchors after the last content word.
    """
    words = "|".join([r"\^", *sorted(set(anchors.split()))])
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    framed = F.concat_ws(" ", F.lit(START), F.nullif(plain, F.lit("")), F.lit(END))
    return F.split(F.regexp_replace(framed, rf"(?<![^ ])({words}) ", "$1~"), " ")


def signatures(text: Column, chain: int = CHAIN, anchors: str = ANCHORS) -> Column:
    """Sorted distinct signature hashes of a text."""

    def led(word: Column, follow: Column) -> Column:
        """A signature for each anchor that leads the word."""
        return let(follow, lambda f: F.transform(F.split(word, "~"), lambda a: F.hash(a, f)))

    def chains(words: Column) -> Column:
        bare = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: F.substring_index(w, "~", -1))

        def all_of(content: Column) -> Column:
            def at(w: Column, i: Column) -> Column:
                follow = F.concat_ws(" ", F.slice(content, i + 1, chain))
                return F.when(w.contains("~") & (i < F.size(content)), led(F.substring(w, F.lit(1), F.length(w) - F.length(F.substring_index(w, "~", -1)) - 1), follow)).otherwise(F.array().cast("array<int>"))

            def spare(w: Column, i: Column) -> Column:
                return F.when((F.pmod(F.hash(w), F.lit(SPARE)) == 0) & (i + 1 < F.size(content)), F.hash(F.lit(SPARE_MARK), F.concat_ws(" ", F.slice(content, i + 2, chain))))

            more = F.filter(F.transform(content, spare), lambda x: x.isNotNull())
            return let(F.flatten(F.transform(words, at)), lambda found: F.when(F.size(found) * SPARSE < F.size(content), F.concat(found, more)).otherwise(found))

        return let(bare, all_of)

    return F.sort_array(F.array_distinct(let(glued_words(F.coalesce(text, F.lit("")), anchors), chains)))


def to_string(sigs: Column) -> Column:
    """Signatures as hexadecimal numbers joined by commas."""
    return F.lower(F.array_join(F.transform(sigs, lambda s: F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), ","))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 where the sets' sizes alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(large == 0, 1.0).when((small == 0) | (small < least * large), 0.0).otherwise(exact).cast("double")


def next_ids(ids: DataFrame, id_col: str, staged: Staged) -> DataFrame:
    """(id_, next_) for every distinct id: the next larger one, the smallest after the largest.

    Ids alone are dealt by range; a window inside each part finds the next, and the
    first id of each part (one row a part) closes the gaps.
    """
    distinct = ids.select(F.col(id_col).alias("id_")).distinct().repartitionByRange("id_")
    parts = staged.put(distinct.withColumn("part_", F.spark_partition_id()), "ids")
    inner = parts.withColumn("next_", F.lead(F.struct("id_")).over(Window.partitionBy("part_").orderBy("id_")))
    heads = parts.groupBy("part_").agg(F.min(F.struct("id_")).alias("head_"))
    order = Window.orderBy("part_")
    all_ = Window.partitionBy(F.lit(0))
    after = heads.select("part_", F.coalesce(F.lead("head_").over(order), F.min("head_").over(all_)).alias("head_"))
    out = inner.join(after, "part_")
    return out.select("id_", F.coalesce("next_", "head_")["id_"].alias("next_"))


def with_next(df: DataFrame, id_col: str, text_col: str, staged: Staged) -> DataFrame:
    """(id_, text_, own_, head_, after_) of every row: its signatures, as much of the next text's head as it may need, and that text's signatures.

    Signatures are computed once, where a text is read. Whole texts are shuffled once, by id, and used from that
    shuffle twice; of the next texts only heads and signatures travel on.
    """
    # ids as structs are never null, so all joins and the aggregate are by plain equality of one column
    docs = df.select(F.struct(F.col(id_col).alias("id_")).alias("key_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    halves = docs.groupBy(F.col("key_").alias("before_")).agg(F.max(F.floor(F.length("text_") / 2)).cast("int").alias("half_"))
    links = next_ids(df, id_col, staged).select(F.struct("id_").alias("before_"), F.struct(F.col("next_").alias("id_")).alias("key_"))
    links = staged.put(links.join(halves, "before_"), "next_ids")
    signed = docs.withColumn("own_", signatures(F.col("text_")))
    head = F.struct(F.substring(F.col("text_"), F.lit(1), F.col("half_")).alias("head_"), F.col("own_").alias("after_"))
    follow = signed.join(links, "key_").select("before_", head.alias("n_")).groupBy("before_").agg(F.min("n_").alias("n_"))
    return signed.join(follow, F.col("key_") == F.col("before_")).select("key_.id_", "text_", "own_", "n_.head_", "n_.after_")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    staged = Staged(df.sparkSession)
    rows = with_next(df, id_col, text_col, staged)
    n = F.length("text_")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text_"), F.lit(1), n - half), F.substring(F.col("head_"), F.lit(1), half))
    rows = rows.withColumns({"edited_": edited}).withColumns({"changed_": signatures(F.col("edited_"))})
    named = lambda name: free(name, (id_col,))
    return rows.select(
        F.col("id_").alias(id_col),
        n.cast("long").alias(named("n_chars")),
        F.sha2(F.col("edited_").cast("binary"), 256).alias(named("edited_sha256")),
        to_string(F.col("own_")).alias(named("fingerprint")),
        to_string(F.col("changed_")).alias(named("edited_fingerprint")),
        likeness(F.col("own_"), F.col("changed_")).alias(named("near_edited")),
        likeness(F.col("own_"), F.col("after_")).alias(named("near_next")),
    )


def duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of distinct fingerprints at or over the threshold, by class, and each id's class.

    A class is one distinct non-empty fingerprint, named by its smallest id. Sets are
    partitioned by length so that only neighbouring partitions can hold a pair; in them a
    pair shares one of the rarest signatures of both, as many as the threshold leaves
    free to differ; lengths prune before sets are intersected. Frequent signatures come
    last in a set's order and so stay out of the index.
    """
    staged = Staged(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id_"), signatures(F.col(text_col)).alias("sigs_")).where(F.size("sigs_") > 0)
    rows = staged.put(rows, "signatures")
    classes = staged.put(rows.groupBy("sigs_").agg(F.min("id_").alias("class_")), "classes")
    members = rows.join(classes, "sigs_").select(F.col("id_").alias(id_col), "class_")
    n = F.size("sigs_")
    rank = classes.select("class_", n.alias("n_"), F.explode("sigs_").alias("sig_"))
    often = rank.groupBy("sig_").agg(F.count("*").alias("df_"))
    order = Window.partitionBy("class_").orderBy("df_", "sig_")
    prefix = rank.join(often, "sig_").withColumn("at_", F.row_number().over(order))
    prefix = prefix.where(F.col("at_") <= F.col("n_") - F.ceil(F.lit(threshold) * F.col("n_")) + 1)
    band = lambda x: F.floor(F.log(x) / F.log(F.lit(1 / threshold)))
    prefix = staged.put(prefix.select("class_", "n_", "sig_", band(F.col("n_")).alias("band_")), "prefixes")
    left = prefix.select(F.col("class_").alias("a"), F.col("n_").alias("na"), "sig_", F.explode(F.array(F.col("band_"), F.col("band_") + 1)).alias("band_"))
    right = prefix.select(F.col("class_").alias("b"), F.col("n_").alias("nb"), "sig_", "band_")
    near = left.join(right, ["sig_", "band_"]).where("na < nb or (na = nb and a < b)").where(F.col("na") >= F.lit(threshold) * F.col("nb"))
    near = near.select("a", "b").distinct()
    sets = classes.select("class_", "sigs_")
    out = near.join(sets.select(F.col("class_").alias("a"), F.col("sigs_").alias("sa")), "a").join(sets.select(F.col("class_").alias("b"), F.col("sigs_").alias("sb")), "b")
    out = out.withColumn("likeness", likeness(F.col("sa"), F.col("sb"), threshold)).where(F.col("likeness") >= threshold)
    return out.select("a", "b", "likeness"), members
