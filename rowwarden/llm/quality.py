"""Quality rules: fixed base rules, then the log-likelihood ratio of hashed n-grams.  Native expressions only.

Words and word pairs of every text are hashed into a fixed number of buckets.  Two multinomials over the buckets are
counted: one over the whole corpus, one over trusted documents (a bounded sample of ids, as it must reach every task).
A document's score is the sum over its n-grams of log(trusted / corpus), divided by their number.  The threshold lies
``SPREAD`` standard deviations below the mean score of labelled good documents, though no lower than halfway to that of
labelled bad ones; both are taken over the half of the labels that was not trusted.  Every document is held against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.functions.text import let
from rowwarden.llm.batches import SPACES, staged, words_of

BUCKETS = 1 << 16
TRUSTED_DOCS = 20_000
SPREAD = 4.0
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words that occurs twice or more, from the hashes of a text's words."""
    def from_windows(windows: Column) -> Column:
        # Only where some window occurs again: sorted by hash, equal windows are neighbours.
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(pairs, from_pairs))

    def from_pairs(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, k: F.get(pairs, k - 1)["h"].eqNullSafe(p["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(p["h"]))
        return let(F.sort_array(F.transform(again, lambda p: p["i"])), covered)

    def covered(places: Column) -> Column:
        # Each place begins a span; it adds the words up to the next place or its own length.
        own = F.transform(places, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - i, F.lit(window))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - window + 1), lambda i: F.xxhash64(F.slice(hashes, i, window)))
    return F.when(F.size(hashes) <= window, 0).otherwise(let(windows, from_windows))


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, the base counts over the whole text, and the buckets of its n-grams."""
    space = "[" + "".join(f"\\x{ord(c):02x}" for c in SPACES) + "]"

    def lines(text: Column) -> Column:
        return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(space.replace("[", "[^"))), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.char_length(text) - F.regexp_count(text, F.lit(space))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines(text).cast("long").alias("n_dup_lines"),
        let(word_hashes(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r"), buckets_of(w).alias("b"))).alias("_w"),
    ).select("doc_id", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"), F.col("_w.b").alias("_buckets"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def buckets_of(hashes: Column) -> Column:
    """The buckets of a text's words and pairs of neighbouring words, from the words' hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i + 1), h), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def for_counts() -> Column:
    """Half of the labelled documents may be trusted; the other half sets the threshold."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(2)) == 0


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_DOCS) -> DataFrame:
    """At most ``limit`` ids of documents of the one half labelled good and not toxic, in the order of a hash of the id."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull() & for_counts())
    return good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, lr) for all buckets that occur: at most ``BUCKETS`` rows, whatever the corpus."""
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(trusted.withColumn("_good", F.lit(1))), "doc_id", "left")
    counts = marked.select(F.coalesce("_good", F.lit(0)).alias("g"), F.explode(let(word_hashes(F.col("text")), buckets_of)).alias("bucket")) \
        .groupBy("bucket").agg(F.count("*").alias("n"), F.sum("g").alias("good"))
    counts = staged(counts)
    sums = counts.agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"))
    ratio = F.log((F.col("good") + 1) / (F.col("all_good") + BUCKETS)) - F.log((F.col("n") + 1) / (F.col("all_n") + BUCKETS))
    return counts.join(F.broadcast(sums)).select("bucket", ratio.alias("lr"))


def score(docs: DataFrame, ratios: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, base counts, and ``score``, the mean log ratio of its n-grams (null without words)."""
    keys = ["_row", "doc_id", *BASE]
    rows = base_features(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    grams = rows.select(*keys, F.explode_outer("_buckets").alias("bucket"))
    return grams.join(F.broadcast(ratios), "bucket", "left").groupBy(*keys).agg(F.avg("lr").alias("score")).drop("_row")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ``base_failed``, ``score``, ``threshold`` and ``kept`` for every row of ``docs``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in 8-word windows that occur again.  ``kept`` is
    false for those, else whether the score reaches the threshold.  Null texts have no words and fail.  Without labelled
    documents of both kinds there is no threshold, and all that pass the base rules are kept.  Repeated rows give
    repeated rows; a null id is judged like any other but is never a labelled one.  Of repeated labels of one document,
    the lowest quality counts.  Other columns are not read.
    """
    ratios = log_ratios(docs, trusted_ids(labels), id_col, text_col)
    scored = staged(score(docs, ratios, id_col, text_col).withColumn("base_failed", base_failed()))
    known = labels.filter(~for_counts() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    spread = scored.filter(~F.col("base_failed")).join(known, "doc_id").agg(*[
        f(F.when(F.col("quality") == q, F.col("score"))).alias(f"{n}{q}") for q in (0, 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    low, high = F.col("m1") - SPREAD * F.col("s1"), (F.col("m0") + F.col("m1")) / 2
    cut = spread.select(F.when(F.col("m0") < F.col("m1"), F.greatest(low, high)).alias("threshold"))
    return scored.join(F.broadcast(cut)).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True)))
