"""Quality rules: counts over a text, and a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus.

Words, cut where letters or digits meet signs, and pairs of such neighbours are hashed into `BUCKETS` buckets. The raw multinomial counts every document, the
target multinomial those that are trusted, smoothed towards the raw one by as many pseudo-counts as there are buckets. A
text's score is the mean of log(p_target / p_raw) over its n-grams, so long and short texts compare; at least `LEAST` is
kept, each document by its own text alone. Only one number per bucket reaches the driver, and it goes back as a literal
array, so scoring is one pass without a shuffle. Everything on rows is a column expression.

A text is held as an array of 64-bit word hashes; two different windows of eight words that share a hash would count as
equal (chance about n^2 / 2^65 for n words).

Defined results: a null text has no words, lines or symbols, and score 0; so has an empty one. Both fail for want of words.
Repeated rows are rated alike, and each counts in the raw multinomial. Rows without a doc_id are rated, never trusted. Null
labels do not count; of several labels of a document the lowest does. Without trusted rows every score is 0 and the fixed
rules alone decide. Texts of any length are taken whole. An empty table gives no rows. `rate` carries other columns along,
whatever their names; its own columns are in one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaweave.session import materialize

from .common import WORD, bounded_sample
from .pseudonyms import let

BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is fitted on: a bounded sample, whose ids go to every executor.
TRUSTED_ROWS = 200_000
#: Least mean log ratio of a kept document.
LEAST = -0.3
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: A word, and its parts: letters and digits, or signs.
WORD_PARTS = r"[A-Za-z0-9\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def hashes(parts: Column) -> Column:
    return F.transform(parts, lambda w: F.xxhash64(w))


def buckets(hashes: Column) -> Column:
    """array<int>: the bucket of every part, then of every pair of neighbours."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pair = lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int")
    return F.concat(single, F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), pair))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of eight words found twice or more."""
    # Hashes of windows from those of their halves.
    wider = lambda h, half: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - half, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + half)))
    all_differ = lambda h: F.size(F.array_distinct(h)) == F.size(h)

    def covered(windows: Column) -> Column:
        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def twice(t: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(t, k)["h"] == x["h"], F.lit(False))
            starts = F.sort_array(F.transform(F.filter(t, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["at"]))
            zero = F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(starts, zero, lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(8), s - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(all_differ(windows), F.lit(0)).otherwise(let(tagged, twice))

    # Where no four words come twice, no eight do.
    of_fours = lambda fours: F.when(all_differ(fours), F.lit(0)).otherwise(let(wider(fours, 4), covered))
    return F.when(F.size(hashes) > 8, let(let(wider(hashes, 1), lambda twos: wider(twos, 2)), of_fours)).otherwise(F.lit(0))


def measures(text: Column, weights: Column) -> Column:
    """The counts and the score of a text, as one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    n_dup = let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s)))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(hashes(w), repeated_words).cast("long").alias("n_repeat_words"),
    )
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(weights, i)) / F.greatest(F.size(b), F.lit(1))
    return F.struct(
        let(words(text), of_words).alias("w"),
        let(let(hashes(words(text, WORD_PARTS)), buckets), mean).alias("score"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"),
    )


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """At most about `most` doc_ids whose labels all speak for quality."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    return materialize(bounded_sample(materialize(good), "doc_id", most, seed=11))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(p_target / p_raw) of every bucket; all 0 without trusted texts. `trusted` holds a bounded number of doc_ids."""
    marked = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(trusted.select(F.col("doc_id").alias("__good")).distinct()), F.col("__id") == F.col("__good"), "left")
    grams = let(hashes(words(F.coalesce("text", F.lit("")), WORD_PARTS)), buckets)
    each = marked.select(F.col("__good").isNotNull().cast("long").alias("good"), F.explode(grams).alias("bucket"))
    counted = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("n_good")).collect()
    n, n_good = sum(r.n for r in counted), sum(r.n_good for r in counted)
    if not n_good:
        return [0.0] * BUCKETS
    ratios = [math.log(BUCKETS / (n_good + BUCKETS))] * BUCKETS
    for r in counted:
        ratios[r.bucket] = math.log((r.n_good * n / r.n + BUCKETS) / (n_good + BUCKETS))
    return ratios


def rate(docs: DataFrame, ratios: list[float], least: float = LEAST) -> DataFrame:
    """`docs` with a struct `quality`: the counts, the score, base_failed and kept."""
    # Folded into one literal array.
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    m = lambda found: F.struct(
        found["w"]["n_words"].alias("n_words"), found["w"]["word_chars"].alias("word_chars"), found["n_symbols"].alias("n_symbols"),
        found["n_dup_lines"].alias("n_dup_lines"), found["w"]["n_repeat_words"].alias("n_repeat_words"), found["score"].alias("score"),
        failed(found).alias("base_failed"), (~failed(found) & (found["score"] >= least)).alias("kept"),
    )
    failed = lambda f: (f["w"]["n_words"] < LEAST_WORDS) | (100 * f["w"]["n_repeat_words"] > REPEAT_PERCENT * f["w"]["n_words"])
    return docs.withColumn("quality", let(measures(F.col("text"), weights), m))


def judge(docs: DataFrame, labels: DataFrame, least: float = LEAST, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id and the measures of every document, trusting those that `labels` (doc_id, quality) speaks for."""
    ratios = log_ratios(docs, trusted_ids(labels.select("doc_id", "quality"), trusted_rows))
    return rate(docs.select("doc_id", "text"), ratios, least).select("doc_id", "quality.*")
