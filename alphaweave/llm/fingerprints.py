"""Document fingerprints: sketches of every shingle hash below a fixed threshold.

A text's shingles are the runs of `SHINGLE` words, or all its words where there are fewer. The sketch keeps each
distinct 64-bit shingle hash in the lowest 1 / `SHARE` of all hashes, so it grows with the text, sketches of parts
merge by union, and the share of one sketch found in another estimates containment between texts of very different
length. A text with no hash so low keeps its smallest one instead, so that short texts have a sketch too; merging drops
it where the other part has a low one, so the merged sketch is that of both texts' shingles.

Two texts that differ in d shingles in all have the same fingerprint with a chance of (1 - 1 / SHARE) ** d: 6 % for one
word changed (ten shingles), less where texts are short enough to keep their smallest hash. The likeness of two sketches,
the smaller of k hashes, is off by about sqrt(c (1 - c) / k) where c is the containment.

Everything is column expressions. The one join brings each document's successor to it; ids are put in order by ranges,
so no task sees more than its range.

Defined results: null texts count as empty; an empty sketch is the empty string, likeness 1 to another empty one and 0
to any other. Texts of any length are taken whole, other columns are not read. Rows that repeat a doc_id all have the same successor, the least text of the next larger id, and repeat
their results. With one id in the table a document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaweave.session import materialize

from .common import small
from .pseudonyms import let

SHINGLE = 5
#: One in so many hashes is kept.
SHARE = 4


def lowest(hashes: Column, share: int) -> Column:
    """The hashes, taken as signed, in the lowest 1/share of their range, or the smallest if there is none."""
    least = F.lit(-(1 << 63) + (1 << 64) // share)
    some = F.filter(hashes, lambda h: h < least)
    return let(some, lambda s: F.when((F.size(s) > 0) | (F.size(hashes) == 0), s).otherwise(F.array(F.array_min(hashes))))


def sketch(text: Column, shingle: int = SHINGLE, share: int = SHARE) -> Column:
    """Sorted distinct hashes kept of a text's shingles."""
    words = F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    empty = F.xxhash64(F.lit(""))

    def hashes(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(n - (shingle - 1), F.least(n, F.lit(1)))
        starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]))

    # Splitting at white space leaves an empty word at either end of a text that begins or ends with it.
    inner = F.filter(words, lambda w: w != empty)
    return let(let(inner, hashes), lambda h: F.array_sort(F.array_distinct(lowest(h, share))))


def written(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda h: F.lower(F.hex(h))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger one."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(both / least)


def merged(a: Column, b: Column, share: int = SHARE) -> Column:
    """The sketch of two parts together, but for the shingles across the cut."""
    return let(F.array_union(a, b), lambda both: F.array_sort(lowest(both, share)))


def successors(ids: DataFrame, slices: int) -> DataFrame:
    """`ids` (doc_id, unique, and n_rows) with `next`, the struct of the next larger id; the last is followed by the first."""
    ranged = materialize(ids.repartitionByRange(slices, "doc_id").withColumn("slice", F.spark_partition_id()))
    one = F.struct("doc_id", "n_rows")
    heads = materialize(ranged.groupBy("slice").agg(F.min(one).alias("head")))
    # One row per slice.
    in_order = Window.orderBy("slice")
    after = heads.select("slice", F.coalesce(F.lead("head").over(in_order), F.min("head").over(Window.partitionBy())).alias("next_head"))
    within = F.lead(one).over(Window.partitionBy("slice").orderBy("doc_id"))
    return ranged.withColumn("within", within).join(F.broadcast(after), "slice").withColumn("next", F.coalesce("within", "next_head")).drop("slice", "within", "next_head")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and that of the next document."""
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 2)).alias("half"), F.count(F.lit(1)).alias("n_rows"))
    order = materialize(successors(ids, slices))
    n = order.count()
    # To each document, the one before it and how much of this text that one can use.
    sent = order.select(F.col("next.doc_id").alias("doc_id"), F.col("next.n_rows").alias("n_rows"), F.col("doc_id").alias("to_id"), F.col("half").cast("int").alias("half"))
    begun = lambda df: df.select("to_id", F.substr("text", F.lit(1), F.col("half")).alias("begin"), sketch(F.col("text")).alias("next"))
    single = begun(rows.join(small(sent.where("n_rows = 1"), n), "doc_id"))
    repeated = rows.join(small(sent.where("n_rows > 1"), n), "doc_id").groupBy("to_id", "half").agg(F.min("text").alias("text"))
    following = single.unionByName(begun(repeated)).withColumnRenamed("to_id", "doc_id")
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n_chars - half), F.substr("begin", F.lit(1), half))
    paired = rows.join(following.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "next", n_chars.cast("long").alias("n_chars"), edited.alias("edited"))
    sketched = paired.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next", *[sketch(F.col(t)).alias(s) for t, s in (("text", "own"), ("edited", "other"))])
    return sketched.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` with the sketch of each text."""
    return docs.withColumn("sketch", sketch(F.coalesce("text", F.lit(""))))
