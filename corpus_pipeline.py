"""The corpus pipeline: five stages over `documents`, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns they were given. Rows that repeat a doc_id count as one document: they stay, go and are
taken equally often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaweave.llm import jaccard_join, mixing, packing, pseudonyms, toxicity
from alphaweave.llm.common import documents, small, stored
from alphaweave.llm.queries import tokenizer_path

#: Words that a packing worker remembers: by then the executor's heap has grown with the stages before.
REMEMBER = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts are scored like others; rows without a doc_id stay."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms of the same format. Null and empty texts and all other columns stay as they are."""
    done = pseudonyms.pseudonymize(docs, kinds_in=None)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and empty texts have no words and are taken as it draws them."""
    taken = stored(mixing.mix(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies")).where("__copies > 0"))
    return docs.join(small(taken), F.col("doc_id").eqNullSafe(F.col("__id"))).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of 2048; a null or empty text is its end id alone. Repeated rows are pieces of their own."""
    return packing.pack_documents(docs, tokenizer_path(), remember=REMEMBER)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("pseudonyms", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "*")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
