"""Registered queries of the corpus operators and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard_join, katz, language_id, mixing, packing, periodic, pseudonyms, quality, secrets, spelling, toxicity, vector_dedup
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def tokenizer_path(name: str = packing.TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir, "doc_id", "text"))


@query
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonyms.pseudonymize(documents(spark, sf_dir, "doc_id", "text"))
    return done.select("doc_id", "text", F.size("pii").alias("n_pii"), F.array_join("pii", ",").alias("pii"))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir, "doc_id", "text"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score(documents(spark, sf_dir, "doc_id", "text"), labels)


@query
def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.deduplicate(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir, "doc_id", "text"), shingle=4, percent=85)


@query
def op3_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir, "doc_id", "text"))


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.judge(documents(spark, sf_dir, "doc_id", "text"), labels)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(documents(spark, sf_dir, "doc_id", "text"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(documents(spark, sf_dir, "doc_id", "text"))
    return spelling.variants(words).select("word", "n", "form", "root", "n_near", "form_n")


#: crc32 by bytes and a table made from its polynomial; words one edit apart share a rest with one letter taken out.
SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE bits(i, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL
),
bytes AS (
    SELECT run, times, hex(encode(doc_id || ':' || run)) AS h FROM runs
),
hashed AS (
    SELECT run, times, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i+1])::BIGINT)),
        lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) AS c
    FROM bytes, crc
),
spelled AS (
    SELECT CASE WHEN c % 199 = 0 THEN substring(run, 1, (c % length(run))::INT) || substring(run, (c % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
),
words AS (SELECT word, sum(times)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
rests AS (
    SELECT word, i, substring(word, 1, i::INT) || substring(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
),
pairs AS (
    SELECT a.word, b.word AS other FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word FROM rests a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM rests a JOIN words b ON a.rest = b.word
),
near AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS best_n
    FROM (SELECT p.word, p.other, w.n AS m FROM pairs p JOIN words w ON w.word = p.other) GROUP BY word
),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
    FROM words w LEFT JOIN near USING (word)
),
chain(word, reached) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.reached AS root FROM chain c JOIN formed f ON f.word = c.reached WHERE f.form IS NULL)
SELECT word, n, form, root, n_near, form_n FROM formed JOIN roots USING (word)
"""
