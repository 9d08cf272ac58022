"""Toxicity by gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Labelled rows of the learning folds are split in three by their fold: one part weighs the lexicon (words and word
beginnings by log odds of a document being toxic), one grows the trees, one calibrates them, so that no part judges
entries that it has itself chosen. Learning uses a bounded sample of labelled rows, their texts in full; scoring is one
pass over all documents.

Features: densities and weights of lexicon hits, hits near a second-person word, capitals, punctuation, disguised words
(digits or signs between letters), and length.

Defined results: null and empty texts are scored as texts without words. Labels that are null do not count; of several
labels of a document the highest does. Where the learning rows hold no toxic or no clean row, every score is their share
of toxic ones (0 without any). Where the calibration part lacks one of the two, the trees' own probability is the score.
Repeated rows score alike and count as often when labelled; entries and splits that tie go by name and by feature order. Texts
of any length are taken whole, in time proportional to it. An empty table gives no rows. Columns other than doc_id and text
are not read by `score` and kept by `reject`, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaweave.session import materialize

from .common import bounded_sample, fold, stored

#: Bounds of what is learned from: labelled rows, and lexicon entries kept.
TRAIN_ROWS, LEXICON_ENTRIES = 20_000, 2_000
PREFIXES = (3, 4, 5, 6, 7)
TREES, DEPTH = 20, 3
NEAR = 3
#: Common insults, and words for the one spoken to, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown imbecile fool retard "
    "bastard bitch asshole jerk pig vermin filth idioten dummkopf abschaum arschloch trottel depp versager dreckig widerlich "
    "imbécile connard connasse salaud salope abruti crétin ordure minable dégoûtant idiota imbécil estúpido estúpida tonto basura escoria "
    "asqueroso patético gilipollas cabrón"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
WORDS = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[^\W\d_]+(?:[0-9@$!*|]+[^\W\d_]+)+|[0-9@$]+[^\W\d_]{2,}")
DISGUISE, SHOUTED = re.compile(r"[0-9@$!*|]"), re.compile(r"\b[A-Z]{3,}\b")
REPEATED, DOUBLES = re.compile(r"([!?.*$#%&])\1+"), [2 * c for c in "!?.*$#%&"]
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": None})
FEATURES = (
    "known_density", "known_hits", "hit_density", "hit_weight", "top_weight", "distinct_hits", "near_second_person", "second_person",
    "capitals", "shouted_words", "exclamations", "punctuation", "repeated_signs", "disguised_density", "disguised_hits", "log_words",
)


def entries(word: str) -> list[str]:
    """A word as lexicon entries: itself, marked, and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]


def learn_lexicon(labelled: DataFrame, most: int = LEXICON_ENTRIES) -> dict[str, float]:
    """Entries of (text, toxic) rows that speak for toxicity, with their log odds."""

    def distinct(batches):
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = {e for w in set(WORDS.findall((text.as_py() or "").lower())) for e in entries(w)} | {""}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([toxic] * len(found), pa.int64())], ["entry", "toxic"])

    counted = labelled.select("text", F.col("toxic").cast("long")).mapInArrow(distinct, "entry string, toxic long").groupBy("entry").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    counted = materialize(counted)
    # The empty entry is in every document.
    total = counted.where("entry = ''").first()
    if total is None or total.bad in (0, total.n):
        return {}
    odds = F.log((F.col("bad") + 0.5) / (total.bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (total.n - total.bad + 1))
    rated = counted.where("entry <> '' AND bad >= 3").withColumn("odds", odds).where(F.col("odds") >= math.log(8))
    best = rated.orderBy(F.desc(F.col("odds") * F.col("bad")), "entry").limit(most)
    return {r.entry: r.odds for r in best.collect()}


class Words(dict):
    """What a word says: None, or (is it known, its weight, does it speak to someone), worked out once while remembered."""

    REMEMBERED = 200_000

    def __init__(self, lexicon: dict[str, float], known: frozenset[str] = frozenset(INSULTS), second: frozenset[str] = frozenset(SECOND_PERSON), begin: frozenset[str] | None = None):
        self.lexicon, self.known, self.second = lexicon, known, second
        self.begin = frozenset(e.lstrip("=")[:3] for e in lexicon) if begin is None else begin

    def __missing__(self, w: str) -> tuple[bool, float, bool] | None:
        weight = 0.0
        if w[:3] in self.begin:
            weight = max((self.lexicon[e] for e in entries(w) if e in self.lexicon), default=0.0)
        found = (w in self.known, weight, w in self.second)
        if len(self) >= self.REMEMBERED:
            self.clear()
        self[w] = found = found if any(found) else None
        return found


#: Whether a code point is a capital letter.
CAPITALS = np.array([chr(i).isupper() for i in range(0x110000)])


def features(text: str, of: Words | dict[str, float], *lists: frozenset[str]) -> list[float]:
    """The features of a text. In place of `Words` a lexicon and the lists that make them may be given."""
    of = of if isinstance(of, Words) else Words(of, *lists)
    words = WORDS.findall(text.lower())
    n = max(1, len(words))
    said = [(i, x) for i, x in enumerate(map(of.__getitem__, words)) if x]
    hits = [(i, known, max(weight, 2.0 * known)) for i, (known, weight, _) in said if known or weight]
    persons = np.array([i for i, (_, _, second) in said if second], np.int64)
    at = np.array([i for i, _, _ in hits], np.int64)
    near = int((np.searchsorted(persons, at + NEAR, "right") > np.searchsorted(persons, at - NEAR)).sum())
    n_known, weights = sum(known for _, known, _ in hits), [w for _, _, w in hits]
    # A disguised word holds a digit or a sign, and no white space.
    disguised = [d for t in text.split() if not t.isalpha() and DISGUISE.search(t) for d in DISGUISED.findall(t)]
    unmasked = [d.lower().translate(PLAIN) for d in disguised]
    letters = max(1, sum(map(len, words)))
    signs = len(text) - letters - text.count(" ")
    capitals = int(CAPITALS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())
    shouted = len(SHOUTED.findall(text)) if capitals >= 3 else 0
    repeated = len(REPEATED.findall(text)) if any(c in text for c in DOUBLES) else 0
    return [
        n_known / n, min(n_known, 20), len(hits) / n, sum(weights) / n, max(weights, default=0.0), min(len({words[i] for i, _, _ in hits}), 20), near / n, len(persons) / n,
        capitals / letters, shouted / n, text.count("!") / n, max(0, signs) / letters, repeated / n,
        len(disguised) / n, sum(u in of.known or "=" + u in of.lexicon for u in unmasked), math.log1p(len(words)),
    ]


def with_features(df: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """`df`'s other columns with `features`, a vector, in place of `text`."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    others = [c for c in df.columns if c != "text"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def measure(batches):
        of = Words(shared.value)
        for batch in batches:
            rows = [features(t.as_py() or "", of) for t in batch.column(batch.num_columns - 1)]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(FEATURES) * (len(rows) + 1), len(FEATURES), dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*others, "x"])

    measured = df.select(*others, "text").mapInArrow(measure, f"{schema}, x array<double>")
    return measured.withColumn("features", array_to_vector("x")).drop("x")


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learning from the folds 1 to 4 of 5."""
    learnable = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = bounded_sample(materialize(learnable), "doc_id", train_rows, seed=5)
    # The sample's size is bounded, so it may go to every executor; its texts are read once.
    labelled = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("part", fold(F.col("doc_id"), 5)))
    lexicon = learn_lexicon(labelled.where("part <= 2"))
    train = materialize(with_features(labelled.where("part >= 3").select("part", F.col("toxic").cast("double").alias("label"), "text"), lexicon)).coalesce(4)
    counts = {(r.part, r.label): r.n for r in train.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    if not (counts.get((3, 0.0)) and counts.get((3, 1.0))):
        share = labelled.agg(F.avg("toxic")).first()[0] or 0.0
        scored = every.withColumn("score", F.lit(float(share)))
    else:
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=2, seed=7).fit(train.where("part = 3"))
        p_toxic = vector_to_array("probability")[1]
        scored = trees.transform(stored(with_features(every, lexicon))).withColumn("score", p_toxic)
        if counts.get((4, 0.0)) and counts.get((4, 1.0)):
            known = trees.transform(train.where("part = 4")).withColumn("p", p_toxic)
            calibrated = IsotonicRegression(featuresCol="p", labelCol="label").fit(known.select("p", "label"))
            scored = calibrated.setFeaturesCol("score").setPredictionCol("calibrated").transform(scored.select("doc_id", "held_out", "score"))
            scored = scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows predicted toxic; rows without a doc_id are kept."""
    toxic = score(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(*docs.columns)
