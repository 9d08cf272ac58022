"""Language identification by multinomial naive Bayes over hashed character n-grams.

Each text becomes the counts of its character 1- to `MAX_N`-grams in a fixed number of hash buckets, letters in lower
case and everything else as one word boundary. Training sums those counts per language in Spark; what reaches the
driver is languages x buckets numbers however large the corpus is. The log-probability matrix is broadcast and each
text is scored by one product of its few non-zero counts with the matrix.

Defined results: a null text or one without a letter is `und` with score 0; so is every text when nothing could be
learned. Repeated rows give repeated equal rows. Equal posteriors go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold

MAX_N = 3
BITS = 15
#: Code points hashed at once; a longer text is taken in overlapping pieces.
PIECE = 1 << 20
#: Bound of the training sample, in rows; the counts of these whole texts make the model.
TRAIN_ROWS = 20_000
#: Languages x 2**BITS doubles are broadcast, so 256 languages are 64 MB.
MAX_LANGUAGES = 256

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str | None, table: np.ndarray) -> np.ndarray | None:
    """Counts of the text's n-grams per bucket; None if it has no letter."""
    if not text:
        return None
    total = None
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[max(0, at - MAX_N) : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = table[codes]
        if not is_letter.any():
            continue
        kept = np.full(len(codes) + 2, 32, np.uint64)
        np.copyto(kept[1:-1], codes, where=is_letter)
        keep = np.ones(len(kept), bool)
        np.logical_or(is_letter[1:], is_letter[:-1], out=keep[2:-1])
        kept = kept[keep]
        h, grams = kept, []
        for n in range(1, MAX_N + 1):
            if n > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + kept[n - 1 :]
            grams.append(((h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
        counts = np.bincount(np.concatenate(grams).view(np.int64), minlength=1 << BITS)
        total = counts if total is None else total + counts
    return total


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5):
    """(languages, log-probability matrix buckets x languages, log priors) from the rows given."""

    def partial(batches):
        table, sums, docs = letters(), {}, {}
        for batch in batches:
            for t, k in zip(batch.column(0), batch.column(1)):
                counts = gram_counts(t.as_py(), table)
                if counts is not None:
                    k = k.as_py()
                    sums[k] = sums[k] + counts if k in sums else counts
                    docs[k] = docs.get(k, 0) + 1
        for k, counts in sums.items():
            used = np.flatnonzero(counts)
            bucket = np.r_[used, -1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(bucket)), pa.array(bucket), pa.array(np.r_[counts[used], docs[k]])], ["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("k"))
    per_bucket = rows.mapInArrow(partial, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = per_bucket.toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the matrix is bounded to {MAX_LANGUAGES}")
    counts, docs = np.zeros((1 << BITS, max(1, len(names)))), np.ones(max(1, len(names)))
    column = np.searchsorted(names, found["lang"].to_numpy(zero_copy_only=False)) if names else np.zeros(0, int)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    docs[column[bucket < 0]] = n[bucket < 0]
    smooth = counts + alpha
    return names, np.log(smooth / smooth.sum(axis=0)), np.log(docs / docs.sum())


def predict(df: DataFrame, model, text: str = "text") -> DataFrame:
    """`df`'s other columns with lang_pred and score, the posterior of the predicted language."""
    names, matrix, prior = model
    shared = df.sparkSession.sparkContext.broadcast((names, matrix, prior))
    others = [c for c in df.columns if c != text and c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def score(batches):
        names, matrix, prior = shared.value
        table = letters()
        for batch in batches:
            pred, posterior = [], []
            for t in batch.column(batch.num_columns - 1):
                counts = gram_counts(t.as_py(), table) if names else None
                if counts is None:
                    pred.append("und")
                    posterior.append(0.0)
                    continue
                used = np.flatnonzero(counts)
                log = counts[used].astype(np.float64) @ matrix[used] + prior
                best = int(log.argmax())
                pred.append(names[best])
                posterior.append(float(1 / np.exp(log - log[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(posterior, pa.float64())], [*others, "lang_pred", "score"])

    return df.select(*others, F.col(text)).mapInArrow(score, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Predict every document's language, learning from the folds 1 to 4 of 5."""
    split = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    labelled = split.where(~F.coalesce("held_out", F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = train(bounded_sample(labelled, "doc_id", train_rows, seed=1))
    return predict(split.select("doc_id", "held_out", "text"), model)
