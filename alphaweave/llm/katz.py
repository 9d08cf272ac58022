"""Katz backoff language model: Good-Turing discounted bigram and unigram counts with exact backoff weights.

    P(w | h) = d(c(h w)) c(h w) / c(h)                 if h w was seen
             = a(h) P(w)                               else;  a(h) = (1 - sum of the first line) / (1 - sum of P over seen w)
    P(w)     = d(c(w)) c(w) / N  if w was seen,  else what those leave: the share of all unknown words together

Texts are held as chunks of up to `CHUNK_TOKENS` tokens: their words' hashes, once each, and the token sequence in those
words' ranks. A chunk asks the count tables for each word, and each bigram, that it holds: once, however often that
occurs in it, so a very common one costs as many rows as there are chunks. Tables are dealt into buckets by hash of the
word or, for bigrams, of the context; a context seen more than `SPLIT_CONTEXT` times is spread over several buckets by
its followers. A bucket sums the counts of all chunks, keeps them as its part of the stored table, and answers each chunk
in the order asked. Bigrams go in `ROUNDS` rounds, each a share of the buckets, so that only that share is on disk as
shuffle files at once. Last, each chunk evaluates its tokens with the answers, in as many rounds of chunks.

Words are compared by 64-bit hashes. The model is of order two: a third order would double what is shuffled and stored.

Defined results: null texts are empty, and an empty text is its end token. Rows without a doc_id are scored, not learned
from. Discounts that counts of counts do not give (none of a count, or outside 0 to 1) are (r - 1/2) / r. Where nothing
would be left for unseen words, the seen ones give up one part in c(h) + 1. With nothing to learn from every word is
unknown, with probability 1. Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, settings, stored

CHUNK_TOKENS = 1 << 20
BATCH_BYTES = 4 << 20
#: Entries that a bucket gets on average.
BUCKET_ENTRIES = 1 << 19
SPLIT_CONTEXT = 1 << 18
ROUNDS = 3
#: Counts above are not discounted.
K = 5
END, START = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind) if b else np.zeros(0, kind)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk; see the module's text. Counts and tokens are compressed, hashes are not compressible."""
    names = ["chunk", "doc_ids", "held", "sizes", "vocab", "counts", "tokens", "n_vocab", "n_tokens"]

    def cut(batches):
        import xxhash

        part, seq = TaskContext.get().partitionId(), 0
        ids, held, sizes, hashes, held_runs, n = [], [], [], [], [], 0

        def emit():
            nonlocal seq, ids, held, sizes, hashes, n
            words = np.concatenate(hashes)
            vocab, tokens = np.unique(words, return_inverse=True)
            learn = np.repeat(np.array([h is False for h in held]), sizes)
            counts = np.bincount(tokens[learn], minlength=len(vocab)).astype(np.uint32)
            row = [(part << 32) + seq, ids, held, sizes, vocab.tobytes(), packed(counts), packed(tokens.astype(np.uint32)), len(vocab), len(tokens)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            seq += 1
            ids, held, sizes, hashes, n = [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for key, is_held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or "").encode().lower().split()
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                h[-1] = END
                ids.append(key)
                held.append(is_held)
                sizes.append(len(h))
                hashes.append(h)
                n += len(h)
                if n >= CHUNK_TOKENS:
                    yield emit()
        if ids:
            yield emit()

    rows = docs.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held"), "text")
    return rows.mapInArrow(cut, "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, vocab binary, counts binary, tokens binary, n_vocab long, n_tokens long")


def _runs(bucket: np.ndarray):
    """(bucket, start, end) of the runs of a sorted array."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[starts].tolist(), starts.tolist(), np.r_[starts[1:], len(bucket)].tolist())


def word_bucket(vocab: np.ndarray, n: int) -> np.ndarray:
    """Rising with the hash, so that the buckets' answers in order are in the order of the words."""
    return ((vocab >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


def unigrams(held_chunks: DataFrame, buckets: int) -> DataFrame:
    """Answers (chunk >= 0) and the table's parts (chunk -1, with words) of every bucket, with its counts of counts."""

    def ask(batches):
        for batch in batches:
            for chunk, vocab, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                vocab, counts = np.frombuffer(vocab, np.uint64), unpacked(counts, np.uint32)
                rows = [(b, chunk, vocab[s:e].tobytes(), packed(counts[s:e])) for b, s, e in _runs(word_bucket(vocab, buckets))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "words", "counts"])

    def total(table: pa.Table) -> pa.Table:
        bucket, chunk = table["bucket"][0].as_py(), table["chunk"].to_pylist()
        words = [np.frombuffer(w, np.uint64) for w in table["words"].to_pylist()]
        all_words, at = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(at, np.concatenate([unpacked(c, np.uint32) for c in table["counts"].to_pylist()]), len(all_words)).astype(np.uint64)
        ends = np.cumsum([len(w) for w in words])
        answers = [packed(sums[x]) for x in np.split(at, ends[:-1])]
        of = [int((sums == r).sum()) for r in range(1, K + 2)]
        n = len(chunk)
        return pa.table({
            "bucket": pa.array([bucket] * (n + 1), pa.int64()), "chunk": pa.array([*chunk, -1], pa.int64()),
            "words": pa.array([None] * n + [all_words.tobytes()], pa.binary()), "counts": pa.array([*answers, packed(sums)], pa.binary()),
            "n": pa.array([0] * n + [int(sums.sum())], pa.int64()), "v": pa.array([0] * n + [int((sums > 0).sum())], pa.int64()),
            "of": pa.array([[0] * (K + 1)] * n + [of], pa.list_(pa.int64())),
        })

    asked = held_chunks.select("chunk", "vocab", "counts").mapInArrow(ask, "bucket long, chunk long, words binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(total, "bucket long, chunk long, words binary, counts binary, n long, v long, of array<long>")


def totals(table: DataFrame) -> tuple[int, int, list[int]]:
    """Tokens, distinct ones, and how many have the counts 1 to K + 1."""
    row = table.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), *[F.sum(F.col("of")[r]).alias(f"of{r}") for r in range(K + 1)]).first()
    return row.n or 0, row.v or 0, [row[f"of{r}"] or 0 for r in range(K + 1)]


def discounts(of: list[int]) -> np.ndarray:
    """Katz's d(0) to d(K): 1 beyond."""
    d = np.ones(K + 1)
    cut = (K + 1) * of[K] / of[0] if of[0] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * of[r] / (r * of[r - 1]) if of[r - 1] else 0.0
        d[r] = (star - cut) / (1 - cut) if cut < 1 else 0.0
        if not 0 < d[r] <= 1:
            d[r] = (r - 0.5) / r
    return d


class Unigram:
    """P(w) by count; count 0 is all unknown words together."""

    def __init__(self, n: int, v: int, of: list[int]):
        self.n, self.v, self.d = n, v, discounts(of)
        seen = n - sum((1 - self.d[r]) * r * of[r - 1] for r in range(1, K + 1))
        self.scale = n / (n + 1) if n and seen >= n * (1 - 1e-12) else 1.0
        self.unknown = 1 - self.scale * seen / n if n else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= K, self.d[np.minimum(c, K).astype(np.int64)], 1.0)
        return np.where(c > 0, self.scale * d * c / max(1, self.n), self.unknown)


class Bigrams:
    """The bigrams of a chunk that the table can know, in the order they are asked in."""

    def __init__(self, vocab: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, word_counts: np.ndarray, end_count: int, buckets: int):
        n = len(vocab)
        ends = np.cumsum(sizes)
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[ends - sizes] = n  # the start of a text
        code, self.at = np.unique(before * (n + 1) + tokens, return_inverse=True)
        self.context, self.word = code // (n + 1), code % (n + 1)
        self.hash = np.r_[vocab, START]
        # A text starts as often as one ends.
        self.context_count = np.r_[word_counts, end_count]
        known = (self.context_count[self.context] > 0) & (word_counts[self.word] > 0)
        parts = -(-self.context_count // SPLIT_CONTEXT)
        own = mixed(self.hash[self.context] ^ START)
        part = mixed(self.hash[self.word]) % np.maximum(1, parts[self.context]).astype(np.uint64)
        bucket = mixed(own + part * MIX) % np.uint64(buckets)
        # A context is asked for without a word where its sums would not come else: in all buckets of a split one, and if
        # only unknown words follow it here.
        seen_context = np.unique(self.context[self.context_count[self.context] > 0])
        bare = np.union1d(seen_context[parts[seen_context] > 1], np.setdiff1d(seen_context, self.context[known]))
        of_bare = np.repeat(bare, parts[bare])
        nth = (np.arange(len(of_bare)) - np.repeat(np.cumsum(parts[bare]) - parts[bare], parts[bare])).astype(np.uint64)
        bare_bucket = mixed(mixed(self.hash[of_bare] ^ START) + nth * MIX) % np.uint64(buckets)
        pick = np.flatnonzero(known)
        context = np.concatenate([self.context[pick], of_bare]).astype(np.int64)
        word = np.concatenate([self.word[pick], np.full(len(context) - len(pick), -1)])
        bucket = np.concatenate([bucket[pick], bare_bucket])
        code_at = np.concatenate([pick, np.full(len(context) - len(pick), -1)])
        order = np.lexsort((word, context, bucket))
        self.asked_context, self.asked_word, self.asked_bucket, self.asked_code = context[order], word[order], bucket[order].astype(np.int64), code_at[order]


def _one_by_one(batch: pa.RecordBatch):
    """Rows as dicts, one chunk in memory at a time."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _unpack_chunk(row: dict):
    vocab, tokens = np.frombuffer(row["vocab"], np.uint64), unpacked(row["tokens"], np.uint32).astype(np.int64)
    sizes = np.array(row["sizes"], np.int64)
    answers = [unpacked(x["counts"], np.uint64) for x in sorted(row["answers"], key=lambda x: x["bucket"])]
    counts = np.concatenate(answers).astype(np.int64) if answers else np.zeros(0, np.int64)
    return vocab, tokens, sizes, counts


def bigrams(joined: DataFrame, buckets: int, turn: int, rounds: int, end_count: int, unigram: Unigram) -> DataFrame:
    """Answers and table parts of the buckets of one round; a context's answer is what its weight needs."""

    def ask(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                vocab, tokens, sizes, counts = _unpack_chunk(row)
                b = Bigrams(vocab, tokens, sizes, counts, end_count, buckets)
                learn = np.repeat(np.array([h is False for h in row["held"]]), sizes)
                times = np.bincount(b.at[learn], minlength=len(b.context))
                for bucket, s, e in _runs(b.asked_bucket):
                    if bucket % rounds != turn:
                        continue
                    context, word, code = b.asked_context[s:e], b.asked_word[s:e], b.asked_code[s:e]
                    starts = np.array([x for _, x, _ in _runs(context)])
                    real = word >= 0
                    out = [
                        bucket, row["chunk"], b.hash[context[starts]].tobytes(), packed(np.add.reduceat(real.astype(np.int64), starts).astype(np.uint32)),
                        b.hash[word[real]].tobytes(), packed(times[code[real]].astype(np.uint32)), packed(counts[word[real]].astype(np.uint64)),
                    ]
                    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], ["bucket", "chunk", "contexts", "sizes", "words", "times", "counts"])

    def total(table: pa.Table) -> pa.Table:
        p = unigram
        bucket, chunk = table["bucket"][0].as_py(), table["chunk"].to_pylist()
        contexts = [np.frombuffer(x, np.uint64) for x in table["contexts"].to_pylist()]
        sizes = [unpacked(x, np.uint32) for x in table["sizes"].to_pylist()]
        words = np.concatenate([np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()])
        times = np.concatenate([unpacked(x, np.uint32) for x in table["times"].to_pylist()])
        word_count = np.concatenate([unpacked(x, np.uint64) for x in table["counts"].to_pylist()])
        own, context_at = np.unique(np.concatenate(contexts), return_inverse=True)
        of_entry = np.repeat(context_at, np.concatenate(sizes))
        entry, first, at = np.unique(mixed(own[of_entry]) + words, return_index=True, return_inverse=True)
        sums = np.bincount(at, times, len(entry)).astype(np.int64)
        context = of_entry[first]
        seen = sums > 0
        gather = lambda x: np.bincount(context[seen], x[seen] if x is not None else None, len(own))
        low = gather(p(word_count[first].astype(np.int64)))
        total_count, few = gather(sums), [gather((sums == r).astype(float)) for r in range(1, K + 1)]
        entry_ends, context_ends = np.cumsum([int(s.sum()) for s in sizes]), np.cumsum([len(c) for c in contexts])
        per_chunk = zip(np.split(at, entry_ends[:-1]), np.split(context_at, context_ends[:-1]))
        answers = [(packed(sums[a].astype(np.uint32)), packed(np.stack([total_count[c], *[f[c] for f in few]]).astype(np.uint32)), low[c].tobytes()) for a, c in per_chunk]
        del of_entry, times, word_count
        order = np.lexsort((words[first], context))
        order = order[seen[order]]
        n, of = len(chunk), [int((sums == r).sum()) for r in range(1, K + 2)]
        return pa.table({
            "bucket": pa.array([bucket] * (n + 1), pa.int64()), "chunk": pa.array([*chunk, -1], pa.int64()),
            "times": pa.array([*[a[0] for a in answers], packed(sums[order].astype(np.uint32))], pa.binary()),
            "contexts": pa.array([*[a[1] for a in answers], own.tobytes()], pa.binary()), "low": pa.array([*[a[2] for a in answers], None], pa.binary()),
            "sizes": pa.array([None] * n + [packed(gather(None).astype(np.uint32))], pa.binary()), "words": pa.array([None] * n + [words[first][order].tobytes()], pa.binary()),
            "n": pa.array([0] * n + [int(sums.sum())], pa.int64()), "v": pa.array([0] * n + [int(seen.sum())], pa.int64()),
            "of": pa.array([[0] * (K + 1)] * n + [of], pa.list_(pa.int64())),
        })

    asked = joined.mapInArrow(ask, "bucket long, chunk long, contexts binary, sizes binary, words binary, times binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(total, "bucket long, chunk long, times binary, contexts binary, low binary, sizes binary, words binary, n long, v long, of array<long>")


def evaluate(joined: DataFrame, buckets: int, end_count: int, unigram: Unigram, d: np.ndarray) -> DataFrame:
    """One row per document from its chunk with the words' answers and the bigrams' answers."""

    def score(batches):
        p = unigram
        for batch in batches:
            for row in _one_by_one(batch):
                vocab, tokens, sizes, counts = _unpack_chunk(row)
                b = Bigrams(vocab, tokens, sizes, counts, end_count, buckets)
                asked = sorted(row["replies"] or [], key=lambda x: x["bucket"])
                n_context = len(b.hash)
                total, few, low = np.zeros(n_context), np.zeros((K, n_context)), np.zeros(n_context)
                times = np.zeros(len(b.context), np.int64)
                for (_, s, e), reply in zip(_runs(b.asked_bucket), asked, strict=True):
                    context, code = b.asked_context[s:e], b.asked_code[s:e]
                    each = context[[x for _, x, _ in _runs(context)]]
                    sums = unpacked(reply["contexts"], np.uint32).reshape(K + 1, -1)
                    total[each] += sums[0]
                    few[:, each] += sums[1:]
                    low[each] += np.frombuffer(reply["low"], np.float64)
                    times[code[code >= 0]] = unpacked(reply["times"], np.uint32)
                given_up = sum((1 - d[r]) * r * few[r - 1] for r in range(1, K + 1))
                scale = np.where(given_up > 1e-9 * np.maximum(1, total), 1.0, total / (total + 1))
                left = 1 - scale * (total - given_up) / np.maximum(1, total)
                weight = np.where(total > 0, left / np.maximum(1e-300, 1 - low), 1.0)
                dc = np.where(times <= K, d[np.minimum(times, K)], 1.0)
                context = b.context
                seen = scale[context] * dc * times / np.maximum(1, total[context])
                log = np.log10(np.where(times > 0, seen, weight[context] * p(counts[b.word])))
                ends = np.cumsum(sizes)
                per_doc = lambda x: np.add.reduceat(x, ends - sizes)
                base = np.log10((counts + 0.1) / (p.n + 0.1 * (p.v + 1)))
                out = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(per_doc((counts[tokens] > 0).astype(np.int64))),
                    pa.array(np.full(len(sizes), p.n, np.int64)), pa.array(per_doc(base[tokens])), pa.array(per_doc(log[b.at])),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _with_answers(chunked: DataFrame, table: DataFrame, name: str, *columns: str) -> DataFrame:
    """Each chunk with the array of its answers; both are dealt by chunk."""
    answers = table.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", *columns)).alias(name))
    return chunked.join(answers.hint("shuffle_merge"), "chunk", "left")


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Score every text by the model of the folds 1 to 9 of 10."""
    chunked = stored(chunks(docs))
    # From here a row is a chunk of many megabytes: one at a time goes to Python.
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        return _score(docs, chunked, rounds)


def _score(docs: DataFrame, chunked: DataFrame, rounds: int) -> DataFrame:
    size = chunked.agg(F.sum("n_vocab").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    words = stored(unigrams(chunked, max(1, (size.words or 0) // BUCKET_ENTRIES)))
    n, v, of = totals(words)
    unigram = Unigram(n, v, of)
    end_count = docs.where(fold(F.col("doc_id"), 10) != 0).count()
    buckets = max(rounds, (size.tokens or 0) // BUCKET_ENTRIES)
    known = stored(_with_answers(chunked.drop("counts", "n_vocab", "n_tokens"), words, "answers", "counts"))
    discard(chunked)
    table = reduce(DataFrame.unionByName, [stored(bigrams(known.drop("doc_ids"), buckets, turn, rounds, end_count, unigram)) for turn in range(rounds)])
    _, _, of_bigrams = totals(table)
    share = lambda df, turn: df.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == turn)
    scored = [stored(evaluate(_with_answers(share(known, turn), share(table, turn), "replies", "times", "contexts", "low"), buckets, end_count, unigram, discounts(of_bigrams))) for turn in range(rounds)]
    return reduce(DataFrame.unionByName, scored)
