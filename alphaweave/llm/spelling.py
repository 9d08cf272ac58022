"""Spelling variants: words one edit apart, by a trie over letter-group counts.

Letters fall into `GROUPS` groups; a word's vector counts its letters by group. One inserted, deleted or replaced letter
changes the vector by a surplus of at most one and a deficit of at most one. A trie arranges the words by their successive
counts; a depth-first search walks it with a budget of one surplus and one deficit, and the words at the leaves it reaches
are verified.

The trie is dealt to tasks by subtries of at most `SUBTRIE` words: counts by prefix tell where it is cut. A word asks in
the subtries whose prefix it can reach, of two words the one with the smaller prefix; the askers of a subtrie come in
chunks of bounded size. A leaf that is still too large is joined on its words with one letter taken out: at most one word per
letter of the alphabet shares such a rest at a place.

Defined results: an empty table gives no rows; null words are left out, repeated ones count once with their greatest n; a
word without near words stands alone. Words of any length are taken whole.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored

GROUPS, SUBTRIE = 12, 40_000
#: Counts above this look alike to the trie; verification tells them apart.
MOST = 50_000
LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: A form has five times the occurrences of its word, and counts stay below 2**63 < 5**28: chains have less than 2**5 steps.
DOUBLINGS = 5


def vector(word: str) -> str:
    """The letter-group counts, one character each."""
    counts = [0] * GROUPS
    for c in word:
        counts[ord(c) % GROUPS] += 1
    return "".join(chr(33 + min(n, MOST)) for n in counts)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(b) == n + 1 else len(b) == n and i < n and a[i + 1 :] == b[i + 1 :]


def reachable(prefix: str) -> Iterator[str]:
    """Prefixes after `prefix` that at most one surplus and one deficit lead to."""
    places = range(len(prefix))
    for up in (None, *places):
        for down in (None, *places):
            if up == down:
                continue
            p = [ord(c) for c in prefix]
            if up is not None:
                p[up] += 1
            if down is not None:
                p[down] -= 1
            if min(p) >= 33:
                moved = "".join(map(chr, p))
                if moved > prefix:
                    yield moved


def rests(word: str) -> list[str]:
    """The word with each letter taken out."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class Leaf:
    """Words with one vector, found by either half: an edit leaves one half of a word as it is."""

    SCANNED = 8

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.half: int | None = None

    def near(self, word: str) -> list[tuple[str, int]]:
        if len(self.words) <= self.SCANNED:
            return [x for x in self.words if one_edit(word, x[0])]
        if self.half is None:
            # The other word may be shorter by one.
            self.half = (min(len(w) for w, _ in self.words) - 1) // 2
            self.heads, self.tails = {}, {}
            for x in self.words:
                self.heads.setdefault(x[0][: self.half], []).append(x)
                self.tails.setdefault(x[0][len(x[0]) - self.half :], []).append(x)
        head = word[: self.half]
        same_tail = self.tails.get(word[len(word) - self.half :], ())
        return [x for x in (*self.heads.get(head, ()), *(x for x in same_tail if x[0][: self.half] != head)) if one_edit(word, x[0])]


class Trie:
    def __init__(self, words: list[tuple[str, str, int]]):
        """From (vector, word, n)."""
        self.root: dict = {}
        for vec, word, n in words:
            node = self.root
            for c in vec[:-1]:
                node = node.setdefault(ord(c), {})
            node.setdefault(ord(vec[-1]), Leaf()).words.append((word, n))

    def leaves(self, vec: str) -> Iterator[Leaf]:
        """The leaves that a surplus of one and a deficit of one reach."""
        want = [ord(c) for c in vec]
        stack = [(self.root, 0, 1, 1)]
        while stack:
            node, depth, surplus, deficit = stack.pop()
            if depth == len(want):
                yield node
                continue
            for step in (-1, 0, 1):
                below = node.get(want[depth] + step)
                if below is not None and (step == 0 or (surplus if step > 0 else deficit)):
                    stack.append((below, depth + 1, surplus - (step > 0), deficit - (step < 0)))


def cut(vectors: DataFrame, most: int = SUBTRIE) -> DataFrame:
    """The prefixes at which the trie is cut: root, size."""
    prefixes = F.explode(F.transform(F.sequence(F.lit(0), F.lit(GROUPS)), lambda d: F.substring("vec", F.lit(1), d)))
    sizes = stored(vectors.select(prefixes.alias("root")).groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    large = sizes.where(F.col("size") > most).select(F.col("root").alias("parent"))
    parent = F.substring("root", F.lit(1), F.length("root") - 1)
    below = sizes.where("root <> ''").join(large, parent == F.col("parent"), "left_semi")
    top = sizes.where((F.col("root") == "") & (F.col("size") <= most))
    return stored(below.where((F.col("size") <= most) | (F.length("root") == GROUPS)).unionByName(top))


def near_words(words: DataFrame, most: int = SUBTRIE) -> DataFrame:
    """word, n, other, other_n: every pair of words (word, n) one edit apart, once."""

    @F.pandas_udf("string")
    def vec(word: pd.Series) -> pd.Series:
        return word.map(vector)

    vocabulary = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.max("n").alias("n")).withColumn("vec", vec("word")))
    roots = cut(vocabulary, most)
    depths = [r[0] for r in roots.select(F.length("root")).distinct().collect()]

    @F.pandas_udf("array<string>")
    def asked(vec: pd.Series) -> pd.Series:
        after = functools.lru_cache(50_000)(lambda prefix: list(reachable(prefix)))
        return vec.map(lambda v: [p for d in depths for p in after(v[:d])])

    own = F.array(*[F.substring("vec", F.lit(1), F.lit(d)) for d in depths]).cast("array<string>")
    known = small(roots.select("root", "size"))
    index = stored(vocabulary.withColumn("root", F.explode(own)).join(known, "root"))
    others = vocabulary.withColumn("root", F.explode(asked("vec"))).join(known, "root")
    askers = stored(index.withColumn("inside", F.lit(True)).unionByName(others.withColumn("inside", F.lit(False))))

    split = F.col("size") > most
    chunks = stored(askers.where(~split).groupBy("root").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("chunks")))
    asking = askers.where(~split).join(small(chunks), "root").withColumn("chunk", F.pmod(F.xxhash64("word"), "chunks").cast("int"))
    copies = index.where(~split).join(small(chunks), "root").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(list(zip(mine["vec"], mine["word"], mine["n"])))
        found = []
        for v, group in theirs.groupby("vec", sort=False):
            leaves = list(trie.leaves(v))
            for word, n, inside in zip(group["word"], group["n"], group["inside"]):
                # Within a subtrie both words ask.
                found += [(word, n, w, m) for leaf in leaves for w, m in leaf.near(word) if not inside or word < w]
        return pd.DataFrame(found, columns=["word", "n", "other", "other_n"])

    schema = "word string, n long, other string, other_n long"
    columns = ["root", "chunk", "vec", "word", "n"]
    pairs = copies.select(*columns).groupBy("root", "chunk").cogroup(asking.select(*columns, "inside").groupBy("root", "chunk")).applyInPandas(search, schema)
    if not roots.where(split).limit(1).count():
        return pairs
    return pairs.unionByName(_pairs_by_rest(index.where(split), askers.where(split)))


def _pairs_by_rest(index: DataFrame, askers: DataFrame) -> DataFrame:
    """Pairs of large leaves: a word's rest at a place, or as a whole, meets the other's."""

    def keys(inside: bool):
        @F.pandas_udf("array<string>")
        def of(word: pd.Series) -> pd.Series:
            whole, rest = ("=", "-") if inside else ("-", "=")
            return word.map(lambda w: [whole + w, *(k for i, r in enumerate(rests(w)) for k in (f"{i}:{r}", rest + r))])

        return F.explode(of("word"))

    theirs = index.select("root", F.col("word").alias("other"), F.col("n").alias("other_n"), keys(True).alias("key"))
    mine = askers.select("root", "word", "n", "inside", keys(False).alias("key"))
    met = mine.join(theirs, ["root", "key"]).where("word <> other AND (NOT inside OR word < other)")
    return met.select("word", "n", "other", "other_n").distinct()


def variants(words: DataFrame, factor: int = FORM_FACTOR, most: int = SUBTRIE) -> DataFrame:
    """word, n, form, form_n, n_near, root of every word of (word, n)."""
    words = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.max("n").alias("n")))
    pairs = stored(near_words(words, most))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    # The most frequent; of equally frequent ones the first by code points, which UTF-8 keeps in order.
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    has_form = -F.col("best.less") >= factor * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    )
    found = stored(found)
    steps = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            break
    return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def vocabulary(docs: DataFrame, one_in: int = 199) -> DataFrame:
    """word and n of `docs` (doc_id, text): letter runs, of which by crc32 of id and run one in `one_in` lacks a letter."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), 0)).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    runs = runs.where(F.length("run") >= LEAST_LETTERS).select("doc_id", lower.alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % one_in == 0, short).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)
