"""Runs: maximal stretches of words that repeat with a period, by longest common extensions in suffix trees.

Per text, words become numbers. A run of length >= max(24, 3 * period) holds no window of eight words that does not come
again within the run, at a distance of its period; so runs lie in stretches of such windows, and only these stretches are
searched, each as a whole. There Ukkonen's algorithm builds the suffix trees of the stretch and of its reversal; an Euler
tour with range minima answers longest common extensions of pairs of places in constant time, many at once. The longest
Lyndon words starting at every place, in both orders of the alphabet, are the candidate roots: every run has one of them
as its Lyndon root. Each candidate is extended in both directions and kept if it is long enough.

All work is within a row, so nothing is shuffled; a task holds one text's stretch and its tree at a time (some 400 bytes a
word of the stretch).

Defined results: null and empty texts have no runs and collapse to the empty string. Repeated rows are searched alike, a
null doc_id too. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .pseudonyms import let

LEAST_LENGTH, LEAST_EXPONENT, WINDOW = 24, 3, 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
    """Edge starts and ends by node, and children by node * base + symbol. `s` ends with a symbol of its own."""
    n, base = len(s), max(s) + 1
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            key = node * base + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i), end.append(n), link.append(0)
                if last:
                    link[last] = node
                last = node
            else:
                size = (end[below] if end[below] <= i else i + 1) - start[below]
                if length >= size:
                    node, length, edge = below, length - size, edge + size
                    continue
                if s[start[below] + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(start)
                start.append(start[below]), end.append(start[below] + length), link.append(0)
                start.append(i), end.append(n), link.append(0)
                child[key] = middle
                child[middle * base + c] = middle + 1
                start[below] += length
                child[middle * base + s[start[below]]] = below
                if last:
                    link[last] = middle
                last = middle
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return start, end, child, base


class Extensions:
    """Longest common prefixes of suffixes of `s`, and the order of its suffixes."""

    BLOCK = 16

    def __init__(self, s: list[int], both_orders: bool = False):
        #: 0 ends the sequence and comes before all other symbols in either order.
        s = [x + 1 for x in s] + [0]
        self.n = len(s)
        start, end, child, base = suffix_tree(s)
        keys = np.fromiter(child, np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        del child
        size = np.array(end) - np.array(start)
        parent, symbol = keys // base, keys % base
        self.ranks = []
        for symbols in (symbol, np.where(symbol == 0, 0, base - symbol))[: 1 + both_orders]:
            order = np.lexsort((-symbols, parent))
            tour, suffixes, first = self._tour(parent[order], nodes[order], size, len(start))
            rank = np.empty(self.n, np.int64)
            rank[suffixes] = np.arange(self.n)
            self.ranks.append(rank)
            if len(self.ranks) == 1:
                self.first = np.empty(self.n, np.int64)
                self.first[suffixes] = first
                self._minima(np.array(tour, np.int32))

    def _tour(self, parent, nodes, size, n_nodes):
        """String depths in Euler order: at every leaf, and at a branching node between two of its children."""
        begin = np.searchsorted(parent, np.arange(n_nodes + 1)).tolist()
        nodes, size = nodes.tolist(), size.tolist()
        depth = [0] * n_nodes
        tour, suffixes, first, stack, n = [], [], [], [0], self.n
        while stack:
            x = stack.pop()
            if x < 0:
                tour.append(~x)
                continue
            d, lo, hi = depth[x], begin[x], begin[x + 1]
            if lo == hi:
                suffixes.append(n - d)
                first.append(len(tour))
                tour.append(d)
                continue
            for k in range(lo, hi):  # the last one pushed comes first
                if k > lo:
                    stack.append(~d)
                c = nodes[k]
                depth[c] = d + size[c]
                stack.append(c)
        return tour, suffixes, first

    def _minima(self, tour: np.ndarray) -> None:
        b = self.BLOCK
        blocks = np.full((-(-len(tour) // b), b), np.iinfo(np.int32).max, np.int32)
        blocks.reshape(-1)[: len(tour)] = tour
        self.tour = blocks.reshape(-1)
        self.up_to = np.minimum.accumulate(blocks, 1).reshape(-1)
        self.from_ = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
        self.table = [blocks.min(1)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at a and b, pair by pair; a <> b."""
        x, y = self.first[a], self.first[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        left, right = lo // self.BLOCK, hi // self.BLOCK
        least = np.minimum(self.from_[lo], self.up_to[hi])
        inside = left == right
        for k in range(self.BLOCK if inside.any() else 0):
            at = np.minimum(lo[inside] + k, hi[inside])
            least[inside] = np.minimum(self.tour[at], least[inside]) if k else self.tour[at]
        between = np.flatnonzero(right - left > 1)
        if len(between):
            l, count = left[between] + 1, right[between] - left[between] - 1
            level = np.frexp(count)[1] - 1
            for k in np.unique(level):
                at = level == k
                t, i = self.table[k], between[at]
                least[i] = np.minimum(least[i], np.minimum(t[l[at]], t[l[at] + count[at] - (1 << int(k))]))
        return least.astype(np.int64)


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word starting at each place: the next place whose suffix comes earlier in the order."""
    rank = rank.tolist()
    ends, stack = [0] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        ends[i] = stack[-1] if stack else len(rank)
        stack.append(i)
    return np.array(ends, np.int64)


def all_runs(s: list[int]) -> np.ndarray:
    """start, length, period of every run of at least two periods, one row each, by start, then period."""
    n = len(s)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead = Extensions(s, both_orders=True)
    # The end symbol has the earliest suffix of all, so every word ends there at the latest.
    ends = [lyndon_ends(rank)[:n] for rank in ahead.ranks]
    i, j = np.tile(np.arange(n), 2), np.concatenate(ends)
    right = ahead(i, j)
    del ahead
    back, left = Extensions(s[::-1]), np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = back(n - i[inner], n - j[inner])
    period = j - i
    length = period + left + right
    keep = length >= 2 * period
    found = np.unique(np.stack([i - left, period, length], 1)[keep], axis=0)
    return found[:, [0, 2, 1]]


def stretches(keys: np.ndarray) -> list[tuple[int, int]]:
    """Places between which runs can lie: equal words have equal keys."""
    n = len(keys)
    if n < LEAST_LENGTH:
        return []
    h = keys.astype(np.uint64)
    for half, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = (h[:-half] ^ (h[:-half] >> np.uint64(29))) * np.uint64(factor) + h[half:]
    order = np.argsort(h, kind="stable")
    far = np.iinfo(np.int64).max
    step = np.where(h[order[1:]] == h[order[:-1]], np.diff(order), far)
    gap = np.full(len(h), far)
    gap[order[1:]] = step
    gap[order[:-1]] = np.minimum(gap[order[:-1]], step)
    out, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        near = gap[lo : hi - WINDOW + 1] <= (hi - lo) // LEAST_EXPONENT
        edges = np.flatnonzero(np.diff(np.r_[0, near, 0]))
        parts = [(lo + a, lo + b + WINDOW - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b + WINDOW - 1 - a >= LEAST_LENGTH]
        # What is shorter than before asks for nearer repeats.
        (out if parts == [(lo, hi)] else todo).extend(parts)
    return sorted(out)


def find_runs(words: list) -> np.ndarray:
    """start, length, period of every run of at least max(24, 3 * period) words, by start, then period."""
    found = []
    for lo, hi in stretches(np.fromiter(map(hash, words), np.int64, len(words))):
        number: dict = {}
        runs = all_runs([number.setdefault(w, len(number)) for w in words[lo:hi]])
        runs = runs[runs[:, 1] >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * runs[:, 2])]
        found.append(runs + np.array([lo, 0, 0]))
    # Stretches may overlap, but no run lies in two.
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list, runs: np.ndarray) -> list:
    """The words without those beyond the first period of a run."""
    if not len(runs):
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs and collapsed: the words of each text that no run repeats, joined by spaces."""

    def search(batches):
        for batch in batches:
            runs, kept = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                found = find_runs(words)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                kept.append(b" ".join(collapse(words, found)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {key}, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document by crc32 of its id the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w)), " ")

    text = F.when((h % 10 == 0) & F.col("text").rlike(WORD), let(F.regexp_extract_all("text", F.lit(WORD), 0), planted)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document of `docs` with planted runs: their number, the one of greatest exponent, and digests."""
    found = collapse_runs(with_planted_runs(docs))
    # Greater length / period first, compared without division; ties keep the earlier start, then period.
    better = lambda a, b: a["length"] * b["period"] < b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
