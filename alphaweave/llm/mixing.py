"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target decides how often its documents appear: `floor(target / size)` times each, and once more with the
fractional rest as inclusion probability. The rest is drawn by the cube method: the vector of probabilities moves along
the null space of the two constraints, total words and number of documents, until all but a few are 0 or 1. That flight
runs in blocks of `BLOCK` documents in parallel; each leaves at most three open documents, and the open ones of all
blocks meet in the next, much smaller round. The last few open documents of a source, `LANDING` at most, are decided
together by the outcome that comes nearest to the word total, then to the document total.

Everything random is a hash of the document id and a seed, so reruns agree whatever the partitions.

Defined results: null and empty texts have size 0. Null sources are one source, the last. Repeated rows are documents of
their own; equal ones are interchangeable. An empty table gives no rows. Columns other than doc_id, text and source are
not read, and `mix` drops them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaweave.session import materialize

from .common import WORD, small

BLOCK = 512
LANDING = 12
#: A document is taken this many times at most, and a target stops at this many times its source's size.
MOST = 3
WEIGHTS = 3


def words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each source.

    Sources in order of size allowed per weight: a source is capped if its allowance per weight is no more than what is
    left per weight for it and all after it. The capped ones are the first in this order, so two running sums settle
    the repeated resharing at once. The windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    ordered = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cap = F.lit(float(MOST)) * F.col("source_size")
    weighted = per_source.withColumn("weight", (F.row_number().over(ordered) - 1) % WEIGHTS + 1).withColumn("cap", cap)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighted.withColumn("level", level)
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    first_free = F.first(free, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least("cap", F.col("weight") * F.coalesce(first_free, "level"))
    return levels.select("source", "source_size", "source_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def fly(size: list[float], pi: list[float], draw: list[float], least: int = 3) -> list[float]:
    """Move `pi` along the null space of (size, 1) until no more than `least` entries are strictly between 0 and 1.

    Three open units at a time have a null vector of their own, the cross product of the constraint rows. `draw` picks
    the direction so that each unit's expectation is kept.
    """
    eps = 1e-9
    pi = list(pi)
    todo = [i for i, p in enumerate(pi) if eps < p < 1 - eps]
    open_, at, step = todo[: least + 1], least + 1, 0
    while len(open_) > least:
        a, b, c = open_[:3]
        v = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if v == (0, 0, 0):
            v = (1.0, -1.0, 0.0)
        up = min((1 - pi[i]) / x if x > 0 else -pi[i] / x for i, x in zip((a, b, c), v) if x)
        down = min(pi[i] / x if x > 0 else (pi[i] - 1) / x for i, x in zip((a, b, c), v) if x)
        move = up if draw[step % len(draw)] * (up + down) < down else -down
        step += 1
        for i, x in zip((a, b, c), v):
            pi[i] = min(1.0, max(0.0, pi[i] + move * x))
        done = [i for i in (a, b, c) if not eps < pi[i] < 1 - eps]
        for i in done:
            pi[i] = float(pi[i] > 0.5)
        open_ = [i for i in open_ if i not in done] if done else open_[1:] + open_[:1]
        fresh = todo[at : at + len(done)]
        at += len(done)
        open_ = fresh + open_
    return pi


def land(size: list[float], pi: list[float]) -> list[float]:
    """Decide the last open units together: the nearest word total, then the nearest count, then the smallest code."""
    open_ = [i for i, p in enumerate(pi) if 1e-9 < p < 1 - 1e-9]
    pi = [float(round(p)) if i not in open_ else p for i, p in enumerate(pi)]
    if open_:
        bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        s, p = np.array([size[i] for i in open_]), np.array([pi[i] for i in open_])
        off = np.abs(bits @ s - s @ p)
        best = np.lexsort((np.arange(len(bits)), np.abs(bits.sum(1) - p.sum()), np.round(off, 6)))[0]
        for i, b in zip(open_, bits[best]):
            pi[i] = float(b)
    return pi


def _round(df: DataFrame, seed: int, last: bool) -> DataFrame:
    """One flight over every block of every source; in the `last` round the open units land."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents fly first, so that short ones are left to meet the totals with.
        rows = rows.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable")
        size = rows["size"].astype(float).tolist()
        pi = fly(size, rows["pi"].tolist(), rows["draw"].tolist(), LANDING if last else 3)
        return rows.assign(pi=land(size, pi) if last else pi)

    drawn = df.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size") / F.lit(2.0**64) + 0.5)
    return drawn.groupBy("source", "block").applyInPandas(block, drawn.schema)


def sample(df: DataFrame, seed: int = 20) -> DataFrame:
    """`df` (doc_id, source, size, pi and others) with pi decided to 0 or 1, balanced within each source."""
    columns = df.columns
    decided, open_ = df.where(F.col("pi").isin(0.0, 1.0)), df.where(~F.col("pi").isin(0.0, 1.0))
    is_open = (F.col("pi") > 0) & (F.col("pi") < 1)
    for turn in range(60):
        counts = materialize(open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
        most, sources = counts.agg(F.max("n"), F.count(F.lit(1))).first()
        if most is None:
            break
        block = F.pmod(F.xxhash64(F.lit(seed + turn), "o.doc_id"), F.ceil(F.col("n") / BLOCK)).cast("int")
        dealt = open_.alias("o").join(small(counts, sources).alias("c"), F.col("o.source").eqNullSafe(F.col("c.source"))).select(*[f"o.{c}" for c in columns], block.alias("block"))
        # In the last round no source has more than one block.
        moved = materialize(_round(dealt, seed + 1000 + turn, most <= BLOCK).select(*columns))
        decided = decided.unionByName(moved.where(~is_open))
        if most <= BLOCK:
            break
        open_ = moved.where(is_open)
    return decided


def mix(docs: DataFrame, seed: int = 20) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    sized = materialize(docs.select("doc_id", "source", words().alias("size")))
    per_source = small(materialize(targets(sized)))
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    joined = sized.alias("d").join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", F.round(ratio, 9).alias("ratio"))
    whole = F.floor("ratio")
    drawn = sample(joined.select("doc_id", "source", "size", "source_size", "target", whole.alias("whole"), (F.col("ratio") - whole).alias("pi")), seed)
    copies = (F.col("whole") + F.col("pi")).cast("int")
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
