"""Regular-expression matches with their places, by built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pseudonyms import let

#: Put around matches; a text's own ones are replaced by a character of the same length that no pattern here matches.
MARK, OTHER = "\x01", "\x02"
#: Values of a block of a running total; blocks of blocks so many levels deep.
BLOCK, LEVELS = 64, 3


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at its matches, leftmost and non-overlapping: every second piece, from the second on, is one."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return F.split(marked, MARK, -1)


def running(values: Column, combine: Callable[[Column, Column], Column], start: Column, levels: int = LEVELS) -> Column:
    """What `combine` makes of `start` and all values up to each one; null for null.

    Appending to an array copies it, so values go in blocks of `BLOCK`, whose totals are run first in the same way: the
    work is in proportion to the values up to BLOCK ** (levels + 1) of them and small for any array that fits a row.
    """

    def append(values: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, v: let(combine(acc["at"], v), lambda at: F.struct(at.alias("at"), F.array_append(acc["all"], at).alias("all")))
        return F.aggregate(values, empty, step, lambda acc: acc["all"])

    if not levels:
        return append(values, start)

    def in_blocks(values: Column) -> Column:
        starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK))).when(values.isNotNull(), F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(values, s + 1, BLOCK))

    def run(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(F.slice(b, 2, BLOCK), b[0], lambda x, y: combine(x, y)))
        before = lambda ends, k: F.coalesce(F.get(ends, k - 1), start)
        return let(running(totals, combine, start, levels - 1), lambda ends: F.flatten(F.transform(blocks, lambda b, k: append(b, before(ends, k)))))

    return let(let(values, in_blocks), run)


def matches(text: Column, pattern: str, prefilter: str | None = None) -> Column:
    """array<struct<start, end, match, before>> in code points, end exclusive; `before` is the text since the last match."""
    kind = "array<struct<start:int,end:int,match:string,before:string>>"

    def placed(cut: Column) -> Column:
        numbers = F.when(F.size(cut) > 1, F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        one = lambda ends, i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.get(cut, i).alias("match"), F.get(cut, i - 1).alias("before"))
        ends = running(F.transform(cut, F.length), lambda a, b: a + b, F.lit(0))
        return let(ends, lambda ends: F.transform(numbers, lambda i: one(ends, i)))

    return F.when(text.rlike(prefilter or pattern), let(pieces(text, pattern), placed)).otherwise(F.array().cast(kind))


def last_at_most(rows: Column, value: Callable[[Column], Column], limit: Column) -> Column:
    """Place, from 0, of the last of the sorted rows whose value is at most the limit; -1 if none. By halving."""
    powers = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    step = lambda at, p: F.when((at + p < F.size(rows)) & (value(F.get(rows, at + p)) <= limit), at + p).otherwise(at)
    return F.aggregate(powers, F.lit(-1), step)
