"""Exact quantiles and ranks per group in which no task ever holds a whole group.

A date's cross-section grows with the number of tickers, and some groups are the
whole table. There is one path for every size: quantiles select by histograms, ranks
number range-partitioned slices.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Most cells of a bucket whose values are listed without narrowing it first; the result is the same either way.
LISTED_CELLS = 1_000_000
#: Most rows of per-group targets, fixed in width, that go to every task; more of them meet the cells in a shuffle.
BROADCAST_ROWS = 500_000


def join_stats(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach one row per date; the calendar bounds its size, so it is broadcast."""
    return df.join(F.broadcast(stats), keys, how)


def value_bucket(v: str) -> Column:
    """A number per double, in its order: 1024 to an octave, with buckets of their own for zero, infinities and NaN (the last)."""
    size = F.floor(F.log2(F.abs(F.col(v))) * 1024) + (1 << 21)
    infinite = F.abs(F.col(v)) == F.lit(float("inf"))
    return (
        F.when(F.isnan(v), 1 << 31).when(infinite, F.signum(v).cast("long") * (1 << 30)).when(F.col(v) == 0, 0)
        .when(F.col(v) > 0, size).when(F.col(v) < 0, -size).cast("long")
    )


def group_quantiles(df: DataFrame, keys: list[str], cols: dict[str, Column], probs: Iterable[float], listed_cells: int = LISTED_CELLS) -> DataFrame:
    """Linear-interpolation quantiles of each column per group, all rows for no keys.

    Returns keys, `<name>__n` (non-null count) and `<name>__q` (array, one entry
    per probability; null when the group has no value).

    Selection by histograms, each a hash aggregation in the order of the values:
    the first, by octave parts, finds the bucket of every rank asked for; where
    such a bucket holds over `listed_cells`, one by 2**21 equal parts of the
    buckets' ranges narrows them; the last, by value, gives the value at each
    rank. A bucket spans less than 2**43 doubles and a part less than 2**23, so
    no list outgrows a task however many rows there are.
    """
    probs = [float(p) for p in probs]
    by = [*keys, "__i"]
    cells = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), c.cast("double").alias("__v")) for i, c in enumerate(cols.values())])))
    cells = cells.withColumn("__b", value_bucket("__v"))
    ranks = F.flatten(F.array(*[F.array(F.floor((F.col("__n") - 1) * p), F.least(F.floor((F.col("__n") - 1) * p) + 1, F.col("__n") - 1)) for p in probs]))

    # Cells without a value are in a bucket of none, so that every group appears.
    first = cells.groupBy(*by, "__b").agg(F.count("__v").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    group = Window.partitionBy(*by)
    first = first.withColumns({"__n": F.sum("__c").over(group), "__through": F.sum("__c").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))})
    before = F.col("__through") - F.col("__c")
    place = lambda r, j: F.struct(j.alias("__j"), *[F.col(c).alias(c) for c in ("__b", "__lo", "__hi", "__c")], (r - before).alias("__r"))
    hit = F.filter(F.transform(ranks, place), lambda x: (x["__r"] >= 0) & (x["__r"] < x["__c"]))
    asked = materialize(first.select(*by, "__n", hit.alias("hit")).groupBy(*by).agg(F.max("__n").alias("__n"), F.flatten(F.collect_list("hit")).alias("hits")))
    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.max(F.array_max(F.transform("hits", lambda x: x["__c"]))).alias("largest")).first()
    near = F.broadcast if size.rows * 2 * len(probs) <= BROADCAST_ROWS else lambda t: t
    wanted = asked.select(*by, F.inline("hits")).drop("__c")

    def held(rows: DataFrame, places: list[str]) -> DataFrame:
        return rows.join(near(wanted.select(*by, *places).distinct()), [*by, *(c for c in places if c in rows.columns)])

    def narrowed(rows: DataFrame, places: list[str], order: str) -> DataFrame:
        """The ranks asked for, within the entry of `order` that holds each."""
        counted = rows.groupBy(*by, *places, order).agg(F.count(F.lit(1)).alias("__c"))
        upto = Window.partitionBy(*by, *places).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("__before", F.sum("__c").over(upto) - F.col("__c"))
        found = counted.join(near(wanted.select(*by, *places, "__j", "__r")), [*by, *places]).where("__r >= __before AND __r < __before + __c")
        return found.select(*by, *places, order, "__j", (F.col("__r") - F.col("__before")).alias("__r"))

    rows, places = held(cells, ["__b", "__lo", "__hi"]), ["__b"]
    if (size.largest or 0) > listed_cells:
        part = F.when(F.col("__lo") == F.col("__hi"), 0).otherwise(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (1 << 21)))
        rows = rows.withColumn("__p", part.cast("int"))
        wanted = materialize(narrowed(rows, places, "__p"))
        places = ["__b", "__p"]
        rows = held(rows, places)
    wanted = narrowed(rows, places, "__v")

    none = lambda t: F.lit(None).cast(t)
    parts = asked.select(*by, "__n", none("int").alias("__j"), none("double").alias("__v")).unionByName(wanted.select(*by, none("long").alias("__n"), "__j", "__v"))
    at = lambda i, j: F.max(F.when((F.col("__i") == i) & (F.col("__j") == j), F.col("__v"))).alias(f"q{i}_{j}")
    flat = parts.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__n"))).alias(f"n{i}") for i in range(len(cols))],
        *[at(i, j) for i in range(len(cols)) for j in range(2 * len(probs))],
    )

    def quantile(i: int, j: int) -> Column:
        v0, v1, h = F.col(f"q{i}_{2 * j}"), F.col(f"q{i}_{2 * j + 1}"), (F.col(f"n{i}") - 1) * probs[j]
        part = h - F.floor(h)
        return F.when((part == 0) | (v0 == v1), v0).otherwise((1 - part) * v0 + part * v1)

    out = list(keys)
    for i, name in enumerate(cols):
        n = F.coalesce(f"n{i}", F.lit(0))
        out += [n.alias(f"{name}__n"), F.when(n > 0, F.array(*[quantile(i, j) for j in range(len(probs))])).alias(f"{name}__q")]
    return flat.select(*out)


def group_rank(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str = "rank",
) -> DataFrame:
    """row_number per group under a total order.

    Rows are range-partitioned on (keys, order), so one group may span many
    tasks; each task numbers its own slice and adds the size of the slices
    before it. The sliced table is written first, so a retry sees the same
    slices.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = materialize(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("__slice", F.spark_partition_id()),
    )
    sizes = slices.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__slice", *keys).orderBy(*order))
    return (
        slices.withColumn("__local", local)
        .join(offsets, [*keys, "__slice"])
        .withColumn(out, (F.col("__local") + F.col("__before")).cast("int"))
        .drop("__slice", "__local", "__before")
    )
