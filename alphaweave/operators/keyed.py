"""Keyed row selection and set operations on long tables.

`keep_last`/`keep_first` are aggregations, not windows: they combine on the map
side, so a key holding a large part of all rows costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str | Column], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest) if rest else F.lit(1), rank).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the last under `order`."""
    return _pick(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def last_non_null(df: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Per key and field the last non-null value under `order` (duplicate-bar collapse)."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields]
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a new row replaces the old row of the same key; of several new rows the last one does."""
    rows = [x.withColumns({"__src": F.lit(i), "__at": F.monotonically_increasing_id()}) for i, x in enumerate((old, new))]
    both = rows[0].unionByName(rows[1], allowMissingColumns=True)
    return keep_last(both, keys, ["__src", "__at"]).drop("__src", "__at")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_union(a: DataFrame, b: DataFrame, key: str = "ticker") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def key_intersection(a: DataFrame, b: DataFrame, key: str = "ticker") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def key_difference(a: DataFrame, b: DataFrame, key: str = "ticker") -> DataFrame:
    """Keys of `a` without a row in `b`."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def align(current: DataFrame, target: DataFrame, key: str = "ticker") -> DataFrame:
    """Current and target values side by side over the union of keys, absent = 0."""
    c = current.select(key, F.col("weight").alias("current_weight"))
    t = target.select(key, F.col("weight").alias("target_weight"))
    return c.join(t, key, "full_outer").select(
        key,
        F.coalesce("current_weight", F.lit(0.0)).alias("current_weight"),
        F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"),
    )


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate, which has exactly one row, to every row."""
    return df.join(F.broadcast(one_row), F.lit(True))
