"""Table, report and log sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import upsert
from ..session import materialize


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_artifacts(tables: dict[str, DataFrame], root: str, by_date: tuple[str, ...] = ("exposures", "returns")) -> None:
    """Pipeline outputs as parquet; the tall tables are partitioned by date for pruned reads.

    Rows are first routed by date, so each date directory gets a few large
    files; the extra hash bucket keeps one date from landing in one task.
    """
    for name, df in tables.items():
        if name in by_date:
            spread = df.withColumn("__b", F.pmod(F.xxhash64("ticker"), F.lit(16))).repartition("date", "__b").drop("__b")
            spread.write.mode("overwrite").partitionBy("date").parquet(f"{root}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_lambda_returns(df: DataFrame, path: str) -> None:
    """Factor returns of every ridge penalty, one directory per penalty index."""
    df.write.mode("overwrite").partitionBy("lambda_idx").parquet(path)


def write_csv_report(
    tables: dict[str, DataFrame], root: str, signal_date: str, date_col: str = "signal_date", order_by: dict[str, list[str]] | None = None,
) -> None:
    """One signal date of each table as CSV; tables without that column are written whole.

    A table named in `order_by` is range-partitioned into part files that hold it in that order, one after another.
    """
    for name, df in tables.items():
        out = df.where(F.col(date_col) == F.to_date(F.lit(signal_date))) if date_col in df.columns else df
        if order_by and name in order_by:
            out = out.orderBy(*order_by[name])
        out.write.mode("overwrite").option("header", True).csv(f"{root}/{signal_date}/{name}")


def write_json(row: DataFrame, path: str) -> None:
    """A one-row table as a JSON document."""
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def upsert_bars(new: DataFrame, path: str, keys: tuple[str, str] = ("date", "ticker")) -> None:
    """Newest row per key wins; only the day partitions touched by `new` are rewritten.

    The partition column is derived from the time key. Old rows are read from
    the touched days only (dynamic pruning on the join), so the cost follows
    the size of the update, not of the table.
    """
    spark = new.sparkSession
    day = F.to_date(keys[0])
    new = new.withColumn("day", day)
    if path_exists(spark, path):
        old = spark.read.parquet(path).select(*new.columns)
        touched = old.join(F.broadcast(new.select("day").distinct()), "day", "left_semi").select(*new.columns)
        merged = materialize(upsert(touched, new, list(keys)))
    else:
        merged = upsert(new.limit(0), new, list(keys))
    # The hash bucket splits a busy day over several tasks and files.
    (
        merged.withColumn("__b", F.pmod(F.xxhash64("ticker"), F.lit(16)))
        .repartition("day", "__b")
        .drop("__b")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def upsert_status(new: DataFrame, old: DataFrame | None) -> DataFrame:
    return upsert(old if old is not None else new.limit(0), new, ["ticker"])


def build_or_read(spark: SparkSession, path: str, build: Callable[[], DataFrame], use_cache: bool = True) -> DataFrame:
    """Reuse a stored table that was written to its end, else build and store it.

    A marker beside the files is written last and goes first, so what a dead job left behind is never read.
    """
    marker = f"{path}/_complete"
    if not (use_cache and path_exists(spark, marker)):
        p = spark._jvm.org.apache.hadoop.fs.Path(marker)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(p, False)
        build().write.mode("overwrite").parquet(path)
        fs.create(p, True).close()
    return spark.read.parquet(path)


def wide_factor_returns(factor_returns: DataFrame, names: list[str]) -> DataFrame:
    """date x factor matrix for a CSV; the names are given, so no extra pass finds them."""
    return factor_returns.groupBy("date").pivot("factor", names).agg(F.first("f"))
