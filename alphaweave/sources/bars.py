"""Bar, dimension and result-table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import label_or_placeholder, safe_double
from ..operators.keyed import keep_last
from ..schemas import BAR_FIELDS


def read_bars(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Daily bars; `date` is cut to a day. Select columns here or later, the scan prunes either way."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return df.withColumn("date", F.to_date("date"))


def read_bars_on(
    spark: SparkSession, path: str, day: str, tickers: DataFrame, order: list[str] | None = None
) -> DataFrame:
    """One day's bars, one row per ticker of the dimension, null where there is no bar.

    The range predicate is on the stored column, so it reaches the scan whether
    the column is a date or a timestamp.
    """
    raw = spark.read.parquet(path)
    day_col = F.to_date(F.lit(day))
    rows = raw.where((F.col("date") >= day_col) & (F.col("date") < F.date_add(day_col, 1)))
    rows = rows.withColumn("date", F.to_date("date"))
    one = keep_last(rows.withColumn("__at", F.monotonically_increasing_id()), ["ticker"], [*(order or []), "__at"]).drop("__at")
    return tickers.select("ticker").join(one, "ticker", "left")


def bars_date_range(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("end_date"),
    )


def read_dimension(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Header CSV of labels in file order: the preferred column, else the first one.

    A label file is one small file; reading it as text lines of one split keeps
    its order, so the position is the line number.
    """
    df = spark.read.option("header", True).csv(path)
    col = name if name in df.columns else df.columns[0]
    lines = df.select(F.col(col).alias("label")).coalesce(1).withColumn("position", F.monotonically_increasing_id())
    return lines.select("position", label_or_placeholder("label", name, F.col("position")).alias(name))


def load_factor_tables(spark: SparkSession, root: str) -> dict[str, DataFrame | None]:
    """Exposure, return, factor-return and mask tables written by `sinks.write_artifacts`.

    The mask defaults to all-true and the returns are optional.
    """
    def maybe(*names: str) -> DataFrame | None:
        for n in names:
            path = f"{root}/{n}"
            fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
                return spark.read.parquet(path)
        return None

    x = maybe("exposures", "X")
    f = maybe("factor_returns", "f")
    if x is None or f is None:
        raise FileNotFoundError(f"exposures and factor_returns are required under {root}")
    r = maybe("returns", "forward_returns", "r")
    mask = maybe("tradable_mask")
    x = with_default_mask(x, mask)
    return {"exposures": x, "factor_returns": f, "returns": r, "tickers": maybe("tickers"), "factors": maybe("factors")}


def with_default_mask(exposures: DataFrame, mask: DataFrame | None) -> DataFrame:
    if mask is None:
        return exposures if "tradable" in exposures.columns else exposures.withColumn("tradable", F.lit(True))
    return exposures.drop("tradable").join(mask.select("date", "ticker", "tradable"), ["date", "ticker"], "left").withColumn(
        "tradable", F.coalesce("tradable", F.lit(False))
    )


def normalize_bars(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Intraday bar rows in the canonical shape.

    The timestamp falls back to `date`, unreadable numbers become null, absent
    columns are added as null, rows without a key are dropped and the last row
    per (timestamp, ticker) wins: under `order`, and among equals by its place in `df`.
    """
    if "timestamp" not in df.columns and "date" in df.columns:
        df = df.withColumn("timestamp", F.col("date"))
    order = order or []
    cols = [
        F.try_to_timestamp(F.col("timestamp").cast("string")).alias("timestamp"),
        F.col("ticker").cast("string").alias("ticker"),
        *[
            (safe_double(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("double")).alias(c)
            for c in BAR_FIELDS
        ],
        *[F.col(c) for c in order],
        F.monotonically_increasing_id().alias("__at"),
    ]
    out = df.select(*cols).dropna(subset=["timestamp", "ticker"])
    return keep_last(out, ["timestamp", "ticker"], [*order, "__at"]).select("timestamp", "ticker", *BAR_FIELDS)


def latest_positions(positions: DataFrame, account: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Last staged whole-share quantity per ticker, optionally of one account."""
    if account is not None:
        positions = positions.where(F.col("account") == account)
    placed = positions.withColumn("__at", F.monotonically_increasing_id())
    last = keep_last(placed, ["ticker"], [*(order or []), "__at"])
    return last.select("ticker", F.col("qty").cast("long").alias("qty"))
