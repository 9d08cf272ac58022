"""Calendar, tradable masks, listing periods and universe selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import INF, is_finite
from .keyed import attach_row, keep_first


def calendar(bars: DataFrame, date_col: str = "date") -> DataFrame:
    """(date, t): t numbers the distinct dates from 0.

    The only window without a partition key: its input is the distinct dates,
    bounded by the length of the history and independent of the row count.
    """
    days = bars.select(date_col).where(F.col(date_col).isNotNull()).distinct()
    return days.withColumn("t", (F.row_number().over(Window.orderBy(date_col)) - 1).cast("int"))


def with_t(df: DataFrame, cal: DataFrame, date_col: str = "date") -> DataFrame:
    """Attach the day ordinal; the calendar is bounded, so it is broadcast."""
    return df.join(F.broadcast(cal), date_col)


def with_adj_close(bars: DataFrame) -> DataFrame:
    return bars if "adj_close" in bars.columns else bars.withColumn("adj_close", F.col("close"))


def with_tradable(bars: DataFrame, require_volume: bool = True) -> DataFrame:
    """`tradable`: finite positive price and, if required, finite positive volume."""
    price = next((c for c in ("adj_close", "close") if c in bars.columns), None)
    if price is None:
        raise KeyError("bars need adj_close or close")
    ok = is_finite(price) & (F.col(price) > 0)
    if require_volume and "volume" in bars.columns:
        ok = ok & is_finite("volume") & (F.col("volume") > 0)
    return bars.withColumn("tradable", F.coalesce(ok, F.lit(False)))


def apply_mask(df: DataFrame, columns: list[str], mask: str = "tradable") -> DataFrame:
    """Null the given columns where the mask is false or missing."""
    return df.withColumns({c: F.when(F.col(mask), F.col(c)) for c in columns})


LIST_COLUMNS = ["list_date", "list_date_utc", "listed_utc", "start_date"]


def listing_periods(meta: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(ticker, listed, delisted), first metadata row per ticker."""
    list_col = next((c for c in LIST_COLUMNS if c in meta.columns), None)
    as_day = lambda c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"))) if c else F.lit(None).cast("date")
    rows = meta.select(
        F.col("ticker").cast("string").alias("ticker"),
        as_day(list_col).alias("listed"),
        as_day("delisted_utc" if "delisted_utc" in meta.columns else None).alias("delisted"),
        *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order or [])],
    )
    keys = [f"__o{i}" for i in range(len(order or []))] or ["listed", "delisted"]
    return keep_first(rows, ["ticker"], keys).select("ticker", "listed", "delisted")


def point_in_time(df: DataFrame, meta: DataFrame, mask: str = "tradable") -> DataFrame:
    """Narrow the mask to listed <= date < delisted; tickers without metadata are out.

    The join side grows with the number of tickers, so its strategy is left to
    the optimizer's size check.
    """
    periods = listing_periods(meta).withColumn("__known", F.lit(True))
    joined = df.join(periods, "ticker", "left")
    listed = F.coalesce(F.col("date") >= F.col("listed"), F.lit(True))
    alive = F.coalesce(F.col("date") < F.col("delisted"), F.lit(True))
    ok = F.coalesce(F.col("__known"), F.lit(False)) & listed & alive
    return joined.withColumn(mask, F.col(mask) & ok).withColumn("pit_ok", ok).drop("listed", "delisted", "__known")


def point_in_time_stats(tickers: DataFrame, meta: DataFrame, cal: DataFrame) -> DataFrame:
    """Counts over the full date x ticker grid, computed without building it.

    Blocked days per ticker follow from counting calendar days outside the
    listing period.
    """
    periods = listing_periods(meta).withColumn("__known", F.lit(True))
    days = cal.agg(F.sort_array(F.collect_list("date")).alias("__days"), F.count("*").alias("__T"))
    outside = lambda cond: F.size(F.filter("__days", cond))
    rows = attach_row(tickers.select("ticker").distinct().join(periods, "ticker", "left"), days)
    blocked = F.when(F.col("__known").isNull(), F.col("__T")).otherwise(
        outside(
            lambda d: F.coalesce(d < F.col("listed"), F.lit(False)) | F.coalesce(d >= F.col("delisted"), F.lit(False))
        )
    )
    return rows.agg(
        F.count_if(F.col("listed").isNotNull()).alias("tickers_with_listing_date"),
        F.count_if(F.col("delisted").isNotNull()).alias("tickers_with_delisted_date"),
        F.count_if(F.col("__known").isNull()).alias("tickers_missing_metadata"),
        F.sum(blocked).alias("blocked_observations"),
    )


def point_in_time_warnings(meta: DataFrame | None) -> list[str]:
    if meta is None or "ticker" not in meta.columns:
        return ["point-in-time mask has no ticker metadata to use"]
    out = []
    if not any(c in meta.columns for c in LIST_COLUMNS):
        out.append("point-in-time mask has no listing date; only delisting and bar availability bound it")
    if "delisted_utc" not in meta.columns:
        out.append("point-in-time mask has no delisting date; inactive tickers are not bounded")
    return out


def active_universe(tickers: DataFrame, active_only: bool = True, limit: int | None = None) -> DataFrame:
    out = tickers
    if active_only and "active" in tickers.columns:
        out = out.where(F.coalesce(F.col("active"), F.lit(False)))
    if active_only and "delisted_utc" in tickers.columns:
        out = out.where(F.col("delisted_utc").isNull())
    out = out.where(F.col("ticker").isNotNull()).select(F.col("ticker").cast("string").alias("ticker")).distinct()
    return out.orderBy("ticker").limit(limit) if limit is not None else out


def restrict_to(df: DataFrame, tickers: DataFrame) -> DataFrame:
    return df.join(tickers.select("ticker"), "ticker", "left_semi")


def date_slice(df: DataFrame, start: str | None, end: str | None, date_col: str = "date") -> DataFrame:
    """Inclusive slice. Forecasts are made before slicing, so they see the full history."""
    if start is not None:
        df = df.where(F.col(date_col) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col(date_col) <= F.to_date(F.lit(end)))
    return df


def dollar_volume_rank(
    bars: DataFrame, window_days: int = 0, anchor: str = "end", top: int | None = None
) -> DataFrame:
    """Median close x volume per ticker over the first/last `window_days` dates, largest first.

    The bars of one ticker are bounded by the dates ranked, so the exact median
    per ticker is small.
    """
    rows = bars.select("date", "ticker", "close", "volume")
    if window_days:
        days = rows.select("date").where(F.col("date").isNotNull()).distinct()
        days = days.orderBy("date" if anchor == "start" else F.desc("date")).limit(window_days)
        rows = rows.join(F.broadcast(days), "date", "left_semi")
    dv = F.col("close") * F.col("volume")
    out = (
        rows.groupBy("ticker")
        .agg(F.median(F.when(~F.isnan(dv), dv)).alias("dollar_volume"))
        .where(F.col("dollar_volume").isNotNull() & (F.abs("dollar_volume") < INF))
    )
    return out.orderBy(F.desc("dollar_volume"), "ticker").limit(top) if top else out


def densify(bars: DataFrame, cal: DataFrame, tickers: DataFrame, fields: list[str]) -> DataFrame:
    """Full date x ticker grid for report tables.

    Each ticker row unfolds the calendar array; no cross join. The output is
    the grid itself, so only reports use it.
    """
    days = cal.agg(F.sort_array(F.collect_list(F.struct("t", "date"))).alias("__days"))
    grid = attach_row(tickers.select("ticker").distinct(), days).select("ticker", F.inline("__days"))
    return grid.join(bars.select("date", "ticker", *fields), ["date", "ticker"], "left")


def finite_ratio(df: DataFrame, columns: list[str], cells: str | None = None) -> DataFrame:
    """Share of finite cells per column over the rows of `df`."""
    return df.agg(*[(F.count_if(is_finite(c)) / F.count(F.lit(1))).alias(c) for c in columns])


def stale_tickers(universe: DataFrame, latest: DataFrame, asof: str) -> DataFrame:
    """Universe tickers without a bar, or whose latest bar is before `asof`."""
    joined = universe.select("ticker").join(latest, "ticker", "left")
    return joined.where(F.col("latest").isNull() | (F.col("latest") < F.to_timestamp(F.lit(asof))))


def latest_timestamp(bars: DataFrame, col: str = "timestamp") -> DataFrame:
    return bars.groupBy("ticker").agg(F.max(col).alias("latest"))


def check_dates(dates: DataFrame, method: str) -> None:
    """Refuse a look-ahead forecast or repeated dates."""
    if method == "oracle":
        raise ValueError("an oracle forecast uses same-date factor returns and is not allowed")
    if dates.groupBy("date").count().where("count > 1").limit(1).count():
        raise ValueError("dates must be strictly increasing")
