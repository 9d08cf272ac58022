"""Regression residuals and their diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import add_all, finite_or_null, group_quantiles, is_finite, join_stats, signed_sqrt
from .forecast import contribution, forecast_vector
from .keyed import attach_row


def residuals(
    exposures: DataFrame, factor_returns: DataFrame, names: list[str], ret: str = "fwd_ret", zero_missing: bool = True,
) -> DataFrame:
    """(date, t, ticker, actual, predicted, residual): return minus exposures times factor returns.

    With `zero_missing` anything not finite counts as 0; otherwise it makes the
    prediction null.
    """
    fv = forecast_vector(factor_returns.withColumnRenamed("f", "__f"), names, "__f", "fp_")
    joined = exposures.join(F.broadcast(fv), "t", "left")
    terms = [contribution(n) if zero_missing else finite_or_null(n) * finite_or_null(f"fp_{n}") for n in names]
    out = joined.select("date", "t", "ticker", F.col(ret).alias("actual"), add_all(terms).alias("predicted"))
    return out.withColumn("residual", finite_or_null(F.col("actual") - F.col("predicted")))


def residual_zscores(resid: DataFrame) -> DataFrame:
    """Adds `residual_zscore` by date (population std; null on a constant date)."""
    stats = resid.groupBy("date").agg(F.avg("residual").alias("__m"), F.stddev_pop("residual").alias("__s"))
    z = F.when(F.col("__s") > 1e-12, (F.col("residual") - F.col("__m")) / F.col("__s"))
    return join_stats(resid, stats, ["date"]).select(*resid.columns, z.alias("residual_zscore"))


def outliers(z: DataFrame, threshold: float = 3.0) -> DataFrame:
    x = F.col("residual_zscore")
    return z.where(F.abs(x) >= threshold).select(
        "ticker", "date", "residual", "residual_zscore",
        F.when(x > 0, "positive_outlier").otherwise("negative_outlier").alias("side_implication"),
        F.lit(False).alias("excluded_from_trading"),
        F.lit("Reported only; outliers are not traded automatically.").alias("reason"),
    )


def recent_residuals(
    exposures: DataFrame, factor_returns: DataFrame, names: list[str], signal_t: int, lookback: int = 30, ret: str = "fwd_ret",
) -> DataFrame:
    """Residual z-scores of the `lookback` days before the signal day.

    Days without any finite return or any finite factor return are left out.
    """
    in_window = F.col("t").between(signal_t - lookback, signal_t - 1)
    f = factor_returns.where(in_window)
    ok_f = f.groupBy("t").agg(F.count_if(is_finite("f")).alias("n")).where("n > 0").select("t")
    x = exposures.where(in_window)
    ok_r = x.groupBy("t").agg(F.count_if(is_finite(ret)).alias("n")).where("n > 0").select("t")
    days = ok_f.join(F.broadcast(ok_r), "t")
    return residual_zscores(residuals(x.join(F.broadcast(days), "t", "left_semi"), f, names, ret))


def daily_mse(resid: DataFrame) -> DataFrame:
    e = F.col("residual") * F.col("residual")
    return resid.groupBy("date").agg(F.avg(e).alias("daily_mse"), F.count("residual").alias("valid_count"))


def ticker_coverage(resid: DataFrame, cal: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Finite share of all calendar days and mean squared residual per ticker."""
    days = cal.agg(F.count("*").alias("__T"))
    per = resid.groupBy("ticker").agg(
        F.count("residual").alias("__n"), F.avg(F.col("residual") * F.col("residual")).alias("mean_squared_residual")
    )
    share = F.col("__n") / F.col("__T")
    return attach_row(per, days).select(
        "ticker", share.alias("finite_residual_fraction"), "mean_squared_residual",
        (share < threshold).alias("below_coverage_threshold"),
    )


def residual_summary(resid: DataFrame, cal: DataFrame, n_factors: int, threshold: float = 0.5) -> DataFrame:
    """One-row summary over the full date x ticker grid."""
    base = resid.select("date", "ticker", "residual", (F.col("residual") * F.col("residual")).alias("sq"))
    q = group_quantiles(base, [], {"sq": F.col("sq")}, [0.5, 0.95, 0.99, 0.995])
    whole = base.agg(
        F.count("residual").alias("__n"), F.countDistinct("ticker").alias("N"), F.avg("sq").alias("mean_squared_residual"),
        F.max("sq").alias("max_squared_residual"),
    )
    days = daily_mse(resid)
    # Calendar days without a row count as days with no valid name.
    day = cal.select("date").join(F.broadcast(days), "date", "left").agg(
        F.count("*").alias("T"), F.max_by("date", "daily_mse").alias("top_date_by_daily_mse"),
        F.min(F.coalesce("valid_count", F.lit(0))).alias("min_daily_valid_count"),
        F.median(F.coalesce("valid_count", F.lit(0))).alias("median_daily_valid_count"),
        F.max(F.coalesce("valid_count", F.lit(0))).alias("max_daily_valid_count"),
    )
    cov = ticker_coverage(resid, cal, threshold)
    tick = cov.agg(
        F.max_by("ticker", "mean_squared_residual").alias("top_ticker_by_mean_squared_residual"),
        F.count_if("below_coverage_threshold").alias("low_coverage_ticker_count"),
    )
    med = group_quantiles(cov, [], {"c": F.col("finite_residual_fraction")}, [0.5])
    out = whole
    for part in (day, tick, q, med):
        out = attach_row(out, part)
    return out.select(
        "T", "N", F.lit(n_factors).alias("K"),
        (F.col("__n") / (F.col("T") * F.col("N"))).alias("finite_fraction_of_residual"),
        "mean_squared_residual", F.col("sq__q")[0].alias("median_squared_residual"),
        F.col("sq__q")[1].alias("p95_squared_residual"), F.col("sq__q")[2].alias("p99_squared_residual"),
        F.col("sq__q")[3].alias("p99_5_squared_residual"), "max_squared_residual",
        "top_ticker_by_mean_squared_residual", "top_date_by_daily_mse", "min_daily_valid_count",
        "median_daily_valid_count", "max_daily_valid_count", F.lit(threshold).alias("coverage_threshold"),
        "low_coverage_ticker_count", F.col("c__q")[0].alias("median_ticker_coverage"),
    )


def top_events(resid: DataFrame, n: int = 100) -> DataFrame:
    """Largest squared residuals overall."""
    return (
        resid.where(F.col("residual").isNotNull())
        .select(
            "date", "ticker", "residual", (F.col("residual") * F.col("residual")).alias("squared_residual"),
            F.col("actual").alias("actual_return"), F.col("predicted").alias("predicted_return"),
        )
        .orderBy(F.desc("squared_residual"), "date", "ticker")
        .limit(n)
    )


def mse_spikes(resid: DataFrame, days: int = 20, per_day: int = 10) -> DataFrame:
    """Worst days by MSE and their largest contributors."""
    worst = (
        daily_mse(resid).where("daily_mse IS NOT NULL").orderBy(F.desc("daily_mse"), "date").limit(days)
        .withColumn("total_sq", F.col("daily_mse") * F.col("valid_count"))
    )
    rows = resid.where("residual IS NOT NULL").join(F.broadcast(worst), "date").withColumn(
        "squared_residual", F.col("residual") * F.col("residual")
    )
    best_first = Window.partitionBy("date").orderBy(F.desc("squared_residual"), "ticker")
    top = rows.withColumn("rank_within_date", F.row_number().over(best_first)).where(F.col("rank_within_date") <= per_day)
    day = Window.partitionBy("date")  # at most `per_day` rows per date from here on
    total = F.nullif(F.col("total_sq"), F.lit(0.0))
    return top.select(
        "date", "daily_mse", "valid_count", "rank_within_date", "ticker", "residual", "squared_residual",
        F.col("actual").alias("actual_return"), F.col("predicted").alias("predicted_return"),
        (F.col("squared_residual") / total).alias("contribution_share"),
        F.min_by("ticker", "rank_within_date").over(day).alias("max_residual_ticker"),
        F.max("squared_residual").over(day).alias("max_squared_residual"),
        (F.sum("squared_residual").over(day) / total).alias("residual_concentration_ratio"),
    )


def heatmap_slice(z: DataFrame, cal: DataFrame, tickers: int = 60, days: int = 30) -> DataFrame:
    """Cells of the residual heat map: signed roots of the last days' z-scores for the most extreme tickers."""
    worst = (
        z.groupBy("ticker").agg(F.max(F.abs("residual_zscore")).alias("__m")).where("__m IS NOT NULL")
        .orderBy(F.desc("__m"), "ticker").limit(tickers).select("ticker")
    )
    recent = z.select("date").distinct().orderBy(F.desc("date")).limit(days)
    return (
        z.join(F.broadcast(worst), "ticker", "left_semi").join(F.broadcast(recent), "date", "left_semi")
        .select("ticker", "date", signed_sqrt("residual_zscore").alias("cell"))
    )


def heatmap_limit(df: DataFrame, value: str = "residual", share: float = 0.995) -> DataFrame:
    """One row, `limit`: the colour scale of the heat map of all cells runs from -limit to limit.

    That quantile of the finite cells' sizes, or 1 where there is none or it is 0.
    """
    if not 0 < share <= 1:
        raise ValueError(f"share must be in (0, 1]: {share}")
    cells = df.select(F.abs(signed_sqrt(finite_or_null(value))).alias("size"))
    q = group_quantiles(cells, [], {"size": F.col("size")}, [share]).select(F.col("size__q")[0].alias("q"))
    # Without any cell there is no row of quantiles.
    return q.agg(F.max("q").alias("q")).select(F.when(F.col("q") > 0, F.col("q")).otherwise(F.lit(1.0)).alias("limit"))


def similarity_order(resid: DataFrame, cal: DataFrame, dims: int = 3) -> DataFrame:
    """(ticker, v1..v3): coordinates that put tickers with alike residual histories together.

    Each ticker's centred, unit-length residual history is a column; the
    coordinates are the leading right-singular vectors. The T x T product of
    the histories is summed over tickers (T is the calendar), decomposed on the
    driver, and every ticker is projected where it lives. Tickers with fewer
    than two residuals or no variation have none and sort last by coverage.
    Singular vectors are fixed up to sign.
    """
    n_days = cal.count()
    stats = resid.where("residual IS NOT NULL").groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg("residual").alias("m"),
        F.collect_list(F.struct("t", "residual")).alias("h"),
    )
    hist = stats.where("n >= 2").select("ticker", "n", "m", "h.t", "h.residual")

    def columns(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        a = np.zeros((n_days, len(pdf)))
        for i, (m, ts, rs) in enumerate(zip(pdf["m"], pdf["t"], pdf["residual"])):
            a[np.asarray(ts, dtype=int), i] = np.asarray(rs) - m
        norm = np.sqrt((a * a).sum(axis=0))
        ok = norm > 0
        a[:, ok] /= norm[ok]
        return a, ok

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_days, n_days))
        for pdf in batches:
            a, ok = columns(pdf)
            total += a[:, ok] @ a[:, ok].T
        yield pd.DataFrame({"i": range(n_days), "row": list(total)})

    summed = (
        hist.mapInPandas(outer, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
        .groupBy("i", "j").agg(F.sum("v").alias("v"))
    )
    g = np.zeros((n_days, n_days))
    for r in summed.where("v <> 0").toLocalIterator():
        g[r["i"], r["j"]] = r["v"]
    values, vectors = np.linalg.eigh(g)
    lead = np.argsort(values)[::-1][:dims]
    basis = vectors[:, lead] / np.sqrt(np.maximum(values[lead], 1e-300))
    names = [f"v{i + 1}" for i in range(len(lead))]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, ok = columns(pdf)
            coords = (a.T @ basis)[ok]
            out = pd.DataFrame({"ticker": pdf["ticker"].to_numpy()[ok]})
            for i, c in enumerate(names):
                out[c] = coords[:, i]
            yield out

    coords = hist.mapInPandas(project, "ticker string, " + ", ".join(f"{c} double" for c in names))
    cover = resid.groupBy("ticker").agg(F.count("residual").alias("observations"))
    return cover.join(coords, "ticker", "left").orderBy(
        *[F.asc_nulls_last(c) for c in names], F.desc("observations"), "ticker"
    )


def coverage_order(resid: DataFrame, cal: DataFrame, by: str = "coverage") -> DataFrame:
    """Ticker order by coverage (then MSE), or by MSE."""
    cov = ticker_coverage(resid, cal)
    if by == "coverage":
        return cov.orderBy(F.desc("finite_residual_fraction"), F.desc_nulls_last("mean_squared_residual"), "ticker")
    return cov.orderBy(F.asc_nulls_first("mean_squared_residual"), "ticker")
