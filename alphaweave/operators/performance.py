"""Portfolio returns, daily exposures and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions import is_finite
from .price_factors import cap_abs


def portfolio_returns(
    weights: DataFrame, cal: DataFrame, min_coverage: float = 0.80, max_abs_return: float | None = 1.0,
    ret: str = "fwd_ret",
) -> DataFrame:
    """(date, t, portfolio_return, return_coverage) from rows with `weight` and a forward return.

    A missing return earns nothing; a day whose finite share of active names is
    below `min_coverage` has no return.
    """
    r = cap_abs(F.col(ret), max_abs_return)
    active = F.abs("weight") > 0
    finite = is_finite(r)
    per_day = weights.groupBy("t").agg(
        F.count_if(active).alias("__n"),
        F.count_if(active & finite).alias("__f"),
        F.sum(F.when(finite, F.col("weight") * r).otherwise(0.0)).alias("__r"),
    )
    cov = F.when(F.col("__n") > 0, F.col("__f") / F.col("__n"))
    return cal.join(F.broadcast(per_day), "t", "left").select(
        "date", "t", F.when(cov >= min_coverage, F.col("__r")).alias("portfolio_return"), cov.alias("return_coverage")
    )


def exposures_by_day(weights: DataFrame, cal: DataFrame) -> DataFrame:
    w = F.col("weight")
    per_day = weights.groupBy("t").agg(
        F.sum(F.abs(w)).alias("gross_exposure"), F.sum(w).alias("net_exposure"),
        F.sum(F.when(w > 0, w).otherwise(0.0)).alias("long_exposure"),
        F.sum(F.when(w < 0, w).otherwise(0.0)).alias("short_exposure"),
        F.count_if(w > 0).alias("number_long"), F.count_if(w < 0).alias("number_short"),
    )
    sums = ["gross_exposure", "net_exposure", "long_exposure", "short_exposure"]
    return cal.join(F.broadcast(per_day), "t", "left").select(
        "date", "t",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sums],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("number_long", "number_short")],
    )


def running_product(ret: Column, window) -> Column:
    """Product of (1 + r) over a running frame; a loss of all or more keeps sign and zero."""
    g = 1 + F.coalesce(ret, F.lit(0.0))
    size = F.exp(F.sum(F.when(g != 0, F.log(F.abs(g))).otherwise(0.0)).over(window))
    sign = F.when(F.sum(F.when(g < 0, 1).otherwise(0)).over(window) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.sum(F.when(g == 0, 1).otherwise(0)).over(window) > 0, 0.0).otherwise(sign * size)


def equity_curve(daily: DataFrame, keys: list[str] | None = None, ret: str = "portfolio_return") -> DataFrame:
    """Adds equity, running peak and drawdown; a null day keeps the level. One row per day."""
    keys = keys or []
    upto = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", running_product(F.col(ret), upto))
    # The peak starts at the first day that has a return.
    seen = F.count(ret).over(upto) > 0
    out = out.withColumn("peak", F.max(F.when(seen, F.col("equity"))).over(upto))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def summarize(daily: DataFrame, keys: list[str] | None = None, periods_per_year: int = 252) -> DataFrame:
    """Backtest summary from daily rows with portfolio_return, gross_exposure and turnover."""
    keys = keys or []
    curve = equity_curve(daily, keys)
    r = F.col("portfolio_return")
    n = F.count(r)
    vol = F.stddev_samp(r)
    return curve.groupBy(*keys).agg(
        n.alias("n_periods"),
        F.avg(r).alias("mean_return"),
        F.when(n > 1, vol).alias("volatility"),
        F.when((n > 1) & (vol > 1e-12), math.sqrt(periods_per_year) * F.avg(r) / vol).alias("sharpe"),
        F.when(n > 0, F.max_by("equity", "t") - 1).alias("total_return"),
        F.min(F.when(r.isNotNull(), F.col("drawdown"))).alias("max_drawdown"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("win_rate"),
        F.avg("gross_exposure").alias("avg_gross_exposure"),
        F.avg("turnover").alias("avg_turnover"),
    )


def portfolio_pnl(daily: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Net return per day from gross return, half-turnover and active-name count.

    A day without positions has no return but still shows its turnover.
    """
    notional = F.col("turnover") * (1.0 if cfg.cost_basis == "half_turnover" else 2.0)
    active = F.col("n_active") > 0
    cost = F.when(active, notional * cfg.trading_cost).otherwise(0.0)
    penalty = F.when(active, notional * (cfg.turnover_penalty_bps / 10_000.0)).otherwise(0.0)
    return daily.withColumns({"transaction_cost": cost, "turnover_penalty": penalty}).withColumn(
        "portfolio_return",
        F.when(active, F.col("gross_return") - F.col("transaction_cost") - F.col("turnover_penalty")),
    )


def gross_returns(weights: DataFrame, cal: DataFrame, ret: str = "realized") -> DataFrame:
    per_day = weights.groupBy("t").agg(
        F.sum(F.when(is_finite(ret), F.col("weight") * F.col(ret)).otherwise(0.0)).alias("gross_return"),
        F.count_if(F.abs("weight") > 0).alias("n_active"),
    )
    return cal.join(F.broadcast(per_day), "t", "left").select(
        "date", "t", F.coalesce("gross_return", F.lit(0.0)).alias("gross_return"), F.coalesce("n_active", F.lit(0)).alias("n_active")
    )


def monthly_returns(daily: DataFrame) -> DataFrame:
    """Compounded return and running equity per month."""
    g = F.col("portfolio_return")
    month = F.date_format("date", "yyyy-MM")
    per = daily.where(g.isNotNull()).groupBy(month.alias("month")).agg(
        (F.exp(F.sum(F.log1p(F.when(g > -1, g)))) - 1).alias("__m"), F.min(g).alias("__worst")
    )
    ret = F.when(F.col("__worst") <= -1, -1.0).otherwise(F.col("__m"))
    per = per.select("month", ret.alias("monthly_return"))
    upto = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("monthly_equity", running_product(F.col("monthly_return"), upto))


def risk_ratios(daily: DataFrame, periods_per_year: int = 252) -> DataFrame:
    """Annualised return, Calmar, profit factor, hit rate, best and worst day."""
    curve = equity_curve(daily)
    r = F.col("portfolio_return")
    base = curve.agg(
        F.count(r).alias("trading_days"), F.max_by("equity", "t").alias("__eq"),
        F.min(F.when(r.isNotNull(), F.col("drawdown"))).alias("max_drawdown"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("__gain"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("__loss"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("hit_rate"),
        F.max(r).alias("best_day"), F.min(r).alias("worst_day"),
        F.avg("turnover").alias("average_turnover"), F.median("turnover").alias("median_turnover"),
    )
    ann = F.pow(F.greatest(F.col("__eq"), F.lit(0.0)), periods_per_year / F.nullif(F.col("trading_days"), F.lit(0))) - 1
    return base.select(
        "trading_days", (F.col("__eq") - 1).alias("cumulative_return"), ann.alias("annualized_return"), "max_drawdown",
        (ann / F.nullif(F.abs("max_drawdown"), F.lit(0.0))).alias("calmar"),
        (F.col("__gain") / F.nullif(F.col("__loss"), F.lit(0.0))).alias("profit_factor"),
        "hit_rate", "best_day", "worst_day", "average_turnover", "median_turnover",
    )


def trailing_risk(
    daily: DataFrame, vol_days: int = 20, var_days: int = 60, confidence: float = 0.95, keys: list[str] | None = None,
) -> DataFrame:
    """Annualised volatility and historical VaR of the returns before each day."""
    w = Window.partitionBy(*(keys or [])).orderBy("t")
    r = F.col("portfolio_return")
    vol_w, var_w = w.rowsBetween(-vol_days, -1), w.rowsBetween(-var_days, -1)
    var = F.greatest(F.lit(0.0), -F.percentile(r, F.lit(1.0 - confidence)).over(var_w))
    return daily.select(
        "*",
        F.when(F.count(r).over(vol_w) >= 2, F.stddev_samp(r).over(vol_w) * math.sqrt(252.0)).alias("rolling_volatility_annual"),
        F.when(F.count(r).over(var_w) >= 2, var).alias("rolling_daily_var"),
    )


def drawdown_scale(drawdown: Column | float, cfg: BacktestConfig) -> Column | float:
    """Full size up to the start, minimum at the limit, linear in between; for a column or a number."""
    top, bottom = float(cfg.max_leverage_multiplier), float(cfg.min_risk_scale)
    as_column = isinstance(drawdown, Column)
    least, greatest, lit = (F.least, F.greatest, F.lit) if as_column else (min, max, float)
    if cfg.max_drawdown_limit is None:
        return lit(top)
    spent = (drawdown - cfg.drawdown_control_start) / (cfg.max_drawdown_limit - cfg.drawdown_control_start)
    return top - (top - bottom) * greatest(lit(0.0), least(lit(1.0), spent))
