"""Factor build and research backtest from bars and filings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fundamentals as fund
from ..operators import performance as perf
from ..operators import portfolio as pf
from ..operators.forecast import predict_factor_returns, score
from ..operators.preprocess import Preprocessed, build_exposures, dense_exposures, grid_cells
from ..operators.price_factors import PRICE_FACTORS, price_factors, with_forward_return
from ..operators.ridge import estimate_factor_returns, factor_returns_long
from ..operators.universe import apply_mask, calendar, with_adj_close, with_t, with_tradable
from ..session import materialize


@dataclass
class FactorBuild:
    """Tables of one factor run."""

    calendar: DataFrame
    exposures: DataFrame
    names: list[str]
    diagnostics: DataFrame
    ridge: DataFrame
    factor_returns: DataFrame
    raw: DataFrame
    cells: DataFrame


def build_factors(
    bars: DataFrame, flat_filings: DataFrame | None = None, price_names: list[str] | None = None, horizon: int = 1,
    max_abs_forward_return: float | None = 1.0, min_names: int = 30, ridge: float | str = 1e-4,
    grid: list[float] | None = None, dense: bool = False, **exposure_options,
) -> FactorBuild:
    """Bars (and flat or trailing filings) to exposures and factor returns.

    `dense` puts the exposures on the full date x ticker grid, where a name
    without a bar has a neutral, untradable row; without it such cells are
    absent. Written once on the way: the calendar and the raw factor table, which every
    per-date statistic reads again, and the exposures.
    """
    cal = materialize(calendar(bars))
    panel = with_tradable(with_adj_close(with_t(bars, cal)))
    panel = with_forward_return(panel, horizon, max_abs_forward_return)
    names = list(price_names or PRICE_FACTORS)
    keep = [c for c in ("tradable", "fwd_ret", "adj_close", "open", "close", "volume") if c in panel.columns]
    raw = price_factors(panel, names, keep)
    if flat_filings is not None:
        ratios = fund.fundamental_panel(flat_filings, raw.select("ticker", "date", "t", "adj_close", "tradable"), cal)
        raw = raw.join(ratios.select("ticker", "t", *fund.RATIOS), ["ticker", "t"], "left")
        names += fund.RATIOS
    raw = materialize(apply_mask(raw, names))
    cells = grid_cells(cal, raw)
    built: Preprocessed = build_exposures(raw, names, min_names, cells=cells, **exposure_options)
    exposures = materialize(dense_exposures(built.table, built.names, cal) if dense else built.table)
    fr = materialize(estimate_factor_returns(exposures, built.names, min_names, ridge, grid=grid))
    long = factor_returns_long(fr, built.names, cal)
    return FactorBuild(cal, exposures, built.names, built.diagnostics, fr, long, raw, cells)


@dataclass
class ResearchBacktest:
    forecasts: DataFrame
    weights: DataFrame
    daily: DataFrame
    metrics: DataFrame


def run_factor_backtest(
    exposures: DataFrame, factor_returns: DataFrame, names: list[str], cal: DataFrame, method: str = "latest",
    lookback: int = 20, half_life: float = 20.0, min_periods: int = 5, quantile: float = 0.10, gross: float = 2.0,
    min_names_per_side: int = 5, min_return_coverage: float = 0.80, max_abs_return: float | None = 1.0,
) -> ResearchBacktest:
    """Forecast, score, quantile weights, returns, turnover, summary."""
    pred = materialize(predict_factor_returns(factor_returns, method, lookback, half_life, min_periods))
    scored = score(exposures, pred, names).select("ticker", "date", "t", "tradable", "fwd_ret", "score")
    scored = materialize(scored)
    weights = materialize(
        pf.quantile_long_short(scored, quantile, gross, min_names_per_side)
    )
    daily = (
        perf.portfolio_returns(weights, cal, min_return_coverage, max_abs_return)
        .join(F.broadcast(perf.exposures_by_day(weights, cal).drop("date")), "t")
        .join(F.broadcast(pf.turnover(weights, cal).select("t", "turnover")), "t")
    )
    daily = materialize(daily)
    curve = perf.equity_curve(daily)
    table = curve.select(
        "date", "t", "portfolio_return",
        F.when(F.col("portfolio_return").isNotNull(), F.col("equity") - 1).alias("cumulative_return"),
        "turnover", "gross_exposure", F.col("number_long").alias("n_long"), F.col("number_short").alias("n_short"),
        "return_coverage",
    )
    return ResearchBacktest(pred, weights, table, perf.summarize(daily))


def stored_or_computed_weights(
    stored: dict[str, DataFrame | None], exposures: DataFrame | None, factor_returns: DataFrame | None,
    names: list[str], cal: DataFrame, date_index: int = -1, quantile: float = 0.10, gross: float = 2.0,
    method: str = "ewma", lookback: int = 20, half_life: float = 20.0, min_periods: int = 5,
) -> DataFrame:
    """(ticker, weight) of one date: stored weights, else positions, else scores, else recomputed."""
    n = cal.count()
    t = n + date_index if date_index < 0 else date_index
    if not 0 <= t < n:
        raise IndexError(f"date_index {date_index} out of range for {n} dates")
    for name, col in (("weights", "weight"), ("positions", "weight"), ("scores", "score")):
        table = stored.get(name)
        if table is not None:
            return table.where(F.col("t") == t).select("ticker", F.col(col).alias("weight"))
    if exposures is None or factor_returns is None:
        raise FileNotFoundError("no stored weights, positions or scores and nothing to compute them from")
    pred = predict_factor_returns(factor_returns, method, lookback, half_life, min_periods)
    day = score(exposures.where(F.col("t") == t), pred.where(F.col("t") == t), names)
    return pf.quantile_long_short(materialize(day), quantile, gross).select("ticker", "weight")
