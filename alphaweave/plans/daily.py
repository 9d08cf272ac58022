"""Close-to-next-open backtest, after-close plan and next-open marking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions import is_finite, session_time
from ..operators import performance as perf
from ..operators import portfolio as pf
from ..operators import rankings as rk
from ..operators import residuals as rs
from ..operators.book import SCALES, run_book
from ..operators.execution import execution_returns, order_costs
from ..operators.forecast import factor_history, factor_report, predict_factor_returns, score
from ..operators.keyed import attach_row
from ..operators.universe import check_dates, date_slice, point_in_time, point_in_time_warnings
from ..session import materialize
from ..sources.sinks import path_exists, write_csv_report, write_json


class BacktestTables:
    """Result tables of one backtest. `daily` is ready; reports are derived when first asked for."""

    def __init__(
        self, cfg: BacktestConfig, days: DataFrame, names: list[str], panel: DataFrame, info: DataFrame, table: DataFrame,
        book: DataFrame, daily: DataFrame, exposures: DataFrame, factor_returns: DataFrame, pred: DataFrame,
        warnings: list[str],
    ):
        self.cfg, self.days, self.names, self.daily, self.book, self.warnings = cfg, days, names, daily, book, warnings
        self._panel, self._info, self._table = panel, info, table
        self._x, self._f, self._pred = exposures, factor_returns, pred

    @cached_property
    def _positions(self) -> DataFrame:
        """The scored panel with the final and the previous weight; carried names appear as extra rows."""
        names = self.names
        prev = pf.previous_weights(self.book, self.days).select("t", "ticker", F.col("weight").alias("__w"), "previous_weight")
        full = (
            self._panel.join(prev, ["t", "ticker"], "full_outer")
            .withColumns({"weight": F.coalesce("__w", F.lit(0.0)), "previous_weight": F.coalesce("previous_weight", F.lit(0.0))})
            .drop("__w", "date")
            .join(F.broadcast(self.days), "t")
        )
        return materialize(full.withColumns({f"c_{n}": F.coalesce(f"c_{n}", F.lit(0.0)) for n in names}))

    @cached_property
    def alpha_rankings(self) -> DataFrame:
        return materialize(rk.alpha_rankings(self._positions, self.names, self.cfg))

    @cached_property
    def orders(self) -> DataFrame:
        prices = self._table.select("ticker", "t", "signal_price", "execution_price", "exit_price", "execution_date", "exit_date")
        return self.alpha_rankings.where("side <> ''").join(prices, ["ticker", "t"], "left").withColumn(
            "holding_period_days", F.lit(self.cfg.holding_period_days)
        )

    @property
    def target_positions(self) -> DataFrame:
        return rk.target_positions(self.alpha_rankings)

    @property
    def current_positions(self) -> DataFrame:
        return rk.current_positions(self.alpha_rankings)

    @property
    def execution_quality(self) -> DataFrame:
        return order_costs(self.orders, self.cfg)

    @property
    def factor_report(self) -> DataFrame:
        return factor_history(self._f, self._pred)

    @cached_property
    def quantile_summary(self) -> DataFrame:
        realized = self._positions.join(self._table.select("t", "ticker", "realized"), ["t", "ticker"], "left")
        return rk.quantile_summary(realized, self._info)

    @cached_property
    def _residual_scores(self) -> DataFrame:
        return rs.residual_zscores(materialize(rs.residuals(self._x, self._f, self.names)))

    @property
    def residuals(self) -> DataFrame:
        return self._residual_scores.select("date", "ticker", "residual", "residual_zscore")

    @property
    def outliers(self) -> DataFrame:
        return rs.outliers(self._residual_scores, self.cfg.residual_outlier_z_threshold)

    @property
    def risk_summary(self) -> DataFrame:
        return rk.risk_summary(self.book, self.daily, self.days.agg(F.max("t")).first()[0])

    @property
    def metadata(self) -> DataFrame:
        return _metadata(self.days, self._panel, self.names, self.cfg)


def _slice_calendar(cal: DataFrame, cfg: BacktestConfig) -> DataFrame:
    days = date_slice(cal, cfg.start_date, cfg.end_date)
    first = days.agg(F.min("t")).first()[0]
    if first is None:
        raise ValueError(f"no dates overlap {cfg.start_date}..{cfg.end_date}")
    return materialize(days.withColumn("t0", F.col("t")).withColumn("t", (F.col("t") - first).cast("int")))


def scored_panel(
    exposures: DataFrame, pred: DataFrame, names: list[str], bars: DataFrame, meta: DataFrame | None, cfg: BacktestConfig,
) -> DataFrame:
    """Exposures with alpha, contributions, the point-in-time mask and the raw price and liquidity."""
    x = exposures
    if cfg.use_point_in_time_universe and meta is not None:
        x = point_in_time(x, meta).drop("pit_ok")
    alpha = score(x, pred, names, mask=None, contributions=True, out="alpha")
    quotes = bars.select("ticker", "t", F.col("close").alias("price"), (F.col("close") * F.col("volume")).alias("dollar_volume"))
    return alpha.join(quotes, ["ticker", "t"], "left")


def capped_targets(
    weighted: DataFrame, cal: DataFrame, cfg: BacktestConfig, portfolio: str = "main"
) -> DataFrame:
    """Targets after the turnover cap (a recursion over days) and the price floor."""
    if cfg.turnover_cap is None:
        return pf.apply_price_floor(weighted, cfg.min_price)
    ok = (
        F.coalesce(F.col("price") >= cfg.min_price, F.lit(False)) if cfg.min_price > 0 else F.lit(True)
    )
    targets = weighted.select(F.lit(portfolio).alias("portfolio_id"), "t", "ticker", "weight", ok.alias("price_ok"))
    book, _ = run_book(targets, cal, cfg, risk=False, floor=cfg.min_price > 0)
    held = book.select("t", "ticker", F.col("weight").alias("__w"))
    # A carried name may have no row on a day; it then appears as an extra row.
    return weighted.drop("weight").join(held, ["t", "ticker"], "full_outer").withColumn(
        "weight", F.coalesce("__w", F.lit(0.0))
    ).drop("__w")


def run_backtest(
    exposures: DataFrame, factor_returns: DataFrame, names: list[str], cal: DataFrame, bars: DataFrame,
    cfg: BacktestConfig, meta: DataFrame | None = None, adjusted_bars: DataFrame | None = None,
    check: bool = True,
) -> BacktestTables:
    """Signal at the close of t, trade at the open of t+1.

    `bars` are the raw execution bars with t; `adjusted_bars`, when given, give
    the returns. Forecasts use the full history before the date slice is taken.
    """
    cfg.validate()
    if check:
        check_dates(cal, cfg.forecast_method)
    pred = materialize(
        predict_factor_returns(factor_returns, cfg.forecast_method, cfg.lookback, cfg.ewma_halflife, cfg.min_periods)
    )
    days = _slice_calendar(cal, cfg)
    shift = days.select("date", "t")
    on_slice = lambda df: df.drop("t").join(F.broadcast(shift), "date")
    x, pred, f, px = on_slice(exposures), on_slice(pred), on_slice(factor_returns), on_slice(bars)
    # The quotes are read for prices and liquidity here and for fills below.
    px = materialize(px.select("ticker", "t", "open", "close", "volume"))
    adj = on_slice(adjusted_bars) if adjusted_bars is not None else None
    days = shift

    panel = materialize(scored_panel(x, pred, names, px, meta, cfg))
    weighted, info = pf.rank_weights(panel, cfg)
    targets = materialize(capped_targets(materialize(weighted), days, cfg))
    side_counts = targets.groupBy("t").agg(
        F.count_if(F.col("weight") > 0).alias("final_number_long"), F.count_if(F.col("weight") < 0).alias("final_number_short")
    )
    info = days.join(F.broadcast(info), "date").join(F.broadcast(side_counts), "t", "left").drop("t")

    filled = execution_returns(targets, px, days, cfg, adj)
    table = materialize(filled.table)
    if check:
        filled.check()
    book, scales = run_book(
        table.select(F.lit("main").alias("portfolio_id"), "t", "ticker", "weight", "realized", F.lit(False).alias("price_ok")),
        days, cfg, risk=True,
    )
    book = book.select("t", "ticker", "weight")
    priced = book.join(table.select("t", "ticker", "realized"), ["t", "ticker"], "left")
    daily = (
        perf.gross_returns(priced, days)
        .join(F.broadcast(pf.turnover(book, days).select("t", "turnover")), "t")
        .join(F.broadcast(perf.exposures_by_day(book, days).drop("date")), "t")
        .join(F.broadcast(scales.select("t", *SCALES)), "t", "left")
    )
    daily = perf.portfolio_pnl(daily, cfg)
    # The equity of the book's own drawdown column and the reported curve differ; keep both.
    curve = perf.equity_curve(daily.withColumnRenamed("drawdown", "__dd"))
    nxt = days.select((F.col("t") - 1).alias("t"), F.col("date").alias("execution_date"))
    daily = materialize(
        curve.join(F.broadcast(nxt), "t", "left").select(
            F.col("date").alias("signal_date"), "t", "execution_date",
            session_time("date", 16).alias("signal_timestamp"), session_time("execution_date", 9, 30).alias("execution_timestamp"),
            "portfolio_return", (F.col("equity") - 1).alias("cumulative_return"), "turnover",
            (F.col("turnover") * 2).alias("traded_notional"), "transaction_cost", "turnover_penalty", "gross_exposure",
            "net_exposure", "long_exposure", "short_exposure", "number_long", "number_short",
            *[F.col("__dd").alias("drawdown") if s == "drawdown" else F.col(s) for s in SCALES],
        )
    )

    return BacktestTables(
        cfg, days, names, panel, info, table, book, daily, x, f, pred,
        point_in_time_warnings(meta) if cfg.use_point_in_time_universe else [],
    )


def _metadata(days: DataFrame, panel: DataFrame, names: list[str], cfg: BacktestConfig) -> DataFrame:
    """One row: date range, universe sizes, finite share per factor."""
    rng = days.agg(F.min("date").alias("data_start_date"), F.max("date").alias("data_end_date"), F.max("t").alias("__lt"))
    sizes = panel.agg(
        F.countDistinct("ticker").alias("universe_size_raw"),
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.avg(is_finite(n).cast("double")) for n in names])
        ).alias("finite_fraction_by_factor"),
    )
    late = attach_row(panel, rng.select("__lt"))
    at = lambda back: F.col("t") == F.col("__lt") - back
    last = late.agg(
        F.count_if(at(1) & is_finite("alpha")).alias("universe_size_after_filters"),
        F.count_if(at(0) & ~F.col("tradable")).alias("excluded_tickers_latest"),
    )
    out = attach_row(attach_row(rng.drop("__lt"), sizes), last)
    return out.withColumn("forecast_method", F.lit(cfg.forecast_method)).withColumn("lookback", F.lit(cfg.lookback))


def write_daily_report(tables: BacktestTables, root: str, signal_date: str) -> None:
    """CSV per table for one signal date plus JSON summaries."""
    write_csv_report(
        {
            "orders": tables.orders, "target_positions": tables.target_positions,
            "current_positions": tables.current_positions, "factor_returns": tables.factor_report,
            "alpha_rankings": tables.alpha_rankings, "quantile_summary": tables.quantile_summary,
            "residuals": tables.residuals, "outliers": tables.outliers, "execution_quality": tables.execution_quality,
        },
        root, signal_date,
    )
    write_json(tables.risk_summary, f"{root}/{signal_date}/risk_summary")
    write_json(tables.metadata, f"{root}/{signal_date}/metadata")


def assert_signal_date(cal: DataFrame, signal_date: str, bars: DataFrame | None = None) -> int:
    """The ordinal of the signal date, which must be the last processed date and covered by bars."""
    day = F.to_date(F.lit(signal_date))
    r = cal.agg(
        F.max(F.when(F.col("date") == day, F.col("t"))).alias("t"), F.min("date").alias("a"), F.max("date").alias("z"),
    ).first()
    if r["t"] is None:
        raise RuntimeError(f"refusing: signal date {signal_date} is not processed (range {r['a']}..{r['z']})")
    if str(r["z"]) != signal_date:
        raise RuntimeError(f"refusing: processed data end {r['z']}, not the requested {signal_date}")
    if bars is not None:
        last = bars.agg(F.max("date")).first()[0]
        if last is None or str(last) < signal_date:
            raise RuntimeError(f"refusing: bars end {last}, before {signal_date}")
    return r["t"]


@dataclass
class DayPlan:
    alpha_rankings: DataFrame
    target_positions: DataFrame
    current_positions: DataFrame
    factor_report: DataFrame
    quantile_summary: DataFrame
    orders: DataFrame
    residuals: DataFrame
    outliers: DataFrame


def after_close_plan(
    exposures: DataFrame, factor_returns: DataFrame, names: list[str], cal: DataFrame, bars: DataFrame,
    cfg: BacktestConfig, signal_date: str, company: DataFrame | None = None,
) -> DayPlan:
    """Order plan of one signal date; the current book is yesterday's recomputed target.

    Only two days of exposures and bars are read.
    """
    t = assert_signal_date(cal, signal_date, bars)
    pred = materialize(
        predict_factor_returns(factor_returns, cfg.forecast_method, cfg.lookback, cfg.ewma_halflife, cfg.min_periods)
    )
    two = F.col("t").isin(t - 1, t)
    panel = materialize(scored_panel(exposures.where(two), pred.where(two), names, bars.where(two), None, cfg))
    weighted, info = pf.rank_weights(panel, cfg)
    weighted = materialize(weighted)
    now = weighted.where(F.col("t") == t).select("ticker", F.col("weight").alias("__w"))
    before = weighted.where(F.col("t") == t - 1).select("ticker", F.col("weight").alias("__p"))
    both = before.join(now, "ticker", "full_outer").na.fill(0.0)
    if cfg.turnover_cap is not None:
        turn = both.agg(0.5 * F.sum(F.abs(F.col("__w") - F.col("__p")))).first()[0] or 0.0
        if turn > cfg.turnover_cap and turn > 0:
            both = both.withColumn("__w", F.col("__p") + (F.col("__w") - F.col("__p")) * (cfg.turnover_cap / turn))
    both = both.where("__w <> 0 OR __p <> 0")
    day = cal.where(F.col("t") == t).select("t", "date")
    full = attach_row(
        panel.where(F.col("t") == t).drop("t", "date").join(both, "ticker", "full_outer")
        .withColumns({"weight": F.coalesce("__w", F.lit(0.0)), "previous_weight": F.coalesce("__p", F.lit(0.0))})
        .drop("__w", "__p"),
        day,
    )
    full = pf.apply_price_floor(full, cfg.min_price)
    full = materialize(full.withColumns({f"c_{n}": F.coalesce(f"c_{n}", F.lit(0.0)) for n in names}))
    rankings = materialize(rk.alpha_rankings(full, names, cfg, company))
    resid = rs.recent_residuals(exposures, factor_returns, names, t)
    orders = rankings.where("side <> ''")
    realized = full.withColumn("realized", F.lit(None).cast("double"))
    return DayPlan(
        rankings, rk.target_positions(rankings), rk.current_positions(rankings),
        factor_report(factor_returns, pred, t), rk.quantile_summary(realized, info), orders,
        resid.select("date", "ticker", "residual", "residual_zscore"),
        rs.outliers(resid, cfg.residual_outlier_z_threshold),
    )


def mark_next_open(spark, root: str, execution_date: str) -> DataFrame:
    """Stamp the newest stored order plan with its execution date; nothing is recomputed."""
    fs_root = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_root.getFileSystem(spark._jsc.hadoopConfiguration())
    plans = sorted(
        str(s.getPath().getName()) for s in fs.listStatus(fs_root) if path_exists(spark, f"{root}/{s.getPath().getName()}/orders")
    )
    if not plans:
        raise FileNotFoundError(f"no order plans under {root}")
    folder = f"{root}/{plans[-1]}"
    quality = spark.read.option("header", True).csv(f"{folder}/execution_quality")
    marked = materialize(quality.withColumn("date", F.lit(execution_date)))
    marked.write.mode("overwrite").option("header", True).csv(f"{folder}/execution_quality")
    return marked

