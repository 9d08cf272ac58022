"""Cost-aware weights, execution, PnL, reports and residual diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaweave.config import BacktestConfig
from alphaweave.operators import performance as perf
from alphaweave.operators import portfolio as pf
from alphaweave.operators import rankings as rk
from alphaweave.operators import residuals as rs
from alphaweave.operators.book import run_book
from alphaweave.operators.execution import execution_returns, order_costs, order_rollup, target_direction
from alphaweave.operators.forecast import factor_report, predict_factor_returns
from alphaweave.plans.daily import after_close_plan, capped_targets, run_backtest, scored_panel
from alphaweave.session import materialize
from alphaweave.sources import adapters

from . import oracle_base as b
from .inputs import FACTORS, Model, rounded
from .market import META_CTE
from .model import FR
from .registry import query

CFG = BacktestConfig(
    min_names_per_side=3, long_quantile=0.7, short_quantile=0.3, gross_exposure=0.02, max_position_weight=0.0008,
    max_net_exposure=0.001, min_price=700.0, min_dollar_volume=30_000.0, min_alpha_threshold=0.02, max_abs_return=None,
    missing_execution_policy="drop", missing_price_policy="terminal_return", missing_exit_long_return=-0.5,
    missing_exit_short_return=0.5, turnover_penalty_bps=1.0, forecast_method="rolling", min_periods=3,
)


class Desk:
    """Scored panel, targets and execution table shared by the report queries."""

    def __init__(self, spark, sf, cfg: BacktestConfig = CFG):
        self.cfg = cfg
        self.m = Model(spark, sf)
        self.x = self.m.exposures()
        self.f = self.m.factor_returns(self.x)
        self.pred = materialize(
            predict_factor_returns(self.f, cfg.forecast_method, cfg.lookback, cfg.ewma_halflife, cfg.min_periods)
        )
        self.bars = self.m.bars
        self.meta = adapters.supplier_meta(spark, sf, gaps=True)
        self.panel = materialize(scored_panel(self.x, self.pred, FACTORS, self.bars, self.meta, cfg))
        weighted, self.info = pf.rank_weights(self.panel, cfg)
        self.weighted = materialize(pf.apply_price_floor(weighted, cfg.min_price).select("ticker", "date", "t", "weight"))

    def executed(self):
        res = execution_returns(self.weighted.select("ticker", "t", "weight"), self.bars, self.m.cal, self.cfg)
        return materialize(res.table)


PRED = f"{FR}, {b.forecast('rolling', mp=3)}, {b.PWIDE}"
PANEL = f"""{PRED}, {META_CTE}, desk AS (
  SELECT x.ticker, x.date, x.t, x.fwd_ret, {", ".join("x." + n for n in b.FACTORS)}, {", ".join("fp_" + n for n in b.FACTORS)},
    tradable AND m.ticker IS NOT NULL AND coalesce(x.date >= listed, true) AND coalesce(x.date < delisted, true) AS tradable,
    {b.ALPHA_EXPR} AS alpha, close AS price, close * volume AS dollar_volume
  FROM x LEFT JOIN pw USING (t) LEFT JOIN meta m ON m.ticker = x.ticker)"""
FLOOR = max(CFG.min_alpha_threshold, CFG.trading_cost + CFG.min_net_alpha_after_cost_bps / 1e4)
G, CAP, NET, MIN = CFG.gross_exposure, CFG.max_position_weight, CFG.max_net_exposure, CFG.min_names_per_side
TARGET = f"""{PANEL}, fl AS (
  SELECT *, (alpha IS NOT NULL AND tradable) AS base, price >= {CFG.min_price} AS p_ok, dollar_volume >= {CFG.min_dollar_volume} AS l_ok,
    coalesce(abs(alpha) >= {FLOOR!r}, false) AS c_ok FROM desk),
va AS (SELECT *, CASE WHEN base AND p_ok AND l_ok AND c_ok THEN alpha END AS a FROM fl),
cut AS (SELECT date, count(a) AS n, quantile_cont(a, {CFG.short_quantile}) AS lo, quantile_cont(a, {CFG.long_quantile}) AS hi FROM va GROUP BY date),
side AS (SELECT va.*, n, lo, hi, coalesce(n >= {2 * MIN} AND a >= hi, false) AS is_l, coalesce(n >= {2 * MIN} AND a <= lo, false) AS is_s FROM va JOIN cut USING (date)),
cnt AS (
  SELECT date, max(n) AS n, max(lo) AS lo, max(hi) AS hi,
    CASE WHEN count(*) FILTER (WHERE is_l) >= {MIN} THEN count(*) FILTER (WHERE is_l) ELSE 0 END AS nl,
    CASE WHEN count(*) FILTER (WHERE is_s) >= {MIN} THEN count(*) FILTER (WHERE is_s) ELSE 0 END AS ns,
    count(*) FILTER (WHERE NOT base) AS filtered_missing_or_untradable, count(*) FILTER (WHERE base AND NOT p_ok) AS filtered_price,
    count(*) FILTER (WHERE base AND NOT l_ok) AS filtered_liquidity, count(*) FILTER (WHERE base AND NOT c_ok) AS filtered_alpha_threshold
  FROM side GROUP BY date),
w0 AS (
  SELECT s.*, CASE WHEN is_s AND ns > 0 THEN -least({G} / 2 / ns, {CAP}) WHEN is_l AND nl > 0 THEN least(CASE WHEN ns > 0 THEN {G} / 2 ELSE {G} END / nl, {CAP}) ELSE 0 END AS w
  FROM side s JOIN cnt USING (date)),
w1 AS (SELECT *, CASE WHEN sum(abs(w)) OVER d > {G} THEN w * {G} / sum(abs(w)) OVER d ELSE w END AS v FROM w0 WINDOW d AS (PARTITION BY date)),
w2 AS (
  SELECT *, sum(v) OVER d AS net, sum(greatest(v, 0)) OVER d AS pos, sum(greatest(-v, 0)) OVER d AS neg FROM w1 WINDOW d AS (PARTITION BY date)),
weights0 AS (
  SELECT *, CASE WHEN net > {NET} AND v > 0 THEN v * greatest(0, pos - (net - {NET})) / pos
    WHEN net < -{NET} AND v < 0 THEN v * greatest(0, neg - (-{NET} - net)) / neg ELSE v END AS weight FROM w2)"""


@query("cost_aware_weights", f"WITH {TARGET} SELECT ticker, date, {b.rd('weight', 10)} AS weight FROM weights0")
def cost_aware_weights(spark, sf):
    """Eligibility, quantile legs, per-name cap, gross and one-sided net limits."""
    return rounded(Desk(spark, sf).weighted.select("ticker", "date", "weight"), 10)


@query(
    "weight_filter_counts",
    f"""WITH {TARGET} SELECT date, {b.rd(f'CASE WHEN n >= {2 * MIN} THEN hi END')} AS long_threshold_alpha, {b.rd(f'CASE WHEN n >= {2 * MIN} THEN lo END')} AS short_threshold_alpha,
  filtered_missing_or_untradable, filtered_price, filtered_liquidity, filtered_alpha_threshold FROM cnt""",
)
def weight_filter_counts(spark, sf):
    i = Desk(spark, sf).info
    return rounded(
        i.select(
            "date", "long_threshold_alpha", "short_threshold_alpha", "filtered_missing_or_untradable", "filtered_price",
            "filtered_liquidity", "filtered_alpha_threshold",
        )
    )


@query(
    "capped_position_counts",
    f"""WITH {TARGET}, r AS (SELECT *, row_number() OVER (PARTITION BY date, is_l ORDER BY a DESC, ticker) AS rl, row_number() OVER (PARTITION BY date, is_s ORDER BY a, ticker) AS rs FROM side)
SELECT date, CASE WHEN count(*) FILTER (WHERE is_l AND rl <= 4) >= 3 THEN count(*) FILTER (WHERE is_l AND rl <= 4) ELSE 0 END AS n_long,
  CASE WHEN count(*) FILTER (WHERE is_s AND rs <= 3) >= 3 THEN count(*) FILTER (WHERE is_s AND rs <= 3) ELSE 0 END AS n_short FROM r GROUP BY date""",
)
def capped_position_counts(spark, sf):
    """Longs and shorts cut to the strongest few per date."""
    from dataclasses import replace

    d = Desk(spark, sf)
    w, _ = pf.rank_weights(d.panel, replace(CFG, max_positions_long=4, max_positions_short=3))
    return w.groupBy("date").agg(F.count_if(F.col("weight") > 0).alias("n_long"), F.count_if(F.col("weight") < 0).alias("n_short"))


EXEC = f"""{TARGET}, lastt AS (SELECT max(t) AS mt FROM cal),
fill AS (
  SELECT coalesce(b.ticker, w.ticker) AS ticker, coalesce(b.t, w.t) AS t, coalesce(weight, 0) AS weight, b.close AS signal_price
  FROM panel b FULL OUTER JOIN weights0 w ON w.ticker = b.ticker AND w.t = b.t),
px AS (
  SELECT f.*, c.date, f.t + 1 <= mt AS live, e.open AS x_open, e.close AS x_close, o.open AS o_open, e.date AS execution_date,
    CASE WHEN f.t + 1 <= mt THEN CASE WHEN f.t + 2 > mt THEN e.close ELSE o.open END END AS exit_price, mt
  FROM fill f JOIN cal c ON c.t = f.t CROSS JOIN lastt LEFT JOIN panel e ON e.ticker = f.ticker AND e.t = f.t + 1 LEFT JOIN panel o ON o.ticker = f.ticker AND o.t = f.t + 2),
ex AS (
  SELECT ticker, t, date, live, signal_price, x_open AS execution_price, exit_price,
    CASE WHEN NOT live OR (abs(weight) > 1e-12 AND x_open IS NULL) THEN 0 ELSE weight END AS weight,
    CASE WHEN live AND abs(weight) > 1e-12 AND x_open IS NOT NULL AND exit_price IS NULL THEN CASE WHEN weight > 0 THEN -0.5 ELSE 0.5 END
      WHEN live THEN exit_price / x_open - 1 END AS realized
  FROM px)"""


@query(
    "execution_returns",
    f"WITH {EXEC} SELECT ticker, date, {b.rd('weight', 10)} AS weight, {b.rd('execution_price', 6)} AS execution_price, {b.rd('exit_price', 6)} AS exit_price, {b.rd('realized')} AS realized FROM ex",
)
def execution_returns_query(spark, sf):
    """Fill at the next open, exit one day later, terminal return where the exit is missing."""
    t = Desk(spark, sf).executed()
    return rounded(
        t.select("ticker", "date", "weight", "execution_price", "exit_price", "realized"), execution_price=6, exit_price=6, weight=10
    )


PNL = f"""{EXEC}, weights AS (SELECT * FROM ex), {b.TURNOVER}, g AS (
  SELECT t, sum(coalesce(weight * realized, 0)) AS gross_return, count(*) FILTER (WHERE abs(weight) > 0) AS n FROM ex GROUP BY t),
pnl AS (
  SELECT d.date, d.t, turnover, CASE WHEN n > 0 THEN 2 * turnover * {CFG.trading_cost!r} ELSE 0 END AS transaction_cost,
    CASE WHEN n > 0 THEN 2 * turnover * 0.0001 ELSE 0 END AS turnover_penalty,
    CASE WHEN n > 0 THEN gross_return - 2 * turnover * {CFG.trading_cost!r} - 2 * turnover * 0.0001 END AS portfolio_return
  FROM turnover d LEFT JOIN g USING (t))"""


@query("portfolio_pnl", f"WITH {PNL} SELECT date, {b.rnd(['turnover', 'transaction_cost', 'turnover_penalty', 'portfolio_return'])} FROM pnl")
def portfolio_pnl(spark, sf):
    d = Desk(spark, sf)
    t = d.executed()
    daily = perf.gross_returns(t, d.m.cal).join(F.broadcast(pf.turnover(t, d.m.cal).select("t", "turnover")), "t")
    return rounded(perf.portfolio_pnl(daily, CFG).select("date", "turnover", "transaction_cost", "turnover_penalty", "portfolio_return"))


@query(
    "daily_exposures",
    f"""WITH {EXEC} SELECT c.date, {b.rd('coalesce(sum(abs(weight)), 0)')} AS gross_exposure, {b.rd('coalesce(sum(weight), 0)')} AS net_exposure,
  {b.rd('coalesce(sum(greatest(weight, 0)), 0)')} AS long_exposure, {b.rd('coalesce(sum(least(weight, 0)), 0)')} AS short_exposure,
  count(*) FILTER (WHERE weight > 0) AS number_long, count(*) FILTER (WHERE weight < 0) AS number_short FROM cal c LEFT JOIN ex USING (t) GROUP BY c.date""",
)
def daily_exposures(spark, sf):
    d = Desk(spark, sf)
    return rounded(perf.exposures_by_day(d.executed(), d.m.cal).drop("t"))


BUCKETS = """edges AS (SELECT date, count(alpha) AS n, list_distinct(quantile_cont(alpha, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM desk GROUP BY date),
bk AS (SELECT d.*, CASE WHEN alpha IS NULL THEN NULL WHEN n >= 10 THEN 1 + len(list_filter(list_sort(e)[2:-2], lambda q: q < alpha)) END AS quantile_bucket, n FROM desk d JOIN edges USING (date))"""


@query(
    "quantile_summary",
    f"""WITH {EXEC}, {BUCKETS}, j AS (
  SELECT bk.*, CASE WHEN n < 10 THEN 1 ELSE quantile_bucket END AS bucket, ex.weight, ex.realized FROM bk LEFT JOIN ex USING (ticker, t))
SELECT date AS signal_date, bucket, {b.rd('min(alpha)')} AS alpha_min, {b.rd('max(alpha)')} AS alpha_max, count(*) AS number_of_stocks,
  {b.rd('avg(alpha)')} AS average_alpha, {b.rd('avg(realized)')} AS average_realized_next_day_return,
  count(*) FILTER (WHERE weight > 0) AS long_selected_count, count(*) FILTER (WHERE weight < 0) AS short_selected_count,
  {b.rd('avg(dollar_volume)', 4)} AS average_liquidity, max(f.filtered_price) AS filtered_price FROM j JOIN (SELECT date AS fd, filtered_price FROM cnt) f ON f.fd = j.date
WHERE alpha IS NOT NULL GROUP BY date, bucket""",
)
def quantile_summary(spark, sf):
    d = Desk(spark, sf)
    j = d.panel.drop("weight").join(d.executed().select("ticker", "t", "weight", "realized"), ["ticker", "t"], "left")
    q = rk.quantile_summary(materialize(j), d.info)
    return rounded(
        q.select(
            "signal_date", "bucket", "alpha_min", "alpha_max", "number_of_stocks", "average_alpha",
            "average_realized_next_day_return", "long_selected_count", "short_selected_count", "average_liquidity", "filtered_price",
        ),
        average_liquidity=4,
    )


RANKED = f"""{EXEC}, {BUCKETS}, pw2 AS (
  SELECT bk.*, coalesce(e.weight, 0) AS weight, coalesce(p.weight, 0) AS prev FROM bk LEFT JOIN ex e ON e.ticker = bk.ticker AND e.t = bk.t LEFT JOIN ex p ON p.ticker = bk.ticker AND p.t = bk.t - 1),
ranked AS (
  SELECT *, weight - prev AS delta, CASE WHEN alpha IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY alpha DESC NULLS LAST, ticker) END AS alpha_rank,
    CASE WHEN weight - prev > 1e-12 THEN CASE WHEN prev >= 0 THEN 'BUY' ELSE 'COVER' END
      WHEN weight - prev < -1e-12 THEN CASE WHEN weight < 0 THEN 'SHORT' ELSE 'SELL' END ELSE '' END AS side,
    CASE WHEN alpha IS NOT NULL THEN CASE WHEN weight < 0 THEN -alpha ELSE alpha END * 10000 - 3 END AS net_bps,
    [{", ".join(f"{{'a': abs(coalesce({n} * fp_{n}, 0)), 'k': {i}, 'n': '{n}', 'v': coalesce({n} * fp_{n}, 0)}}" for i, n in enumerate(b.FACTORS))}] AS con
  FROM pw2)"""


def ranked_table(spark, sf, ranks: bool = False):
    d = Desk(spark, sf)
    t = d.executed()
    prev = pf.previous_weights(t, d.m.cal).select("t", "ticker", F.col("weight").alias("__w"), "previous_weight")
    full = d.panel.join(prev, ["t", "ticker"], "left").withColumns(
        {"weight": F.coalesce("__w", F.lit(0.0)), "previous_weight": F.coalesce("previous_weight", F.lit(0.0))}
    ).drop("__w")
    # With ranks the table has several readers.
    return d, t, rk.alpha_rankings(materialize(full) if ranks else full, FACTORS, CFG, ranks=ranks)


@query(
    "alpha_rankings",
    f"""WITH {RANKED} SELECT date AS signal_date, ticker, side, {b.rd('prev', 10)} AS current_weight, {b.rd('weight', 10)} AS target_weight,
  {b.rd('delta', 10)} AS order_weight_delta, {b.rd('alpha')} AS alpha_score, {b.rd('net_bps', 6)} AS net_alpha_after_cost_bps,
  coalesce(net_bps >= 5, false) AS passes_cost_threshold, alpha_rank, quantile_bucket,
  array_to_string(list_transform(list_reverse_sort(list_filter(con, lambda c: c.v > 0))[1:3], lambda c: c.n), ';') AS top_positive_factor_contributors,
  array_to_string(list_transform(list_reverse_sort(list_filter(con, lambda c: c.v < 0))[1:3], lambda c: c.n), ';') AS top_negative_factor_contributors,
  coalesce(price >= {CFG.min_price}, false) AS price_flag, coalesce(dollar_volume >= {CFG.min_dollar_volume}, false) AS liquidity_flag FROM ranked""",
)
def alpha_rankings(spark, sf):
    """Report table with sides, ranks, buckets and contributors."""
    _, _, r = ranked_table(spark, sf, ranks=True)
    return rounded(
        r.select(
            "signal_date", "ticker", "side", "current_weight", "target_weight", "order_weight_delta", "alpha_score",
            "net_alpha_after_cost_bps", "passes_cost_threshold", "alpha_rank", "quantile_bucket",
            "top_positive_factor_contributors", "top_negative_factor_contributors", "price_flag", "liquidity_flag",
        ),
        current_weight=10, target_weight=10, order_weight_delta=10, net_alpha_after_cost_bps=6,
    )


@query("alpha_reasons")
def alpha_reasons(spark, sf):
    """Reason texts and JSON maps of the orders."""
    _, _, r = ranked_table(spark, sf)
    return r.where("side <> ''").select(
        "signal_date", "ticker", "reason_text", "factor_exposures", "factor_return_forecast_used", "factor_contributions"
    )


ORDER_SQL = f"""{RANKED}, orders0 AS (
  SELECT r.date, r.ticker, r.side, r.alpha, r.delta, r.weight, e.execution_price, e.exit_price FROM ranked r LEFT JOIN ex e ON e.ticker = r.ticker AND e.t = r.t WHERE side <> '')"""


@query(
    "execution_costs",
    f"""WITH {ORDER_SQL} SELECT date AS signal_date, ticker, side, CAST(CASE WHEN execution_price > 0 THEN trunc(abs(delta) * 100000 / execution_price) ELSE 0 END AS BIGINT) AS planned_quantity,
  {b.rd('abs(delta) * 100000 * 0.0001', 6)} AS transaction_cost, {b.rd('abs(delta) * 100000 * 0.0002', 6)} AS estimated_slippage_cost FROM orders0""",
)
def execution_costs(spark, sf):
    _, t, r = ranked_table(spark, sf)
    prices = t.select("ticker", "t", "execution_price", "exit_price", "execution_date")
    orders = materialize(r.where("side <> ''").join(prices, ["ticker", "t"], "left"))
    costs = order_costs(orders, CFG).select(F.col("date").alias("execution_date"), "ticker", "planned_quantity", "transaction_cost", "estimated_slippage_cost")
    signal = orders.select("signal_date", "execution_date", "ticker", "side")
    # The execution date of the last signal day is null, hence the null-safe join.
    j = signal.join(costs.withColumnRenamed("ticker", "tk").withColumnRenamed("execution_date", "xd"), F.expr("ticker = tk AND execution_date <=> xd"))
    return rounded(j.select("signal_date", "ticker", "side", "planned_quantity", "transaction_cost", "estimated_slippage_cost"), 6)


@query(
    "order_rollups",
    f"""WITH {ORDER_SQL} SELECT side, CASE WHEN weight > 1e-12 THEN 'LONG' WHEN weight < -1e-12 THEN 'SHORT' ELSE 'FLAT' END AS direction,
  count(*) AS orders, count(DISTINCT ticker) AS tickers, {b.rd('sum(abs(delta) * 100000)', 4)} AS notional, {b.rd('sum(abs(delta) * 100000 * 0.0003)', 4)} AS estimated_total_cost
FROM orders0 GROUP BY 1, 2""",
)
def order_rollups(spark, sf):
    """Orders, tickers, notional and cost by side and target direction."""
    _, _, r = ranked_table(spark, sf)
    o = r.where("side <> ''").selectExpr(
        "ticker", "side", f"{target_direction()} AS direction", "abs(estimated_order_value) AS notional",
        "abs(estimated_order_value) * 0.0003D AS estimated_total_cost",
    )
    return rounded(order_rollup(o, ["side", "direction"]), 4)


@query(
    "order_candidates",
    f"""WITH {ORDER_SQL} (SELECT ticker, date AS signal_date, side, {b.rd('alpha')} AS alpha_score FROM orders0 WHERE side IN ('BUY', 'COVER') ORDER BY alpha DESC, ticker LIMIT 10)
UNION ALL (SELECT ticker, date, side, {b.rd('alpha')} FROM orders0 WHERE side IN ('SELL', 'SHORT') ORDER BY alpha, ticker LIMIT 10)""",
)
def order_candidates(spark, sf):
    _, _, r = ranked_table(spark, sf)
    o = materialize(r.where("side <> ''"))
    both = rk.candidates(o, True).unionByName(rk.candidates(o, False))
    return rounded(both.select("ticker", "signal_date", "side", "alpha_score"))


@query(
    "top_weights_by_day",
    f"""WITH {EXEC} SELECT date, ticker, {b.rd('weight', 10)} AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(weight) DESC, ticker) AS rn FROM ex WHERE weight <> 0) WHERE rn <= 5""",
)
def top_weights_by_day(spark, sf):
    t = Desk(spark, sf).executed().where("weight <> 0").select("date", "ticker", "weight")
    return rounded(rk.top_weights(t, 5, ["date"]), 10)


@query("full_backtest_daily", f"""WITH {PNL}, e AS (SELECT *, product(1 + coalesce(portfolio_return, 0)) OVER (ORDER BY t) - 1 AS cum FROM pnl)
SELECT date AS signal_date, {b.rnd(['portfolio_return', 'turnover', 'transaction_cost'])}, {b.rd('cum')} AS cumulative_return FROM e""")
def full_backtest_daily(spark, sf):
    """The whole close-to-next-open backtest without feedback rules."""
    m = Model(spark, sf)
    x = m.exposures()
    res = run_backtest(x, m.factor_returns(x), FACTORS, m.cal, m.bars, CFG, adapters.supplier_meta(spark, sf, gaps=True))
    return rounded(res.daily.select("signal_date", "portfolio_return", "turnover", "transaction_cost", "cumulative_return"))


def risk_cfg():
    from dataclasses import replace

    return replace(
        CFG, turnover_cap=0.004, volatility_target_annual=0.02, max_daily_var=0.002, max_drawdown_limit=0.05,
        drawdown_control_start=0.01, max_leverage_multiplier=1.5, volatility_lookback_days=12, var_lookback_days=24,
    )


R = risk_cfg()
RATE = 2 * (R.transaction_cost_bps + R.slippage_bps + R.turnover_penalty_bps) / 1e4


def recursion(source: str, cfg, risk: bool, floor: bool = False, portfolios: str = "('main', 1e0)") -> str:
    """The book day by day as lists over all names in order; the result is `step`, one row per portfolio and day."""
    floor = str(not floor).lower()
    dot = lambda x: f"list_sum(list_transform(range(1, len(w) + 1), lambda i: {x}))"
    top, low = float(cfg.max_leverage_multiplier), float(cfg.min_risk_scale)
    vol, var = (f"list_slice(nets, -{n}, -1)" for n in (cfg.volatility_lookback_days, cfg.var_lookback_days))
    budget = lambda limit, used: f"CASE WHEN {used} IS NULL OR {used} <= 1e-12 THEN {top} ELSE least({top}, {limit} / {used}) END"
    scales = "1e0 AS vol_scale, 1e0 AS var_scale, 1e0 AS drawdown_scale, 0e0 AS drawdown"
    if risk:
        vol_used = f"CASE WHEN len(nets) >= 2 THEN list_aggregate({vol}, 'stddev_samp') * sqrt(252) END"
        var_used = f"CASE WHEN len(nets) >= 2 THEN greatest(0, -list_aggregate({var}, 'quantile_cont', {round(1 - cfg.var_confidence, 12)})) END"
        drawdown = "greatest(0, 1 - level / top_level)"
        spent = f"({drawdown} - {cfg.drawdown_control_start}) / {cfg.max_drawdown_limit - cfg.drawdown_control_start!r}"
        scales = f"""{budget(cfg.volatility_target_annual, vol_used)} AS vol_scale, {budget(cfg.max_daily_var, var_used)} AS var_scale,
    {top} - {top - low} * greatest(0, least(1, {spent})) AS drawdown_scale, {drawdown} AS drawdown"""
    scale = f"greatest({low}, least(vol_scale, var_scale, drawdown_scale))" if risk else "1e0"
    share = f"CASE WHEN turn > {cfg.turnover_cap} THEN {cfg.turnover_cap} / turn ELSE 1e0 END"
    return f"""
held AS (SELECT DISTINCT ticker FROM {source} WHERE weight <> 0),
day AS (
  SELECT c.t, list(coalesce(e.weight, 0)::DOUBLE ORDER BY h.ticker) AS w, list(coalesce(e.realized, 0)::DOUBLE ORDER BY h.ticker) AS r, list(coalesce(e.ok, {floor}) ORDER BY h.ticker) AS ok
  FROM cal c CROSS JOIN held h LEFT JOIN {source} e ON e.ticker = h.ticker AND e.t = c.t GROUP BY c.t),
step(p, size, t, book, nets, level, top_level, turnover, risk_scale, vol_scale, var_scale, drawdown_scale, drawdown) AS (
  SELECT p, size, -1, list_transform(w, lambda x: 0e0), []::DOUBLE[], 1e0, 1e0, 0e0, 1e0, 1e0, 1e0, 1e0, 0e0 FROM (VALUES {portfolios}) v(p, size), day WHERE t = 0
  UNION ALL
  SELECT p, size, t, next, list_append(nets, net), level * (1 + net), greatest(top_level, level * (1 + net)), turned, risk_scale, vol_scale, var_scale, drawdown_scale, drawdown FROM (
    SELECT *, CASE WHEN {dot('(next[i] <> 0)::INT')} > 0 THEN {dot('next[i] * r[i]')} - turned * {RATE!r} ELSE 0e0 END AS net FROM (
      SELECT *, 0.5 * {dot('abs(next[i] - book[i])')} AS turned FROM (
        SELECT *, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN NOT ok[i] THEN 0e0 WHEN share = 1 THEN w[i] ELSE book[i] + share * (w[i] - book[i]) END) AS next FROM (
          SELECT *, {share} AS share FROM (
            SELECT *, 0.5 * {dot('abs(w[i] - book[i])')} AS turn FROM (
              SELECT * REPLACE (list_transform(w, lambda x: x * size * risk_scale) AS w) FROM (
                SELECT *, {scale} AS risk_scale FROM (
                  SELECT s.p, s.size, d.t, s.book, s.nets, s.level, s.top_level, d.w, d.r, d.ok, {scales} FROM step s JOIN day d ON d.t = s.t + 1))))))))),
named AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS i FROM held)"""


BOOK_SOURCE = "src AS (SELECT t, ticker, weight, CASE WHEN isfinite(realized) THEN realized END AS realized, true AS ok FROM ex)"


@query(
    "risk_controlled_book",
    f"""WITH RECURSIVE {EXEC}, {BOOK_SOURCE}, {recursion('src', R, True)}
SELECT date, {b.rnd(['turnover', 'risk_scale', 'vol_scale', 'var_scale', 'drawdown_scale', 'drawdown'], 7)} FROM step JOIN cal USING (t)""",
)
def risk_controlled_book(spark, sf):
    """Turnover cap and volatility, VaR and drawdown scaling fed back through the book."""
    d = Desk(spark, sf)
    t = d.executed().select(F.lit("main").alias("portfolio_id"), "t", "ticker", "weight", "realized", F.lit(False).alias("price_ok"))
    weights, scales = run_book(t, d.m.cal, risk_cfg(), risk=True)
    turn = pf.turnover(weights, d.m.cal)
    return rounded(turn.join(F.broadcast(scales), "t").select("date", "turnover", "risk_scale", "vol_scale", "var_scale", "drawdown_scale", "drawdown"), 7)


SIZES = {"half": 0.5, "full": 1.0, "double": 2.0}


@query(
    "risk_sweep",
    f"""WITH RECURSIVE {EXEC}, {BOOK_SOURCE}, {recursion('src', R, True, portfolios=', '.join(f"('{p}', {x}e0)" for p, x in SIZES.items()))},
g AS (SELECT s.p, s.t, sum(coalesce(s.book[n.i] * e.realized, 0)) AS gross FROM step s JOIN named n ON true LEFT JOIN src e ON e.ticker = n.ticker AND e.t = s.t GROUP BY 1, 2)
SELECT date, {", ".join(f"{b.rd(f'max(gross) FILTER (WHERE p = {chr(39)}{n}{chr(39)})')} AS gross_{n}, {b.rd(f'max(turnover) FILTER (WHERE p = {chr(39)}{n}{chr(39)})')} AS {chr(34)}{n}{chr(34)}" for n in SIZES)}
FROM step JOIN g USING (p, t) JOIN cal USING (t) GROUP BY date""",
)
def risk_sweep(spark, sf):
    """Several capped books in one run, one group per portfolio."""
    d = Desk(spark, sf)
    t = d.executed().select("t", "ticker", "weight", "realized", F.lit(False).alias("price_ok"))
    books = t.withColumn("portfolio_id", F.explode(F.array(*[F.lit(n) for n in SIZES])))
    books = books.withColumn("weight", F.expr("weight * CASE portfolio_id WHEN 'half' THEN 0.5D WHEN 'full' THEN 1D ELSE 2D END"))
    weights, _ = run_book(books, d.m.cal, risk_cfg(), risk=True)
    held = weights.join(t.select("t", "ticker", "realized"), ["t", "ticker"], "left")
    out = pf.turnover(weights, d.m.cal, ["portfolio_id"]).groupBy("t").pivot("portfolio_id", list(SIZES)).agg(F.first("turnover"))
    for name in SIZES:
        gross = perf.gross_returns(held.where(F.col("portfolio_id") == name), d.m.cal)
        out = gross.select("date", "t", F.col("gross_return").alias(f"gross_{name}")).join(F.broadcast(out), ["t"] if "date" not in out.columns else ["date", "t"])
    return rounded(out.select("date", *[f"gross_{name}" for name in SIZES], *SIZES))


def turnover_cfg():
    from dataclasses import replace

    return replace(CFG, turnover_cap=0.004)


@query(
    "turnover_capped_targets",
    f"""WITH RECURSIVE {TARGET}, src AS (SELECT t, ticker, weight, NULL::DOUBLE AS realized, price >= {CFG.min_price} AS ok FROM weights0), {recursion('src', turnover_cfg(), False, floor=True)}
SELECT t, ticker, {b.rd('book[i]', 10)} AS weight FROM step, named WHERE t >= 0 AND book[i] <> 0""",
)
def turnover_capped_targets(spark, sf):
    """Targets moved towards within a daily turnover cap, shut below the price floor."""
    d = Desk(spark, sf)
    weighted, _ = pf.rank_weights(d.panel, turnover_cfg())
    return rounded(capped_targets(materialize(weighted), d.m.cal, turnover_cfg()).where("weight <> 0").select("t", "ticker", "weight"), 10)


PLAN = f"""{TARGET.replace("tradable AND m.ticker IS NOT NULL AND coalesce(x.date >= listed, true) AND coalesce(x.date < delisted, true) AS tradable", "tradable")}, {BUCKETS},
day AS (
  SELECT bk.*, w.weight, coalesce(p.weight, 0) AS prev, CASE WHEN bk.alpha IS NOT NULL THEN row_number() OVER (ORDER BY bk.alpha DESC NULLS LAST, bk.ticker) END AS alpha_rank
  FROM bk JOIN weights0 w ON w.ticker = bk.ticker AND w.t = bk.t LEFT JOIN weights0 p ON p.ticker = bk.ticker AND p.t = bk.t - 1 WHERE bk.t = (SELECT max(t) FROM cal)
  UNION ALL BY NAME
  SELECT (SELECT max(date) FROM cal) AS date, p.ticker, p.weight AS prev, 0 AS weight FROM weights0 p
  WHERE p.t = (SELECT max(t) - 1 FROM cal) AND p.weight <> 0 AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.ticker = p.ticker AND bk.t = p.t + 1)),
ranked AS (SELECT *, CASE WHEN alpha IS NOT NULL THEN CASE WHEN weight < 0 THEN -alpha ELSE alpha END * 10000 - 3 END AS net_bps FROM day)"""


@query(
    "after_close_targets",
    f"""WITH {PLAN} SELECT date AS signal_date, ticker, {b.rd('weight', 10)} AS target_weight, {b.rd('prev', 10)} AS current_weight, {b.rd('weight - prev', 10)} AS order_weight_delta,
  {b.rd('alpha')} AS alpha_score, {b.rd('net_bps', 6)} AS net_alpha_after_cost_bps, coalesce(net_bps >= 5, false) AS passes_cost_threshold,
  alpha_rank, quantile_bucket, coalesce(price >= {CFG.min_price}, false) AS price_flag FROM ranked""",
)
def after_close_targets(spark, sf):
    """Order plan of the last date against yesterday's recomputed book."""
    m = Model(spark, sf)
    x = m.exposures()
    last = str(m.cal.agg(F.max("date")).first()[0])
    plan = after_close_plan(x, m.factor_returns(x), FACTORS, m.cal, m.bars, CFG, last)
    t = plan.target_positions.select(
        "signal_date", "ticker", "target_weight", "current_weight", "order_weight_delta", "alpha_score",
        "net_alpha_after_cost_bps", "passes_cost_threshold", "alpha_rank", "quantile_bucket", "price_flag",
    )
    return rounded(t, target_weight=10, current_weight=10, order_weight_delta=10, net_alpha_after_cost_bps=6)


@query(
    "factor_report_of_a_day",
    f"""WITH {FR}, {b.forecast('ewma', mp=1).replace('pred AS', 'prevp AS').replace('seen AS', 'seen0 AS').replace('JOIN seen USING', 'JOIN seen0 USING')},
{b.forecast('rolling', mp=3)}, d AS (SELECT max(t) AS s FROM cal),
h AS (SELECT factor, avg(f) AS m, stddev_pop(f) AS sd FROM fr, d WHERE t < s AND t >= s - 252 GROUP BY 1),
l AS (SELECT factor, f AS latest FROM fr WHERE t = (SELECT max(t) FROM fr, d WHERE t < s AND f IS NOT NULL))
SELECT p.factor, {b.rd('latest')} AS latest_estimated_f_t, {b.rd('m')} AS rolling_mean_f, {b.rd('q.f_pred')} AS previous_day_f_hat, {b.rd('p.f_pred - q.f_pred')} AS day_over_day_change,
  {b.rd('CASE WHEN sd > 1e-12 THEN (latest - m) / sd END', 6)} AS zscore_factor_return, {b.rd('p.f_pred')} AS final_f_hat
FROM pred p JOIN d ON p.t = s JOIN h USING (factor) JOIN l USING (factor) JOIN prevp q ON q.factor = p.factor AND q.t = s - 1""",
)
def factor_report_of_a_day(spark, sf):
    m = Model(spark, sf)
    f = m.factor_returns(m.exposures())
    t = m.cal.agg(F.max("t")).first()[0]
    r = factor_report(f, predict_factor_returns(f, "rolling", min_periods=3), t)
    return rounded(
        r.select("factor", "latest_estimated_f_t", "rolling_mean_f", "previous_day_f_hat", "day_over_day_change", "zscore_factor_return", "final_f_hat"),
        zscore_factor_return=6,
    )


# ---- residuals -----------------------------------------------------------------------------

RES = f"""{FR}, fw AS (SELECT t, {", ".join(f"max(f) FILTER (WHERE factor = '{n}') AS f_{n}" for n in b.FACTORS)} FROM fr GROUP BY t),
res AS (SELECT x.date, x.t, x.ticker, fwd_ret AS actual, {" + ".join(f"{n} * coalesce(f_{n}, 0)" for n in b.FACTORS)} AS predicted FROM x LEFT JOIN fw USING (t)),
resid AS (SELECT *, actual - predicted AS residual FROM res),
zr AS (SELECT r.*, CASE WHEN s > 1e-12 THEN (residual - m) / s END AS z FROM resid r JOIN (SELECT date, avg(residual) AS m, stddev_pop(residual) AS s FROM resid GROUP BY date) USING (date))"""


def resid(spark, sf):
    m = Model(spark, sf)
    x = m.exposures()
    return m, materialize(rs.residuals(x, m.factor_returns(x), FACTORS))


@query("residual_zscores", f"WITH {RES} SELECT date, ticker, {b.rd('residual')} AS residual, {b.rd('z')} AS residual_zscore FROM zr")
def residual_zscores(spark, sf):
    _, r = resid(spark, sf)
    return rounded(rs.residual_zscores(r).select("date", "ticker", "residual", "residual_zscore"))


@query(
    "residual_outliers",
    f"WITH {RES} SELECT ticker, date, {b.rd('z')} AS residual_zscore, CASE WHEN z > 0 THEN 'positive_outlier' ELSE 'negative_outlier' END AS side_implication FROM zr WHERE abs(z) >= 3",
)
def residual_outliers(spark, sf):
    _, r = resid(spark, sf)
    return rounded(rs.outliers(rs.residual_zscores(r), 3.0).select("ticker", "date", "residual_zscore", "side_implication"))


@query(
    "recent_residuals",
    f"WITH {RES} SELECT date, ticker, {b.rd('z')} AS residual_zscore FROM zr WHERE t BETWEEN (SELECT max(t) FROM cal) - 30 AND (SELECT max(t) FROM cal) - 1",
)
def recent_residuals(spark, sf):
    m = Model(spark, sf)
    x = m.exposures()
    t = m.cal.agg(F.max("t")).first()[0]
    r = rs.recent_residuals(x, m.factor_returns(x), FACTORS, t)
    return rounded(r.select("date", "ticker", "residual_zscore"))


@query("daily_mse", f"WITH {RES} SELECT date, {b.rd('avg(residual * residual)')} AS daily_mse, count(residual) AS valid_count FROM resid GROUP BY date")
def daily_mse(spark, sf):
    return rounded(rs.daily_mse(resid(spark, sf)[1]))


COVERAGE = "cov AS (SELECT ticker, count(residual) / (SELECT count(*) FROM cal) AS c, avg(residual * residual) AS mse FROM resid GROUP BY ticker)"


@query("ticker_coverage", f"WITH {RES}, {COVERAGE} SELECT ticker, {b.rd('c')} AS finite_residual_fraction, {b.rd('mse')} AS mean_squared_residual, c < 0.9 AS below_coverage_threshold FROM cov")
def ticker_coverage(spark, sf):
    m, r = resid(spark, sf)
    return rounded(rs.ticker_coverage(r, m.cal, 0.9))


@query(
    "residual_summary",
    f"""WITH {RES}, {COVERAGE}, s AS (SELECT residual * residual AS sq FROM resid), dm AS (SELECT c.date, avg(residual * residual) AS mse, count(residual) AS n FROM cal c LEFT JOIN resid r USING (date) GROUP BY 1)
SELECT (SELECT count(*) FROM cal) AS "T", (SELECT count(*) FROM cov) AS "N", {b.rd('(SELECT count(residual) FROM resid) / ((SELECT count(*) FROM cal) * (SELECT count(*) FROM cov))')} AS finite_fraction_of_residual,
  (SELECT {b.rd('avg(sq)')} FROM s) AS mean_squared_residual, (SELECT {b.rd('median(sq)')} FROM s) AS median_squared_residual,
  (SELECT {b.rd('quantile_cont(sq, 0.95)')} FROM s) AS p95_squared_residual, (SELECT {b.rd('quantile_cont(sq, 0.995)')} FROM s) AS p99_5_squared_residual,
  (SELECT {b.rd('max(sq)', 6)} FROM s) AS max_squared_residual, (SELECT arg_max(ticker, mse) FROM cov) AS top_ticker_by_mean_squared_residual,
  (SELECT arg_max(date, mse) FROM dm) AS top_date_by_daily_mse, (SELECT min(n) FROM dm) AS min_daily_valid_count, (SELECT {b.rd('median(n)')} FROM dm) AS median_daily_valid_count,
  (SELECT count(*) FROM cov WHERE c < 0.9) AS low_coverage_ticker_count, (SELECT {b.rd('median(c)')} FROM cov) AS median_ticker_coverage""",
)
def residual_summary(spark, sf):
    m, r = resid(spark, sf)
    s = rs.residual_summary(r, m.cal, 3, 0.9)
    return rounded(
        s.select(
            "T", "N", "finite_fraction_of_residual", "mean_squared_residual", "median_squared_residual", "p95_squared_residual",
            "p99_5_squared_residual", "max_squared_residual", "top_ticker_by_mean_squared_residual", "top_date_by_daily_mse",
            "min_daily_valid_count", "median_daily_valid_count", "low_coverage_ticker_count", "median_ticker_coverage",
        ),
        max_squared_residual=6,
    )


@query(
    "top_residual_events",
    f"WITH {RES} SELECT date, ticker, {b.rd('residual')} AS residual, {b.rd('actual')} AS actual_return FROM resid WHERE residual IS NOT NULL ORDER BY residual * residual DESC, date, ticker LIMIT 100",
)
def top_residual_events(spark, sf):
    return rounded(rs.top_events(resid(spark, sf)[1], 100).select("date", "ticker", "residual", "actual_return"))


@query(
    "mse_spikes",
    f"""WITH {RES}, d AS (SELECT date, avg(residual * residual) AS mse, count(residual) AS n, sum(residual * residual) AS tot FROM resid GROUP BY date HAVING count(residual) > 0 ORDER BY mse DESC, date LIMIT 20),
k AS (SELECT r.date, ticker, residual * residual AS sq, mse, n, tot, row_number() OVER (PARTITION BY r.date ORDER BY residual * residual DESC, ticker) AS rn FROM resid r JOIN d USING (date) WHERE residual IS NOT NULL)
SELECT date, ticker, rn AS rank_within_date, {b.rd('mse')} AS daily_mse, n AS valid_count, {b.rd('sq / tot')} AS contribution_share,
  first_value(ticker) OVER (PARTITION BY date ORDER BY rn) AS max_residual_ticker, {b.rd('sum(sq) OVER (PARTITION BY date) / tot')} AS residual_concentration_ratio FROM k WHERE rn <= 10""",
)
def mse_spikes(spark, sf):
    s = rs.mse_spikes(resid(spark, sf)[1])
    return rounded(
        s.select("date", "ticker", "rank_within_date", "daily_mse", "valid_count", "contribution_share", "max_residual_ticker", "residual_concentration_ratio")
    )


@query(
    "residual_heatmap_cells",
    f"""WITH {RES}, tk AS (SELECT ticker FROM zr GROUP BY 1 HAVING max(abs(z)) IS NOT NULL ORDER BY max(abs(z)) DESC, ticker LIMIT 60),
dy AS (SELECT DISTINCT date FROM zr ORDER BY date DESC LIMIT 30)
SELECT ticker, date, {b.rd('sign(z) * sqrt(abs(z))')} AS cell FROM zr WHERE ticker IN (SELECT ticker FROM tk) AND date IN (SELECT date FROM dy)""",
)
def residual_heatmap_cells(spark, sf):
    m, r = resid(spark, sf)
    return rounded(rs.heatmap_slice(materialize(rs.residual_zscores(r)), m.cal))


@query(
    "residual_heatmap_limit",
    f"WITH {RES} SELECT {b.rd('coalesce(nullif(quantile_cont(sqrt(abs(residual)), 0.995), 0), 1)')} AS \"limit\" FROM resid",
)
def residual_heatmap_limit(spark, sf):
    return rounded(rs.heatmap_limit(resid(spark, sf)[1]))


@query("residual_similarity")
def residual_similarity(spark, sf):
    """Tickers ordered by the leading directions of their residual histories."""
    m, r = resid(spark, sf)
    return rs.similarity_order(r, m.cal)


@query("ticker_order_by_coverage", f"WITH {RES}, {COVERAGE} SELECT ticker, {b.rd('c')} AS finite_residual_fraction FROM cov")
def ticker_order_by_coverage(spark, sf):
    m, r = resid(spark, sf)
    return rounded(rs.coverage_order(r, m.cal).select("ticker", "finite_residual_fraction"))
