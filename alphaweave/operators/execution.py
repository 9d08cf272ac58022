"""Close-to-next-open execution: prices, realized returns, policies, costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions import sql_finite, sql_is_finite
from .keyed import attach_row
from .price_factors import _over


@dataclass
class ExecutionResult:
    table: DataFrame
    violations: DataFrame

    def check(self, limit: int = 8) -> ExecutionResult:
        """Raise when an active position breaks a price rule; a broken rule costs a second action for its first samples."""
        found = self.violations.groupBy("rule").agg(F.count("*").alias("n")).collect() if self.violations is not None else []
        for row in found:
            broken = self.violations.where(F.col("rule") == row["rule"]).select("sample").distinct().orderBy("sample").limit(limit)
            raise RuntimeError(f"{row['rule']}: count={row['n']}, sample={', '.join(r['sample'] for r in broken.collect())}")
        return self


def next_dates(cal: DataFrame, holding: int) -> DataFrame:
    """(t, execution_date, exit_date, last_t) per signal day; small, one row per day."""
    last = cal.agg(F.max("t").alias("last_t"))
    exec_ = cal.select((F.col("t") - 1).alias("t"), F.col("date").alias("execution_date"))
    exit_ = cal.select((F.col("t") - 1 - holding).alias("t"), F.col("date").alias("exit_date"))
    return attach_row(
        cal.select("t").join(F.broadcast(exec_), "t", "left").join(F.broadcast(exit_), "t", "left"), last
    )


def execution_returns(
    weights: DataFrame, raw_bars: DataFrame, cal: DataFrame, cfg: BacktestConfig, adjusted_bars: DataFrame | None = None,
) -> ExecutionResult:
    """Signal at t, fill at open[t+1], exit at open[t+1+h]; the last executable
    day of a one-day holding exits at its own close.

    `weights` has (ticker, t, weight); bars have (ticker, t, open, close). Raw
    bars decide whether a trade is possible, adjusted bars what it earned. All
    look-aheads are range frames over one (ticker, t) ordering.
    """
    h = cfg.holding_period_days
    raw = raw_bars.select("ticker", "t", "open", "close")
    both = raw if adjusted_bars is None else raw.join(
        adjusted_bars.select("ticker", "t", F.col("open").alias("a_open"), F.col("close").alias("a_close")),
        ["ticker", "t"], "full_outer",
    )
    if adjusted_bars is None:
        both = both.selectExpr("*", "open AS a_open", "close AS a_close")
    base = both.join(weights.select("ticker", "t", "weight"), ["ticker", "t"], "full_outer")
    at = lambda c, n: _over(f"max({c})", n, n)
    looked = base.selectExpr(
        "ticker", "t", "coalesce(weight, 0D) AS weight", "close AS signal_price",
        f"{at('open', 1)} AS x_open", f"{at('open', 1 + h)} AS o_exit", f"{at('open', h)} AS o_last",
        f"{at('close', 1)} AS c_exec",
        f"{at('a_open', 1)} AS ax_open", f"{at('a_open', 1 + h)} AS ao_exit", f"{at('a_open', h)} AS ao_last",
        f"{at('a_close', 1)} AS ac_exec",
    )
    days = next_dates(cal, h).join(F.broadcast(cal), "t")
    table = looked.join(F.broadcast(days), "t")
    tail = f"t + {1 + h} > last_t"
    live = f"t + {h} <= last_t"
    last_exit = lambda o, c: c if h == 1 else o
    table = table.selectExpr(
        "ticker", "t", "date", "execution_date", "exit_date", "weight", "signal_price", f"{live} AS executable",
        f"CASE WHEN {live} THEN x_open END AS execution_price",
        f"CASE WHEN {live} THEN CASE WHEN {tail} THEN {last_exit('o_last', 'c_exec')} ELSE o_exit END END AS exit_price",
        f"CASE WHEN {live} THEN ax_open END AS r_exec",
        f"CASE WHEN {live} THEN CASE WHEN {tail} THEN {last_exit('ao_last', 'ac_exec')} ELSE ao_exit END END AS r_exit",
    )
    good = lambda c: f"({sql_is_finite(c)} AND {c} > 0)"
    table = table.selectExpr(
        "*",
        f"coalesce({good('execution_price')}, false) AS ok_exec", f"coalesce({good('exit_price')}, false) AS ok_exit",
        f"CASE WHEN {good('execution_price')} AND {good('exit_price')} AND {good('r_exec')} AND {good('r_exit')} "
        "THEN r_exit / r_exec - 1 END AS realized0",
    )
    active = "executable AND abs(weight) > 1e-12"
    rules = []
    if cfg.missing_execution_policy == "fail":
        rules.append(("Missing next-open execution price for active positions", f"{active} AND NOT ok_exec"))
    else:
        table = table.withColumn("weight", F.expr(f"CASE WHEN {active} AND NOT ok_exec THEN 0D ELSE weight END"))
    gone = f"{active} AND ok_exec AND NOT ok_exit"
    realized = "realized0"
    if cfg.missing_price_policy == "fail":
        rules.append(("Missing exit price for active positions", gone))
    else:
        long_, short = (
            (cfg.missing_exit_long_return, cfg.missing_exit_short_return)
            if cfg.missing_price_policy == "terminal_return"
            else (0.0, 0.0)
        )
        realized = f"CASE WHEN {gone} THEN CASE WHEN weight > 0 THEN {long_!r}D ELSE {short!r}D END ELSE realized0 END"
    table = table.withColumn("realized1", F.expr(realized))
    rules.append(
        (
            "Adjusted return price is missing for active positions with valid raw execution prices",
            f"{active} AND ok_exec AND ok_exit AND realized1 IS NULL",
        )
    )
    final = "realized1"
    if cfg.max_abs_return is not None:
        rules.append(
            ("Execution return exceeded max_abs_return for active positions", f"{active} AND abs(realized1) > {cfg.max_abs_return!r}D")
        )
        final = f"CASE WHEN abs(realized1) <= {cfg.max_abs_return!r}D THEN realized1 END"
    broken = "CASE " + " ".join(f"WHEN {cond} THEN '{rule}'" for rule, cond in rules) + " END"
    violations = table.selectExpr(
        f"{broken} AS rule", "concat(date_format(date, 'yyyy-MM-dd'), ':', ticker) AS sample"
    ).where("rule IS NOT NULL")
    out = table.selectExpr(
        "ticker", "t", "date", "execution_date", "exit_date",
        "CASE WHEN executable THEN weight ELSE 0D END AS weight",
        "signal_price", "execution_price", "exit_price", f"{sql_finite(final)} AS realized", "executable",
    )
    return ExecutionResult(out, violations)


def order_costs(orders: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Planned quantity and cost per order, in currency, on the order notional."""
    delta = f"abs(order_weight_delta) * {cfg.initial_equity!r}D"
    return orders.selectExpr(
        "execution_date AS date", "ticker", "side",
        f"CASE WHEN execution_price > 0 THEN coalesce(bigint({delta} / execution_price), 0L) ELSE 0L END AS planned_quantity",
        "execution_price AS planned_price", "exit_price AS close_price",
        f"{cfg.slippage_bps!r}D AS slippage_bps",
        f"{delta} * {cfg.transaction_cost_bps / 1e4!r}D AS transaction_cost",
        f"{delta} * {cfg.slippage_bps / 1e4!r}D AS estimated_slippage_cost",
        f"{delta} * {cfg.transaction_cost_bps / 1e4!r}D + {delta} * {cfg.slippage_bps / 1e4!r}D AS estimated_total_cost",
    ).selectExpr(
        "date", "ticker", "side", "planned_quantity", "planned_quantity AS filled_quantity", "1D AS fill_ratio",
        "planned_price", "planned_price AS average_fill_price", "planned_price AS arrival_price", "close_price",
        "slippage_bps", "transaction_cost", "estimated_slippage_cost", "estimated_total_cost",
        "'order_notional' AS cost_basis", "'filled' AS order_status", "'' AS rejected_reason",
    )


def order_rollup(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Orders, tickers, notional and cost by status, side or target direction."""
    return orders.groupBy(*keys).agg(
        F.count("*").alias("orders"), F.countDistinct("ticker").alias("tickers"),
        F.sum("notional").alias("notional"), F.sum("estimated_total_cost").alias("estimated_total_cost"),
    )


def target_direction(weight: str = "target_weight") -> str:
    return f"CASE WHEN {weight} > 1e-12 THEN 'LONG' WHEN {weight} < -1e-12 THEN 'SHORT' ELSE 'FLAT' END"
