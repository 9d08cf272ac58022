"""Live candidates, target weights, orders and order checks.

Tables are per-ticker snapshots. Limits that act on the whole book (gross, net,
turnover) need a few sums of it; those are computed by a distributed
aggregation and applied as constants, so a book of any size stays spread out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LiveConfig, SubmitConfig
from ..functions import finite_or_null, is_finite, padded_limit, safe_double, signed_cap, truthy, whole_shares
from .keyed import align, attach_row, keep_last


def latest_bars(bars: DataFrame, time: str = "timestamp") -> DataFrame:
    """Last bar per ticker with its price and dollar volume."""
    last = keep_last(bars.select("ticker", time, "close", "volume"), ["ticker"], [time])
    return last.select("ticker", F.col("close").alias("price"), (F.col("close") * F.col("volume")).alias("dollar_volume"))


def standardize(alpha: DataFrame) -> DataFrame:
    """Adds z_alpha over the finite alphas (population std; null when flat)."""
    x = finite_or_null("alpha")
    stats = alpha.agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
    z = F.when(F.col("__s") > 1e-12, (F.col("alpha") - F.col("__m")) / F.col("__s"))
    return attach_row(alpha, stats).select(*alpha.columns, z.alias("z_alpha"))


def signal_filter(candidates: DataFrame, bars: DataFrame, cfg: LiveConfig) -> DataFrame:
    """Adds dollar_volume and passes_signal: net alpha, z and liquidity all clear their thresholds."""
    liquid = bars.select("ticker", "dollar_volume")
    ok = (
        (F.abs("alpha") - cfg.cost_return > cfg.min_net_alpha_after_cost_bps / 1e4)
        & (F.abs("z_alpha") > cfg.alpha_z_threshold)
        & (F.col("dollar_volume") >= cfg.min_dollar_volume)
    )
    return candidates.join(liquid, "ticker", "left").withColumn("passes_signal", F.coalesce(ok, F.lit(False)))


def alpha_stats(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.avg("alpha").alias("alpha_mean"), F.stddev_pop("alpha").alias("alpha_std"),
        F.count_if("passes_signal").alias("number_candidates"),
    )


def _sums(weights: DataFrame) -> tuple[float, float, int]:
    r = weights.agg(F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n"), F.count("*").alias("c")).first()
    return r["g"] or 0.0, r["n"] or 0.0, r["c"]


def enforce_limits(weights: DataFrame, cfg: LiveConfig) -> DataFrame:
    """Clip per name, scale gross, spread the net excess evenly, clip and scale again; near-zero names go."""
    cap, gmax, nmax = cfg.max_position_weight, cfg.max_gross_exposure, cfg.max_net_exposure
    clip = lambda c: F.least(F.greatest(c, F.lit(-cap)), F.lit(cap))
    w = weights.where(is_finite("weight")).select("ticker", clip(F.col("weight")).alias("weight"))
    gross, net, n = _sums(w)
    if gross > gmax > 0:
        w = w.withColumn("weight", F.col("weight") * (gmax / gross))
        net *= gmax / gross
    if abs(net) > nmax and gross > 0:
        shift = (net - math.copysign(nmax, net)) / n
        w = w.withColumn("weight", clip(F.col("weight") - shift))
        gross, _, _ = _sums(w)
        if gross > gmax:
            w = w.withColumn("weight", F.col("weight") * (gmax / gross))
    return w.where(F.abs("weight") > 1e-12)


def min_holding(target: DataFrame, current: DataFrame, holding: DataFrame, cfg: LiveConfig) -> DataFrame:
    """Keep the current weight where a young position would be closed or flipped.

    A position of unknown age counts as old enough.
    """
    both = align(current, target).join(holding.select("ticker", "bars_held"), "ticker", "left")
    held = F.coalesce("bars_held", F.lit(cfg.min_holding_period_bars))
    cur, tgt = F.col("current_weight"), F.col("target_weight")
    turn = (tgt == 0) | (F.signum(tgt) != F.signum(cur))
    stay = (F.abs(cur) > 1e-12) & (held < cfg.min_holding_period_bars) & turn
    out = both.select("ticker", F.when(stay, cur).otherwise(tgt).alias("weight"))
    return out.where(F.col("weight") != 0)


def turnover_between(current: DataFrame, target: DataFrame) -> DataFrame:
    return align(current, target).agg(
        F.coalesce(0.5 * F.sum(F.abs(F.col("target_weight") - F.col("current_weight"))), F.lit(0.0)).alias("turnover")
    )


def cap_turnover(current: DataFrame, target: DataFrame, cap: float) -> DataFrame:
    """Move only part of the way when the full move exceeds the cap."""
    both = align(current, target)
    turn = both.agg(0.5 * F.sum(F.abs(F.col("target_weight") - F.col("current_weight")))).first()[0] or 0.0
    if turn <= cap or turn <= 0:
        return target.select("ticker", "weight")
    step = F.col("current_weight") + (F.col("target_weight") - F.col("current_weight")) * (cap / turn)
    return both.select("ticker", step.alias("weight")).where(F.abs("weight") > 1e-12)


def target_portfolio(candidates: DataFrame, current: DataFrame, holding: DataFrame, cfg: LiveConfig) -> DataFrame:
    """Score-proportional targets under all live limits."""
    active = candidates.where("passes_signal").select("ticker", "alpha", F.col("z_alpha").alias("z"))
    if cfg.long_short:
        sums = active.agg(
            F.sum(F.when(F.col("z") > 0, F.col("z"))).alias("__l"), F.sum(F.when(F.col("z") < 0, -F.col("z"))).alias("__s")
        )
        half = cfg.max_gross_exposure / 2
        w = F.when(F.col("z") > 0, F.col("z") / F.col("__l") * half).when(F.col("z") < 0, F.col("z") / F.col("__s") * half)
    else:
        active = active.where("alpha > 0").withColumn("z", F.greatest("z", F.lit(0.0)))
        sums = active.agg(F.sum("z").alias("__l"))
        w = F.when(F.col("__l") > 0, F.col("z") / F.col("__l") * min(cfg.max_gross_exposure, 1.0))
    base = attach_row(active, sums).select("ticker", w.alias("weight")).where("weight IS NOT NULL")
    target = enforce_limits(base, cfg)
    target = enforce_limits(min_holding(target, current, holding, cfg), cfg)
    target = cap_turnover(current, target, cfg.max_turnover_per_rebalance)
    return enforce_limits(target, cfg)


def weights_from_positions(positions: DataFrame, prices: DataFrame, equity: float) -> DataFrame:
    """Shares x price / equity where both are known."""
    if equity <= 0:
        return positions.select("ticker", F.lit(0.0).alias("weight")).limit(0)
    w = F.col("qty") * F.col("price") / F.lit(float(equity))
    return positions.select("ticker", "qty").join(prices.select("ticker", "price"), "ticker").select(
        "ticker", w.alias("weight")
    ).where(is_finite("weight"))


def generate_orders(positions: DataFrame, targets: DataFrame, prices: DataFrame, equity: float, cfg: LiveConfig) -> DataFrame:
    """Whole-share orders toward the targets, with a slippage-padded limit price."""
    book = positions.select("ticker", "qty").join(targets.select("ticker", "weight"), "ticker", "full_outer")
    priced = book.join(prices.select("ticker", "price"), "ticker").where(is_finite("price") & (F.col("price") > 0))
    goal = whole_shares(F.coalesce("weight", F.lit(0.0)) * float(equity), F.col("price"))
    diff = goal - F.coalesce(F.col("qty"), F.lit(0)).cast("long")
    out = priced.withColumn("__d", diff).where(
        (F.col("__d") != 0) & (F.abs(F.col("__d") * F.col("price")) >= cfg.min_order_dollars)
    )
    out = out.withColumn("side", F.when(F.col("__d") > 0, "BUY").otherwise("SELL"))
    return out.select(
        "ticker", "side", F.abs("__d").alias("quantity"), padded_limit("price", "side", cfg.slippage_bps).alias("limit_price"),
        F.lit(cfg.dry_run).alias("dry_run"),
    )


def risk_check(orders: DataFrame, equity: float, max_weight: float) -> DataFrame:
    """Adds notional, ok and reason."""
    notional = F.abs(F.col("quantity") * F.col("limit_price"))
    ok = (F.col("quantity") > 0) & (F.col("limit_price") > 0) & (notional <= equity * max_weight * 1.10)
    return orders.withColumns(
        {"notional": notional, "ok": ok, "reason": F.when(ok, "").otherwise("size_or_price_limit")}
    )


def recheck_targets(saved: DataFrame, cfg: SubmitConfig | None, order: list[str]) -> DataFrame:
    """Saved targets that still clear the thresholds; the last one per ticker, non-zero ones only.

    A zero target is kept through the filters so it can override an earlier one.
    """
    df = saved.withColumn("target_weight", safe_double(F.col("target_weight").cast("string")))
    flat = F.abs("target_weight") <= 1e-12
    if cfg is not None and "alpha_score" in df.columns:
        alpha = safe_double(F.col("alpha_score").cast("string"))
        directional = F.when(F.col("target_weight") >= 0, alpha).otherwise(-alpha)
        df = df.where(flat | (directional >= cfg.alpha_floor))
    if cfg is not None and cfg.min_price > 0 and "price_flag" in df.columns:
        df = df.where(flat | truthy("price_flag"))
    df = df.dropna(subset=["ticker", "target_weight"])
    last = df.groupBy("ticker").agg(F.max_by("target_weight", F.struct(*order)).alias("weight"))
    return last.where(F.abs("weight") > 1e-12)


def drop_low_priced(targets: DataFrame, prices: DataFrame, min_price: float) -> DataFrame:
    """Submission-time floor: a missing price passes."""
    if min_price <= 0:
        return targets
    joined = targets.join(prices.select("ticker", "price"), "ticker", "left")
    return joined.where(F.col("price").isNull() | (F.col("price") >= min_price)).select(*targets.columns)


def plan_prices(plans: list[DataFrame]) -> DataFrame:
    """Last positive price per ticker over plan tables, later tables and rows winning.

    Each plan has ticker, seq and signal_price or execution_price.
    """
    parts = []
    for i, p in enumerate(plans):
        col = next((c for c in ("signal_price", "execution_price") if c in p.columns), None)
        if col is not None:
            parts.append(p.select("ticker", safe_double(F.col(col).cast("string")).alias("price"), F.lit(i).alias("src"), "seq"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("price > 0").groupBy("ticker").agg(F.max_by("price", F.struct("src", "seq")).alias("price"))


def with_fallback_prices(live: DataFrame, fallback: DataFrame) -> DataFrame:
    f = fallback.select("ticker", F.col("price").alias("__f"))
    return live.select("ticker", "price").join(f, "ticker", "full_outer").select(
        "ticker", F.coalesce("price", "__f").alias("price")
    )


def submission_rows(orders: DataFrame, checked: DataFrame, cfg: SubmitConfig, equity_rows: bool = True) -> DataFrame:
    """Order rows with costs and risk flags, cut to `max_orders` in ticker order."""
    out = orders.orderBy("ticker").limit(cfg.max_orders) if cfg.max_orders is not None else orders
    flags = checked.select("ticker", "side", "quantity", F.col("ok").alias("__ok"), F.col("reason").alias("__reason"))
    out = out.join(flags, ["ticker", "side", "quantity"], "left")
    notional = F.abs(F.col("quantity") * F.col("limit_price"))
    return out.select(
        "ticker", "side", "quantity", "limit_price", notional.alias("notional"),
        F.lit("dry_run" if cfg.dry_run else "submitted").alias("order_status"),
        (notional * (cfg.transaction_cost_bps / 1e4)).alias("estimated_transaction_cost"),
        (notional * (cfg.slippage_bps / 1e4)).alias("estimated_slippage_cost"),
        (notional * (cfg.transaction_cost_bps / 1e4) + notional * (cfg.slippage_bps / 1e4)).alias("estimated_total_cost"),
        F.coalesce("__ok", F.lit(True)).alias("risk_ok"), F.coalesce("__reason", F.lit("")).alias("risk_reason"),
    )


def positions_from_fills(fills: DataFrame) -> DataFrame:
    """Signed share sum per ticker."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    return fills.groupBy("ticker").agg(F.sum(signed).alias("qty")).where("qty <> 0")


def dollar_targets(
    weights: DataFrame, equity: float, gross: float = 2.0, max_symbol_pct: float = 0.02, max_side_pct: float = 0.60,
    max_symbols: int = 50,
) -> DataFrame:
    """Legacy sizing: dollars per name, per-name cap, per-side cap, largest names."""
    if gross <= 0:
        raise ValueError("gross must be positive")
    d = weights.where(is_finite("weight") & (F.col("weight") != 0)).select(
        "ticker", signed_cap(F.col("weight") * (equity / gross), equity * max_symbol_pct).alias("dollars")
    )
    side = d.agg(
        F.sum(F.when(F.col("dollars") > 0, F.col("dollars"))).alias("__l"),
        F.sum(F.when(F.col("dollars") < 0, -F.col("dollars"))).alias("__s"),
    )
    cap = equity * max_side_pct
    scale = F.when(F.col("dollars") > 0, F.when(F.col("__l") > cap, cap / F.col("__l")).otherwise(1.0)).otherwise(
        F.when(F.col("__s") > cap, cap / F.col("__s")).otherwise(1.0)
    )
    scaled = attach_row(d, side).select("ticker", (F.col("dollars") * scale).alias("dollars"))
    return scaled.orderBy(F.desc(F.abs("dollars")), "ticker").limit(max_symbols)


def share_plan(dollars: DataFrame, prices: DataFrame, current: DataFrame) -> DataFrame:
    """Share differences between floored targets and current holdings."""
    t = dollars.join(prices.select("ticker", "price"), "ticker").where(is_finite("price") & (F.col("price") > 0))
    t = t.select("ticker", whole_shares("dollars", "price").alias("target_qty")).where("target_qty <> 0")
    both = t.join(current.select("ticker", F.col("qty").cast("long").alias("qty")), "ticker", "full_outer")
    goal, now = F.coalesce("target_qty", F.lit(0)), F.coalesce("qty", F.lit(0))
    return both.select("ticker", now.alias("current_qty"), goal.alias("target_qty"), (goal - now).alias("order_qty")).where(
        "order_qty <> 0"
    )


def next_holding(holding: DataFrame, targets: DataFrame) -> DataFrame:
    """Bars held after a rebalance: kept names age by one, new ones start at 1, dropped ones leave."""
    return targets.select("ticker").join(holding.select("ticker", "bars_held"), "ticker", "left").select(
        "ticker", (F.coalesce("bars_held", F.lit(0)) + 1).cast("int").alias("bars_held")
    )
