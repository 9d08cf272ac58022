"""Target weights from scores.

Weights of a date depend on its cross-section only through a handful of per-date
numbers (counts and quantile cuts), so the rules reduce to aggregations plus a
broadcast of one row per date. A window over a whole date is never needed; a
position cap uses a top-n per date, which is limited before its exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions import finite_or_null, group_quantiles, is_finite, join_stats
from .keyed import attach_row


def quantile_long_short(
    scores: DataFrame, quantile: float = 0.10, gross: float = 2.0, min_names: int = 5,
    mask: str | None = "tradable", key: str = "date", score: str = "score",
) -> DataFrame:
    """Adds `weight`: equal-weight top and bottom quantile legs of +/- gross/2, ties included.

    All zero when a date has fewer than 2 x min_names scores or either leg is
    thin; where both legs claim a name the short leg wins.
    """
    if not 0 < quantile < 0.5:
        raise ValueError("quantile must be between 0 and 0.5")
    if gross <= 0:
        raise ValueError("gross must be positive")
    valid = is_finite(score) & (F.col(mask) if mask else F.lit(True))
    df = scores.withColumn("__x", F.when(valid, F.col(score)))
    cuts = group_quantiles(df, [key], {"x": F.col("__x")}, [quantile, 1.0 - quantile])
    is_long, is_short = F.col("__x") >= F.col("x__q")[1], F.col("__x") <= F.col("x__q")[0]
    sides = join_stats(df.select(key, "__x"), cuts, [key]).groupBy(key).agg(
        F.count_if(is_long).alias("n_long"), F.count_if(is_short).alias("n_short")
    )
    stats = cuts.join(F.broadcast(sides), key)
    ok = (F.col("x__n") >= 2 * min_names) & (F.col("n_long") >= min_names) & (F.col("n_short") >= min_names)
    w = F.when(ok & is_short, -gross / 2 / F.col("n_short")).when(ok & is_long, gross / 2 / F.col("n_long")).otherwise(0.0)
    return join_stats(df, stats, [key]).select(*scores.columns, w.alias("weight"))


def _cap_strongest(df: DataFrame, side: str, keep: int | None, alpha: str, key: str) -> DataFrame:
    """Keep only the n strongest candidates of a side per date; ties go to the earlier ticker."""
    if not keep:
        return df
    order = F.desc(alpha) if side == "long" else F.asc(alpha)
    best = (
        df.where(F.col(f"__{side}"))
        .select(key, "ticker", alpha)
        .withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order, "ticker")))
        .where(F.col("__rn") <= keep)
        .select(key, "ticker", F.lit(True).alias("__in"))
    )
    joined = df.join(best, [key, "ticker"], "left")
    return joined.withColumn(f"__{side}", F.coalesce("__in", F.lit(False))).drop("__in")


def eligibility(cfg: BacktestConfig, alpha: str = "alpha") -> dict[str, Column]:
    """Boolean parts of the trading rule: base, price, liquidity, cost threshold."""
    a = F.col(alpha)
    price = is_finite("price") & (F.col("price") >= cfg.min_price) if cfg.min_price > 0 else F.lit(True)
    liquid = is_finite("dollar_volume") & (F.col("dollar_volume") >= cfg.min_dollar_volume)
    return {
        "base": is_finite(a) & F.coalesce(F.col("tradable"), F.lit(False)),
        "price": F.coalesce(price, F.lit(False)),
        "liquidity": F.coalesce(liquid, F.lit(False)),
        "cost": F.coalesce(F.abs(a) >= cfg.alpha_floor, F.lit(False)),
    }


def rank_weights(
    df: DataFrame, cfg: BacktestConfig, alpha: str = "alpha", key: str = "date",
) -> tuple[DataFrame, DataFrame]:
    """Cost-aware quantile legs under position, gross and net limits.

    Returns the input with `weight`, and one row per date of cuts and reject
    counts. Every limit acts on whole legs, so weights are a function of the
    two leg sizes.
    """
    parts = eligibility(cfg, alpha)
    flagged = df.withColumns({f"__{k}": v for k, v in parts.items()})
    valid = F.col("__base") & F.col("__price") & F.col("__liquidity") & F.col("__cost")
    flagged = flagged.withColumn("__x", F.when(valid, F.col(alpha)))
    cuts = group_quantiles(flagged, [key], {"x": F.col("__x")}, [cfg.short_quantile, cfg.long_quantile])
    enough = F.col("x__n") >= 2 * cfg.min_names_per_side
    sided = join_stats(flagged, cuts, [key]).withColumns(
        {
            "__long": F.coalesce(enough & (F.col("__x") >= F.col("x__q")[1]), F.lit(False)),
            "__short": F.coalesce(enough & (F.col("__x") <= F.col("x__q")[0]), F.lit(False)) & F.lit(cfg.allow_short),
        }
    )
    sided = _cap_strongest(sided, "long", cfg.max_positions_long, alpha, key)
    sided = _cap_strongest(sided, "short", cfg.max_positions_short, alpha, key)

    b = F.col("__base")
    counts = sided.groupBy(key).agg(
        F.count_if("__long").alias("__nl"), F.count_if("__short").alias("__ns"),
        # Names a capped leg could share with the other side do not exist: long and short cuts overlap
        # only when the cuts coincide, and then the short leg wins.
        F.count_if(F.col("__long") & F.col("__short")).alias("__both"),
        F.count_if(~b).alias("filtered_missing_or_untradable"),
        F.count_if(b & ~F.col("__price")).alias("filtered_price"),
        F.count_if(b & ~F.col("__liquidity")).alias("filtered_liquidity"),
        F.count_if(b & ~F.col("__cost")).alias("filtered_alpha_threshold"),
        F.first("x__q", ignorenulls=True).alias("__q"), F.first("x__n").alias("__n"),
    )
    m = cfg.min_names_per_side
    nl = F.when(F.col("__nl") >= m, F.col("__nl")).otherwise(0)
    ns = F.when(F.col("__ns") >= m, F.col("__ns")).otherwise(0)
    legs = counts.withColumn("__nl", nl).withColumn("__ns", ns)
    legs = legs.withColumn("__both", F.when((F.col("__nl") > 0) & (F.col("__ns") > 0), F.col("__both")).otherwise(0))
    nl, ns = F.col("__nl"), F.col("__ns")
    g, cap, net_cap = cfg.gross_exposure, cfg.max_position_weight, cfg.max_net_exposure
    leg = F.when(ns > 0, g / 2).otherwise(g)
    wl = F.when(nl > 0, F.least(leg / nl, F.lit(cap))).otherwise(0.0)
    ws = F.when(ns > 0, F.least(F.lit(g / 2) / ns, F.lit(cap))).otherwise(0.0)
    held = nl - F.col("__both")
    gross = held * wl + ns * ws
    shrink = F.when(gross > g, g / gross).otherwise(1.0)
    legs = legs.select("*", (wl * shrink).alias("__wl"), (ws * shrink).alias("__ws"), held.alias("__held"))
    pos, neg = F.col("__held") * F.col("__wl"), F.col("__ns") * F.col("__ws")
    net = pos - neg
    trim_l = F.when((net > net_cap) & (pos > 0), F.greatest(F.lit(0.0), pos - (net - net_cap)) / pos).otherwise(1.0)
    trim_s = F.when((net < -net_cap) & (neg > 0), F.greatest(F.lit(0.0), neg - (-net_cap - net)) / neg).otherwise(1.0)
    legs = legs.withColumns({"__tl": F.col("__wl") * trim_l, "__ts": F.col("__ws") * trim_s})
    w = (
        F.when(F.col("__short") & (F.col("__ns") > 0), -F.col("__ts"))
        .when(F.col("__long") & (F.col("__nl") > 0), F.col("__tl"))
        .otherwise(0.0)
    )
    weights = join_stats(sided, legs.select(key, "__nl", "__ns", "__tl", "__ts"), [key]).select(*df.columns, w.alias("weight"))
    q = lambda i: F.when(F.col("__n") >= 2 * m, F.col("__q")[i])
    info = legs.select(
        key,
        q(1).alias("long_threshold_alpha"), q(0).alias("short_threshold_alpha"),
        F.lit(cfg.alpha_floor).alias("cost_adjusted_alpha_threshold"),
        F.lit(cfg.trading_cost).alias("trading_cost_return"),
        F.lit(cfg.min_net_alpha_after_cost_bps / 10_000.0).alias("min_net_alpha_after_cost"),
        "filtered_missing_or_untradable", "filtered_price", "filtered_liquidity", "filtered_alpha_threshold",
    )
    return weights, info


def apply_price_floor(df: DataFrame, min_price: float, missing_passes: bool = False, weight: str = "weight") -> DataFrame:
    """Zero the weight below the floor. A missing price fails here but passes at submission."""
    if min_price <= 0:
        return df
    ok = F.coalesce(finite_or_null("price") >= min_price, F.lit(missing_passes))
    return df.withColumn(weight, F.when(ok, F.col(weight)).otherwise(0.0))


def turnover(weights: DataFrame, cal: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, date, t, turnover): half the sum of absolute weight changes, first day against zero.

    Works on the non-zero rows only. A position that vanishes is booked on the
    next calendar day, seen from its own row, so no self join is needed and the
    ticker exchange of the earlier windows is reused.
    """
    keys = keys or []
    held = weights.where(F.col("weight") != 0).select(*keys, "ticker", "t", "weight")
    w = Window.partitionBy(*keys, "ticker").orderBy("t")
    prev_t, prev_w, next_t = F.lag("t").over(w), F.lag("weight").over(w), F.lead("t").over(w)
    steps = held.select(
        *keys, "t",
        F.abs(F.col("weight") - F.when(prev_t == F.col("t") - 1, prev_w).otherwise(0.0)).alias("__in"),
        F.when(F.coalesce(next_t, F.lit(-1)) != F.col("t") + 1, F.abs("weight")).otherwise(0.0).alias("__out"),
    )
    moves = steps.select(
        *keys, F.inline(F.array(F.struct(F.col("t"), F.col("__in").alias("m")), F.struct((F.col("t") + 1).alias("t"), F.col("__out").alias("m"))))
    )
    per_day = moves.groupBy(*keys, "t").agg((0.5 * F.sum("m")).alias("turnover"))
    if keys:
        grid = weights.select(*keys).distinct()
        days = cal.agg(F.collect_list(F.struct("t", "date")).alias("__d"))
        base = attach_row(grid, days).select(*keys, F.inline("__d"))
        return base.join(per_day, [*keys, "t"], "left").select(
            *keys, "date", "t", F.coalesce("turnover", F.lit(0.0)).alias("turnover")
        )
    return cal.join(F.broadcast(per_day), "t", "left").select(
        "date", "t", F.coalesce("turnover", F.lit(0.0)).alias("turnover")
    )


def previous_weights(weights: DataFrame, cal: DataFrame, price_key: str = "ticker") -> DataFrame:
    """Rows (ticker, date, t, weight, previous_weight) wherever either side is non-zero."""
    held = weights.where(F.col("weight") != 0).select("ticker", "t", "weight")
    nxt = held.select("ticker", (F.col("t") + 1).alias("t"), F.col("weight").alias("previous_weight"))
    both = held.withColumn("previous_weight", F.lit(0.0)).unionByName(nxt.withColumn("weight", F.lit(0.0)))
    summed = both.groupBy("ticker", "t").agg(F.sum("weight").alias("weight"), F.sum("previous_weight").alias("previous_weight"))
    return summed.join(F.broadcast(cal), "t")
