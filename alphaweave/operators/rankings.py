"""Report tables: alpha rankings, quantile buckets, orders, risk summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions import (
    factor_json, finite_or_null, group_quantiles, group_rank, is_finite, join_stats, order_side, quantile_bucket,
    sql_is_finite,
)
from .keyed import attach_row

DECILES = [i / 10 for i in range(11)]


def with_buckets(df: DataFrame, value: str = "alpha", small_bucket: int | None = None, key: str = "date", out: str = "quantile_bucket") -> DataFrame:
    """Decile bucket per date with duplicate edges removed.

    Dates with fewer than ten values get `small_bucket`.
    """
    return in_buckets(df, bucket_edges(df, value, key), value, small_bucket, key, out)


def bucket_edges(df: DataFrame, value: str = "alpha", key: str = "date") -> DataFrame:
    return group_quantiles(df, [key], {"x": finite_or_null(value)}, DECILES)


def in_buckets(df: DataFrame, edges: DataFrame, value: str = "alpha", small_bucket: int | None = None, key: str = "date", out: str = "quantile_bucket") -> DataFrame:
    """`df` with the bucket between its date's `edges`."""
    joined = join_stats(df, edges, [key])
    small = F.when(is_finite(value), F.lit(small_bucket).cast("int"))
    bucket = F.when(F.col("x__n") >= 10, quantile_bucket(value, "x__q")).otherwise(small)
    return joined.select(*df.columns, bucket.alias(out))


def with_rank(df: DataFrame, value: str = "alpha", key: str = "date", out: str = "alpha_rank") -> DataFrame:
    """Rank of the finite values, largest first, ties by ticker; other rows have none."""
    finite = group_rank(df.where(is_finite(value)), [key], [F.desc(value), F.asc("ticker")], out)
    rest = df.where(~is_finite(value)).withColumn(out, F.lit(None).cast("int"))
    return finite.unionByName(rest)


def top_contributors(names: list[str], positive: bool, n: int = 3, prefix: str = "c_") -> str:
    """SQL text: names of the n largest contributions of one sign, strongest first."""
    items = ", ".join(
        f"named_struct('a', abs({prefix}{x}), 'k', {i}, 'n', '{x}', 'v', {prefix}{x})" for i, x in enumerate(names)
    )
    sign = ">" if positive else "<"
    return f"transform(slice(sort_array(filter(array({items}), e -> e.v {sign} 0), false), 1, {n}), e -> e.n)"


def alpha_rankings(
    scored: DataFrame, names: list[str], cfg: BacktestConfig, company: DataFrame | None = None, ranks: bool = True,
) -> DataFrame:
    """One row per (signal date, ticker) with position change, cost, rank, bucket, contributors and reason.

    `scored` carries alpha, weight, previous_weight, price, dollar_volume, the
    exposures, `c_<factor>` contributions and `fp_<factor>` forecasts. Without
    `ranks` the columns alpha_rank and quantile_bucket, which need a sort of all
    rows, are left out; orders do not read them.
    """
    df, ranked = scored, ["alpha_rank", "quantile_bucket"] if ranks else []
    if ranks:
        # Ranks first: range partitioning computes its input twice, once for a sample.
        edges = bucket_edges(scored, "alpha")
        df = in_buckets(with_rank(scored, "alpha"), edges, "alpha", None)
    cost = cfg.transaction_cost_bps + cfg.slippage_bps
    df = df.selectExpr(
        "*", "weight - previous_weight AS delta",
        f"CASE WHEN {sql_is_finite('alpha')} THEN (CASE WHEN weight < 0 THEN -alpha ELSE alpha END) * 10000D - {cost!r}D END AS net_bps",
        (f"coalesce({sql_is_finite('price')} AND price >= {cfg.min_price!r}D, false) AS price_flag" if cfg.min_price > 0 else "true AS price_flag"),
        f"coalesce({sql_is_finite('dollar_volume')} AND dollar_volume >= {cfg.min_dollar_volume!r}D, false) AS liquidity_flag",
        f"abs(weight) <= {cfg.max_position_weight + 1e-12!r}D AS risk_flag",
        f"{top_contributors(names, True)} AS top_pos", f"{top_contributors(names, False)} AS top_neg",
    )
    df = df.withColumn("side", order_side("previous_weight", "weight", "delta"))
    if company is not None:
        df = df.join(company.select("ticker", F.col("name").alias("company_name")), "ticker", "left")
    main = (
        "coalesce(nullif(array_join(CASE WHEN weight > 0 THEN top_pos WHEN weight < 0 THEN top_neg "
        "WHEN size(top_pos) > 0 THEN top_pos ELSE top_neg END, ', '), ''), 'the cross-sectional factor mix')"
    )
    place = (
        "CASE WHEN weight > 0 THEN 'top decile' WHEN weight < 0 THEN 'bottom decile' ELSE 'cost-adjusted no-position band' END"
    )
    # Wording and number formats of the reason text.
    reason = (
        "CASE WHEN side = '' THEN '' ELSE format_string('%s because predicted alpha is in the %s. "
        "Net alpha after estimated %.1f bps trading cost is %.2f bps versus threshold %.2f bps. "
        "Main contributors were %s. Price filter %s; liquidity filter %s.', "
        f"side, {place}, {cost!r}D, net_bps, {cfg.min_net_alpha_after_cost_bps!r}D, {main}, "
        "CASE WHEN price_flag THEN 'passed' ELSE 'failed' END, CASE WHEN liquidity_flag THEN 'passed' ELSE 'failed' END) END"
    )
    return df.select(
        F.col("date").alias("signal_date"), "t", "ticker",
        (F.coalesce("company_name", F.lit("")) if company is not None else F.lit("")).alias("company_name"),
        "side",
        F.col("previous_weight").alias("current_weight"), F.col("weight").alias("target_weight"),
        F.col("delta").alias("order_weight_delta"),
        (F.col("delta") * cfg.initial_equity).alias("estimated_order_value"),
        F.col("alpha").alias("alpha_score"),
        F.lit(float(cost)).alias("trading_cost_bps"),
        F.col("net_bps").alias("net_alpha_after_cost_bps"),
        F.lit(float(cfg.min_net_alpha_after_cost_bps)).alias("min_net_alpha_after_cost_bps"),
        F.coalesce(F.col("net_bps") >= cfg.min_net_alpha_after_cost_bps, F.lit(False)).alias("passes_cost_threshold"),
        *ranked,
        F.array_join("top_pos", ";").alias("top_positive_factor_contributors"),
        F.array_join("top_neg", ";").alias("top_negative_factor_contributors"),
        factor_json(names, [F.col(n) for n in names]).alias("factor_exposures"),
        factor_json(names, [F.col(f"fp_{n}") for n in names]).alias("factor_return_forecast_used"),
        factor_json(names, [F.col(f"c_{n}") for n in names]).alias("factor_contributions"),
        F.lit(None).cast("double").alias("residual_score"), F.lit(False).alias("outlier_flag"),
        "price_flag", "liquidity_flag", "risk_flag", F.expr(reason).alias("reason_text"),
    )


POSITION_COLUMNS = [
    "signal_date", "ticker", "target_weight", "current_weight", "order_weight_delta", "alpha_score", "trading_cost_bps",
    "net_alpha_after_cost_bps", "min_net_alpha_after_cost_bps", "passes_cost_threshold", "alpha_rank", "quantile_bucket",
    "price_flag", "reason_text",
]


def target_positions(rankings: DataFrame) -> DataFrame:
    return rankings.select(*POSITION_COLUMNS)


def current_positions(rankings: DataFrame) -> DataFrame:
    return rankings.select("signal_date", "ticker", F.col("current_weight").alias("weight"))


def quantile_summary(scored: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Per date and decile bucket of alpha: counts and averages, with the day's filter numbers.

    `scored` carries alpha, weight, realized and dollar_volume.
    """
    df = with_buckets(scored, "alpha", 1, out="bucket").where("bucket IS NOT NULL")
    out = df.groupBy("date", "bucket").agg(
        F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max"), F.count("*").alias("number_of_stocks"),
        F.avg("alpha").alias("average_alpha"), F.avg(finite_or_null("realized")).alias("average_realized_next_day_return"),
        F.count_if(F.col("weight") > 0).alias("long_selected_count"),
        F.count_if(F.col("weight") < 0).alias("short_selected_count"),
        F.avg(finite_or_null("dollar_volume")).alias("average_liquidity"),
    )
    if info is not None:
        out = join_stats(out, info, ["date"])
    return out.withColumnRenamed("date", "signal_date")


def top_weights(weights: DataFrame, n: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Largest absolute weights; per group a top-n limited before its exchange."""
    if not keys:
        return weights.orderBy(F.desc(F.abs("weight")), "ticker").limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("weight")), "ticker")
    return weights.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def candidates(orders: DataFrame, buys: bool, n: int = 10) -> DataFrame:
    """Best buys by alpha, or worst names to sell."""
    sides = ["BUY", "COVER"] if buys else ["SELL", "SHORT"]
    order = F.desc("alpha_score") if buys else F.asc("alpha_score")
    return orders.where(F.col("side").isin(sides)).orderBy(order, "ticker").limit(n)


def risk_summary(weights: DataFrame, daily: DataFrame, t: int) -> DataFrame:
    """One-row exposure and risk summary of day t; the ten largest weights as a map."""
    day = weights.where(F.col("t") == t)
    w = F.col("weight")
    agg = day.agg(
        F.coalesce(F.sum(F.abs(w)), F.lit(0.0)).alias("gross_exposure"), F.coalesce(F.sum(w), F.lit(0.0)).alias("net_exposure"),
        F.coalesce(F.sum(F.when(w > 0, w)), F.lit(0.0)).alias("long_exposure"),
        F.coalesce(F.sum(F.when(w < 0, w)), F.lit(0.0)).alias("short_exposure"),
        F.count_if(w > 0).alias("number_long"), F.count_if(w < 0).alias("number_short"),
        F.coalesce(F.max(F.abs(w)), F.lit(0.0)).alias("max_position_weight"),
    )
    top = top_weights(day).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "weight"))).alias("top_10_position_weights"))
    keep = [
        c for c in (
            "turnover", "turnover_penalty", "risk_scale", "vol_scale", "var_scale", "drawdown_scale",
            "rolling_volatility_annual", "rolling_daily_var", "drawdown",
        ) if c in daily.columns
    ]
    latest = daily.where(F.col("t") == t).select(*keep)
    r = F.col("portfolio_return")
    whole = daily.agg(
        F.when(F.count(r) >= 2, F.stddev_samp(r) * F.sqrt(F.lit(252.0))).alias("realized_volatility_annual"),
        *([F.max("drawdown").alias("max_drawdown")] if "drawdown" in daily.columns else []),
    )
    out = agg
    for part in (top, whole, latest):
        out = attach_row(out, part)
    out = out.withColumn("leverage", F.col("gross_exposure"))
    return out.withColumnRenamed("turnover", "expected_turnover").withColumnRenamed("drawdown", "current_drawdown")
