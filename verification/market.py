"""Scans, calendar and universe operators, price factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaweave.functions import (
    business_days, floor_to_interval, is_business_day, label_or_placeholder, millis_to_timestamp, padded_limit,
    round_to_tick, session_time, signed_sqrt, truthy, whole_shares,
)
from alphaweave.operators import keyed, universe as uni
from alphaweave.operators.price_factors import price_factors, with_forward_return
from alphaweave.schemas import GROUPED_DAILY, TICKER_REFERENCE
from alphaweave.sources import adapters, bars as src, vendor

from . import oracle_base as b
from .inputs import month_bars, month_panel, rounded, week_panel
from .registry import query

BAR_COLS = "open, high, low, close, volume, vwap, transactions"
R = b.rnd(["open", "high", "low", "close", "volume", "vwap", "transactions"], 6)


@query("scan_month_bars", f"WITH {b.MONTH_BARS} SELECT ticker, date, {R} FROM bars")
def scan_month_bars(spark, sf):
    return rounded(month_bars(spark, sf), 6)


@query("scan_week_bars", f"WITH {b.WEEK_BARS} SELECT ticker, date, {R} FROM bars")
def scan_week_bars(spark, sf):
    return rounded(adapters.bars_brand_week(spark, sf), 6)


@query(
    "bars_on_date",
    f"WITH {b.MONTH_BARS} SELECT t.ticker, {R} FROM (SELECT DISTINCT ticker FROM bars) t "
    "LEFT JOIN (SELECT * FROM bars WHERE date = DATE '1998-03-01') USING (ticker)",
)
def bars_on_date(spark, sf):
    """One day's bars over the whole ticker dimension."""
    bars = month_bars(spark, sf)
    day = keyed.keep_last(bars.where(F.col("date") == F.to_date(F.lit("1998-03-01"))), ["ticker"], ["date"])
    return rounded(bars.select("ticker").distinct().join(day.drop("date"), "ticker", "left"), 6)


@query(
    "bars_date_range",
    f"WITH {b.MONTH_BARS} SELECT strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date FROM bars",
)
def bars_date_range(spark, sf):
    return src.bars_date_range(month_bars(spark, sf))


GROUPED_SQL = f"WITH {b.MONTH_BARS} SELECT date, ticker, {R} FROM bars"


def grouped_responses(spark, sf):
    """The month bars as JSON responses of the price vendor, one per ticker, parsed with its schema."""
    bars = month_bars(spark, sf)
    item = F.struct(
        F.col("ticker").alias("T"), F.unix_millis(F.col("date").cast("timestamp")).alias("t"), F.col("open").alias("o"),
        F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"),
        F.col("vwap").alias("vw"), F.col("transactions").alias("n"),
    )
    # A response holds one ticker's bars, bounded by the calendar.
    text = bars.groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("json"))
    return text.select(F.from_json("json", GROUPED_DAILY).alias("r")).select("r.results")


@query("grouped_daily_json", GROUPED_SQL)
def grouped_daily_json(spark, sf):
    return rounded(vendor.parse_grouped_daily(grouped_responses(spark, sf)), 6)


@query(
    "grouped_daily_range",
    f"WITH {b.MONTH_BARS} SELECT date, ticker, {R} FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' "
    "AND isodow(date) <= 5",
)
def grouped_daily_range(spark, sf):
    return rounded(vendor.parse_grouped_daily_range(grouped_responses(spark, sf), "1996-01-01", "1999-12-31"), 6)


ALL_META = """meta AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS name,
    CASE WHEN s_suppkey % 7 = 3 THEN NULL WHEN s_suppkey % 7 = 5 THEN 'ETF' ELSE 'CS' END AS type,
    CASE WHEN s_suppkey % 3 <> 0 THEN CAST(DATE '1995-06-01' + CAST((s_suppkey * 37) % 900 AS INTEGER) AS DATE) END AS listed,
    CASE WHEN s_suppkey % 5 = 1 THEN CAST(DATE '1998-06-01' + CAST((s_suppkey * 53) % 1000 AS INTEGER) AS DATE) END AS delisted
  FROM supplier)"""
# The point-in-time queries meet tickers without any metadata.
META_CTE = ALL_META.replace("FROM supplier)", "FROM supplier WHERE s_suppkey % 11 <> 7)")


@query(
    "ticker_reference_json",
    f"WITH {ALL_META} SELECT ticker, name, type, delisted IS NULL AS active, strftime(listed, '%Y-%m-%d') AS list_date, "
    "strftime(delisted, '%Y-%m-%d') AS delisted_utc FROM meta WHERE type IS NULL OR type IN ('CS', 'Common Stock', 'COMMON')",
)
def ticker_reference_json(spark, sf):
    """Active and inactive responses parsed, filtered to common stock and merged; active rows win."""
    meta = adapters.supplier_meta(spark, sf)
    one = meta.select(F.to_json(F.struct(F.array(F.struct(*meta.columns)).alias("results"))).alias("json"))
    parsed = vendor.parse_ticker_reference(
        one.select(F.from_json("json", TICKER_REFERENCE).alias("r")).select("r.results")
    )
    inactive = parsed.withColumn("active", F.lit(False)).withColumn("name", F.lit("stale"))
    return vendor.merge_ticker_status(parsed.where("active"), inactive.where("delisted_utc IS NOT NULL").unionByName(
        parsed.where("NOT active")
    ).where("name <> 'stale' OR active"))


@query(
    "dimension_labels",
    "SELECT p_partkey AS position, CASE WHEN p_partkey % 5 = 0 THEN 'missing_ticker_' || CAST(p_partkey AS VARCHAR) "
    "ELSE p_brand END AS ticker FROM part",
)
def dimension_labels(spark, sf):
    part = adapters.table(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit("  ")).otherwise(F.col("p_brand"))
    return part.select(F.col("p_partkey").alias("position"), label_or_placeholder(raw, "ticker", F.col("p_partkey")).alias("ticker"))


@query("calendar_ordinals", f"WITH {b.MONTH_BARS}, {b.CAL} SELECT date, t FROM cal")
def calendar_ordinals(spark, sf):
    return uni.calendar(month_bars(spark, sf))


@query(
    "tradable_mask",
    f"WITH {b.MONTH_BARS} SELECT ticker, date, close > 0 AND v > 0 AS tradable FROM "
    "(SELECT *, CASE WHEN transactions = 1 THEN 0 ELSE volume END AS v FROM bars)",
)
def tradable_mask(spark, sf):
    bars = month_bars(spark, sf).withColumn("volume", F.expr("CASE WHEN transactions = 1 THEN 0D ELSE volume END"))
    return uni.with_tradable(uni.with_adj_close(bars)).select("ticker", "date", "tradable")


PIT = f"""WITH {b.MONTH_BARS}, {META_CTE}, pit AS (
  SELECT b.ticker, b.date, m.ticker IS NOT NULL AND coalesce(b.date >= listed, true) AND coalesce(b.date < delisted, true) AS tradable
  FROM bars b LEFT JOIN meta m USING (ticker))"""


@query("point_in_time_mask", f"{PIT} SELECT * FROM pit")
def point_in_time_mask(spark, sf):
    bars = uni.with_tradable(uni.with_adj_close(month_bars(spark, sf)))
    return uni.point_in_time(bars, adapters.supplier_meta(spark, sf, gaps=True)).select("ticker", "date", "tradable")


@query(
    "point_in_time_stats",
    f"""WITH {b.MONTH_BARS}, {b.CAL}, {META_CTE}, grid AS (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM bars), cal)
SELECT count(DISTINCT g.ticker) FILTER (WHERE listed IS NOT NULL) AS tickers_with_listing_date,
  count(DISTINCT g.ticker) FILTER (WHERE delisted IS NOT NULL) AS tickers_with_delisted_date,
  count(DISTINCT g.ticker) FILTER (WHERE m.ticker IS NULL) AS tickers_missing_metadata,
  count(*) FILTER (WHERE m.ticker IS NULL OR g.date < listed OR g.date >= delisted) AS blocked_observations
FROM grid g LEFT JOIN meta m USING (ticker)""",
)
def point_in_time_stats(spark, sf):
    bars = month_bars(spark, sf)
    return uni.point_in_time_stats(bars.select("ticker"), adapters.supplier_meta(spark, sf, gaps=True), uni.calendar(bars))


@query("active_universe", f"WITH {ALL_META} SELECT ticker FROM meta WHERE delisted IS NULL")
def active_universe(spark, sf):
    return uni.active_universe(adapters.supplier_meta(spark, sf))


@query(
    "restricted_bars",
    f"WITH {b.MONTH_BARS}, {ALL_META} SELECT ticker, count(*) AS n FROM bars WHERE ticker IN "
    "(SELECT ticker FROM meta WHERE delisted IS NULL) AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1",
)
def restricted_bars(spark, sf):
    """Semi join on the universe and an inclusive date slice."""
    bars = uni.restrict_to(month_bars(spark, sf), uni.active_universe(adapters.supplier_meta(spark, sf)))
    return uni.date_slice(bars, "1996-01-01", "1998-12-31").groupBy("ticker").agg(F.count("*").alias("n"))


def rank_sql(days: str, order: str) -> str:
    return f"""WITH {b.MONTH_BARS}, d AS (SELECT DISTINCT date FROM bars ORDER BY date {order} LIMIT {days})
SELECT ticker, {b.rd('median(close * volume)', 4)} AS dollar_volume FROM bars WHERE date IN (SELECT date FROM d) GROUP BY 1"""


@query("dollar_volume_rank_end", rank_sql("20", "DESC"))
def dollar_volume_rank_end(spark, sf):
    return rounded(uni.dollar_volume_rank(month_bars(spark, sf), 20), 4)


@query(
    "dollar_volume_top_start",
    rank_sql("30", "ASC") + " ORDER BY median(close * volume) DESC, ticker LIMIT 25",
)
def dollar_volume_top_start(spark, sf):
    """Universe head: the 25 largest over the first 30 dates."""
    return rounded(uni.dollar_volume_rank(month_bars(spark, sf), 30, "start", 25), 4)


@query(
    "dense_grid",
    f"WITH {b.MONTH_BARS}, {b.CAL} SELECT g.ticker, g.date, g.t, {b.rd('close', 6)} AS close FROM "
    "(SELECT ticker, date, t FROM (SELECT DISTINCT ticker FROM bars), cal) g LEFT JOIN bars USING (ticker, date)",
)
def dense_grid(spark, sf):
    bars = month_bars(spark, sf)
    return rounded(uni.densify(bars, uni.calendar(bars), bars, ["close"]), 6).select("ticker", "date", "t", "close")


@query(
    "last_non_null_bar",
    f"""SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  {b.rd('last(p ORDER BY k) FILTER (WHERE p IS NOT NULL)', 6)} AS close, {b.rd('last(q ORDER BY k) FILTER (WHERE q IS NOT NULL)', 6)} AS volume
FROM (SELECT l_suppkey, l_shipdate, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice / l_quantity END AS p,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS q,
  (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem)
GROUP BY 1, 2""",
)
def last_non_null_bar(spark, sf):
    """Duplicate rows collapse to the last non-null value per field."""
    l = adapters.table(spark, sf, "lineitem")
    rows = l.select(
        F.expr("concat('S', l_suppkey)").alias("ticker"), F.trunc(F.to_date("l_shipdate"), "month").alias("date"),
        F.expr("CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice / l_quantity END").alias("close"),
        F.expr("CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END").alias("volume"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    return rounded(keyed.last_non_null(rows, ["ticker", "date"], ["close", "volume"], order), 6)


UPSERT = f"""WITH {b.MONTH_BARS}, fresh AS (
  SELECT ticker, date, close * 2 AS close FROM bars WHERE date >= DATE '2001-01-01'
  UNION ALL SELECT 'NEW', date, close FROM bars WHERE ticker = 'S1')
SELECT ticker, date, {b.rd('close', 6)} AS close FROM (
  SELECT * FROM fresh UNION ALL
  SELECT ticker, date, close FROM bars o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.ticker = o.ticker AND f.date = o.date))"""


@query("upsert_bars", UPSERT)
def upsert_bars(spark, sf):
    """Newest row wins per (date, ticker)."""
    bars = month_bars(spark, sf).select("ticker", "date", "close")
    fresh = bars.where("date >= DATE'2001-01-01'").withColumn("close", F.col("close") * 2)
    new = bars.where("ticker = 'S1'").withColumn("ticker", F.lit("NEW"))
    return rounded(keyed.upsert(bars, keyed.union_all([fresh, new]), ["date", "ticker"]), 6)


@query(
    "status_upsert_pending",
    """WITH s AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, s_suppkey AS k FROM supplier)
SELECT ticker, CASE WHEN k % 4 = 0 THEN 'ok' ELSE 'error' END AS status, k % 8 = 7 AS pending FROM s WHERE k % 2 = 0
UNION ALL SELECT ticker, NULL, true FROM s WHERE k % 2 = 1""",
)
def status_upsert_pending(spark, sf):
    """Latest status per ticker, plus the tickers not fetched yet (anti join)."""
    from alphaweave.sources.sinks import upsert_status

    s = adapters.table(spark, sf, "supplier").selectExpr("concat('S', s_suppkey) AS ticker", "s_suppkey AS k")
    old = s.where("k % 2 = 0").selectExpr("ticker", "'error' AS status")
    new = s.where("k % 4 = 0").selectExpr("ticker", "'ok' AS status")
    status = upsert_status(new, old)
    todo = keyed.key_difference(s, status)
    return status.withColumn("pending", F.lit(False)).unionByName(
        todo.selectExpr("ticker", "CAST(NULL AS STRING) AS status", "true AS pending")
    )


@query(
    "key_sets",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM c)
UNION ALL SELECT 'intersection', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM c)
UNION ALL SELECT 'difference', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM c)""",
)
def key_sets(spark, sf):
    o = adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), "o_orderstatus")
    a, c = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")
    parts = [("union", keyed.key_union(a, c)), ("intersection", keyed.key_intersection(a, c)), ("difference", keyed.key_difference(a, c))]
    return keyed.union_all([d.agg(F.count("*").alias("n")).withColumn("op", F.lit(n)) for n, d in parts])


@query(
    "stale_tickers",
    f"WITH {b.MONTH_BARS} SELECT s.ticker, latest FROM (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier) s "
    "LEFT JOIN (SELECT ticker, max(date) AS latest FROM bars GROUP BY 1) USING (ticker) WHERE latest IS NULL OR latest < DATE '2001-11-01'",
)
def stale_tickers(spark, sf):
    s = adapters.table(spark, sf, "supplier").selectExpr("concat('S', s_suppkey) AS ticker")
    return uni.stale_tickers(s, uni.latest_timestamp(month_bars(spark, sf), "date"), "2001-11-01")


@query(
    "normalized_intraday",
    """SELECT timestamp, ticker, round(last(close ORDER BY event_id) * 1.0000000000001e0, 6) + 0e0 AS close FROM (
  SELECT CAST(to_timestamp(floor(epoch(ts) / 900) * 900) AT TIME ZONE 'UTC' AS TIMESTAMP) AS timestamp, 'U' || CAST(user_id AS VARCHAR) AS ticker,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS close, event_id FROM events) GROUP BY 1, 2""",
)
def normalized_intraday(spark, sf):
    """Bad numbers become null, the last row per (timestamp, ticker) wins."""
    e = adapters.table(spark, sf, "events").select(
        floor_to_interval(F.col("ts").cast("timestamp"), 15).alias("timestamp"),
        F.expr("concat('U', user_id)").alias("ticker"),
        F.expr("CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS STRING) END").alias("close"),
        "event_id",
    )
    return rounded(src.normalize_bars(e, ["event_id"]).select("timestamp", "ticker", "close"), 6)


@query(
    "scalar_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS px,
  CAST(trunc((l_discount - 0.05) * 1e6 / l_quantity) AS BIGINT) AS shares,
  round(sign(l_tax - 0.04) * sqrt(abs(l_tax - 0.04)), 8) + 0.0 AS ssq,
  round(CASE WHEN l_linenumber % 2 = 0 THEN ceil(l_extendedprice / 0.05 - 1e-12) * 0.05 ELSE floor(l_extendedprice / 0.05 + 1e-12) * 0.05 END, 2) AS tick,
  isodow(l_shipdate) <= 5 AS business,
  CAST(l_shipdate AS TIMESTAMP) + INTERVAL 16 HOUR AS closes,
  l_returnflag = 'A' AS flag,
  CAST(l_shipdate AS DATE) + 60 AS lagged
FROM lineitem""",
)
def scalar_functions(spark, sf):
    l = adapters.table(spark, sf, "lineitem")
    side = F.when(F.col("l_linenumber") % 2 == 0, "BUY").otherwise("SELL")
    flag = F.when(F.col("l_returnflag") == "A", "True").otherwise("no")
    day = F.to_date("l_shipdate")
    return l.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("px"),
        whole_shares((F.col("l_discount") - 0.05) * 1e6, "l_quantity").alias("shares"),
        (F.round(signed_sqrt(F.col("l_tax") - 0.04), 8) + 0.0).alias("ssq"),
        round_to_tick("l_extendedprice", side, 0.05).alias("tick"),
        is_business_day(day).alias("business"),
        session_time(day, 16).alias("closes"),
        truthy(flag).alias("flag"),
        F.date_add(day, 60).alias("lagged"),
    )


@query(
    "business_day_sequence",
    """SELECT o_orderkey, count(*) FILTER (WHERE isodow(d) <= 5) AS n FROM (
  SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 30, INTERVAL 1 DAY)) AS d FROM orders) GROUP BY 1""",
)
def business_day_sequence(spark, sf):
    o = adapters.table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.select("o_orderkey", F.size(business_days(F.col("d"), F.date_add("d", 30))).cast("long").alias("n"))


@query(
    "epoch_and_limits",
    """SELECT event_id, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts_ms,
  round(round(value * CASE WHEN user_id % 2 = 0 THEN 1.00023717 ELSE 0.99976283 END, 4), 4) AS lim FROM events""",
)
def epoch_and_limits(spark, sf):
    e = adapters.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    side = F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL")
    return e.select("event_id", millis_to_timestamp(F.unix_millis("ts")).alias("ts_ms"), padded_limit("value", side, 2.3717).alias("lim"))


# ---- price factors -------------------------------------------------------------------------


def rolling(fn: str, n: int, obs: int, x: str) -> str:
    return f"CASE WHEN count({x}) {b.w(1 - n, 0)} >= {obs} THEN {fn}({x}) {b.w(1 - n, 0)} END"


FACTOR_SQL: dict[str, str] = {}
for _n in (1, 5, 10, 21, 63, 126, 252):
    FACTOR_SQL[f"mom_{_n}"] = f"close / max(close) {b.w(-_n, -_n)} - 1"
for _n in (10, 20, 63, 126):
    FACTOR_SQL[f"volatility_{_n}"] = rolling("stddev_samp", _n, max(3, _n // 2), "lr")
FACTOR_SQL |= {
    "parkinson_vol_20": f"({rolling('avg', 20, 10, '(ln(high / low) * ln(high / low))')}) / (4 * ln(2))",
    "intraday_return": "close / open - 1",
    "overnight_return": f"open / max(close) {b.w(-1, -1)} - 1",
    "hl_range_20": rolling("avg", 20, 10, "((high - low) / close)"),
    "close_to_high_20": f"close / ({rolling('max', 20, 10, 'high')}) - 1",
    "close_to_low_20": f"close / ({rolling('min', 20, 10, 'low')}) - 1",
    "dist_52w_high": f"close / ({rolling('max', 252, 126, 'high')}) - 1",
    "dist_52w_low": f"close / ({rolling('min', 252, 126, 'low')}) - 1",
    "log_dollar_vol_20": f"ln({rolling('avg', 20, 10, '(close * volume)')})",
    "volume_z_20": f"(volume - ({rolling('avg', 20, 10, 'volume')})) / ({rolling('stddev_samp', 20, 10, 'volume')})",
    "log_dollar_vol_60": f"ln({rolling('avg', 60, 30, '(close * volume)')})",
    "volume_z_60": f"(volume - ({rolling('avg', 60, 30, 'volume')})) / ({rolling('stddev_samp', 60, 30, 'volume')})",
    "volume_mom_20_60": f"({rolling('avg', 20, 10, 'volume')}) / ({rolling('avg', 60, 30, 'volume')}) - 1",
    "amihud_20": f"({rolling('avg', 20, 10, 'abs(lr)')}) / ({rolling('avg', 20, 10, '(close * volume)')}) * 1e6",
    "price_skew_63": rolling("skewness", 63, 30, "lr"),
    "price_kurt_63": rolling("kurtosis", 63, 30, "lr"),
}
LR = f"lrp AS (SELECT *, ln(close) - ln(max(close) {b.w(-1, -1)}) AS lr FROM panel)"


def factor_query(name: str, source: str, factors: list[str]) -> None:
    cte = b.WEEK if source == "week" else b.MONTH
    cols = ", ".join(f"{b.rd(FACTOR_SQL[f])} AS {f}" for f in factors)

    @query(name, f"WITH {cte}, {LR} SELECT ticker, date, {cols} FROM lrp")
    def run(spark, sf):
        panel, _ = week_panel(spark, sf) if source == "week" else month_panel(spark, sf)
        out = price_factors(panel, factors, []).drop("t")
        if "amihud_20" in factors:
            out = out.withColumn("amihud_20", F.col("amihud_20") * 1e6)
        return rounded(out)


factor_query("factors_momentum", "week", [f"mom_{n}" for n in (1, 5, 10, 21, 63, 126, 252)])
factor_query("factors_volatility", "week", ["volatility_10", "volatility_20", "volatility_63", "volatility_126", "parkinson_vol_20"])
factor_query("factors_range", "week", ["intraday_return", "overnight_return", "hl_range_20", "close_to_high_20", "close_to_low_20", "dist_52w_high", "dist_52w_low"])
factor_query("factors_liquidity", "week", ["log_dollar_vol_20", "volume_z_20", "log_dollar_vol_60", "volume_z_60", "volume_mom_20_60", "amihud_20"])
factor_query("factors_shape", "week", ["price_skew_63", "price_kurt_63"])
factor_query("factors_month_wide", "month", ["mom_1", "mom_10", "volatility_20", "volume_z_20", "hl_range_20", "overnight_return"])


@query("forward_returns", f"WITH {b.MONTH} SELECT ticker, date, {b.rd(b.fwd(2, 3.0))} AS fwd_ret FROM panel")
def forward_returns(spark, sf):
    """Two-day-ahead returns, capped at 300% and masked."""
    panel, _ = month_panel(spark, sf)
    return rounded(with_forward_return(panel, 2, 3.0).select("ticker", "date", "fwd_ret"))


@query(
    "masked_factors_finite_ratio",
    f"""WITH {b.MONTH}, {LR}, f AS (SELECT tradable AND volume > 50 AS ok, {b.MOM1} AS mom_1, {FACTOR_SQL['volatility_10']} AS volatility_10 FROM lrp)
SELECT {b.rd('count(mom_1) FILTER (WHERE ok) / count(*)')} AS mom_1, {b.rd('count(volatility_10) FILTER (WHERE ok) / count(*)')} AS volatility_10 FROM f""",
)
def masked_factors_finite_ratio(spark, sf):
    """Mask applied to raw factors, then the finite share per factor."""
    panel, _ = month_panel(spark, sf)
    panel = panel.withColumn("tradable", F.expr("tradable AND volume > 50"))
    raw = uni.apply_mask(price_factors(panel, ["mom_1", "volatility_10"]), ["mom_1", "volatility_10"])
    return rounded(uni.finite_ratio(raw, ["mom_1", "volatility_10"]))


@query("distinct_tickers", f"WITH {b.MONTH_BARS} SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates FROM bars")
def distinct_tickers(spark, sf):
    return month_bars(spark, sf).agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates"))
