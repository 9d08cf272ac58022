"""Bars, filings, metadata and intraday bars derived from the sales-and-events tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lines: DataFrame, ticker: Column, date: Column) -> DataFrame:
    """OHLCV bars by one partially aggregated pass; first/last follow the full row tuple."""
    order = F.struct(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    # The tuple holds what the price is made of, so the least and the largest one are all that is kept.
    bars = lines.groupBy(ticker.alias("ticker"), date.alias("date")).agg(
        F.min(order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max(order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"),
        F.count("*").cast("double").alias("transactions"),
    )
    return bars.withColumns({c: F.col(c)["l_extendedprice"] / F.col(c)["l_quantity"] for c in ("open", "close")})


def bars_supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide cross-section: ticker = supplier, one bar per month."""
    lines = table(spark, sf_dir, "lineitem")
    # First and last rows need a sort by key: that of a number is cheaper than that of the name made from it.
    bars = _bars(lines, F.col("l_suppkey"), F.trunc(F.to_date("l_shipdate"), "month"))
    return bars.withColumn("ticker", F.concat(F.lit("S"), F.col("ticker").cast("string")))


def bars_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long history: ticker = brand, one bar per week."""
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    lines = lines.join(part, "l_partkey")
    return _bars(lines, F.col("brand"), F.trunc(F.to_date("l_shipdate"), "week"))


def supplier_meta(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Ticker metadata with listing periods by arithmetic on the key; with `gaps` some tickers have none at all."""
    s = table(spark, sf_dir, "supplier")
    if gaps:
        s = s.where("s_suppkey % 11 <> 7")
    k = F.col("s_suppkey")
    listed = F.when(k % 3 != 0, F.date_add(F.lit("1995-06-01").cast("date"), ((k * 37) % 900).cast("int")))
    delisted = F.when(k % 5 == 1, F.date_add(F.lit("1998-06-01").cast("date"), ((k * 53) % 1000).cast("int")))
    return s.select(
        F.concat(F.lit("S"), k.cast("string")).alias("ticker"),
        F.col("s_name").alias("name"),
        F.when(k % 7 == 3, F.lit(None)).when(k % 7 == 5, "ETF").otherwise("CS").alias("type"),
        delisted.isNull().alias("active"),
        F.date_format(listed, "yyyy-MM-dd").alias("list_date"),
        F.date_format(delisted, "yyyy-MM-dd").alias("delisted_utc"),
    )


def filing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly filings per supplier as JSON text, with the vendor's irregularities.

    Item names vary by filing, some values cannot be read, some filing dates are
    missing and some quarters are restated later. Amounts are whole units of
    1/10000 so that their text form is exact.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS k", "trunc(to_date(l_shipdate), 'quarter') AS q", "bigint(round(l_extendedprice * 100)) AS px",
        "bigint(round((1 - l_discount) * 100)) AS part", "bigint(round(l_tax * 100)) AS tax", "bigint(l_quantity) AS qty",
    )
    agg = lines.groupBy("k", "q").agg(
        F.expr("sum(px * part) AS rev"), F.expr("sum(px * tax) AS tax"), F.expr("sum(px) AS gross"), F.expr("sum(qty) AS qty")
    )
    rows = agg.selectExpr(
        "*", "explode(CASE WHEN k % 4 = 2 THEN array(0, 1) ELSE array(0) END) AS v", "date_sub(add_months(q, 3), 1) AS e"
    ).selectExpr("*", "rev * (1 + v) AS rv", "k % 13 = 4 AND month(q) = 4 AS bad")
    node = lambda name, amount: (
        f"named_struct('key', {name}, 'value', map('value', CAST({amount} AS STRING), 'unit', 'USD'))"
    )
    fixed = lambda *items: f"map_from_entries(array({', '.join(node(repr(n), a) for n, a in items)}))"
    balance = fixed(
        ("assets", "gross * 300"), ("current_assets", "gross * 100"), ("current_liabilities", "gross * 40 + 10000"),
        ("long_term_debt", "gross * 80"), ("cash", "tax * 2"),
    )
    equity_key = "CASE WHEN k % 3 = 0 THEN 'stockholders_equity' ELSE 'equity' END"
    equity = f"map_from_entries(array({node(equity_key, 'gross * 150')}))"
    income = fixed(
        ("cost_of_revenue", "gross * 60"), ("gross_profit", "rv - gross * 60"), ("operating_income_loss", "rv - gross * 70"),
        ("net_income_loss", "rv - gross * 70 - tax"), ("basic_average_shares", "qty * 10"),
    )
    sales_key = "CASE WHEN k % 3 = 1 AND NOT bad THEN 'sales' ELSE 'revenues' END"
    sales = f"map_from_entries(array({node(sales_key, 'CASE WHEN bad THEN NULL ELSE rv END')}))"
    unreadable = "map('revenues', map('value', 'n/a', 'unit', 'USD'), 'sales', map('value', CAST(rv AS STRING), 'unit', 'USD'))"
    diluted = "map('diluted_average_shares', map('value', CAST(qty * 11 AS STRING), 'unit', 'shares'))"
    none = "map_from_entries(slice(array(named_struct('key', 'x', 'value', map('value', 'x'))), 1, 0))"
    cash_flow = fixed(("net_cash_flow_from_operating_activities", "rv - gross * 65"), ("capital_expenditures", "gross * -5"))
    day = lambda c: f"date_format({c}, 'yyyy-MM-dd')"
    return rows.selectExpr(
        f"""to_json(named_struct(
          'ticker', CASE WHEN k % 10 <> 9 THEN concat('S', k) END, 'tickers', array(concat('S', k)),
          'start_date', {day('q')}, 'end_date', {day('e')},
          'filing_date', CASE WHEN k % 6 <> 5 OR v <> 0 THEN {day('date_add(e, int(20 + k % 40 + v * 100))')} END,
          'timeframe', 'quarterly', 'fiscal_period', concat('Q', quarter(q)), 'fiscal_year', CAST(year(q) AS STRING),
          'financials', named_struct(
            'balance_sheet', map_concat({balance}, {equity}),
            'income_statement', map_concat(
              {income}, CASE WHEN bad THEN {unreadable} ELSE {sales} END, CASE WHEN k % 2 = 0 THEN {diluted} ELSE {none} END),
            'cash_flow_statement', {cash_flow}))) AS json"""
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as intraday ticks: ticker = user, price = value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("value").alias("price"),
        "event_id",
    )
