"""Filings, trailing sums, as-of joins and ratio factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaweave.operators import fundamentals as fund
from alphaweave.session import materialize
from alphaweave.sources import adapters, vendor

from . import oracle_base as b
from .inputs import month_panel, rounded
from .registry import query

# The flat filings that the JSON round trip must give back.
FLAT = """agg AS (
  SELECT l_suppkey AS k, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q,
    CAST(sum(px * part) AS BIGINT) AS rev, CAST(sum(px * tax) AS BIGINT) AS tax, CAST(sum(px) AS BIGINT) AS gross, CAST(sum(qty) AS BIGINT) AS qty
  FROM (SELECT l_suppkey, l_shipdate, CAST(round(l_extendedprice * 100) AS BIGINT) AS px,
    CAST(round((1 - l_discount) * 100) AS BIGINT) AS part, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)
  GROUP BY 1, 2),
ver AS (SELECT *, unnest(CASE WHEN k % 4 = 2 THEN [0, 1] ELSE [0] END) AS v FROM agg),
num AS (
  SELECT *, rev * (1 + v) AS rv, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS e FROM ver),
raw_filings AS (
  SELECT 'S' || CAST(k AS VARCHAR) AS ticker, q AS start_date, e AS end_date,
    CASE WHEN k % 6 = 5 AND v = 0 THEN NULL ELSE CAST(e + CAST(20 + k % 40 + v * 100 AS INTEGER) AS DATE) END AS filing_date,
    CASE WHEN k % 13 = 4 AND month(q) = 4 THEN NULL ELSE CAST(rv AS DOUBLE) END AS revenues,
    CAST(gross * 60 AS DOUBLE) AS cost_of_revenue, CAST(rv - gross * 60 AS DOUBLE) AS gross_profit,
    CAST(rv - gross * 70 AS DOUBLE) AS operating_income, CAST(rv - gross * 70 - tax AS DOUBLE) AS net_income,
    CAST(qty * 10 AS DOUBLE) AS shares_basic, CASE WHEN k % 2 = 0 THEN CAST(qty * 11 AS DOUBLE) END AS shares_diluted,
    CAST(gross * 300 AS DOUBLE) AS assets, CAST(gross * 100 AS DOUBLE) AS current_assets, CAST(gross * 40 + 10000 AS DOUBLE) AS current_liabilities,
    CAST(gross * 150 AS DOUBLE) AS equity, CAST(gross * 80 AS DOUBLE) AS debt, CAST(tax * 2 AS DOUBLE) AS cash,
    CAST(rv - gross * 65 AS DOUBLE) AS operating_cash_flow, CAST(gross * -5 AS DOUBLE) AS capex
  FROM num),
flat AS (
  SELECT *, coalesce(filing_date, CAST(end_date + 60 AS DATE)) AS available_date,
    CASE WHEN filing_date IS NULL THEN 'end_date_plus_lag' ELSE 'filing_date' END AS availability_source,
    operating_cash_flow - abs(capex) AS free_cash_flow
  FROM raw_filings)"""

NUMBERS = [
    "revenues", "cost_of_revenue", "gross_profit", "operating_income", "net_income", "shares_basic", "shares_diluted",
    "assets", "current_assets", "current_liabilities", "equity", "debt", "cash", "operating_cash_flow", "capex", "free_cash_flow",
]
FLAT_COLS = "ticker, start_date, end_date, filing_date, available_date, availability_source"


def flat(spark, sf):
    return fund.flatten_filings(fund.parse_filing_json(adapters.filing_json(spark, sf)), 60)


@query("flat_filings", f"WITH {FLAT} SELECT {FLAT_COLS}, {b.rnd(NUMBERS, 1)} FROM flat")
def flat_filings(spark, sf):
    """Nested JSON filings, fallback item names, unreadable values, missing dates."""
    return rounded(flat(spark, sf).select(*FLAT_COLS.split(", "), *NUMBERS), 1)


@query(
    "filings_in_range",
    f"WITH {FLAT} SELECT 'REQ' AS ticker, count(*) AS n FROM raw_filings WHERE filing_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' "
    "AND end_date >= DATE '1996-06-30'",
)
def filings_in_range(spark, sf):
    """Range predicates on filing and report dates; the requested ticker replaces the payload's."""
    raw = fund.parse_filing_json(adapters.filing_json(spark, sf))
    out = vendor.parse_filings(
        raw, "REQ", "quarterly", filed_from="1996-01-01", filed_to="1999-12-31", period_from="1996-06-30"
    )
    return out.groupBy("ticker").agg(F.count("*").alias("n"))


FLOWS = fund.FLOW_COLUMNS


def ttm_sql() -> str:
    sums = ", ".join(
        f"CASE WHEN count({c}) FILTER (WHERE rn <= 4) >= 4 THEN sum({c}) FILTER (WHERE rn <= 4) END AS {c}" for c in FLOWS
    )
    return f"""{FLAT},
vers AS (
  SELECT a.ticker, a.end_date, a.available_date, p.end_date AS period, {", ".join(f"p.{c}" for c in FLOWS)},
    row_number() OVER (PARTITION BY a.ticker, a.end_date, a.available_date, p.end_date ORDER BY p.available_date DESC) AS newest
  FROM flat a JOIN flat p ON p.ticker = a.ticker AND p.end_date <= a.end_date
    AND (p.available_date < a.available_date OR (p.available_date = a.available_date AND p.end_date <= a.end_date))),
per AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, end_date, available_date ORDER BY period DESC) AS rn FROM vers WHERE newest = 1),
ttm AS (
  SELECT ticker, end_date, available_date, least(count(*), 4) AS ttm_quarters_available, {sums}
  FROM per GROUP BY 1, 2, 3)"""


@query(
    "ttm_filings",
    f"WITH {ttm_sql()} SELECT ticker, end_date, available_date, ttm_quarters_available, {b.rnd(FLOWS, 1)}, "
    f"{b.rd('operating_cash_flow - abs(capex)', 1)} AS free_cash_flow FROM ttm",
)
def ttm_filings(spark, sf):
    """Trailing four quarters as known on each filing day, restatements included."""
    out = fund.build_ttm(materialize(flat(spark, sf)))
    out = out.withColumn("ttm_quarters_available", F.col("ttm_quarters_available").cast("long"))
    return rounded(out.select("ticker", "end_date", "available_date", "ttm_quarters_available", *FLOWS, "free_cash_flow"), 1)


STOCKS = ["assets", "current_assets", "current_liabilities", "equity", "debt", "cash", "shares_basic", "shares_diluted"]


def asof_sql(cols: list[str]) -> str:
    """Per column as-of lookups on the trailing table."""
    model = f"""{ttm_sql()}, model AS (
  SELECT t.*, t.operating_cash_flow - abs(t.capex) AS free_cash_flow, {", ".join("f." + c for c in STOCKS)}
  FROM ttm t JOIN flat f ON f.ticker = t.ticker AND f.end_date = t.end_date AND f.available_date = t.available_date)"""
    parts, joins = [], []
    for i, c in enumerate(cols):
        parts.append(
            f"m{i} AS (SELECT ticker, available_date, arg_max({c}, end_date) AS {c} FROM model WHERE {c} IS NOT NULL GROUP BY 1, 2)"
        )
        joins.append(f"ASOF LEFT JOIN m{i} ON m{i}.ticker = p.ticker AND m{i}.available_date <= p.date")
    sel = ", ".join(f"m{i}.{c} AS {c}" for i, c in enumerate(cols))
    return f"""{model}, {b.MONTH}, {", ".join(parts)},
daily AS (SELECT p.ticker, p.date, p.t, p.close, {sel} FROM panel p {" ".join(joins)})"""


ASOF = ["revenues", "net_income", "equity", "shares_diluted"]


@query("daily_fundamentals", f"WITH {asof_sql(ASOF)} SELECT ticker, date, {b.rnd(ASOF, 1)} FROM daily")
def daily_fundamentals(spark, sf):
    """As-of join per ticker and column; never filled backwards."""
    panel, _ = month_panel(spark, sf)
    ttm = fund.build_ttm(materialize(flat(spark, sf)))
    out = fund.daily_fundamentals(ttm, panel.select("ticker", "date"), ASOF)
    return rounded(out.select("ticker", "date", *ASOF), 1)


ALL = [
    "net_income", "revenues", "operating_cash_flow", "free_cash_flow", "operating_income", "gross_profit", *STOCKS,
]
RATIO_SQL = {
    "earnings_yield": "net_income / mcap", "book_to_market": "equity / mcap", "sales_to_price": "revenues / mcap",
    "cashflow_to_price": "operating_cash_flow / mcap", "fcf_yield": "free_cash_flow / mcap", "ev_to_sales": "ev / revenues",
    "ev_to_operating_income": "ev / operating_income", "roe": "net_income / equity", "roa": "net_income / assets",
    "gross_margin": "gross_profit / revenues", "operating_margin": "operating_income / revenues",
    "net_margin": "net_income / revenues", "debt_to_equity": "debt / equity",
    "current_ratio": "current_assets / current_liabilities", "cash_to_assets": "cash / assets",
    "asset_turnover": "revenues / assets", "revenue_growth_yoy": "revenues / rev_lag - 1",
    "net_income_growth_yoy": "net_income / ni_lag - 1", "market_cap": "mcap", "enterprise_value": "ev",
}


def ratio_sql() -> str:
    cols = ", ".join(
        f"CASE WHEN isfinite({e}) THEN {b.rd(e, 2 if n in ('market_cap', 'enterprise_value') else 7)} END AS {n}" for n, e in RATIO_SQL.items()
    )
    return f"""WITH {asof_sql(ALL)},
back AS (SELECT p.ticker, p.t, c.date AS d FROM panel p JOIN cal c ON c.t = p.t - 12),
m_rev AS (SELECT ticker, available_date, arg_max(revenues, end_date) AS x FROM model WHERE revenues IS NOT NULL GROUP BY 1, 2),
m_ni AS (SELECT ticker, available_date, arg_max(net_income, end_date) AS x FROM model WHERE net_income IS NOT NULL GROUP BY 1, 2),
lagged AS (
  SELECT k.ticker, k.t, r.x AS rev_lag, n.x AS ni_lag FROM back k
  ASOF LEFT JOIN m_rev r ON r.ticker = k.ticker AND r.available_date <= k.d
  ASOF LEFT JOIN m_ni n ON n.ticker = k.ticker AND n.available_date <= k.d),
wide AS (
  SELECT d.*, rev_lag, ni_lag, close * coalesce(shares_diluted, shares_basic) AS mcap,
    close * coalesce(shares_diluted, shares_basic) + debt - cash AS ev
  FROM daily d LEFT JOIN lagged l ON l.ticker = d.ticker AND l.t = d.t)
SELECT ticker, date, {cols} FROM wide"""


@query("fundamental_ratios", ratio_sql())
def fundamental_ratios(spark, sf):
    """The 18 ratio factors; growth looks 12 calendar rows back on monthly bars."""
    panel, cal = month_panel(spark, sf)
    ttm = fund.build_ttm(materialize(flat(spark, sf)))
    out = fund.fundamental_panel(ttm, materialize(panel), materialize(cal), year=12)
    names = list(RATIO_SQL)
    out = out.selectExpr("ticker", "date", *[f"CASE WHEN abs({n}) < double('infinity') THEN {n} END AS {n}" for n in names])
    return rounded(out, 7, market_cap=2, enterprise_value=2)
