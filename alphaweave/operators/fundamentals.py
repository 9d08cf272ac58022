"""Filings to point-in-time ratio factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import free_cash_flow, sql_div, sql_finite, sql_first_present, sql_is_finite
from ..schemas import FILING

# Vendor item names per statement, in order of preference.
ITEMS: dict[str, tuple[str, list[str]]] = {
    "assets": ("balance_sheet", ["assets"]),
    "current_assets": ("balance_sheet", ["current_assets"]),
    "liabilities": ("balance_sheet", ["liabilities"]),
    "current_liabilities": ("balance_sheet", ["current_liabilities"]),
    "equity": ("balance_sheet", ["equity", "stockholders_equity", "equity_attributable_to_parent"]),
    "debt": ("balance_sheet", ["long_term_debt", "debt", "liabilities_noncurrent"]),
    "cash": (
        "balance_sheet",
        ["cash", "cash_and_cash_equivalents", "cash_and_cash_equivalents_at_carrying_value"],
    ),
    "revenues": ("income_statement", ["revenues", "sales", "net_sales"]),
    "cost_of_revenue": ("income_statement", ["cost_of_revenue"]),
    "gross_profit": ("income_statement", ["gross_profit"]),
    "operating_income": ("income_statement", ["operating_income_loss", "operating_income"]),
    "net_income": ("income_statement", ["net_income_loss", "net_income_loss_attributable_to_parent"]),
    "basic_eps": (
        "income_statement",
        ["basic_earnings_per_share", "basic_earnings_per_share_continuing_operations"],
    ),
    "diluted_eps": (
        "income_statement",
        ["diluted_earnings_per_share", "diluted_earnings_per_share_continuing_operations"],
    ),
    "shares_basic": ("income_statement", ["basic_average_shares", "weighted_average_shares_outstanding_basic"]),
    "shares_diluted": (
        "income_statement",
        ["diluted_average_shares", "weighted_average_shares_outstanding_diluted"],
    ),
    "operating_cash_flow": (
        "cash_flow_statement",
        ["net_cash_flow_from_operating_activities", "net_cash_flow_from_operating_activities_continuing"],
    ),
    "capex": (
        "cash_flow_statement",
        [
            "capital_expenditure",
            "capital_expenditures",
            "payments_to_acquire_property_plant_and_equipment",
            "payments_to_acquire_productive_assets",
            "payments_to_acquire_businesses_and_property_plant_and_equipment",
        ],
    ),
}
VALUE_COLUMNS = [*ITEMS, "free_cash_flow"]
FLOW_COLUMNS = [
    "revenues", "cost_of_revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow", "capex",
]


def parse_filing_json(lines: DataFrame, col: str = "json") -> DataFrame:
    """Filing records from JSON text.

    The record goes through `inline`: a generator is not merged into later
    projections, so a line is parsed once however many items are read from it.
    """
    return lines.select(F.inline(F.array(F.from_json(col, FILING))))


def flatten_filings(filings: DataFrame, lag_days: int = 60) -> DataFrame:
    """One flat row per filing with the day it became known.

    Known from the filing date, or from period end plus a lag when that is
    missing; `availability_source` says which.
    """
    day = lambda c: f"to_date(try_to_timestamp(CAST({c} AS STRING))) AS {c}"
    base = filings.selectExpr(
        "coalesce(ticker, try_element_at(tickers, 1)) AS ticker", day("start_date"), day("end_date"), day("filing_date"),
        "timeframe", "fiscal_period", "fiscal_year",
        *[f"try_element_at(financials, '{s}') AS __{s}" for s in sorted({s for s, _ in ITEMS.values()})],
    )
    flat = base.selectExpr(
        "ticker", "start_date", "end_date", "filing_date", "timeframe", "fiscal_period", "fiscal_year",
        f"coalesce(filing_date, date_add(end_date, {lag_days})) AS available_date",
        "CASE WHEN filing_date IS NULL THEN 'end_date_plus_lag' ELSE 'filing_date' END AS availability_source",
        *[f"{sql_first_present(f'__{s}', keys)} AS {c}" for c, (s, keys) in ITEMS.items()],
    )
    return flat.withColumn("free_cash_flow", free_cash_flow("operating_cash_flow", "capex")).dropna(
        subset=["ticker", "available_date"]
    )


def build_ttm(flat: DataFrame, min_quarters: int = 4) -> DataFrame:
    """Trailing-four-quarter flow columns for every filing, as known on its day.

    For a filing: among the periods already known and not after its own period,
    the latest version of each, the last four of them. Instead of pairing every
    filing with every earlier one, each filing asks for a short run of period
    numbers. A period that first arrived after a later one ("late") may be
    unknown at the time, so the run reaches back until it holds four periods
    that are never late; four known periods are then always in it.
    """
    rows = flat.where("ticker IS NOT NULL AND end_date IS NOT NULL AND available_date IS NOT NULL")
    # Number of arrival; the filing date and the values break ties the same way everywhere. What comes after it is within
    # a ticker, so one exchange by ticker serves all; a ticker has at most one period per reporting date.
    of_ticker = Window.partitionBy("ticker")
    arrival = F.struct("available_date", "end_date", "filing_date", F.struct(*VALUE_COLUMNS))
    keyed = rows.withColumn("__arrival", F.row_number().over(of_ticker.orderBy(arrival)))
    keyed = keyed.withColumn("__p", F.dense_rank().over(of_ticker.orderBy("end_date")))
    keyed = keyed.withColumn("__first", F.min("__arrival").over(Window.partitionBy("ticker", "__p")))
    by_end = of_ticker.orderBy("__p")
    later = F.min("__arrival").over(by_end.rangeBetween(1, Window.unboundedFollowing))
    keyed = keyed.withColumn("__late", F.coalesce(F.col("__first") > later, F.lit(False)))
    on_time = F.sort_array(F.collect_set(F.when(~F.col("__late"), F.col("__p"))).over(by_end.rangeBetween(Window.unboundedPreceding, 0)))
    keyed = keyed.withColumn("__from", F.coalesce(F.try_element_at(on_time, F.lit(-4)), F.lit(1)))

    # A filing is a version of its period and asks for the periods of its run; the first entry brings the filing along.
    flows, filing = F.struct(*FLOW_COLUMNS), F.struct(*rows.columns)
    entry = lambda q, ask, known, row: F.struct(q.alias("__q"), F.lit(ask).alias("__ask"), known.alias("__flows"), row.alias("__row"))
    kind = keyed.select(flows.alias("f"), filing.alias("r")).schema
    no_flows, no_row = F.lit(None).cast(kind["f"].dataType), F.lit(None).cast(kind["r"].dataType)
    asks = F.transform(F.sequence("__from", "__p"), lambda q: entry(q, 1, no_flows, F.when(q == F.col("__p"), filing)))
    entries = F.concat(F.array(entry(F.col("__p"), 0, flows, no_row)), asks)
    as_of = Window.partitionBy("ticker", "__q").orderBy("__arrival", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    answered = (
        keyed.select("ticker", "__arrival", F.inline(entries))
        .withColumn("__known", F.last("__flows", ignorenulls=True).over(as_of))
        .where("__ask = 1 AND __known IS NOT NULL")
    )
    four = answered.groupBy("ticker", "__arrival").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("__q", "__known")), asc=False), 1, 4).alias("__last4"),
        F.first("__row", ignorenulls=True).alias("__row"),
    )
    out = four.select("__last4", "__row.*")

    total = lambda c: (
        f"CASE WHEN size(filter(__last4, e -> {sql_is_finite(f'e.__known.{c}')})) >= {min_quarters} THEN "
        f"aggregate(reverse(__last4), 0D, (a, e) -> a + coalesce({sql_finite(f'e.__known.{c}')}, 0D)) END AS {c}"
    )
    out = out.drop(*FLOW_COLUMNS).selectExpr("*", *[total(c) for c in FLOW_COLUMNS])
    return out.select(
        "ticker", "start_date", "end_date", "filing_date", "available_date", "availability_source",
        F.lit("ttm_from_quarterly").alias("timeframe"),
        F.col("timeframe").alias("source_timeframe"),
        "fiscal_period", "fiscal_year",
        F.size("__last4").alias("ttm_quarters_available"),
        *ITEMS,
        free_cash_flow("operating_cash_flow", "capex").alias("free_cash_flow"),
    )


def daily_fundamentals(
    flat: DataFrame, days: DataFrame, columns: list[str] | None = None, lag_rows: dict[str, int] | None = None,
    cal: DataFrame | None = None,
) -> DataFrame:
    """As-of join: per row of `days` (ticker, date, …) and per column the last
    non-null value known on or before that date. Never filled backwards.

    Filings and days are merged into one stream per ticker, so one exchange and
    one sort answer all columns. Filings of one day are reduced first, hence a
    ticker's stream is bounded by twice the calendar. `lag_rows` asks for extra
    copies `<col>_lag` as they stood that many calendar days earlier; `cal`
    supplies the dates.
    """
    cols = columns or VALUE_COLUMNS
    filed = flat.groupBy("ticker", F.col("available_date").alias("date")).agg(
        *[F.expr(f"max_by({c}, CASE WHEN {sql_is_finite(c)} THEN struct(end_date, filing_date) END) AS {c}") for c in cols]
    )
    filed = filed.withColumn("__kind", F.lit(0))
    asked = days.withColumn("__kind", F.lit(1)).withColumn("__offset", F.lit(0))
    lags = sorted(set((lag_rows or {}).values()))
    keys = [c for c in days.columns if c not in ("date", "ticker")]
    if lags:
        ts = cal.select((F.col("t")).alias("__pt"), F.col("date").alias("__pd"))
        for n in lags:
            back = days.withColumn("__pt", F.col("t") - n).join(F.broadcast(ts), "__pt").drop("__pt")
            back = back.withColumn("__home", F.col("date")).withColumn("date", F.col("__pd")).drop("__pd")
            asked = asked.unionByName(
                back.withColumn("__kind", F.lit(1)).withColumn("__offset", F.lit(n)), allowMissingColumns=True
            )
    both = filed.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy("ticker").orderBy("date", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    known = both.select(
        "ticker", "date", *keys, "__kind", "__offset",
        *(["__home"] if lags else []),
        *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in cols],
    ).where("__kind = 1")
    if not lags:
        return known.drop("__kind", "__offset")
    # Bring the lagged answers back to their own day: still keyed by ticker, no new exchange.
    home = F.coalesce("__home", "date")
    per_day = known.groupBy("ticker", home.alias("date")).agg(
        *[F.max(F.when(F.col("__offset") == 0, F.col(k))).alias(k) for k in keys],
        *[F.max(F.when(F.col("__offset") == 0, F.col(c))).alias(c) for c in cols],
        *[F.max(F.when(F.col("__offset") == n, F.col(c))).alias(f"{c}_lag") for c, n in (lag_rows or {}).items()],
    )
    return per_day


YEAR = 252
# Ratio: numerator, denominator, and what is taken off the quotient.
_RATIOS = {
    "earnings_yield": ("net_income", "market_cap", ""),
    "book_to_market": ("equity", "market_cap", ""),
    "sales_to_price": ("revenues", "market_cap", ""),
    "cashflow_to_price": ("operating_cash_flow", "market_cap", ""),
    "fcf_yield": ("free_cash_flow", "market_cap", ""),
    "ev_to_sales": ("enterprise_value", "revenues", ""),
    "ev_to_operating_income": ("enterprise_value", "operating_income", ""),
    "roe": ("net_income", "equity", ""),
    "roa": ("net_income", "assets", ""),
    "gross_margin": ("gross_profit", "revenues", ""),
    "operating_margin": ("operating_income", "revenues", ""),
    "net_margin": ("net_income", "revenues", ""),
    "debt_to_equity": ("debt", "equity", ""),
    "current_ratio": ("current_assets", "current_liabilities", ""),
    "cash_to_assets": ("cash", "assets", ""),
    "asset_turnover": ("revenues", "assets", ""),
    "revenue_growth_yoy": ("revenues", "revenues_lag", " - 1"),
    "net_income_growth_yoy": ("net_income", "net_income_lag", " - 1"),
}
RATIOS = list(_RATIOS)


def fundamental_factors(daily: DataFrame, close: str = "adj_close", keep: list[str] | None = None) -> DataFrame:
    """The 18 ratio factors; a missing input column makes its ratios null."""
    have = set(daily.columns)
    inputs = [*VALUE_COLUMNS, "revenues_lag", "net_income_lag"]
    keep = keep if keep is not None else [c for c in ("t", "tradable") if c in have]
    base = daily.selectExpr(
        "ticker", "date", *keep, *[c if c in have else f"CAST(NULL AS DOUBLE) AS {c}" for c in inputs],
        f"{close} * CASE WHEN {sql_is_finite('shares_diluted') if 'shares_diluted' in have else 'false'} THEN "
        f"{'shares_diluted' if 'shares_diluted' in have else 'CAST(NULL AS DOUBLE)'} ELSE "
        f"{'shares_basic' if 'shares_basic' in have else 'CAST(NULL AS DOUBLE)'} END AS market_cap",
    ).selectExpr("*", "market_cap + debt - cash AS enterprise_value")
    return base.selectExpr(
        "ticker", "date", *keep, "market_cap", "enterprise_value",
        *[f"{sql_div(num, den)}{minus} AS {name}" for name, (num, den, minus) in _RATIOS.items()],
    )


def fundamental_panel(flat: DataFrame, panel: DataFrame, cal: DataFrame, year: int = YEAR) -> DataFrame:
    """Ratio factors on the bar days of `panel` (ticker, date, t, adj_close, tradable)."""
    days = panel.select("ticker", "date", "t", "adj_close", "tradable")
    daily = daily_fundamentals(flat, days, lag_rows={"revenues": year, "net_income": year}, cal=cal)
    return fundamental_factors(daily)

