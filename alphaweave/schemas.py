"""Schemas of the tables the operators exchange. Keys take the place of array positions."""

BARS = (
    "date DATE, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "volume DOUBLE, vwap DOUBLE, transactions DOUBLE"
)
INTRADAY_BARS = (
    "timestamp TIMESTAMP, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "volume DOUBLE, vwap DOUBLE, transactions DOUBLE"
)
BAR_FIELDS = ["open", "high", "low", "close", "volume", "vwap", "transactions"]

# One grouped-daily response: T ticker, t epoch milliseconds, o/h/l/c prices, v volume, vw vwap, n trades.
# Two keys differ only by case, so the items are read as maps.
GROUPED_DAILY = "results ARRAY<MAP<STRING, STRING>>"
TICKER_REFERENCE = (
    "results ARRAY<STRUCT<ticker: STRING, name: STRING, type: STRING, active: BOOLEAN, "
    "list_date: STRING, delisted_utc: STRING>>"
)
STATEMENTS = "MAP<STRING, MAP<STRING, MAP<STRING, STRING>>>"
FILING = (
    "ticker STRING, tickers ARRAY<STRING>, start_date STRING, end_date STRING, filing_date STRING, "
    f"timeframe STRING, fiscal_period STRING, fiscal_year STRING, financials {STATEMENTS}"
)
FILINGS_RESPONSE = f"results ARRAY<STRUCT<{', '.join(c.strip().replace(' ', ': ', 1) for c in ('ticker STRING; tickers ARRAY<STRING>; start_date STRING; end_date STRING; filing_date STRING; timeframe STRING; fiscal_period STRING; fiscal_year STRING; financials ' + STATEMENTS).split(';'))}>>"
TICKERS = "ticker STRING, name STRING, type STRING, active BOOLEAN, list_date STRING, delisted_utc STRING"
POSITIONS = "account STRING, ticker STRING, qty DOUBLE"
