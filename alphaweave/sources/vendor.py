"""JSON landing files of the price and filings vendor, read with fixed schemas.

All functions take a DataFrame of parsed responses (`spark.read.schema(...).json`),
so one read covers any number of files and a streaming read works as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_business_day, millis_to_timestamp
from ..operators.keyed import keep_first
from ..schemas import FILINGS_RESPONSE, GROUPED_DAILY, TICKER_REFERENCE


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_grouped_daily(spark: SparkSession, path: str) -> DataFrame:
    return parse_grouped_daily(read_json(spark, path, GROUPED_DAILY))


def parse_grouped_daily(responses: DataFrame) -> DataFrame:
    """Explode grouped-daily responses into daily bars; epoch milliseconds become a UTC date."""
    item = responses.select(F.explode("results").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    # The vendor's key per field.
    fields = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "vwap": "vw", "transactions": "n"}
    return item.select(
        F.to_date(millis_to_timestamp(get("t").try_cast("double").cast("bigint"))).alias("date"),
        get("T").alias("ticker"),
        *[get(k).try_cast("double").alias(name) for name, k in fields.items()],
    )


def parse_grouped_daily_range(responses: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of the business days in [start, end]."""
    bars = parse_grouped_daily(responses)
    return bars.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & is_business_day("date"))


def read_ticker_reference(spark: SparkSession, path: str) -> DataFrame:
    return parse_ticker_reference(read_json(spark, path, TICKER_REFERENCE))


def common_stock(tickers: DataFrame) -> DataFrame:
    # The vendor's labels for common stock; a missing type is kept.
    return tickers.where(F.col("type").isNull() | F.col("type").isin("CS", "Common Stock", "COMMON"))


def parse_ticker_reference(responses: DataFrame) -> DataFrame:
    return common_stock(responses.select(F.inline("results")))


def merge_ticker_status(active: DataFrame, inactive: DataFrame) -> DataFrame:
    """Active rows win over inactive rows of the same ticker."""
    both = active.withColumn("__p", F.lit(0)).unionByName(inactive.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, ["ticker"], ["__p"]).drop("__p")


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, FILINGS_RESPONSE).select(F.inline("results"))


def parse_filings(
    filings: DataFrame,
    ticker: str | None = None,
    timeframe: str | None = None,
    filed_from: str | None = None,
    filed_to: str | None = None,
    period_from: str | None = None,
    period_to: str | None = None,
) -> DataFrame:
    """Filing rows within inclusive filing-date and report-period ranges.

    A requested ticker replaces whatever the payload says.
    """
    out = filings
    if timeframe:
        out = out.where(F.col("timeframe") == timeframe)
    for col, op, value in (
        ("filing_date", ">=", filed_from),
        ("filing_date", "<=", filed_to),
        ("end_date", ">=", period_from),
        ("end_date", "<=", period_to),
    ):
        if value is not None:
            day, bound = F.to_date(col), F.to_date(F.lit(value))
            out = out.where(day >= bound if op == ">=" else day <= bound)
    return out.withColumn("ticker", F.lit(ticker)) if ticker else out
