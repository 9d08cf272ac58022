"""Shared inputs of the registered queries: panels derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alphaweave.operators.preprocess import preprocess
from alphaweave.operators.ridge import estimate_factor_returns, factor_returns_long
from alphaweave.operators.price_factors import price_factors, with_forward_return
from alphaweave.operators.universe import calendar, with_adj_close, with_t, with_tradable
from alphaweave.session import materialize
from alphaweave.sources import adapters


def month_bars(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.bars_supplier_month(spark, sf)


def week_bars(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.bars_brand_week(spark, sf)


def panel_of(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with adj_close, t and tradable, and the calendar."""
    cal = calendar(bars)
    return with_tradable(with_adj_close(with_t(bars, cal))), cal


def month_panel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return panel_of(month_bars(spark, sf))


def week_panel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return panel_of(week_bars(spark, sf))


def month_factors(spark: SparkSession, sf: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Masked raw factors with forward returns on the wide panel, and the calendar; both written once."""
    raw, cal, _ = month_tables(spark, sf, names)
    return raw, cal


def month_tables(spark: SparkSession, sf: str, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `month_factors`, with the bar panel. Bars are the first written table: the raw rows are read once."""
    bars = materialize(month_bars(spark, sf))
    cal = materialize(calendar(bars))
    panel = with_tradable(with_adj_close(with_t(bars, cal)))
    keep = ["tradable", "fwd_ret", "close", "open", "volume"]
    raw = price_factors(with_forward_return(panel, 1, 10.0), names, keep)
    masked = [f"CASE WHEN tradable THEN {n} END AS {n}" for n in names]
    return materialize(raw.selectExpr("ticker", "date", "t", *keep, *masked)), cal, panel


def rounded(df: DataFrame, digits: int = 8, **by_col: int) -> DataFrame:
    """Round the double columns for comparison; per-column digits by keyword.

    Scaling by 1 + 1e-13 moves exact decimal ties, which the two engines would
    round differently; adding 0 turns -0.0 into 0.0.
    """
    out = []
    for name, typ in df.dtypes:
        if typ == "double":
            out.append(f"round(`{name}` * 1.0000000000001D, {by_col.get(name, digits)}) + 0D AS `{name}`")
        else:
            out.append(f"`{name}`")
    return df.selectExpr(*out)


FACTORS = ["mom_1", "mom_5", "intraday_return"]
MIN_NAMES = 5


class Model:
    """The small factor model most queries share: three factors on the wide panel."""

    def __init__(self, spark: SparkSession, sf: str):
        self.raw, self.cal, self.bars = month_tables(spark, sf, FACTORS)
        self.names = FACTORS

    def z(self) -> DataFrame:
        return preprocess(self.raw, FACTORS, MIN_NAMES)

    def exposures(self) -> DataFrame:
        """Neutral-filled exposures, written once."""
        z = self.z()
        others = [c for c in z.columns if c not in FACTORS]
        return materialize(z.selectExpr(*others, *[f"coalesce({n}, 0D) AS {n}" for n in FACTORS]))

    def factor_returns(self, x: DataFrame, **kw) -> DataFrame:
        """Long factor returns, dense over the calendar."""
        fr = estimate_factor_returns(x, FACTORS, MIN_NAMES, **({"ridge": 0.5} | kw))
        return materialize(factor_returns_long(fr, FACTORS, self.cal))
