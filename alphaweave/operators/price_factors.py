"""The 27 price/volume factors and forward returns.

All look-backs count days of the shared calendar, not a ticker's own rows, so
every window is a range frame over the day ordinal `t`. All frames share one
(ticker, t) ordering: one exchange and one sort serve every factor. A ticker
has at most one bar per day, so the length of the calendar bounds each window
partition whatever the number of raw rows behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql_div, sql_finite, sql_log

MOMENTUM = [1, 5, 10, 21, 63, 126, 252]
VOLATILITY = [10, 20, 63, 126]


def frame(first: int, last: int, key: str = "ticker", t: str = "t"):
    return Window.partitionBy(key).orderBy(t).rangeBetween(first, last)


def at_offset(col: str | Column, n: int, key: str = "ticker") -> Column:
    """Value exactly n calendar days away (negative = earlier), null if that day has no bar."""
    return F.max(col).over(frame(n, n, key))


def _over(fn: str, first: int, last: int = 0) -> str:
    side = lambda x: "CURRENT ROW" if x == 0 else f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"
    return f"{fn} OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN {side(first)} AND {side(last)})"


def _rolling(fn: str, x: str, n: int, min_obs: int) -> str:
    """Rolling aggregate over the last n days that needs `min_obs` values."""
    return f"CASE WHEN {_over(f'count({x})', 1 - n)} >= {min_obs} THEN {_over(f'{fn}({x})', 1 - n)} END"


def _lag(x: str, n: int) -> str:
    return _over(f"max({x})", -n, -n)


def _shape(x: str, n: int, min_obs: int, flat: float, value: str) -> str:
    """Bias-corrected moment; `cnt` in `value` is the number of observations. A constant window has a fixed value."""
    cnt = f"double({_over(f'count({x})', 1 - n)})"
    same = f"{_over(f'min({x})', 1 - n)} = {_over(f'max({x})', 1 - n)}"
    return f"CASE WHEN {cnt} >= {min_obs} THEN CASE WHEN {same} THEN {flat}D ELSE {value.replace('cnt', cnt)} END END"


def _definitions() -> dict[str, str]:
    """SQL text of every factor over close c, high h, low l, open o, volume v, dollar volume dv, log return lr.

    Rolling inputs are finite values; an infinity counts as missing inside a window.
    """
    half = lambda n: max(5, n // 2)
    f = {f"mom_{n}": f"{sql_div('c', _lag('c', n))} - 1" for n in MOMENTUM}
    for n in VOLATILITY:
        f[f"volatility_{n}"] = _rolling("stddev_samp", "lr", n, max(3, n // 2))
    f["parkinson_vol_20"] = f"({_rolling('avg', 'log_range * log_range', 20, 10)}) / {4 * math.log(2)!r}D"
    f["intraday_return"] = f"{sql_div('c', 'o')} - 1"
    f["overnight_return"] = f"{sql_div('o', 'prev')} - 1"
    f["hl_range_20"] = _rolling("avg", "spread", 20, 10)
    for name, fn, x, n, obs in (
        ("close_to_high_20", "max", "h", 20, 10), ("close_to_low_20", "min", "l", 20, 10),
        ("dist_52w_high", "max", "h", 252, 126), ("dist_52w_low", "min", "l", 252, 126),
    ):
        f[name] = f"{sql_div('c', _rolling(fn, x, n, obs))} - 1"
    for n in (20, 60):
        f[f"log_dollar_vol_{n}"] = sql_log(_rolling("avg", "dv", n, half(n)))
        f[f"volume_z_{n}"] = sql_div(
            f"v - {_rolling('avg', 'v', n, half(n))}", _rolling("stddev_samp", "v", n, half(n))
        )
    f["volume_mom_20_60"] = f"{sql_div(_rolling('avg', 'v', 20, 10), _rolling('avg', 'v', 60, 30))} - 1"
    f["amihud_20"] = sql_div(_rolling("avg", "abs(lr)", 20, 10), _rolling("avg", "dv", 20, 10))
    skew = f"{_over('skewness(lr)', -62)} * sqrt(cnt * (cnt - 1)) / (cnt - 2)"
    kurt = f"(cnt - 1) / ((cnt - 2) * (cnt - 3)) * ((cnt + 1) * {_over('kurtosis(lr)', -62)} + 6)"
    f["price_skew_63"] = _shape("lr", 63, 30, 0.0, skew)
    f["price_kurt_63"] = _shape("lr", 63, 30, -3.0, kurt)
    return f


_FACTORS = _definitions()
PRICE_FACTORS = list(_FACTORS)


def price_factors(panel: DataFrame, names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(ticker, date, t, `keep`, factors) from bars with `adj_close` and `t`."""
    have = set(panel.columns)
    use = lambda c: c if c in have else "adj_close"
    keep = keep if keep is not None else [c for c in ("tradable",) if c in have]
    base = panel.selectExpr(
        "ticker", "date", "t", *[f"{k} AS __k_{k}" for k in keep],
        "adj_close AS c", f"{use('high')} AS h", f"{use('low')} AS l", f"{use('open')} AS o",
        "CASE WHEN volume <> 0 THEN volume END AS v",
        "CASE WHEN adj_close * volume <> 0 THEN adj_close * volume END AS dv",
        f"{_lag('adj_close', 1)} AS prev",
    )
    derived = {
        "lr": f"({sql_log('c')}) - ({sql_log('prev')})",
        "log_range": sql_log(sql_div("h", "l")),
        "spread": sql_div("h - l", "c"),
    }
    base = base.selectExpr(
        "*",
        *[f"{sql_finite(f'({text})')} AS {name}" for name, text in derived.items()],
    )
    return base.selectExpr(
        "ticker", "date", "t", *[f"__k_{k} AS {k}" for k in keep], *[f"{_FACTORS[n]} AS {n}" for n in names or PRICE_FACTORS]
    )


def cap_abs(r: Column, cap: float | None) -> Column:
    if cap is None:
        return r
    if cap <= 0:
        raise ValueError("max_abs_return must be positive")
    return F.when(F.abs(r) <= cap, r)


def with_forward_return(
    panel: DataFrame, horizon: int = 1, max_abs_return: float | None = None, mask: str | None = "tradable",
    price: str = "adj_close",
) -> DataFrame:
    """Adds `fwd_ret` = price[t+h]/price[t] - 1 by calendar day.

    Outliers become null, and so do signal days on which the name is not tradable.
    """
    if max_abs_return is not None and max_abs_return <= 0:
        raise ValueError("max_abs_return must be positive")
    ahead = panel.withColumn("__next", F.expr(_over(f"max({price})", horizon, horizon)))
    out = ahead.withColumn("fwd_ret", F.expr(f"{sql_div('__next', price)} - 1")).drop("__next")
    keep = ["true"]
    keep += [f"abs(fwd_ret) <= {float(max_abs_return)}D"] if max_abs_return is not None else []
    keep += [mask] if mask else []
    return out.withColumn("fwd_ret", F.expr(f"CASE WHEN {' AND '.join(keep)} THEN fwd_ret END"))
