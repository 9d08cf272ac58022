"""Column expressions shared by all operators; everything here stays in the JVM.

Missing values are null. Real +/-Infinity doubles are kept, because clipping
turns them into a bound whereas a null stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# SQL text of the floating-point rules. A long expression built as text is one
# call into the JVM; the Column forms below are for composing with Columns.


def sql_is_finite(x: str) -> str:
    return f"coalesce(NOT isnan({x}) AND abs({x}) < double('infinity'), false)"


def sql_finite(x: str) -> str:
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) < double('infinity') THEN {x} END"


def sql_not_nan(x: str) -> str:
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


def sql_div(num: str, den: str) -> str:
    return (
        f"CASE WHEN ({den}) = 0 THEN CASE WHEN ({num}) > 0 THEN double('infinity') "
        f"WHEN ({num}) < 0 THEN double('-infinity') END ELSE try_divide({num}, {den}) END"
    )


def sql_log(x: str) -> str:
    return f"CASE WHEN ({x}) = 0 THEN double('-infinity') WHEN ({x}) > 0 THEN ln({x}) END"


def is_finite(x) -> Column:
    """True for a real number, false for null, NaN and +/-Infinity."""
    if isinstance(x, str):
        return F.expr(sql_is_finite(x))
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(INF)), F.lit(False))


def finite_or_null(x) -> Column:
    return F.expr(sql_finite(x)) if isinstance(x, str) else F.when(is_finite(x), x)


def null_nan(x) -> Column:
    return F.expr(sql_not_nan(x)) if isinstance(x, str) else F.when(~F.isnan(x), x)


def ieee_div(num, den) -> Column:
    """x/0 gives a signed Infinity and 0/0 gives null, as floating point does."""
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(sql_div(num, den))
    num, den = _c(num), _c(den)
    by_zero = F.when(num > 0, F.lit(INF)).when(num < 0, F.lit(-INF))
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def ieee_log(x) -> Column:
    """ln with ln(0) = -Infinity and ln(negative) = null."""
    if isinstance(x, str):
        return F.expr(sql_log(x))
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.log(x))


def safe_double(x) -> Column:
    """Numeric parse in which an unreadable or NaN value becomes null."""
    return null_nan(F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x.try_cast("double"))


def clip(x, low, high) -> Column:
    """Limit to [low, high]; null stays null, an infinity becomes the bound."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, _c(low)), _c(high)))


def signed_sqrt(x) -> Column:
    x = _c(x)
    return F.signum(x) * F.sqrt(F.abs(x))


def half_life_weight(age, half_life: float) -> Column:
    return F.pow(F.lit(0.5), _c(age) / F.lit(float(half_life)))


def whole_shares(dollars, price) -> Column:
    """Shares bought by `dollars`, cut toward zero."""
    ratio = _c(dollars) / _c(price)
    return (F.signum(ratio) * F.floor(F.abs(ratio))).cast("long")


def signed_cap(x, cap) -> Column:
    x = _c(x)
    return F.signum(x) * F.least(F.abs(x), cap if isinstance(cap, Column) else F.lit(float(cap)))


def padded_limit(price, side, slippage_bps: float) -> Column:
    """Limit price moved against the order by the slippage allowance, 4 decimals."""
    pad = F.when(_c(side) == "BUY", 1.0 + slippage_bps / 1e4).otherwise(1.0 - slippage_bps / 1e4)
    return F.round(_c(price) * pad, 4)


def round_to_tick(price, side, tick) -> Column:
    """Buys round up, sells round down; at or above 1.0 the tick is at least one cent."""
    price, tick = _c(price), (tick if isinstance(tick, Column) else F.lit(float(tick)))
    step = F.when(price >= 1.0, F.greatest(tick, F.lit(0.01))).otherwise(tick)
    steps = price / step
    units = F.when(F.upper(_c(side)) == "BUY", F.ceil(steps - 1e-12)).otherwise(F.floor(steps + 1e-12))
    digits = F.when(step < 1, F.greatest(F.lit(0), F.least(F.lit(6), F.ceil(-F.log10(step))))).otherwise(F.lit(0))
    scale = F.pow(F.lit(10.0), digits)
    return F.when(step <= 0, F.round(price, 4)).otherwise(F.round(units * step * scale) / scale)


def bps(x: float) -> float:
    return float(x) / 10_000.0


def trading_date(x) -> Column:
    return F.to_date(_c(x))


def millis_to_timestamp(ms) -> Column:
    return F.timestamp_millis(_c(ms))


def plus_days(d, n: int) -> Column:
    return F.date_add(_c(d), n)


def floor_to_interval(ts, minutes: int) -> Column:
    """Start of the bar interval that holds `ts`."""
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(_c(ts)) / step) * step)


def is_business_day(d) -> Column:
    return F.dayofweek(_c(d)).between(2, 6)


def business_days(start, end) -> Column:
    """Array of the weekdays from start to end, both included."""
    return F.filter(F.sequence(_c(start), _c(end)), is_business_day)


def session_time(d, hour: int, minute: int = 0) -> Column:
    d = _c(d)
    return F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), F.lit(hour), F.lit(minute), F.lit(0))


def to_utc(ts, zone: str | None = None) -> Column:
    """Wall-clock time of `zone` as UTC; a string carrying an offset is parsed as it stands."""
    ts = _c(ts)
    return F.to_utc_timestamp(ts, zone) if zone else F.try_to_timestamp(ts.cast("string"))


def truthy(x) -> Column:
    return F.coalesce(F.lower(_c(x).cast("string")).isin("true", "1", "yes"), F.lit(False))


def label_or_placeholder(x, name: str, position) -> Column:
    """Blank labels become missing_<name>_<position>."""
    x = _c(x)
    return F.when(
        x.isNull() | (F.trim(x.cast("string")) == ""),
        F.concat(F.lit(f"missing_{name}_"), _c(position).cast("string")),
    ).otherwise(x.cast("string"))


def sql_first_present(stmt: str, keys: list[str]) -> str:
    """Value of the first key present in a statement map.

    A present key wins even when its value cannot be read as a number; the
    result is then null instead of falling through to the next key.
    """
    node = lambda k: f"try_element_at({stmt}, '{k}')"
    whens = " ".join(
        f"WHEN map_contains_key({node(k)}, 'value') THEN nullif(try_cast(try_element_at({node(k)}, 'value') AS DOUBLE), double('NaN'))"
        for k in keys
    )
    return f"CASE {whens} END"


def free_cash_flow(ocf, capex) -> Column:
    """Operating cash flow less the size of capital spending; null unless both are finite."""
    if isinstance(ocf, str) and isinstance(capex, str):
        return F.expr(f"CASE WHEN {sql_is_finite(ocf)} AND {sql_is_finite(capex)} THEN {ocf} - abs({capex}) END")
    return F.when(is_finite(ocf) & is_finite(capex), _c(ocf) - F.abs(_c(capex)))


def quantile_bucket(x, edges) -> Column:
    """1-based bucket of x among sorted edges with duplicates removed.

    A value on an inner edge belongs to the lower bucket.
    """
    edges = F.array_distinct(_c(edges))
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    x = _c(x)
    return F.when(is_finite(x), 1 + F.size(F.filter(inner, lambda e: e < x)))


def order_side(current, target, delta) -> Column:
    """BUY/COVER when the position grows, SHORT/SELL when it shrinks, else empty."""
    current, target, delta = _c(current), _c(target), _c(delta)
    return (
        F.when(delta > 1e-12, F.when(current >= 0, "BUY").otherwise("COVER"))
        .when(delta < -1e-12, F.when(target < 0, "SHORT").otherwise("SELL"))
        .otherwise("")
    )


def factor_json(names: list[str], values: list[Column]) -> Column:
    """JSON object of the finite entries only, keyed by factor name."""
    items = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in zip(names, values)])
    return F.to_json(F.map_from_entries(F.filter(items, lambda e: is_finite(e["value"]))))


def blend_weight(state) -> Column:
    """Weight of the regression estimate per regime."""
    # Weight by regime state; any other state counts as 0.5.
    weights = {"normal": 0.3, "warning": 0.6, "break": 0.8}
    out = F.lit(0.5)
    for name, w in weights.items():
        out = F.when(_c(state) == name, F.lit(w)).otherwise(out)
    return out


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) if cols else F.lit(0.0)
