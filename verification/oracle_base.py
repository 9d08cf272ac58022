"""SQL building blocks for the DuckDB side: the same panels as `inputs`, as CTEs."""

from __future__ import annotations

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def bars(ticker: str, period: str, source: str) -> str:
    return f"""bars AS (
  SELECT {ticker} AS ticker, CAST(date_trunc('{period}', l_shipdate) AS DATE) AS date,
    first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open,
    max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
    sum(l_quantity) AS volume,
    sum(l_extendedprice) / sum(l_quantity) AS vwap,
    CAST(count(*) AS DOUBLE) AS transactions
  FROM {source} GROUP BY 1, 2)"""


MONTH_BARS = bars("'S' || CAST(l_suppkey AS VARCHAR)", "month", "lineitem")
WEEK_BARS = bars("p_brand", "week", "lineitem JOIN part ON l_partkey = p_partkey")

CAL = "cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars))"
PANEL = """panel AS (
  SELECT b.*, b.close AS adj_close, c.t, (b.close > 0 AND b.volume > 0) AS tradable
  FROM bars b JOIN cal c USING (date))"""

MONTH = f"{MONTH_BARS}, {CAL}, {PANEL}"
WEEK = f"{WEEK_BARS}, {CAL}, {PANEL}"


def w(first: int, last: int) -> str:
    """Range frame over the day ordinal of a ticker, in the given offsets."""
    def side(x: int) -> str:
        return "CURRENT ROW" if x == 0 else f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"

    return f"OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN {side(first)} AND {side(last)})"


def fwd(h: int = 1, cap: float | None = 10.0) -> str:
    r = f"(max(close) {w(h, h)} / close - 1)"
    return f"CASE WHEN tradable AND abs({r}) <= {cap} THEN {r} END" if cap else f"CASE WHEN tradable THEN {r} END"


# Momentum and range factors on the wide panel with the forward return.
def month_factors(**exprs: str) -> str:
    cols = ",\n    ".join(f"{e} AS {n}" for n, e in exprs.items())
    return f"""{MONTH}, raw AS (
  SELECT ticker, date, t, tradable, {fwd()} AS fwd_ret, close, open, volume,
    {cols}
  FROM panel)"""


MOM1 = f"close / max(close) {w(-1, -1)} - 1"
MOM5 = f"close / max(close) {w(-5, -5)} - 1"
INTRADAY = "close / open - 1"


def preprocess(names: list[str], min_names: int, lo: float = 0.01, hi: float = 0.99, source: str = "raw", other: str = "ticker, date, t, tradable, fwd_ret, close, open, volume") -> str:
    """Winsorize and z-score CTEs; the result is `z`."""
    b = ", ".join(
        f"quantile_cont({n}, {lo}) AS {n}_lo, quantile_cont({n}, {hi}) AS {n}_hi, count({n}) AS {n}_n" for n in names
    )
    c = ", ".join(f"CASE WHEN {n}_n >= {min_names} THEN least(greatest({n}, {n}_lo), {n}_hi) END AS {n}" for n in names)
    m = ", ".join(f"avg({n}) AS {n}_m, stddev_pop({n}) AS {n}_s, count({n}) AS {n}_c" for n in names)
    z = ", ".join(
        f"CASE WHEN {n}_c >= {min_names} AND {n}_s > 1e-12 THEN ({n} - {n}_m) / {n}_s END AS {n}" for n in names
    )
    # least/greatest skip nulls in this engine, so a null value is guarded.
    c = ", ".join(
        f"CASE WHEN {n}_n >= {min_names} AND {n} IS NOT NULL THEN least(greatest({n}, {n}_lo), {n}_hi) END AS {n}"
        for n in names
    )
    return f"""bounds AS (SELECT date, {b} FROM {source} GROUP BY date),
clipped AS (SELECT {other}, {c} FROM {source} JOIN bounds USING (date)),
moments AS (SELECT date, {m} FROM clipped GROUP BY date),
z AS (SELECT {other}, {z} FROM clipped JOIN moments USING (date))"""


def long_short(q: float, gross: float, min_names: int, source: str = "scored") -> str:
    """Equal-weight quantile legs; the result is `weights`."""
    return f"""cuts AS (
  SELECT date, quantile_cont(score, {q}) AS lo, quantile_cont(score, 1 - {q}) AS hi, count(score) AS n
  FROM {source} WHERE tradable GROUP BY date),
sides AS (
  SELECT date, count(*) FILTER (WHERE tradable AND score >= hi) AS nl, count(*) FILTER (WHERE tradable AND score <= lo) AS ns
  FROM {source} JOIN cuts USING (date) GROUP BY date),
weights AS (
  SELECT s.*, CASE
    WHEN n >= {2 * min_names} AND nl >= {min_names} AND ns >= {min_names} AND tradable AND score <= lo THEN -{gross} / 2 / ns
    WHEN n >= {2 * min_names} AND nl >= {min_names} AND ns >= {min_names} AND tradable AND score >= hi THEN {gross} / 2 / nl
    ELSE 0.0 END AS weight
  FROM {source} s LEFT JOIN cuts USING (date) LEFT JOIN sides USING (date))"""


TURNOVER = """turnover AS (
  SELECT c.date, c.t, coalesce(0.5 * sum(abs(coalesce(a.weight, 0) - coalesce(a.prev, 0))), 0) AS turnover
  FROM cal c LEFT JOIN (
    SELECT coalesce(x.t, y.t + 1) AS t, x.weight, y.weight AS prev
    FROM weights x FULL OUTER JOIN weights y ON x.ticker = y.ticker AND x.t = y.t + 1) a ON a.t = c.t
  GROUP BY c.date, c.t)"""


def port_returns(min_cov: float = 0.8) -> str:
    return f"""port AS (
  SELECT date, t, CASE WHEN n > 0 AND f / n >= {min_cov} THEN r END AS portfolio_return,
    CASE WHEN n > 0 THEN f / n END AS return_coverage, gross_exposure, n_long, n_short
  FROM (
    SELECT c.date, c.t, count(*) FILTER (WHERE abs(weight) > 0) AS n,
      count(*) FILTER (WHERE abs(weight) > 0 AND fwd_ret IS NOT NULL) AS f,
      sum(coalesce(weight * fwd_ret, 0)) AS r, coalesce(sum(abs(weight)), 0) AS gross_exposure,
      count(*) FILTER (WHERE weight > 0) AS n_long, count(*) FILTER (WHERE weight < 0) AS n_short
    FROM cal c LEFT JOIN weights w ON w.t = c.t GROUP BY c.date, c.t))"""


SUMMARY = """eq AS (
  SELECT p.*, d.turnover, product(1 + coalesce(portfolio_return, 0)) OVER (ORDER BY p.t) AS equity,
    count(portfolio_return) OVER (ORDER BY p.t) AS seen
  FROM port p JOIN turnover d USING (t)),
dd AS (SELECT *, equity / max(CASE WHEN seen > 0 THEN equity END) OVER (ORDER BY t) - 1 AS drawdown FROM eq),
summary AS (
  SELECT count(portfolio_return) AS n_periods, avg(portfolio_return) AS mean_return,
    stddev_samp(portfolio_return) AS volatility,
    sqrt(252) * avg(portfolio_return) / stddev_samp(portfolio_return) AS sharpe,
    arg_max(equity, t) - 1 AS total_return, min(drawdown) FILTER (WHERE portfolio_return IS NOT NULL) AS max_drawdown,
    avg(CASE WHEN portfolio_return IS NOT NULL THEN CAST(portfolio_return > 0 AS DOUBLE) END) AS win_rate,
    avg(gross_exposure) AS avg_gross_exposure, avg(turnover) AS avg_turnover
  FROM dd)"""


def rnd(names: list[str], digits: int = 8) -> str:
    return ", ".join(f"{rd(n, digits)} AS {n}" for n in names)


def rd(expr: str, digits: int = 8) -> str:
    """The rounding of `inputs.rounded`."""
    return f"round(({expr}) * 1.0000000000001e0, {digits}) + 0e0"


SUMMARY_COLUMNS = [
    "mean_return", "volatility", "sharpe", "total_return", "max_drawdown", "win_rate", "avg_gross_exposure", "avg_turnover",
]


# ---- the shared three-factor model ---------------------------------------------------------

FACTORS = ["mom_1", "mom_5", "intraday_return"]
RAW3 = month_factors(mom_1=MOM1, mom_5=MOM5, intraday_return=INTRADAY)
Z3 = f"{RAW3}, {preprocess(FACTORS, 5)}"
X3 = f"""{Z3}, x AS (
  SELECT ticker, date, t, tradable, fwd_ret, close, open, volume,
    {", ".join(f"coalesce({n}, 0) AS {n}" for n in FACTORS)} FROM z)"""


def ridge3(lam: float, min_names: int = 5) -> str:
    """Closed-form three-factor ridge per date (Cramer's rule); `beta` has one row per date, `fr` the long dense form."""
    f = ["mom_1", "mom_5", "intraday_return"]
    g = [f"sum({f[i]} * {f[j]}) + {lam if i == j else 0.0}e0 AS g{i}{j}" for i in range(3) for j in range(i, 3)]
    rhs = [f"sum({f[i]} * y) AS b{i}" for i in range(3)]

    def det(cols: list[list[str]]) -> str:
        a, b, c = cols
        return (
            f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]}) "
            f"+ {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"
        )

    col = [["g00", "g01", "g02"], ["g01", "g11", "g12"], ["g02", "g12", "g22"]]
    b = ["b0", "b1", "b2"]
    d = det(col)
    sol = [f"CASE WHEN n >= {min_names} THEN {det([b if k == i else col[k] for k in range(3)])} / {d} END AS {f[i]}" for i in range(3)]
    long = " UNION ALL ".join(f"SELECT c.date, c.t, '{n}' AS factor, {n} AS f FROM cal c LEFT JOIN beta USING (date)" for n in f)
    return f"""rows3 AS (
  SELECT *, fwd_ret - avg(fwd_ret) OVER (PARTITION BY date) AS y FROM x WHERE tradable AND fwd_ret IS NOT NULL),
gram AS (SELECT date, count(*) AS n, {", ".join(g + rhs)} FROM rows3 GROUP BY date),
beta AS (SELECT d.date, coalesce(n, 0) AS n_obs, {", ".join(sol)} FROM (SELECT DISTINCT date FROM x) d LEFT JOIN gram USING (date)),
fr AS ({long})"""


SEEN = "seen AS (SELECT c.t, max(CASE WHEN f IS NOT NULL THEN fr.t END) AS last_any FROM cal c LEFT JOIN fr ON fr.t < c.t GROUP BY c.t)"


def forecast(method: str, lookback: int = 20, hl: float = 20.0, mp: int = 5) -> str:
    """`pred` (date, t, factor, f_pred) from `fr`."""
    if method == "latest":
        value = "SELECT a.date, a.t, a.factor, b.f AS v FROM fr a JOIN seen USING (t) LEFT JOIN fr b ON b.factor = a.factor AND b.t = last_any"
    else:
        weight = f"pow(0.5e0, (a.t - 1 - b.t) / {hl}e0)" if method == "ewma" else "1e0"
        value = f"""SELECT a.date, a.t, a.factor, CASE WHEN count(b.f) >= {mp} THEN sum(b.f * {weight}) / sum({weight}) END AS v
    FROM fr a LEFT JOIN fr b ON b.factor = a.factor AND b.t BETWEEN a.t - {lookback} AND a.t - 1 AND b.f IS NOT NULL GROUP BY 1, 2, 3"""
    return f"""{SEEN},
pred AS (SELECT v.date, v.t, v.factor, CASE WHEN last_any IS NOT NULL THEN coalesce(v, 0) END AS f_pred
  FROM ({value}) v JOIN seen USING (t))"""


PWIDE = "pw AS (SELECT t, " + ", ".join(f"max(f_pred) FILTER (WHERE factor = '{n}') AS fp_{n}" for n in FACTORS) + " FROM pred GROUP BY t)"
ALPHA_EXPR = "CASE WHEN " + " OR ".join(f"fp_{n} IS NOT NULL" for n in FACTORS) + " THEN " + " + ".join(
    f"{n} * coalesce(fp_{n}, 0)" for n in FACTORS
) + " END"
SCORED = f"{PWIDE}, scored AS (SELECT x.*, CASE WHEN tradable THEN {ALPHA_EXPR} END AS score FROM x LEFT JOIN pw USING (t))"
