"""Preprocessing, ridge, forecasts, scores, quantile weights, research backtest, run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaweave.operators import diagnostics as dg
from alphaweave.operators import performance as perf
from alphaweave.operators import portfolio as pf
from alphaweave.operators import preprocess as pp
from alphaweave.operators import ridge as rg
from alphaweave.operators.forecast import align_forecast, factor_history, latest_forecast, predict_factor_returns, score, score_long
from alphaweave.operators.universe import calendar
from alphaweave.plans.research import build_factors, run_factor_backtest, stored_or_computed_weights
from alphaweave.session import materialize
from alphaweave.sources.sinks import wide_factor_returns

from . import oracle_base as b
from .inputs import FACTORS, MIN_NAMES, Model, month_bars, month_factors, rounded
from .registry import query

LAM = 0.5
RF = b.rnd(FACTORS)


@query(
    "momentum_long_short_summary",
    f"""WITH {b.month_factors(mom_1=b.MOM1)}, {b.preprocess(["mom_1"], 5)},
scored AS (SELECT *, mom_1 AS score FROM z), {b.long_short(0.2, 0.02, 2)}, {b.TURNOVER}, {b.port_returns()}, {b.SUMMARY}
SELECT n_periods, {b.rnd(b.SUMMARY_COLUMNS)} FROM summary""",
)
def momentum_long_short_summary(spark, sf):
    """Momentum score, quantile legs, returns, turnover and summary: the flagship."""

    raw, cal = month_factors(spark, sf, ["mom_1"])
    z = materialize(pp.preprocess(raw, ["mom_1"], 5).withColumn("score", F.col("mom_1")))
    weights = materialize(pf.quantile_long_short(z, 0.2, 0.02, 2))
    daily = (
        perf.portfolio_returns(weights, cal, max_abs_return=10.0)
        .join(F.broadcast(perf.exposures_by_day(weights, cal).select("t", "gross_exposure")), "t")
        .join(F.broadcast(pf.turnover(weights, cal).select("t", "turnover")), "t")
    )
    return rounded(perf.summarize(daily))


@query("winsorized_factors", f"WITH {b.Z3} SELECT ticker, date, {RF} FROM clipped")
def winsorized_factors(spark, sf):
    m = Model(spark, sf)
    return rounded(pp.winsorize(m.raw, FACTORS, 0.01, 0.99, MIN_NAMES).select("ticker", "date", *FACTORS))


@query("winsorized_factors_split", f"WITH {b.Z3} SELECT ticker, date, {RF} FROM clipped")
def winsorized_factors_split(spark, sf):
    """Same result where every bucket of values is narrowed before its values are listed."""
    m = Model(spark, sf)
    return rounded(pp.winsorize(m.raw, FACTORS, 0.01, 0.99, MIN_NAMES, listed_cells=0).select("ticker", "date", *FACTORS))


@query("zscored_factors", f"WITH {b.Z3} SELECT ticker, date, {RF} FROM z")
def zscored_factors(spark, sf):
    return rounded(Model(spark, sf).z().select("ticker", "date", *FACTORS))


@query(
    "dense_exposures",
    f"WITH {b.X3} SELECT g.ticker, g.date, coalesce(tradable, false) AS tradable, "
    + ", ".join(f"{b.rd(f'coalesce({n}, 0)')} AS {n}" for n in FACTORS)
    + " FROM (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM x), cal) g LEFT JOIN x USING (ticker, date)",
)
def dense_exposures(spark, sf):
    """Full grid: names without a bar are neutral and untradable."""
    m = Model(spark, sf)
    return rounded(pp.dense_exposures(m.exposures(), FACTORS, m.cal).select("ticker", "date", "tradable", *FACTORS))


@query("neutral_exposures", f"WITH {b.X3} SELECT ticker, date, {RF} FROM x")
def neutral_exposures(spark, sf):
    return rounded(Model(spark, sf).exposures().select("ticker", "date", *FACTORS))


CELLS = "cells AS (SELECT (SELECT count(*) FROM cal) * (SELECT count(DISTINCT ticker) FROM panel) AS cells)"
COVER = " UNION ALL ".join(
    f"SELECT '{n}' AS factor, count({n}) AS finite_cells, count(DISTINCT CASE WHEN {n} IS NOT NULL THEN date END) AS finite_dates, "
    f"max(cells) AS cells FROM z, cells" for n in FACTORS
)


@query("factor_coverage", f"WITH {b.Z3}, {CELLS} {COVER}")
def factor_coverage(spark, sf):
    m = Model(spark, sf)
    return pp.coverage(m.z(), FACTORS, pp.grid_cells(m.cal, m.raw)).select("factor", "finite_cells", "finite_dates", "cells")


PAIRS = " UNION ALL ".join(
    f"SELECT '{b.FACTORS[j]}' AS factor, '{b.FACTORS[i]}' AS \"with\", {b.rd(f'corr({b.FACTORS[i]}, {b.FACTORS[j]})')} AS corr, "
    f"count(*) FILTER (WHERE {b.FACTORS[i]} IS NOT NULL AND {b.FACTORS[j]} IS NOT NULL) AS overlap FROM z"
    for i in range(3) for j in range(i + 1, 3)
)


@query("factor_correlations", f"WITH {b.Z3} {PAIRS}")
def factor_correlations(spark, sf):
    return rounded(pp.factor_correlations(materialize(Model(spark, sf).z()), FACTORS).select("factor", "with", "corr", "overlap"))


SCREENED = f"""WITH {b.Z3}, {CELLS}, c AS ({COVER}), r AS ({COVER.replace('FROM z, cells', 'FROM raw, cells')})
SELECT factor, true AS kept, {b.rd('r.finite_cells / r.cells')} AS raw_finite_ratio, {b.rd('c.finite_cells / c.cells')} AS processed_finite_ratio,
  c.finite_dates, '' AS drop_reason FROM c JOIN r USING (factor)
UNION ALL SELECT 'mom_1_copy', false, {b.rd('r.finite_cells / r.cells')}, {b.rd('c.finite_cells / c.cells')}, c.finite_dates, 'high_corr' FROM c JOIN r USING (factor) WHERE factor = 'mom_1'
UNION ALL SELECT 'sparse', false, {b.rd("(SELECT count(CASE WHEN hash_in THEN 1 END) FROM (SELECT ticker = 'S1' AND mom_1 IS NOT NULL AS hash_in FROM raw)) / (SELECT cells FROM cells)")}, 0e0, 0, 'low_coverage'"""


def screened(spark, sf):
    m = Model(spark, sf)
    raw = m.raw.withColumn("mom_1_copy", -F.col("mom_1")).withColumn("sparse", F.expr("CASE WHEN ticker = 'S1' THEN mom_1 END"))
    built = pp.build_exposures(
        raw, [*FACTORS, "mom_1_copy", "sparse"], MIN_NAMES, cells=pp.grid_cells(m.cal, m.raw)
    )
    return built.diagnostics.select("factor", "kept", "raw_finite_ratio", "processed_finite_ratio", "finite_dates", "drop_reason")


@query("factor_screening", SCREENED)
def factor_screening(spark, sf):
    """Coverage filter and greedy duplicate removal, one row per factor."""
    return rounded(screened(spark, sf))


@query("weakest_coverage", f"SELECT * FROM ({SCREENED}) ORDER BY processed_finite_ratio, factor LIMIT 3")
def weakest_coverage(spark, sf):
    """The three factors with the least coverage, as the report of a build names them."""
    return rounded(dg.weakest_coverage(screened(spark, sf), 3))


BETA = f"WITH {b.X3}, {b.ridge3(LAM)} SELECT date, n_obs, {RF} FROM beta"


@query("ridge_factor_returns", BETA)
def ridge_factor_returns(spark, sf):
    """Fixed-penalty ridge per date through orthogonal reduction of row blocks."""
    m = Model(spark, sf)
    fr = rg.estimate_factor_returns(m.exposures(), FACTORS, MIN_NAMES, LAM)
    return rounded(fr.select("date", "n_obs", *[F.col("f")[i].alias(n) for i, n in enumerate(FACTORS)]))


@query("ridge_factor_returns_gram", BETA)
def ridge_factor_returns_gram(spark, sf):
    """Same estimate from packed sums and normal equations."""
    m = Model(spark, sf)
    fr = rg.gram_returns(m.exposures(), FACTORS, LAM, MIN_NAMES)
    return rounded(fr.select("date", "n_obs", *[F.col("f")[i].alias(n) for i, n in enumerate(FACTORS)]))


@query(
    "gram_sums",
    f"""WITH {b.X3} SELECT date, count(*) AS n, {b.rd('sum(mom_1 * mom_1)', 6)} AS xx00, {b.rd('sum(mom_1 * mom_5)', 6)} AS xx01,
  {b.rd('sum(mom_5 * fwd_ret)', 6)} AS xy1, {b.rd('sum(intraday_return)', 6)} AS x2, {b.rd('sum(fwd_ret * fwd_ret)', 6)} AS yy
FROM x WHERE tradable AND fwd_ret IS NOT NULL GROUP BY date""",
)
def gram_sums(spark, sf):
    g = rg.gram(rg.regression_rows(Model(spark, sf).exposures(), FACTORS), 3)
    return rounded(
        g.selectExpr("date", "n", "xx[0] AS xx00", "xx[1] AS xx01", "xy[1] AS xy1", "x[2] AS x2", "yy"), 6
    )


@query("ridge_gcv_factor_returns")
def ridge_gcv_factor_returns(spark, sf):
    """Penalty chosen per date by generalized cross-validation."""
    fr = rg.estimate_factor_returns(Model(spark, sf).exposures(), FACTORS, MIN_NAMES, "auto")
    return fr.select("date", "selected_ridge", "n_obs", *[F.col("f")[i].alias(n) for i, n in enumerate(FACTORS)])


LAMBDAS = [0.05, 0.5, 50.0]


def diag(spark, sf):
    d = rg.ridge_diagnostics(Model(spark, sf).exposures(), FACTORS, LAMBDAS, MIN_NAMES)
    # Without full rank the smallest singular value is rounding noise.
    return materialize(d.withColumn("cond_X", F.when(F.col("cond_X") > 1e12, float("inf")).otherwise(F.col("cond_X"))))


def lam_rows(cols: str) -> str:
    """One closed-form fit per penalty over the shared exposures, from x and the betas."""
    parts = []
    for i, lam in enumerate(LAMBDAS):
        ctes = b.ridge3(lam, 5)
        parts.append(
            f"SELECT * FROM (WITH {ctes} SELECT {i} AS lambda_idx, {lam}e0 AS \"lambda\", r.date, count(*) AS n_names, "
            f"sqrt(sum(y * y)) AS return_norm, sqrt(sum(power(y - fit, 2))) AS residual_norm, "
            f"any_value(beta.mom_1) AS mom_1, any_value(beta.mom_5) AS mom_5, any_value(beta.intraday_return) AS intraday_return "
            f"FROM (SELECT rows3.date, rows3.y, rows3.mom_1 * be.mom_1 + rows3.mom_5 * be.mom_5 + rows3.intraday_return * be.intraday_return AS fit "
            f"FROM rows3 JOIN beta be ON be.date = rows3.date) r JOIN beta ON beta.date = r.date GROUP BY r.date)"
        )
    return f"WITH {b.X3}, lam AS ({' UNION ALL '.join(parts)}) {cols}"


@query(
    "ridge_diagnostics_fit",
    lam_rows(
        "SELECT lambda_idx, \"lambda\", date, n_names, "
        + b.rnd(["return_norm", "residual_norm"], 7)
        + f", {b.rd('1 - residual_norm * residual_norm / (return_norm * return_norm)', 7)} AS centered_R2, "
        + f"{b.rd('sqrt(mom_1 * mom_1 + mom_5 * mom_5 + intraday_return * intraday_return)', 7)} AS norm_f "
        + "FROM lam WHERE residual_norm IS NOT NULL"
    ),
)
def ridge_diagnostics_fit(spark, sf):
    """Fit quality per date and penalty, one decomposition per date."""
    d = diag(spark, sf).where("day_valid")
    return rounded(d.select("lambda_idx", "lambda", "date", "n_names", "return_norm", "residual_norm", "centered_R2", "norm_f"), 7)


@query("ridge_diagnostics_full")
def ridge_diagnostics_full(spark, sf):
    """All diagnostics with warning flags."""
    d = rg.ridge_diagnostics(Model(spark, sf).exposures(), FACTORS, [0.0, *LAMBDAS], MIN_NAMES)
    return rg.warning_flags(materialize(d)).drop("f")


@query(
    "ridge_factor_stats",
    lam_rows(
        "SELECT lambda_idx, \"lambda\", factor, "
        + ", ".join(
            f"{b.rd(e, 7)} AS {n}"
            for n, e in {
                "mean": "avg(f)", "std": "stddev_pop(f)", "median": "median(f)", "mad": "mad(f)", "min": "min(f)", "max": "max(f)",
                "mean_abs": "avg(abs(f))", "max_abs": "max(abs(f))", "q01": "quantile_cont(f, 0.01)", "q95": "quantile_cont(f, 0.95)",
            }.items()
        )
        + " FROM (UNPIVOT (SELECT lambda_idx, \"lambda\", date, mom_1, mom_5, intraday_return FROM lam) ON mom_1, mom_5, intraday_return "
        "INTO NAME factor VALUE f) GROUP BY 1, 2, 3"
    ),
)
def ridge_factor_stats(spark, sf):
    d = diag(spark, sf)
    cells = F.array(*[F.struct(F.lit(n).alias("factor"), F.col("f")[i].alias("f")) for i, n in enumerate(FACTORS)])
    stats = rg.factor_stats_by_lambda(materialize(d.select("lambda_idx", "lambda", F.inline(cells))))
    return rounded(
        stats.select("lambda_idx", "lambda", "factor", "mean", "std", "median", "mad", "min", "max", "mean_abs", "max_abs", "q01", "q95"), 7
    )


@query(
    "ridge_lambda_summary",
    lam_rows(
        "SELECT \"lambda\", count(*) FILTER (WHERE residual_norm IS NOT NULL) AS valid_days, "
        f"{b.rd('quantile_cont(nf, 0.95)', 7)} AS q95_norm_f, {b.rd('max(nf)', 7)} AS max_norm_f, {b.rd('avg(rr)', 7)} AS mean_residual_norm_ratio, "
        f"{b.rd('median(1 - rr * rr)', 7)} AS median_centered_R2 "
        "FROM (SELECT *, sqrt(mom_1 * mom_1 + mom_5 * mom_5 + intraday_return * intraday_return) AS nf, residual_norm / return_norm AS rr FROM lam) GROUP BY \"lambda\""
    ),
)
def ridge_lambda_summary(spark, sf):
    s = rg.lambda_summary(diag(spark, sf))
    return rounded(s.select("lambda", "valid_days", "q95_norm_f", "max_norm_f", "mean_residual_norm_ratio", "median_centered_R2"), 7)


REASONS = {"largest_norm_f": "nf DESC", "largest_max_abs_f": "mf DESC", "largest_cond_X": "cond DESC", "worst_centered_R2": "r2", "largest_residual_norm_ratio": "rr DESC"}
#: Condition number from the eigenvalues of the 3 x 3 moment matrix in closed form.
COND = """g AS (SELECT date, sum(mom_1 * mom_1) AS a, sum(mom_5 * mom_5) AS b, sum(intraday_return * intraday_return) AS c, sum(mom_1 * mom_5) AS d,
  sum(mom_5 * intraday_return) AS e, sum(mom_1 * intraday_return) AS f FROM x WHERE tradable AND fwd_ret IS NOT NULL GROUP BY date),
e1 AS (SELECT *, (a + b + c) / 3 AS q, sqrt((power(a - (a + b + c) / 3, 2) + power(b - (a + b + c) / 3, 2) + power(c - (a + b + c) / 3, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM g),
e2 AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)) / (2 * p * p * p)))) / 3 AS phi FROM e1),
e3 AS (SELECT date, q + 2 * p * cos(phi) AS most, q + 2 * p * cos(phi + 2 * pi() / 3) AS least FROM e2),
cnd AS (SELECT date, CASE WHEN least > 1e-13 * most THEN sqrt(most / least) ELSE 'infinity'::DOUBLE END AS cond FROM e3)"""


@query(
    "ridge_suspicious_days",
    lam_rows(
        f""", {COND}, m AS (SELECT *, sqrt(mom_1 * mom_1 + mom_5 * mom_5 + intraday_return * intraday_return) AS nf, greatest(abs(mom_1), abs(mom_5), abs(intraday_return)) AS mf,
  residual_norm / return_norm AS rr, 1 - power(residual_norm / return_norm, 2) AS r2 FROM lam JOIN cnd USING (date) WHERE residual_norm IS NOT NULL)
SELECT date, "lambda", reason, {b.rd("value", 7)} AS value FROM ("""
        + " UNION ALL ".join(
            f"SELECT date, \"lambda\", '{reason}' AS reason, {order.split()[0]} AS value, row_number() OVER (PARTITION BY \"lambda\" ORDER BY {order}, date) AS rn FROM m"
            for reason, order in REASONS.items()
        )
        + ") WHERE rn <= 10"
    ),
)
def ridge_suspicious_days(spark, sf):
    return rounded(rg.suspicious_days(diag(spark, sf), 10), 7)


FR = f"{b.X3}, {b.ridge3(LAM)}"


@query(
    "wide_factor_returns",
    f"WITH {FR} SELECT date, {RF} FROM cal LEFT JOIN beta USING (date)",
)
def wide_factor_returns_query(spark, sf):
    m = Model(spark, sf)
    return rounded(wide_factor_returns(m.factor_returns(m.exposures()), FACTORS))


def forecast_query(method: str) -> None:
    @query(f"forecast_{method}", f"WITH {FR}, {b.forecast(method)} SELECT date, t, factor, {b.rd('f_pred')} AS f_pred FROM pred")
    def run(spark, sf):
        m = Model(spark, sf)
        return rounded(predict_factor_returns(m.factor_returns(m.exposures()), method))


for _m in ("latest", "rolling", "ewma"):
    forecast_query(_m)


@query(
    "latest_forecast_aligned",
    f"""WITH {FR}, {b.forecast('ewma', mp=1)}, want AS (SELECT unnest(['mom_1', 'unknown', 'intraday_return']) AS factor)
SELECT w.factor, {b.rd('coalesce(f_pred, 0)')} AS f_pred FROM want w
LEFT JOIN (SELECT factor, arg_max(f_pred, t) AS f_pred FROM pred GROUP BY 1) p USING (factor)""",
)
def latest_forecast_aligned(spark, sf):
    """Newest forecast aligned to a factor list; unknown factors get 0."""
    m = Model(spark, sf)
    want = spark.createDataFrame([("mom_1",), ("unknown",), ("intraday_return",)], "factor string")
    return rounded(align_forecast(latest_forecast(m.factor_returns(m.exposures())), want))


SCORE = f"WITH {FR}, {b.forecast('ewma')}, {b.SCORED}"


def scored(m: Model, method: str = "ewma"):
    x = m.exposures()
    pred = materialize(predict_factor_returns(m.factor_returns(x), method))
    return x, pred, score(x, pred, FACTORS)


@query("scores", f"{SCORE} SELECT ticker, date, {b.rd('score')} AS score FROM scored")
def scores(spark, sf):
    _, _, s = scored(Model(spark, sf))
    return rounded(s.select("ticker", "date", "score"))


@query("scores_long_form", f"WITH {FR}, {b.forecast('ewma')}, {b.PWIDE} SELECT ticker, date, {b.rd(b.ALPHA_EXPR)} AS score FROM x LEFT JOIN pw USING (t)")
def scores_long_form(spark, sf):
    """The same contraction as an equi join and a sum over (date, factor)."""
    x, pred, _ = scored(Model(spark, sf))
    cells = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("x")) for n in FACTORS])
    return rounded(score_long(x.select("date", "ticker", F.inline(cells)), pred))


@query("quantile_weights", f"{SCORE}, {b.long_short(0.2, 2.0, 2)} SELECT ticker, date, {b.rd('weight')} AS weight FROM weights")
def quantile_weights(spark, sf):
    m = Model(spark, sf)
    _, _, s = scored(m)
    w = pf.quantile_long_short(materialize(s), 0.2, 2.0, 2)
    return rounded(w.select("ticker", "date", "weight"))


@query("weights_turnover", f"{SCORE}, {b.long_short(0.2, 2.0, 2)}, {b.TURNOVER} SELECT date, {b.rd('turnover')} AS turnover FROM turnover")
def weights_turnover(spark, sf):
    m = Model(spark, sf)
    _, _, s = scored(m)
    w = materialize(pf.quantile_long_short(materialize(s), 0.2, 2.0, 2))
    return rounded(pf.turnover(w, m.cal).select("date", "turnover"))


BACKTEST = f"WITH {FR}, {b.forecast('latest')}, {b.SCORED}, {b.long_short(0.2, 0.02, 2)}, {b.TURNOVER}, {b.port_returns()}, {b.SUMMARY}"


def backtest(spark, sf):
    m = Model(spark, sf)
    x = m.exposures()
    return m, run_factor_backtest(
        x, m.factor_returns(x), FACTORS, m.cal, "latest", quantile=0.2, gross=0.02, min_names_per_side=2, max_abs_return=10.0,
    )


@query("research_backtest_metrics", f"{BACKTEST} SELECT n_periods, {b.rnd(b.SUMMARY_COLUMNS, 7)} FROM summary")
def research_backtest_metrics(spark, sf):
    return rounded(backtest(spark, sf)[1].metrics, 7)


@query(
    "research_backtest_daily",
    f"""{BACKTEST} SELECT date, t, {b.rd('portfolio_return', 7)} AS portfolio_return,
  {b.rd('CASE WHEN portfolio_return IS NOT NULL THEN equity - 1 END', 7)} AS cumulative_return, {b.rd('turnover', 7)} AS turnover,
  {b.rd('gross_exposure', 7)} AS gross_exposure, n_long, n_short, {b.rd('return_coverage', 7)} AS return_coverage FROM eq""",
)
def research_backtest_daily(spark, sf):
    return rounded(backtest(spark, sf)[1].daily, 7)


@query(
    "monthly_and_risk_ratios",
    f"""{BACKTEST}, mo AS (
  SELECT strftime(date, '%Y-%m') AS month, product(1 + portfolio_return) - 1 AS r FROM eq WHERE portfolio_return IS NOT NULL GROUP BY 1)
SELECT month, {b.rd('r', 7)} AS monthly_return, {b.rd('product(1 + r) OVER (ORDER BY month)', 7)} AS monthly_equity FROM mo""",
)
def monthly_and_risk_ratios(spark, sf):
    return rounded(perf.monthly_returns(backtest(spark, sf)[1].daily), 7)


@query(
    "risk_ratios",
    f"""{BACKTEST} SELECT count(portfolio_return) AS trading_days, {b.rd('min(drawdown) FILTER (WHERE portfolio_return IS NOT NULL)', 7)} AS max_drawdown,
  {b.rd('sum(greatest(portfolio_return, 0)) / nullif(sum(greatest(-portfolio_return, 0)), 0)', 7)} AS profit_factor,
  {b.rd('avg(CASE WHEN portfolio_return IS NOT NULL THEN CAST(portfolio_return > 0 AS DOUBLE) END)', 7)} AS hit_rate,
  {b.rd('max(portfolio_return)', 7)} AS best_day, {b.rd('min(portfolio_return)', 7)} AS worst_day,
  {b.rd('avg(turnover)', 7)} AS average_turnover, {b.rd('median(turnover)', 7)} AS median_turnover FROM dd""",
)
def risk_ratios(spark, sf):
    r = perf.risk_ratios(backtest(spark, sf)[1].daily)
    return rounded(
        r.select("trading_days", "max_drawdown", "profit_factor", "hit_rate", "best_day", "worst_day", "average_turnover", "median_turnover"), 7
    )


@query(
    "trailing_volatility_var",
    f"""{BACKTEST} SELECT date, {b.rd('CASE WHEN count(portfolio_return) OVER v >= 2 THEN stddev_samp(portfolio_return) OVER v * sqrt(252) END', 6)} AS rolling_volatility_annual,
  {b.rd('CASE WHEN count(portfolio_return) OVER q >= 2 THEN greatest(0, -quantile_cont(portfolio_return, 0.05) OVER q) END', 6)} AS rolling_daily_var
FROM port WINDOW v AS (ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), q AS (ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
)
def trailing_volatility_var(spark, sf):
    r = perf.trailing_risk(backtest(spark, sf)[1].daily)
    return rounded(r.select("date", "rolling_volatility_annual", "rolling_daily_var"), 6)


@query(
    "factor_history",
    f"""WITH {FR}, {b.forecast('ewma')}, h AS (
  SELECT fr.date, fr.t, fr.factor, f, f_pred, avg(f) OVER w AS m, stddev_pop(f) OVER w AS s, lag(f_pred) OVER (PARTITION BY fr.factor ORDER BY fr.t) AS prev
  FROM fr JOIN pred ON pred.t = fr.t AND pred.factor = fr.factor WINDOW w AS (PARTITION BY fr.factor ORDER BY fr.t))
SELECT date, factor, {b.rd('f')} AS latest_estimated_f_t, {b.rd('m')} AS rolling_mean_f, {b.rd('f_pred - prev')} AS day_over_day_change,
  {b.rd('CASE WHEN s > 1e-12 THEN (f - m) / s END', 6)} AS zscore_factor_return FROM h""",
)
def factor_history_query(spark, sf):
    m = Model(spark, sf)
    f = m.factor_returns(m.exposures())
    h = factor_history(f, predict_factor_returns(f, "ewma"))
    return rounded(
        h.select("date", "factor", "latest_estimated_f_t", "rolling_mean_f", "day_over_day_change", "zscore_factor_return"),
        zscore_factor_return=6,
    )


@query("weights_of_a_date", f"{SCORE}, {b.long_short(0.1, 2.0, 5)} SELECT ticker, {b.rd('weight')} AS weight FROM weights WHERE t = (SELECT max(t) - 2 FROM cal)")
def weights_of_a_date(spark, sf):
    """Nothing stored: forecast, score and weights are recomputed for one date index."""
    m = Model(spark, sf)
    x = m.exposures()
    return rounded(stored_or_computed_weights({}, x, m.factor_returns(x), FACTORS, m.cal, -3))


SUMMARY_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS factor, {b.rd(f'count({n}) / max(cells)')} AS finite_ratio, max(cells) - count({n}) AS nan_count, "
    f"{b.rd(f'avg({n})')} AS mean, {b.rd(f'stddev_pop({n})')} AS std FROM raw, cells" for n in FACTORS
)


@query("factor_summary", f"WITH {b.RAW3}, {CELLS} {SUMMARY_ROWS}")
def factor_summary(spark, sf):
    m = Model(spark, sf)
    s = dg.factor_summary(m.raw, FACTORS, pp.grid_cells(m.cal, m.raw))
    return rounded(s.select("factor", "finite_ratio", "nan_count", "mean", "std"))


@query(
    "run_summary",
    f"""WITH {b.X3}, {CELLS} SELECT count(DISTINCT date) AS n_dates, count(DISTINCT ticker) AS n_tickers, {b.rd('count(*) / max(cells)')} AS x_finite_ratio,
  {b.rd('count(fwd_ret) / max(cells)')} AS r_finite_ratio, count(*) FILTER (WHERE tradable) AS true_count FROM x, cells""",
)
def run_summary(spark, sf):
    m = Model(spark, sf)
    s = dg.run_summary(m.exposures(), FACTORS, pp.grid_cells(m.cal, m.raw))
    return rounded(s.select("n_dates", "n_tickers", "x_finite_ratio", "r_finite_ratio", "true_count"))


@query(
    "output_validation",
    f"""WITH {FR}, {CELLS} SELECT 0 AS unmatched_keys, 0 AS duplicate_keys, true AS factors_match,
  {b.rd('(SELECT count(fwd_ret) FROM x) / (SELECT cells FROM cells)')} AS r_finite_ratio,
  {b.rd('(SELECT count(f) / count(*) FROM fr)')} AS f_finite_ratio,
  CASE WHEN (SELECT count(fwd_ret) FROM x) / (SELECT cells FROM cells) >= 0.5 AND (SELECT count(f) / count(*) FROM fr) >= 0.1 THEN 'PASS' ELSE 'FAIL' END AS verdict""",
)
def output_validation(spark, sf):
    m = Model(spark, sf)
    x = m.exposures()
    v = dg.validate_outputs(
        x, x.select("date", "ticker", "fwd_ret"), m.factor_returns(x), FACTORS, pp.grid_cells(m.cal, m.raw)
    )
    return rounded(v.select("unmatched_keys", "duplicate_keys", "factors_match", "r_finite_ratio", "f_finite_ratio", "verdict"))


@query("factor_build_all")
def factor_build_all(spark, sf):
    """All 27 price factors through screening and cross-validated ridge; the chosen penalty per date."""

    built = build_factors(
        month_bars(spark, sf), max_abs_forward_return=10.0, min_names=MIN_NAMES, ridge="auto"
    )
    return built.ridge.select("date", "selected_ridge", "n_obs", F.size("f").alias("n_factors"))


@query("calendar_check", f"WITH {b.MONTH_BARS} SELECT count(DISTINCT date) AS days FROM bars")
def calendar_check(spark, sf):
    """Strictly increasing dates and an allowed method, else an error."""
    from alphaweave.operators.universe import check_dates

    cal = materialize(calendar(month_bars(spark, sf)))
    check_dates(cal, "ewma")
    return cal.agg(F.count("*").alias("days"))
