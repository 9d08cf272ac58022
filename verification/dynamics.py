"""State-space factor returns, regimes, blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaweave.operators import dynamic as dy
from alphaweave.operators.forecast import FILTER_COLUMNS, factor_report, predict_factor_returns
from alphaweave.session import materialize

from . import oracle_base as b
from .inputs import FACTORS, Model, rounded
from .model import FR
from .registry import query

Q, RN, P0 = 1e-3, 1e-2, 1.0
LOOK, WARN, BREAK = 20, 0.8, 0.95


def estimates(spark, sf):
    """Factor returns of the wide model with two factors blanked on some days."""
    m = Model(spark, sf)
    f = m.factor_returns(m.exposures())
    return m, f.withColumn("f", F.expr("CASE WHEN t % 17 = 9 THEN NULL WHEN factor = 'mom_1' AND t % 11 = 4 THEN NULL ELSE f END"))


KALMAN = f"""RECURSIVE {FR},
fo AS (SELECT date, t, factor, CASE WHEN t % 17 = 9 THEN NULL WHEN factor = 'mom_1' AND t % 11 = 4 THEN NULL ELSE f END AS z FROM fr),
ob AS (SELECT t, count(z) > 0 AS has FROM fo GROUP BY t),
kf AS (
  SELECT -1 AS t, factor, 0e0 AS m, {P0}e0 AS p, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS s FROM (SELECT DISTINCT factor FROM fo)
  UNION ALL
  SELECT o.t, k.factor,
    CASE WHEN z IS NOT NULL THEN m + (p + {Q}) / (p + {Q} + {RN}) * (z - m) ELSE m END,
    CASE WHEN z IS NOT NULL THEN (p + {Q}) - (p + {Q}) / (p + {Q} + {RN}) * (p + {Q}) WHEN has THEN p + {Q} ELSE p END,
    z - m, CASE WHEN z IS NOT NULL THEN p + {Q} + {RN} END
  FROM kf k JOIN fo o ON o.factor = k.factor AND o.t = k.t + 1 JOIN ob ON ob.t = o.t),
inn AS (
  SELECT c.date, c.t, count(y) AS valid_factor_count, sqrt(sum(y * y) / nullif(count(y), 0)) AS innovation_norm, sum(y * y / s) AS innovation_score
  FROM cal c JOIN kf USING (t) GROUP BY 1, 2)"""
REG = f"""{KALMAN},
th AS (
  SELECT i.*, count(innovation_score) OVER w AS n, quantile_cont(innovation_score, {WARN}) OVER w AS wq, quantile_cont(innovation_score, {BREAK}) OVER w AS bq
  FROM inn i WINDOW w AS (ORDER BY t RANGE BETWEEN {LOOK} PRECEDING AND 1 PRECEDING)),
rg AS (
  SELECT *, CASE WHEN t < {LOOK} THEN 'warmup' WHEN n < {LOOK // 2} OR innovation_score IS NULL THEN 'unknown' WHEN innovation_score > bq THEN 'break'
    WHEN innovation_score > wq THEN 'warning' ELSE 'normal' END AS regime_state,
    CASE WHEN t >= {LOOK} AND n >= {LOOK // 2} THEN wq END AS warning_threshold, CASE WHEN t >= {LOOK} AND n >= {LOOK // 2} THEN bq END AS break_threshold FROM th)"""


def filtered(spark, sf):
    m, f = estimates(spark, sf)
    f = materialize(f)
    kf, inn = dy.kalman_from_returns(f, Q, RN, P0)
    return m, f, materialize(kf), materialize(inn)


@query("kalman_factor_returns", f"WITH {KALMAN} SELECT c.date, k.factor, {b.rd('m')} AS f_kf FROM kf k JOIN cal c USING (t)")
def kalman_factor_returns(spark, sf):
    """Per-factor random-walk filter with missing observations."""
    _, _, kf, _ = filtered(spark, sf)
    return rounded(kf.select("date", "factor", "f_kf"))


@query(
    "kalman_innovations",
    f"WITH {KALMAN} SELECT date, valid_factor_count, {b.rd('innovation_norm')} AS innovation_norm, {b.rd('innovation_score', 7)} AS innovation_score FROM inn",
)
def kalman_innovations(spark, sf):
    _, _, _, inn = filtered(spark, sf)
    return rounded(inn.drop("t"), innovation_score=7)


@query(
    "kalman_filter_states",
    f"""WITH {KALMAN} SELECT c.date, k.factor, {b.rd('lag(m) OVER w')} AS kalman_forecast_f_hat, {b.rd('m')} AS kalman_f_hat, {b.rd(f'(s - {RN}) / s')} AS kalman_gain,
  {b.rd('p')} AS state_covariance_diag, {Q}e0 AS process_noise_q, {RN}e0 AS measurement_noise_r
FROM kf k LEFT JOIN cal c USING (t) WINDOW w AS (PARTITION BY k.factor ORDER BY k.t) QUALIFY k.t >= 0""",
)
def kalman_filter_states(spark, sf):
    """Forecast, state, gain and variance of the filter, per day and factor."""
    _, f = estimates(spark, sf)
    return rounded(dy.kalman_states(f, Q, RN, P0).drop("t", "y", "s"))


@query(
    "factor_report_filter_columns",
    f"""WITH {KALMAN} SELECT factor, {b.rd('m')} AS kalman_forecast_f_hat, {b.rd('m')} AS kalman_f_hat, {b.rd(f'(s - {RN}) / s')} AS kalman_gain, {b.rd('p')} AS state_covariance_diag,
  {Q}e0 AS process_noise_q, {RN}e0 AS measurement_noise_r, 0e0 AS kalman_weight, 1e0 AS rolling_weight FROM kf WHERE t = (SELECT max(t) FROM cal) - 1""",
)
def factor_report_filter_columns(spark, sf):
    """The factor table of the last day with the filter's state of the day before."""
    m, f = estimates(spark, sf)
    f = materialize(f)
    t = m.cal.agg(F.max("t")).first()[0]
    r = factor_report(f, predict_factor_returns(f, "ewma", min_periods=1), t, dy.kalman_states(f, Q, RN, P0))
    return rounded(r.select("factor", *FILTER_COLUMNS, "kalman_weight", "rolling_weight"))


@query("kalman_stock_level")
def kalman_stock_level(spark, sf):
    """Filter on every stock return, in K x K form."""
    m = Model(spark, sf)
    out = dy.kalman_from_stocks(m.exposures(), m.cal, FACTORS)
    return out.select("date", "n_obs", *[F.col("f")[i].alias(n) for i, n in enumerate(FACTORS)], "innovation_norm", "innovation_score")


def regimes(spark, sf):
    m, f, kf, inn = filtered(spark, sf)
    return m, f, kf, materialize(dy.classify_regimes(inn, LOOK, WARN, BREAK))


@query(
    "regimes",
    f"""WITH {REG} SELECT date, regime_state, {b.rd('warning_threshold', 7)} AS warning_threshold, {b.rd('break_threshold', 7)} AS break_threshold,
  regime_state IN ('warning', 'break') AS regime_event,
  coalesce(regime_state IN ('normal', 'warning', 'break') AND regime_state <> lag(regime_state) OVER (ORDER BY t), false) AS regime_switch,
  lag(regime_state) OVER (ORDER BY t) AS regime_for_trading FROM rg""",
)
def regimes_query(spark, sf):
    r = dy.trading_regime(regimes(spark, sf)[3])
    return rounded(
        r.select("date", "regime_state", "warning_threshold", "break_threshold", "regime_event", "regime_switch", "regime_for_trading"), 7
    )


BLEND = f"""{REG}, bl AS (
  SELECT o.date, o.t, o.factor, o.z AS f, k.m AS f_kf, regime_state,
    CASE regime_state WHEN 'normal' THEN 0.3 WHEN 'warning' THEN 0.6 WHEN 'break' THEN 0.8 ELSE 0.5 END AS a
  FROM fo o JOIN kf k ON k.t = o.t AND k.factor = o.factor JOIN rg ON rg.t = o.t)"""


@query("blended_factor_returns", f"WITH {BLEND} SELECT date, factor, a::DOUBLE AS alpha_ols, {b.rd('coalesce(a * f + (1 - a) * f_kf, f, f_kf)')} AS f_blend FROM bl")
def blended_factor_returns(spark, sf):
    _, f, kf, r = regimes(spark, sf)
    return rounded(dy.blend(f, kf, r).select("date", "factor", "alpha_ols", "f_blend"))


@query(
    "dynamic_diagnostics",
    f"""WITH {BLEND} SELECT (SELECT count(*) FROM rg) AS dates, 3 AS factors, (SELECT count(DISTINCT ticker) FROM panel) AS assets,
  {b.rd('(SELECT count(f) / count(*) FROM bl)')} AS coverage_ols, {b.rd('(SELECT count(innovation_score) / count(*) FROM rg)')} AS coverage_innovation,
  {b.rd('(SELECT avg(valid_factor_count) FROM rg)')} AS mean_valid_obs, (SELECT count(*) FROM rg WHERE valid_factor_count = 0) AS skipped_dates,
  (SELECT count(*) FROM rg WHERE regime_state = 'normal') AS normal_days, (SELECT count(*) FROM rg WHERE regime_state = 'break') AS break_days,
  (SELECT count(*) FROM rg WHERE regime_state IN ('unknown', 'warmup')) AS unknown_warmup_days, {b.rd('(SELECT avg(a) FROM bl)')} AS mean_alpha_ols""",
)
def dynamic_diagnostics(spark, sf):
    m, f, kf, r = regimes(spark, sf)
    assets = m.raw.agg(F.countDistinct("ticker").alias("assets"))
    d = dy.dynamic_diagnostics(materialize(dy.blend(f, kf, r)), r, assets)
    return rounded(
        d.select(
            "dates", "factors", "assets", "coverage_ols", "coverage_innovation", "mean_valid_obs", "skipped_dates", "normal_days",
            "break_days", "unknown_warmup_days", "mean_alpha_ols",
        )
    )


@query(
    "innovation_spikes",
    f"WITH {REG} SELECT date, {b.rd('innovation_score', 7)} AS score, regime_state FROM rg WHERE innovation_score IS NOT NULL ORDER BY innovation_score DESC, t LIMIT 5",
)
def innovation_spikes(spark, sf):
    return rounded(dy.innovation_spikes(regimes(spark, sf)[3]).select("date", "score", "regime_state"), 7)


@query(
    "recent_regime_events",
    f"WITH {REG} SELECT date, {b.rd('innovation_score', 7)} AS score, regime_state FROM rg WHERE regime_state IN ('warning', 'break') ORDER BY t DESC LIMIT 5",
)
def recent_regime_events(spark, sf):
    return rounded(dy.recent_events(regimes(spark, sf)[3]).select("date", "score", "regime_state"), 7)
