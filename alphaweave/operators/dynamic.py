"""State-space factor returns, regimes and blending.

Inputs here are day-level tables: (dates x factors) rows, bounded by the
calendar and the model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blend_weight, finite_or_null, is_finite
from .keyed import attach_row
from .ridge import triangles


def kalman_states(f: DataFrame, q_scale: float = 1e-5, r_scale: float = 1e-3, p0_scale: float = 1.0) -> DataFrame:
    """Random-walk filter on estimated factor returns (date, t, factor, f), dense in t, with its state per day and factor.

    All noise covariances are multiples of the identity, so the state
    covariance stays diagonal and each factor filters on its own: one group per
    factor, run in parallel. A day without any finite factor carries the state
    and adds no process noise.

    `kalman_forecast_f_hat` is the state before the day's return is known and
    `kalman_f_hat` after it; `kalman_gain`, the innovation `y` and its variance
    `s` are null where the factor has no finite return; `state_covariance_diag`
    is the variance of the state after the day.
    """
    seen = f.groupBy("t").agg(F.count_if(is_finite("f")).alias("valid_factor_count"))
    rows = f.join(F.broadcast(seen), "t").select("date", "t", "factor", finite_or_null("f").alias("z"), "valid_factor_count")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        z, any_obs = pdf["z"].to_numpy(dtype=float), pdf["valid_factor_count"].to_numpy() > 0
        m, p = 0.0, p0_scale
        before, state, variance = (np.empty(len(z)) for _ in range(3))
        y, s, gains = (np.full(len(z), np.nan) for _ in range(3))
        for i, obs in enumerate(z):
            before[i] = m
            if any_obs[i]:
                p += q_scale
                if np.isfinite(obs):
                    y[i], s[i] = obs - m, p + r_scale
                    gains[i] = p / s[i]
                    m, p = m + gains[i] * y[i], p - gains[i] * p
            state[i], variance[i] = m, p
        return pd.DataFrame(
            {
                "date": pdf["date"], "t": pdf["t"], "factor": pdf["factor"], "kalman_forecast_f_hat": before, "kalman_f_hat": state,
                "kalman_gain": gains, "state_covariance_diag": variance, "y": y, "s": s,
            }
        )

    out = rows.groupBy("factor").applyInPandas(
        run,
        "date date, t int, factor string, kalman_forecast_f_hat double, kalman_f_hat double, kalman_gain double, state_covariance_diag double, y double, s double",
    )
    return out.withColumns(
        {c: finite_or_null(c) for c in ("kalman_gain", "y", "s")}
        | {"process_noise_q": F.lit(q_scale), "measurement_noise_r": F.lit(r_scale)}
    )


def kalman_from_returns(
    f: DataFrame, q_scale: float = 1e-5, r_scale: float = 1e-3, p0_scale: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(date, t, factor, f_kf) of `kalman_states` and the per-day innovation table."""
    out = kalman_states(f, q_scale, r_scale, p0_scale)
    innovation = out.groupBy("date", "t").agg(
        F.count("y").alias("valid_factor_count"),
        F.sqrt(F.sum(F.col("y") * F.col("y")) / F.nullif(F.count("y"), F.lit(0))).alias("innovation_norm"),
        F.sum(F.col("y") * F.col("y") / F.col("s")).alias("innovation_score"),
    )
    return out.select("date", "t", "factor", F.col("kalman_f_hat").alias("f_kf")), innovation


def kalman_from_stocks(
    exposures: DataFrame, cal: DataFrame, names: list[str], q_scale: float = 1e-4, r_scale: float = 1e-2,
    p0_scale: float = 1.0, ret: str = "fwd_ret",
) -> DataFrame:
    """Filter with every stock return as an observation: (date, t, n_obs, f, innovation_norm, innovation_score).

    The stocks of a day enter only through the triangle of [X | 1 | r], built by
    partial reduction; the recursion then runs on K x K matrices. Rows count
    when the return and all exposures are finite; days with fewer than K + 5
    such rows carry the state.
    """
    k = len(names)
    ok = is_finite(ret)
    for n in names:
        ok = ok & is_finite(n)
    rows = exposures.where(ok).select("date", F.array(*names).alias("x"), F.col(ret).alias("y"))
    tri = cal.join(triangles(rows, k), "date", "left").withColumn("model", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        f, p = np.zeros(k), p0_scale * np.eye(k)
        out = []
        for d, t, n, r in zip(pdf["date"], pdf["t"], pdf["n"], pdf["r"]):
            n = 0 if n is None or n != n else int(n)
            norm = score = None
            if n >= k + 5:
                a = np.asarray(r, dtype=float).reshape(-1, k + 2)
                x, y = a[:, :k], a[:, k + 1]
                p = p + q_scale * np.eye(k)
                resid = y - x @ f
                g, b = x.T @ x, x.T @ resid
                p = np.linalg.inv(np.linalg.inv(p) + g / r_scale)
                p = (p + p.T) / 2
                norm = float(np.linalg.norm(resid) / np.sqrt(n))
                score = float((resid @ resid - b @ p @ b / r_scale) / r_scale)
                f = f + p @ b / r_scale
            out.append((d, t, n, list(f), norm, score))
        return pd.DataFrame(out, columns=["date", "t", "n_obs", "f", "innovation_norm", "innovation_score"])

    return tri.groupBy("model").applyInPandas(
        run, "date date, t int, n_obs bigint, f array<double>, innovation_norm double, innovation_score double"
    )


def kalman_factor_returns(exposures=None, cal=None, names=None, f=None, **scales):
    """Filter on factor returns when they are given, else on stock observations."""
    if f is not None:
        return kalman_from_returns(f, **scales)
    if exposures is None:
        raise ValueError("either factor returns or exposures are needed")
    return kalman_from_stocks(exposures, cal, names, **scales)


def classify_regimes(
    innovation: DataFrame, lookback: int = 252, warning_q: float = 0.95, break_q: float = 0.99, score: str = "innovation_score",
) -> DataFrame:
    """Regime per day against quantiles of the `lookback` days before it.

    warmup while t < lookback; unknown when fewer than half the past scores are
    finite or today's is missing; a switch is only marked on classified days.
    """
    if lookback <= 0:
        raise ValueError("lookback must be positive")
    if not 0.0 < warning_q < break_q < 1.0:
        raise ValueError("expected 0 < warning_q < break_q < 1")
    x = finite_or_null(score)
    past = Window.orderBy("t").rangeBetween(-lookback, -1)
    df = innovation.withColumns(
        {
            "__n": F.count(x).over(past),
            "__w": F.percentile(x, F.lit(warning_q)).over(past),
            "__b": F.percentile(x, F.lit(break_q)).over(past),
        }
    )
    enough = (F.col("t") >= lookback) & (F.col("__n") >= lookback // 2)
    df = df.withColumn("warning_threshold", F.when(enough, F.col("__w"))).withColumn(
        "break_threshold", F.when(enough, F.col("__b"))
    )
    state = (
        F.when(F.col("t") < lookback, "warmup")
        .when(~enough | ~is_finite(score), "unknown")
        .when(F.col(score) > F.col("break_threshold"), "break")
        .when(F.col(score) > F.col("warning_threshold"), "warning")
        .otherwise("normal")
    )
    df = df.withColumn("regime_state", state)
    classified = F.col("regime_state").isin("normal", "warning", "break")
    before = F.lag("regime_state").over(Window.orderBy("t"))
    return df.withColumns(
        {
            "regime_event": F.col("regime_state").isin("warning", "break"),
            "regime_switch": F.coalesce(classified & (F.col("regime_state") != before), F.lit(False)),
        }
    ).drop("__n", "__w", "__b")


def trading_regime(regimes: DataFrame) -> DataFrame:
    """The regime a trader may use on day t is the one of t - 1."""
    return regimes.withColumn("regime_for_trading", F.lag("regime_state").over(Window.orderBy("t")))


def blend(f_ols: DataFrame, f_kf: DataFrame, regimes: DataFrame) -> DataFrame:
    """Mix of both estimates by regime where both exist, else whichever exists."""
    a, x, y = F.col("alpha_ols"), F.col("f"), F.col("f_kf")
    joined = f_ols.join(F.broadcast(f_kf.select("t", "factor", "f_kf")), ["t", "factor"]).join(
        F.broadcast(regimes.select("t", "regime_state", blend_weight("regime_state").alias("alpha_ols"))), "t"
    )
    both = F.when(is_finite("f") & is_finite("f_kf"), a * x + (1 - a) * y)
    return joined.select(
        "date", "t", "factor", "f", "f_kf", "regime_state", "alpha_ols",
        F.coalesce(both, finite_or_null("f"), finite_or_null("f_kf")).alias("f_blend"),
    )


def innovation_spikes(regimes: DataFrame, n: int = 5) -> DataFrame:
    return regimes.where(is_finite("innovation_score")).orderBy(F.desc("innovation_score"), "t").limit(n).select(
        "date", F.col("innovation_score").alias("score"), "warning_threshold", "break_threshold", "regime_state"
    )


def recent_events(regimes: DataFrame, n: int = 5) -> DataFrame:
    return regimes.where("regime_event").orderBy(F.desc("t")).limit(n).select(
        "date", "regime_state", F.col("innovation_score").alias("score"), "warning_threshold", "break_threshold"
    )


def dynamic_diagnostics(blended: DataFrame, regimes: DataFrame, n_assets: DataFrame) -> DataFrame:
    """One-row coverage, observation, regime and warning summary.

    `n_assets` is a one-row table with column `assets`.
    """
    cells = blended.agg(
        F.countDistinct("factor").alias("factors"),
        F.avg(is_finite("f").cast("double")).alias("coverage_ols"),
        F.avg(is_finite("f_kf").cast("double")).alias("coverage_kf"),
        F.avg(is_finite("f_blend").cast("double")).alias("coverage_blend"),
    )
    state = lambda *s: F.count_if(F.col("regime_state").isin(*s))
    days = regimes.agg(
        F.count("*").alias("dates"),
        F.avg(is_finite("innovation_score").cast("double")).alias("coverage_innovation"),
        F.avg("valid_factor_count").alias("mean_valid_obs"), F.min("valid_factor_count").alias("min_valid_obs"),
        F.count_if(F.col("valid_factor_count") == 0).alias("skipped_dates"),
        state("normal").alias("normal_days"), state("warning").alias("warning_days"), state("break").alias("break_days"),
        state("unknown", "warmup").alias("unknown_warmup_days"),
        F.avg(blend_weight("regime_state")).alias("mean_alpha_ols"),
    )
    out = attach_row(attach_row(days, cells), n_assets)
    warn = F.array_compact(
        F.array(
            F.when(F.col("skipped_dates") > F.col("dates") * 0.1, "high_skipped_dates"),
            F.when(F.col("coverage_innovation") < 0.8, "low_innovation_coverage"),
            F.when(F.col("break_days") > F.col("dates") * 0.05, "frequent_breaks"),
            F.when(F.col("coverage_blend") < F.col("coverage_ols") * 0.9, "blend_coverage_below_ols"),
        )
    )
    return out.withColumn("warnings", F.array_join(warn, ";"))
