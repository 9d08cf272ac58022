"""Factor-return forecasts, scores and contributions.

Factor-level tables have (dates x factors) rows; both counts are fixed by the
history and the model, so windows and broadcasts over them stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import add_all, finite_or_null, half_life_weight, is_finite

#: What the state-space filter tells of a factor; null without one.
FILTER_COLUMNS = (
    "kalman_forecast_f_hat", "kalman_f_hat", "kalman_gain", "state_covariance_diag", "process_noise_q", "measurement_noise_r",
)
METHODS = ("latest", "rolling", "ewma", "zero", "oracle")


def ewma_of(history: Column, t: Column, half_life: float, min_periods: int) -> Column:
    """Weighted mean of an array of (t, f); ages are counted back from t - 1.

    Local ages keep the powers small; a global exponent would overflow on long
    histories.
    """
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))

    def step(acc, e):
        w = half_life_weight(t - 1 - e["t"], half_life)
        return F.struct((acc["s"] + w * e["f"]).alias("s"), (acc["w"] + w).alias("w"))

    return F.when(F.size(history) >= min_periods, F.aggregate(history, zero, step, lambda a: a["s"] / a["w"]))


def predict_factor_returns(
    f: DataFrame, method: str = "latest", lookback: int = 20, half_life: float = 20.0, min_periods: int = 5,
    horizon: int = 1,
) -> DataFrame:
    """(date, t, factor, f_pred) using only rows before t.

    `f` is dense (one row per calendar day and factor). With horizon h > 1 the
    newest usable row is t - h, because f[s] contains prices up to s + h;
    horizon = 1 uses everything before t.
    """
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if lookback <= 0 or min_periods <= 0 or half_life <= 0 or horizon <= 0:
        raise ValueError("lookback, min_periods, half_life and horizon must be positive")
    keys = [c for c in f.columns if c != "f"]
    x = finite_or_null("f")
    if method == "oracle":
        return f.select(*keys, F.col("f").alias("f_pred"))
    if method == "zero":
        return f.select(*keys, F.lit(0.0).alias("f_pred"))
    h = horizon
    by_factor = Window.partitionBy("factor").orderBy("t")
    past = by_factor.rangeBetween(Window.unboundedPreceding, -h)
    recent = by_factor.rangeBetween(-(lookback + h - 1), -h)

    days = f.groupBy("t").agg(F.max(F.when(x.isNotNull(), F.col("t"))).alias("__t_any"))
    seen = days.select(
        "t",
        F.max("__t_any").over(Window.orderBy("t").rangeBetween(Window.unboundedPreceding, -h)).alias("__last_any"),
    )
    if method == "latest":
        last = f.select("factor", F.col("t").alias("__last_any"), x.alias("__f"))
        out = f.join(F.broadcast(seen), "t").join(F.broadcast(last), ["factor", "__last_any"], "left")
        value = F.coalesce("__f", F.lit(0.0))
    elif method == "rolling":
        out = f.withColumn(
            "__v", F.when(F.count(x).over(recent) >= min_periods, F.avg(x).over(recent))
        ).join(F.broadcast(seen), "t")
        value = F.coalesce("__v", F.lit(0.0))
    else:
        hist = F.collect_list(F.when(x.isNotNull(), F.struct("t", F.col("f").alias("f")))).over(recent)
        out = f.withColumn("__hist", hist).join(F.broadcast(seen), "t")
        shifted = F.col("t") - (h - 1)
        value = F.coalesce(ewma_of(F.col("__hist"), shifted, half_life, min_periods), F.lit(0.0))
    return out.select(*keys, F.when(F.col("__last_any").isNotNull(), value).alias("f_pred"))


def forecast_vector(f_pred: DataFrame, names: list[str], value: str = "f_pred", prefix: str = "fp_") -> DataFrame:
    """One row per day with a column per factor."""
    return f_pred.groupBy("t").agg(
        *[F.max(F.when(F.col("factor") == n, F.col(value))).alias(f"{prefix}{n}") for n in names]
    )


def with_forecast(exposures: DataFrame, f_pred: DataFrame, names: list[str]) -> DataFrame:
    return exposures.join(F.broadcast(forecast_vector(f_pred, names)), "t", "left")


def contribution(name: str, prefix: str = "fp_") -> Column:
    """Exposure times forecast; anything not finite counts as 0."""
    return F.coalesce(finite_or_null(name), F.lit(0.0)) * F.coalesce(finite_or_null(f"{prefix}{name}"), F.lit(0.0))


def has_forecast(names: list[str], prefix: str = "fp_") -> Column:
    out = F.lit(False)
    for n in names:
        out = out | is_finite(f"{prefix}{n}")
    return out


def score(
    exposures: DataFrame, f_pred: DataFrame, names: list[str], mask: str | None = "tradable",
    contributions: bool = False, out: str = "score",
) -> DataFrame:
    """Sum of exposure x forecast per row; null on days without a forecast or where masked.

    The forecasts arrive by a broadcast of one row per day, so scoring adds no
    exchange and compiles to plain multiply-adds.
    """
    joined = with_forecast(exposures, f_pred, names)
    total = F.when(has_forecast(names), add_all([contribution(n) for n in names]))
    if mask:
        total = F.when(F.col(mask), total)
    cols = [*exposures.columns, total.alias(out)]
    if contributions:
        cols += [contribution(n).alias(f"c_{n}") for n in names] + [F.col(f"fp_{n}") for n in names]
    return joined.select(*cols)


def score_long(exposures: DataFrame, f_pred: DataFrame) -> DataFrame:
    """Long form of the contraction: (date, ticker, factor, x) against (date, factor, f_pred)."""
    terms = F.coalesce(finite_or_null("x"), F.lit(0.0)) * F.coalesce(finite_or_null("f_pred"), F.lit(0.0))
    return (
        exposures.join(F.broadcast(f_pred.select("date", "factor", "f_pred")), ["date", "factor"])
        .groupBy("date", "ticker")
        .agg(F.when(F.count_if(is_finite("f_pred")) > 0, F.sum(terms)).alias("score"))
    )


def latest_forecast(f: DataFrame, half_life: float = 20.0) -> DataFrame:
    """(factor, f_pred): the exponentially weighted forecast made at the newest row.

    The newest row itself is not part of its own forecast.
    """
    pred = predict_factor_returns(f, "ewma", 20, half_life, 1)
    return pred.groupBy("factor").agg(F.max_by("f_pred", "t").alias("f_pred"))


def align_forecast(stored: DataFrame | None, factors: DataFrame) -> DataFrame:
    """Forecasts for exactly the given factors; unknown or missing ones are 0."""
    if stored is None:
        return factors.select("factor", F.lit(0.0).alias("f_pred"))
    return factors.select("factor").join(F.broadcast(stored), "factor", "left").select(
        "factor", F.coalesce(finite_or_null("f_pred"), F.lit(0.0)).alias("f_pred")
    )


def factor_history(f: DataFrame, f_pred: DataFrame) -> DataFrame:
    """Expanding mean/std z of each factor return and the day-over-day forecast change."""
    w = Window.partitionBy("factor").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = finite_or_null("f")
    joined = f.join(F.broadcast(f_pred.select("t", "factor", "f_pred")), ["t", "factor"])
    prev = F.lag("f_pred").over(w)
    mean, std = F.avg(x).over(upto), F.stddev_pop(x).over(upto)
    return joined.select(
        "date", "t", "factor",
        F.col("f").alias("latest_estimated_f_t"),
        mean.alias("rolling_mean_f"),
        prev.alias("previous_day_f_hat"),
        (F.col("f_pred") - finite_or_null(prev)).alias("day_over_day_change"),
        F.when(std > 1e-12, (F.col("f") - mean) / std).alias("zscore_factor_return"),
        F.col("f_pred").alias("final_f_hat"),
    )


def factor_report(f: DataFrame, f_pred: DataFrame, signal_t: int, states: DataFrame | None = None) -> DataFrame:
    """Factor table of one signal day from history before it: last usable row, trailing-252 mean/std.

    The previous forecast is always the 20-row exponential one, as made a day
    earlier. `states`, of `dynamic.kalman_states`, fills the filter's columns
    with its state at the end of the day before; its forecast for the signal
    day is that state, as it walks at random.
    """
    x = finite_or_null("f")
    hist = f.where(F.col("t") < signal_t)
    last_t = hist.where(x.isNotNull()).agg(F.max("t").alias("__lt"))
    latest = hist.join(F.broadcast(last_t), F.col("t") == F.col("__lt")).select("factor", F.col("f").alias("__latest"))
    stats = hist.where(F.col("t") >= signal_t - 252).groupBy("factor").agg(
        F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s")
    )
    prev = predict_factor_returns(f, "ewma", 20, 20.0, 1).where(F.col("t") == signal_t - 1)
    now = f_pred.where(F.col("t") == signal_t).select("date", "factor", F.col("f_pred").alias("__now"))
    sides = [latest, stats, prev.select("factor", F.col("f_pred").alias("__prev"))]
    if states is None:
        filtered = [F.lit(None).cast("double").alias(c) for c in FILTER_COLUMNS]
    else:
        state = states.where(F.col("t") == signal_t - 1)
        sides.append(state.select("factor", F.col("kalman_f_hat").alias(FILTER_COLUMNS[0]), *FILTER_COLUMNS[1:]))
        filtered = list(FILTER_COLUMNS)
    out = now
    for side in sides:
        out = out.join(F.broadcast(side), "factor", "left")
    return out.select(
        "date", "factor",
        F.col("__latest").alias("latest_estimated_f_t"),
        F.col("__m").alias("rolling_mean_f"),
        F.col("__prev").alias("previous_day_f_hat"),
        (F.col("__now") - F.col("__prev")).alias("day_over_day_change"),
        F.when(F.col("__s") > 1e-12, (F.col("__latest") - F.col("__m")) / F.col("__s")).alias("zscore_factor_return"),
        *filtered, F.lit(0.0).alias("kalman_weight"), F.lit(1.0).alias("rolling_weight"),
        F.col("__now").alias("final_f_hat"),
    )
