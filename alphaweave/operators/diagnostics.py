"""Table summaries and output validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import INF, is_finite
from .keyed import attach_row


def factor_summary(df: DataFrame, names: list[str], cells: DataFrame | None = None) -> DataFrame:
    """Per factor: finite share, null and infinity counts, mean and population std, in one pass.

    `cells` (one row) is the full grid size; cells without a row count as null.
    """
    total = cells if cells is not None else df.agg(F.count("*").alias("cells"))
    aggs = []
    for n in names:
        x = F.col(n)
        aggs.append(
            F.struct(
                F.lit(n).alias("factor"), F.count_if(is_finite(n)).alias("finite"),
                F.count_if(x == INF).alias("posinf_count"), F.count_if(x == -INF).alias("neginf_count"),
                F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
            ).alias(n)
        )
    long = df.agg(*aggs).select(F.inline(F.array(*names)))
    out = attach_row(long, total)
    return out.select(
        "factor", (F.col("finite") / F.col("cells")).alias("finite_ratio"),
        (F.col("cells") - F.col("finite") - F.col("posinf_count") - F.col("neginf_count")).alias("nan_count"),
        "posinf_count", "neginf_count", "mean", "std",
    )


def run_summary(exposures: DataFrame, names: list[str], cells: DataFrame, ret: str = "fwd_ret") -> DataFrame:
    """One-row pipeline summary: sizes, finite shares, tradable cells."""
    finite_x = F.lit(0)
    for n in names:
        finite_x = finite_x + is_finite(n).cast("int")
    base = exposures.agg(
        F.countDistinct("date").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"),
        F.sum(finite_x).alias("__fx"), F.count_if(is_finite(ret)).alias("__fr"), F.count_if("tradable").alias("true_count"),
    )
    c = F.col("cells")
    return attach_row(base, cells).select(
        "n_dates", "n_tickers", F.lit(len(names)).alias("n_factors"),
        (F.col("__fx") / (c * len(names))).alias("x_finite_ratio"), (F.col("__fr") / c).alias("r_finite_ratio"),
        "true_count", (F.col("true_count") / c).alias("true_ratio"),
    )


def validate_outputs(
    exposures: DataFrame, returns: DataFrame, factor_returns: DataFrame, names: list[str], cells: DataFrame,
    min_x: float = 0.95, min_r: float = 0.50, min_f: float = 0.10,
) -> DataFrame:
    """One-row verdict: key agreement, unique keys, finite-share minima.

    Shape checks on arrays become key checks: every return row has an exposure
    row and the other way round, no key repeats, and the factor set matches.
    """
    keys = ["date", "ticker"]
    x = exposures.groupBy(*keys).agg(F.count("*").alias("nx"))
    r = returns.groupBy(*keys).agg(F.count("*").alias("nr"))
    match = x.join(r, keys, "full_outer").agg(
        F.count_if(F.col("nx").isNull() | F.col("nr").isNull()).alias("unmatched_keys"),
        F.count_if((F.col("nx") > 1) | (F.col("nr") > 1)).alias("duplicate_keys"),
    )
    known = F.col("factor").isin(*names)
    f = factor_returns.agg(
        F.avg(is_finite("f").cast("double")).alias("f_finite_ratio"),
        F.countDistinct(F.when(known, F.col("factor"))).alias("__kf"), F.count_if(~known).alias("__uf"),
    )
    finite_x = F.lit(0)
    for n in names:
        finite_x = finite_x + is_finite(n).cast("int")
    xs = exposures.agg(F.sum(finite_x).alias("__fx"), F.count("*").alias("__rows"))
    rs = returns.agg(F.count_if(is_finite("fwd_ret")).alias("__fr"))
    out = match
    for part in (f, xs, rs, cells):
        out = attach_row(out, part)
    out = out.select(
        "unmatched_keys", "duplicate_keys",
        ((F.col("__kf") == len(names)) & (F.col("__uf") == 0)).alias("factors_match"),
        (F.col("__fx") / (F.col("__rows") * len(names))).alias("x_finite_ratio"),
        (F.col("__fr") / F.col("cells")).alias("r_finite_ratio"), "f_finite_ratio",
    )
    good = (
        (F.col("unmatched_keys") == 0) & (F.col("duplicate_keys") == 0) & F.col("factors_match")
        & (F.col("x_finite_ratio") >= min_x) & (F.col("r_finite_ratio") >= min_r) & (F.col("f_finite_ratio") >= min_f)
    )
    return out.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def weakest_coverage(diagnostics: DataFrame, n: int = 10) -> DataFrame:
    """The factors with the smallest share of finite cells after processing, of equal ones the first by name."""
    return diagnostics.orderBy("processed_finite_ratio", "factor").limit(n)
