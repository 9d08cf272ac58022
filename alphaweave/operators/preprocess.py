"""Cross-sectional cleaning of raw factors: winsorize, z-score, coverage, duplicates.

Every per-date statistic is a partial aggregation followed by a broadcast of
one row per date; no task ever holds a whole cross-section. These rows are
written once: the cleaned table has many readers, and each would otherwise
pass over all cells again for the same few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


from ..functions import finite_or_null, group_quantiles, join_stats, sql_finite, sql_is_finite
from ..functions.stats import LISTED_CELLS
from ..session import materialize
from .keyed import attach_row
from .universe import densify


def winsorize(
    df: DataFrame, names: list[str], lower: float = 0.01, upper: float = 0.99, min_names: int = 30,
    key: str = "date", listed_cells: int = LISTED_CELLS,
) -> DataFrame:
    """Clip each date's values to its quantiles; a thin date becomes null.

    Quantiles use finite values, but an infinity is then clipped to the bound.
    """
    stats = materialize(group_quantiles(df, [key], {n: finite_or_null(n) for n in names}, [lower, upper], listed_cells))
    clipped = [
        f"CASE WHEN {n}__n >= {min_names} AND {n} IS NOT NULL AND NOT isnan({n}) THEN least(greatest({n}, {n}__q[0]), {n}__q[1]) END AS {n}"
        for n in names
    ]
    return join_stats(df, stats, [key]).selectExpr(*[c for c in df.columns if c not in names], *clipped)


def zscore(df: DataFrame, names: list[str], min_names: int = 30, key: str = "date") -> DataFrame:
    """(x - mean) / population std per date; null for a thin or constant date."""
    aggs = [
        F.expr(f"{fn}({sql_finite(n)}) AS {n}__{tag}")
        for n in names
        for fn, tag in (("count", "n"), ("avg", "m"), ("stddev_pop", "s"))
    ]
    scaled = [
        f"CASE WHEN {n}__n >= {min_names} AND {n}__s > 1e-12 AND {n}__s < double('infinity') "
        f"THEN ({n} - {n}__m) / {n}__s END AS {n}"
        for n in names
    ]
    stats = materialize(df.groupBy(key).agg(*aggs))
    return join_stats(df, stats, [key]).selectExpr(*[c for c in df.columns if c not in names], *scaled)


def preprocess(
    df: DataFrame, names: list[str], min_names: int = 30, lower: float = 0.01, upper: float = 0.99,
    key: str = "date",
) -> DataFrame:
    return zscore(winsorize(df, names, lower, upper, min_names, key), names, min_names, key)


def coverage(df: DataFrame, names: list[str], cells: DataFrame | None = None) -> DataFrame:
    """Per factor: finite cells and dates with any finite cell, in one pass plus one small regroup.

    `cells` (one row, column `cells`) is T x N of the full grid; without it the
    rows of `df` are the grid.
    """
    per_date = df.groupBy("date").agg(
        F.expr("count(1) AS __rows"), *[F.expr(f"count_if({sql_is_finite(n)}) AS {n}") for n in names]
    )
    packed = per_date.agg(
        F.expr("sum(__rows) AS rows"),
        *[F.expr(f"named_struct('c', sum({n}), 'd', count_if({n} > 0)) AS {n}") for n in names],
    )
    items = ", ".join(
        f"named_struct('k', {i}, 'factor', '{n}', 'finite_cells', {n}.c, 'finite_dates', {n}.d)" for i, n in enumerate(names)
    )
    out = packed.selectExpr("rows", f"inline(array({items}))")
    if cells is None:
        return out.withColumnRenamed("rows", "cells")
    return attach_row(out.drop("rows"), cells)


def grid_cells(cal: DataFrame, tickers: DataFrame) -> DataFrame:
    """T x N as one row, without building the grid."""
    n = tickers.select("ticker").distinct().agg(F.count("*").alias("__n"))
    return attach_row(cal.agg(F.count("*").alias("__t")), n).select((F.col("__t") * F.col("__n")).alias("cells"))


def factor_correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation and overlap of every factor pair over pairwise-finite cells.

    Every task turns its rows into K x K sums by matrix products and hands on
    only those; a sum over (i, j) completes them. Meant for z-scored columns,
    whose sums do not cancel. Returns (i, j, factor, with, corr, overlap) with
    i < j and factor = j.
    """
    k = len(names)
    upper = np.triu_indices(k, 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            m = np.isfinite(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            sq = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        yield pd.DataFrame(
            {"i": upper[0], "j": upper[1]} | {c: total[a][upper] for a, c in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}
        )

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    part = df.select(*names).mapInPandas(sums, schema)
    agg = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    agg = agg.selectExpr(
        "i", "j", "bigint(n) AS overlap", "try_divide(sxy, n) - try_divide(sx, n) * try_divide(sy, n) AS cov",
        "sqrt(greatest(try_divide(sxx, n) - power(try_divide(sx, n), 2), 0D)) AS dx",
        "sqrt(greatest(try_divide(syy, n) - power(try_divide(sy, n), 2), 0D)) AS dy",
    )
    label = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    return agg.selectExpr(
        "i", "j", f"{label}[j] AS factor", f"{label}[i] AS with",
        "CASE WHEN dx > 1e-12 AND dy > 1e-12 THEN cov / (dx * dy) END AS corr", "overlap",
    )


def greedy_duplicates(pairs: list[Row], kept: list[str], threshold: float, min_overlap: int) -> dict[str, Row]:
    """Walk factors in order; drop one that nearly equals an earlier kept one.

    The input is the K x K table, whose size is fixed by the factor list.
    """
    if not 0 < threshold <= 1:
        return {}
    by_later: dict[str, list[Row]] = {}
    for p in sorted(pairs, key=lambda r: (r["j"], r["i"])):
        by_later.setdefault(p["factor"], []).append(p)
    dropped: dict[str, Row] = {}
    for name in kept:
        for p in by_later.get(name, []):
            if p["with"] in dropped or p["overlap"] < min_overlap or p["corr"] is None:
                continue
            if abs(p["corr"]) >= threshold:
                dropped[name] = p
                break
    return dropped


def dense_exposures(exposures: DataFrame, names: list[str], cal: DataFrame) -> DataFrame:
    """Exposures on the full date x ticker grid: absent cells get the neutral 0 and are not tradable.

    Only needed where reports must rank and bucket names on days without a bar.
    """
    others = [c for c in exposures.columns if c not in ("date", "t", "ticker", *names)]
    grid = densify(exposures, cal, exposures, [*others, *names])
    return grid.withColumns(
        {n: F.coalesce(n, F.lit(0.0)) for n in names}
        | ({"tradable": F.coalesce("tradable", F.lit(False))} if "tradable" in others else {})
    )


class Preprocessed:
    """Cleaned factor table, the kept factor names in order, and the diagnostics table."""

    def __init__(self, table: DataFrame, names: list[str], diagnostics: DataFrame):
        self.table, self.names, self.diagnostics = table, names, diagnostics


DIAGNOSTIC_SCHEMA = (
    "factor string, kept boolean, raw_finite_ratio double, processed_finite_ratio double, finite_dates long, "
    "min_factor_coverage double, drop_reason string, corr_with string, corr_value double, corr_overlap long"
)


def build_exposures(
    raw: DataFrame, names: list[str], min_names: int = 30, min_factor_coverage: float = 0.02,
    fill_missing: bool = True, lower: float = 0.01, upper: float = 0.99, max_factor_corr: float = 0.999,
    corr_min_overlap: int = 100, cells: DataFrame | None = None,
) -> Preprocessed:
    """Clean all factors, drop sparse and duplicate ones, fill the rest with the neutral 0.

    Which factors survive decides the columns of everything downstream, so two
    small results come to the driver: K coverage rows and K x K correlations.
    """
    z = preprocess(raw, names, min_names, lower, upper)
    before = {r["factor"]: r for r in coverage(raw, names, cells).collect()}
    after = {r["factor"]: r for r in coverage(z, names, cells).collect()}
    ratio = lambda r: r["finite_cells"] / r["cells"] if r["cells"] else 0.0
    covered = [n for n in names if ratio(after[n]) >= min_factor_coverage and after[n]["finite_dates"] > 0]
    dropped: dict[str, Row] = {}
    if len(covered) > 1 and 0 < max_factor_corr <= 1:
        pairs = factor_correlations(z, covered).collect()
        dropped = greedy_duplicates(pairs, covered, max_factor_corr, corr_min_overlap)
    kept = [n for n in covered if n not in dropped]
    rows = []
    for n in names:
        hit = dropped.get(n)
        reason = "" if n in kept else "high_corr" if hit else "low_coverage"
        rows.append(
            (
                n, n in kept, ratio(before[n]), ratio(after[n]), int(after[n]["finite_dates"]), min_factor_coverage,
                reason, hit["with"] if hit else "", hit["corr"] if hit else None, hit["overlap"] if hit else 0,
            )
        )
    rows.sort(key=lambda r: (not r[1], -r[3], r[0]))
    diagnostics = raw.sparkSession.createDataFrame(rows, DIAGNOSTIC_SCHEMA)
    others = [c for c in raw.columns if c not in names]
    fill = lambda n: F.coalesce(finite_or_null(n), F.lit(0.0)) if fill_missing else finite_or_null(n)
    return Preprocessed(z.select(*others, *[fill(n).alias(n) for n in kept]), kept, diagnostics)
