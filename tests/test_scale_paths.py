"""Paths for large groups give the same result as the small ones, skew included."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
import pandas as pd
from conftest import business_days
from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaweave.config import BacktestConfig
from alphaweave.functions import group_quantiles, group_rank
from alphaweave.functions.stats import value_bucket
from alphaweave.operators import rankings as rk
from alphaweave.operators import ridge as rg
from alphaweave.operators.book import run_book
from alphaweave.operators.dynamic import kalman_from_stocks
from alphaweave.operators.preprocess import factor_correlations
from alphaweave.operators.residuals import similarity_order


def skewed(spark, n=4000):
    """One group holds a third of the rows and many ties."""
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 5) END AS g", "id",
        "CASE WHEN id % 4 = 0 THEN 7D WHEN id % 97 = 1 THEN NULL ELSE (id * 7919 % 1009) / 10D END AS v",
    )


@pytest.mark.parametrize("listed", [0, 1_000_000])
def test_quantiles_equal_percentile(spark, listed):
    probs = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    df = skewed(spark).withColumn("w", F.expr("CASE WHEN id % 3 = 1 THEN -exp(id % 700 - 350) ELSE id * 1e-320D END"))
    for keys in (["g"], []):
        exact = df.groupBy(*keys).agg(F.percentile("v", probs).alias("v"), F.percentile("w", probs).alias("w"), F.count("v").alias("n"))
        exact = {r["g"] if keys else None: r for r in exact.collect()}
        got = group_quantiles(df, keys, {"v": F.col("v"), "w": F.col("w")}, probs, listed).collect()
        assert len(got) == len(exact)
        for r in got:
            want = exact[r["g"] if keys else None]
            assert r["v__n"] == want["n"] and r["w__q"] == want["w"]
            np.testing.assert_allclose(r["v__q"], want["v"], rtol=1e-15)


def test_quantiles_of_infinities_single_values_and_none(spark):
    inf = float("inf")
    rows = [("a", x) for x in (1.0, 2.0, 3.0, inf)] + [("b", x) for x in (-inf, 5.0)] + [("c", 4.0), ("d", None), ("z", -0.0), ("z", 0.0), ("n", float("nan")), ("n", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["v__n"], r["v__q"]) for r in group_quantiles(df, ["g"], {"v": F.col("v")}, [0.0, 0.5, 1.0]).collect()}
    assert got["a"] == (4, [1.0, 2.5, inf]) and got["b"] == (2, [-inf, -inf, 5.0])
    assert got["c"] == (1, [4.0] * 3) and got["d"] == (0, None) and got["z"] == (2, [0.0] * 3)
    assert got["n"][1][0] == 1.0 and np.isnan(got["n"][1][2])
    assert [tuple(r) for r in group_quantiles(df.where("g = 'd'"), [], {"v": F.col("v")}, [0.5]).collect()] == [(0, None)]
    assert group_quantiles(df.limit(0), ["g"], {"v": F.col("v")}, [0.5]).collect() == []


def test_buckets_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.integers(0, 1 << 64, 5_000, dtype=np.uint64).view(float), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1074, 1024), 0), 5e-324, 1.7e308, 0.0]
    x = np.r_[x[np.isfinite(x)], np.inf]
    x = np.unique(np.r_[x, -x])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").select("v", value_bucket("v").alias("b"))
    got = sorted((r["v"], r["b"]) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and len({b for _, b in got}) > 5_000


def test_sliced_rank_equals_window(spark):
    df = skewed(spark).where("v IS NOT NULL")
    order = [F.desc("v"), F.asc("id")]
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    a = {(r["g"], r["id"]): r["rank"] for r in plain.collect()}
    b = {(r["g"], r["id"]): r["rank"] for r in group_rank(df, ["g"], order, "rank").collect()}
    assert a == b


def exposures(spark, T=6, N=60, K=4, seed=1, noise=0.05):
    rng = np.random.default_rng(seed)
    days = business_days("2024-01-02", T)
    names = [f"f{k}" for k in range(K)]
    X = rng.normal(size=(T, N, K))
    beta = rng.normal(size=(T, K))
    r = np.einsum("tnk,tk->tn", X, beta) + noise * rng.normal(size=(T, N))
    rows = [(days[t], t, f"T{n}", True, float(r[t, n]), *map(float, X[t, n])) for t in range(T) for n in range(N)]
    schema = "date date, t int, ticker string, tradable boolean, fwd_ret double, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema), names, X, r, days


def ridge_numpy(X, r, lam):
    y = r - r.mean()
    return np.linalg.solve(X.T @ X + lam * np.eye(X.shape[1]), X.T @ y)


def test_ridge_matches_numpy_across_partitions(spark):
    df, names, X, r, days = exposures(spark)
    fr = {x["date"]: x for x in rg.estimate_factor_returns(df.repartition(7), names, 10, 0.3).collect()}
    for t, d in enumerate(days):
        np.testing.assert_allclose(fr[d]["f"], ridge_numpy(X[t], r[t], 0.3), rtol=1e-9)
        assert fr[d]["n_obs"] == X.shape[1]


def test_ridge_fewer_names_than_factors(spark):
    df, names, X, r, days = exposures(spark, T=1, N=5, K=8)
    f = rg.estimate_factor_returns(df, names, 3, 1e-2).first()["f"]
    np.testing.assert_allclose(f, ridge_numpy(X[0], r[0], 1e-2), rtol=1e-7)
    assert rg.estimate_factor_returns(df, names, 3, 0.0).first()["f"] is None


def test_gcv_picks_the_numpy_minimum(spark):
    df, names, X, r, days = exposures(spark, noise=1.0)
    got = {x["date"]: x["selected_ridge"] for x in rg.estimate_factor_returns(df, names, 10, "auto").collect()}
    for t, d in enumerate(days):
        y = r[t] - r[t].mean()
        s2 = np.linalg.svd(X[t], compute_uv=False) ** 2

        def score(lam):
            b = ridge_numpy(X[t], r[t], lam)
            n = len(y)
            return ((y - X[t] @ b) ** 2).sum() / n / ((n - (s2 / (s2 + lam)).sum()) / n) ** 2

        assert got[d] == min(rg.DEFAULT_GRID, key=score)
    assert len(rg.DEFAULT_GRID) == 27


def test_mask_and_missing_exposures(spark):
    df, names, X, r, _ = exposures(spark, T=1)
    masked = df.withColumn("tradable", F.col("ticker") != "T3").withColumn("f1", F.when(F.col("ticker") != "T7", F.col("f1")))
    got = rg.estimate_factor_returns(masked, names, 10, 0.3).first()
    keep = [n for n in range(60) if n != 3]
    x = X[0].copy()
    x[7, 1] = 0.0
    np.testing.assert_allclose(got["f"], ridge_numpy(x[keep], r[0][keep], 0.3), rtol=1e-9)
    assert got["n_obs"] == 59


def test_diagnostics_zero_penalty_is_least_squares(spark):
    df, names, X, r, days = exposures(spark, T=2)
    d = rg.ridge_diagnostics(df, names, [0.0, 1e-2, 10.0], 10).orderBy("date", "lambda").collect()
    y = r[0] - r[0].mean()
    ols = np.linalg.lstsq(X[0], y, rcond=None)[0]
    np.testing.assert_allclose(d[0]["f"], ols, rtol=1e-8)
    assert d[0]["effective_df"] >= d[1]["effective_df"] >= d[2]["effective_df"]
    resid = y - X[0] @ ols
    np.testing.assert_allclose([d[0]["residual_norm"], d[0]["fitted_std"], d[0]["residual_std"]],
                               [np.linalg.norm(resid), (X[0] @ ols).std(), resid.std()], rtol=1e-8)
    s = np.linalg.svd(X[0], compute_uv=False)
    np.testing.assert_allclose(d[0]["cond_X"], s[0] / s[-1], rtol=1e-8)
    thin = rg.ridge_diagnostics(df, names, [1e-2], 100).collect()
    assert not any(x["day_valid"] for x in thin) and len(thin) == 2


def test_pairwise_correlations(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    pdf.loc[::7, "b"] = np.nan
    pdf["c"] = pdf["a"] * 0.5 + pdf["c"]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in pdf.to_numpy()], "a double, b double, c double")
    got = {(r["with"], r["factor"]): r for r in factor_correlations(df, ["a", "b", "c"]).collect()}
    for (i, j), r in got.items():
        both = pdf[[i, j]].dropna()
        assert r["overlap"] == len(both) and abs(r["corr"] - np.corrcoef(both[i], both[j])[0, 1]) < 1e-12


def book_rows(spark, T=12, N=8):
    rng = np.random.default_rng(5)
    rows = []
    for p in ("p1", "p2"):
        for t in range(T):
            for n in range(N):
                w = float(rng.normal() * 0.1) if (t + n) % 3 else 0.0
                rows.append((p, t, f"T{n}", w, float(rng.normal() * 0.05), bool((t + n) % 5)))
    return spark.createDataFrame(rows, "portfolio_id string, t int, ticker string, weight double, realized double, price_ok boolean"), T


def book_by_hand(rows, T, cfg, risk, floor):
    """The recursion in plain loops over dicts."""
    out, scales = {}, {}
    for p in sorted({r["portfolio_id"] for r in rows}):
        prev, nets = {}, []
        for t in range(T):
            today = {r["ticker"]: r for r in rows if r["portfolio_id"] == p and r["t"] == t}
            top, s = cfg.max_leverage_multiplier, 1.0
            if risk:
                vol, var = nets[-cfg.volatility_lookback_days :], nets[-cfg.var_lookback_days :]
                parts = [top]
                if cfg.volatility_target_annual and len(vol) > 1:
                    parts.append(cfg.volatility_target_annual / (np.std(vol, ddof=1) * 252**0.5))
                if cfg.max_daily_var and len(var) > 1 and -np.quantile(var, 1 - cfg.var_confidence) > 1e-12:
                    parts.append(cfg.max_daily_var / -np.quantile(var, 1 - cfg.var_confidence))
                equity = np.cumprod([1.0, *(1 + x for x in nets)])
                dd = 1 - equity[-1] / equity.max()
                if cfg.max_drawdown_limit:
                    part = (dd - cfg.drawdown_control_start) / (cfg.max_drawdown_limit - cfg.drawdown_control_start)
                    parts.append(top - min(1.0, max(0.0, part)) * (top - cfg.min_risk_scale))
                s = max(cfg.min_risk_scale, min(parts))
                scales[p, t] = s, dd
            names = set(prev) | set(today)
            target = {n: today[n]["weight"] * s if n in today else 0.0 for n in names}
            turn = 0.5 * sum(abs(target[n] - prev.get(n, 0.0)) for n in names)
            share = cfg.turnover_cap / turn if cfg.turnover_cap is not None and turn > cfg.turnover_cap else 1.0
            book = {n: prev.get(n, 0.0) + share * (target[n] - prev.get(n, 0.0)) for n in names}
            if floor:
                book = {n: w if n in today and today[n]["price_ok"] else 0.0 for n, w in book.items()}
            gain = sum(w * today[n]["realized"] for n, w in book.items() if n in today and np.isfinite(today[n]["realized"]))
            traded = 0.5 * sum(abs(book[n] - prev.get(n, 0.0)) for n in names)
            rate = (cfg.transaction_cost_bps + cfg.slippage_bps + cfg.turnover_penalty_bps) / 1e4 * 2
            nets.append(gain - traded * rate if any(abs(w) > 1e-15 for w in book.values()) else 0.0)
            prev = {n: w for n, w in book.items() if abs(w) > 1e-15}
            out.update({(p, t, n): w for n, w in prev.items()})
    return out, scales


def test_books_equal_the_plain_recursion(spark):
    rows, T = book_rows(spark, T=6)
    # A return that is not finite counts as none, with feedback and without.
    rows = rows.withColumn("realized", F.expr("CASE WHEN t = 1 AND ticker = 'T0' THEN double('Infinity') WHEN t = 2 AND ticker = 'T1' THEN double('NaN') ELSE realized END"))
    cal = spark.createDataFrame([(d, t) for t, d in enumerate(business_days("2024-01-02", T))], "date date, t int")
    capped = replace(BacktestConfig(), turnover_cap=0.1, max_daily_var=0.01, var_lookback_days=3, max_drawdown_limit=0.2, volatility_target_annual=0.3)
    free = replace(BacktestConfig(), var_lookback_days=3)
    for cfg, risk, floor in ((capped, True, False), (capped, False, True), (free, True, False), (free, False, True)):
        weights, scales = run_book(rows, cal, cfg, risk, floor)
        got = {(r["portfolio_id"], r["t"], r["ticker"]): r["weight"] for r in weights.collect() if abs(r["weight"]) > 1e-15}
        expect, by_day = book_by_hand(rows.collect(), T, cfg, risk, floor)
        assert got.keys() == expect.keys()
        for k, w in expect.items():
            assert abs(got[k] - w) < 1e-12
        if risk:
            found = {(r["portfolio_id"], r["t"]): (r["risk_scale"], r["drawdown"]) for r in scales.collect()}
            assert found.keys() == by_day.keys()
            for k in found:
                np.testing.assert_allclose(found[k], by_day[k], rtol=0, atol=1e-12)


def test_book_without_feedback_stays_columns(spark):
    rows, T = book_rows(spark, T=3)
    cal = spark.createDataFrame([(d, t) for t, d in enumerate(business_days("2024-01-02", T))], "date date, t int")
    for df in run_book(rows, cal, BacktestConfig(), risk=True):
        assert "Pandas" not in df._jdf.queryExecution().toString()


def test_stock_kalman_matches_the_full_matrix_form(spark):
    df, names, X, r, days = exposures(spark, T=5, N=30, K=3)
    df = df.withColumn("fwd_ret", F.when(~((F.col("t") == 2) & (F.col("ticker") < "T28")), F.col("fwd_ret")))
    cal = spark.createDataFrame([(d, t) for t, d in enumerate(days)], "date date, t int")
    got = kalman_from_stocks(df, cal, names).orderBy("t").collect()
    alive = np.ones_like(r, dtype=bool)
    alive[2] = [f"T{n}" >= "T28" for n in range(30)]
    f, P = np.zeros(3), np.eye(3)
    for t in range(5):
        x, y = X[t][alive[t]], r[t][alive[t]]
        assert got[t]["n_obs"] == len(y)
        if len(y) >= 8:
            P = P + 1e-4 * np.eye(3)
            S = x @ P @ x.T + 1e-2 * np.eye(len(y))
            e = y - x @ f
            assert abs(got[t]["innovation_score"] - e @ np.linalg.solve(S, e)) < 1e-6 * abs(e @ np.linalg.solve(S, e))
            gain = P @ x.T @ np.linalg.inv(S)
            f, P = f + gain @ e, P - gain @ x @ P
        else:
            assert got[t]["innovation_norm"] is None
        np.testing.assert_allclose(got[t]["f"], f, rtol=1e-7, atol=1e-9)


def test_similarity_coordinates_are_singular_vectors(spark):
    rng = np.random.default_rng(8)
    E = rng.normal(size=(7, 5))
    days = business_days("2024-01-02", 7)
    rows = [(days[t], t, f"T{n}", float(E[t, n])) for t in range(7) for n in range(5)]
    df = spark.createDataFrame(rows, "date date, t int, ticker string, residual double")
    cal = spark.createDataFrame([(d, t) for t, d in enumerate(days)], "date date, t int")
    got = {r["ticker"]: [r["v1"], r["v2"], r["v3"]] for r in similarity_order(df, cal).collect()}
    c = E - E.mean(axis=0)
    vt = np.linalg.svd(c / np.linalg.norm(c, axis=0), full_matrices=False)[2][:3]
    mine = np.array([got[f"T{n}"] for n in range(5)]).T
    np.testing.assert_allclose(np.abs(mine), np.abs(vt), atol=1e-8)


def scored(spark):
    return spark.range(24).selectExpr(
        "date_add(DATE '2024-01-01', int(id % 2)) AS date", "int(id % 2) AS t", "string(id) AS ticker", "double(id * 7 % 12) AS alpha",
        "0.1D AS weight", "0D AS previous_weight", "10D AS price", "1e9D AS dollar_volume", "1D AS a", "1D AS c_a", "1D AS fp_a",
    )


def test_rows_are_ranked_before_their_buckets_are_joined(spark, monkeypatch):
    seen, rank = [], rk.group_rank
    monkeypatch.setattr(rk, "group_rank", lambda df, *a: seen.append(df.columns) or rank(df, *a))
    got = rk.alpha_rankings(scored(spark), ["a"], BacktestConfig()).collect()
    assert len(got) == 24 and "quantile_bucket" not in seen[0]
    for day in (0, 1):
        rows = sorted((r for r in got if r["t"] == day), key=lambda r: r["alpha_rank"])
        assert [r["alpha_rank"] for r in rows] == list(range(1, 13))
        assert [(-r["alpha_score"], r["ticker"]) for r in rows] == sorted((-r["alpha_score"], r["ticker"]) for r in rows)
        assert {r["quantile_bucket"] for r in rows} <= set(range(1, 11)) and rows[0]["quantile_bucket"] > rows[-1]["quantile_bucket"]


def test_orders_need_no_ranks(spark, monkeypatch):
    whole = rk.alpha_rankings(scored(spark), ["a"], BacktestConfig())
    monkeypatch.setattr(rk, "group_rank", None)
    got = rk.alpha_rankings(scored(spark), ["a"], BacktestConfig(), ranks=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect()))
    assert set(whole.columns) - set(got.columns) == {"alpha_rank", "quantile_bucket"}


def test_rows_without_a_date_stay_apart_in_triangles(spark):
    rows = spark.range(8).selectExpr("CASE WHEN id < 5 THEN DATE '2024-01-01' END AS date", "array(double(id), 1D) AS x", "double(id) AS y").coalesce(1)
    assert sorted(r["n"] for r in rg.triangles(rows, 2).collect()) == [3, 5]
