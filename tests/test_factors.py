"""Price factors, forward returns, masks and winsor/z-score on hand-made bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import business_days
from pyspark.sql import functions as F

from alphaweave.operators import preprocess as pp
from alphaweave.operators import universe as uni
from alphaweave.operators.price_factors import PRICE_FACTORS, price_factors, with_forward_return

INF = float("inf")


def bars(spark, rows, schema="date date, ticker string, open double, high double, low double, close double, volume double"):
    return spark.createDataFrame(rows, schema)


def panel(spark, df):
    cal = uni.calendar(df)
    return uni.with_tradable(uni.with_adj_close(uni.with_t(df, cal)))


def closes(spark, values, ticker="A"):
    days = business_days("2024-01-02", len(values))
    return bars(spark, [(d, ticker, v, v, v, v, 100.0) for d, v in zip(days, values) if v is not None])


def test_all_factors_match_pandas_rolling(spark):
    rng = np.random.default_rng(3)
    n, tickers = 300, ["A", "B"]
    days = business_days("2022-01-03", n)
    rows = []
    for k, tk in enumerate(tickers):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i, d in enumerate(days):
            if tk == "B" and i % 9 == 4:
                continue  # gaps: look-backs must count calendar days
            o = c[i] * (1 + rng.normal(0, 0.01))
            rows.append((d, tk, *map(float, (o, max(c[i], o) * 1.01, min(c[i], o) * 0.98, c[i], 1000 + (i * 7 + k) % 50))))
    df = bars(spark, rows)
    got = price_factors(panel(spark, df), keep=[]).toPandas().set_index(["ticker", "t"]).sort_index()
    pdf = pd.DataFrame(rows, columns=["date", "ticker", "open", "high", "low", "close", "volume"])
    p = {f: pdf.pivot(index="date", columns="ticker", values=f) for f in ("open", "high", "low", "close", "volume")}
    c, v = p["close"], p["volume"]
    lr, dv = np.log(c) - np.log(c.shift(1)), c * v
    expect = {
        "mom_21": c / c.shift(21) - 1,
        "mom_252": c / c.shift(252) - 1,
        "volatility_63": lr.rolling(63, min_periods=31).std(),
        "parkinson_vol_20": (np.log(p["high"] / p["low"]) ** 2).rolling(20, min_periods=10).mean() / (4 * np.log(2)),
        "overnight_return": p["open"] / c.shift(1) - 1,
        "dist_52w_high": c / p["high"].rolling(252, min_periods=126).max() - 1,
        "volume_z_60": (v - v.rolling(60, min_periods=30).mean()) / v.rolling(60, min_periods=30).std(),
        "volume_mom_20_60": v.rolling(20, min_periods=10).mean() / v.rolling(60, min_periods=30).mean() - 1,
        "amihud_20": lr.abs().rolling(20, min_periods=10).mean() / dv.rolling(20, min_periods=10).mean(),
        "log_dollar_vol_60": np.log(dv.rolling(60, min_periods=30).mean()),
        "price_skew_63": lr.rolling(63, min_periods=30).skew(),
        "price_kurt_63": lr.rolling(63, min_periods=30).kurt(),
    }
    assert len(PRICE_FACTORS) == 27 and set(PRICE_FACTORS) <= set(got.columns)
    for name, wide in expect.items():
        for tk in tickers:
            want = wide[tk].to_numpy()
            mine = got.loc[tk][name]
            np.testing.assert_allclose(mine.to_numpy(dtype=float), want[mine.index], rtol=1e-8, atol=1e-10, err_msg=name)


def test_no_look_ahead(spark):
    """Deleting later bars changes no earlier factor."""
    df = closes(spark, [100.0 + (i * 37 % 11) for i in range(60)])
    p = panel(spark, df)
    names = ["mom_5", "volatility_20", "price_skew_63", "hl_range_20"]
    full = price_factors(p, names, []).where("t <= 40").orderBy("t").toPandas()
    cut = price_factors(p.where("t <= 40"), names, []).orderBy("t").toPandas()
    pd.testing.assert_frame_equal(full, cut)


def test_constant_window_moments(spark):
    out = price_factors(panel(spark, closes(spark, [50.0] * 70)), ["price_skew_63", "price_kurt_63"], []).orderBy("t").collect()
    assert (out[-1]["price_skew_63"], out[-1]["price_kurt_63"]) == (0.0, -3.0)


def test_forward_returns_and_outlier_cap(spark):
    r = with_forward_return(panel(spark, closes(spark, [100.0, 110.0, 121.0])), 1).orderBy("t").collect()
    assert [None if x["fwd_ret"] is None else round(x["fwd_ret"], 10) for x in r] == [0.1, 0.1, None]
    r = with_forward_return(panel(spark, closes(spark, [1.0, 50.0, 51.0])), 1, 1.0).orderBy("t").collect()
    assert r[0]["fwd_ret"] is None and abs(r[1]["fwd_ret"] - 0.02) < 1e-12
    with pytest.raises(ValueError):
        with_forward_return(panel(spark, closes(spark, [1.0])), 1, 0.0)


def test_tradable_mask(spark):
    d = business_days("2024-01-02", 2)
    df = spark.createDataFrame(
        [(d[0], "A", 10.0, 100.0), (d[1], "A", 11.0, 0.0), (d[0], "B", 5.0, 50.0), (d[1], "B", None, 60.0)],
        "date date, ticker string, close double, volume double",
    )
    got = {(r["ticker"], r["date"]): r["tradable"] for r in uni.with_tradable(uni.with_adj_close(df)).collect()}
    assert got == {("A", d[0]): True, ("A", d[1]): False, ("B", d[0]): True, ("B", d[1]): False}
    with pytest.raises(KeyError):
        uni.with_tradable(df.select("date", "ticker"))


def test_mask_before_zscore(spark):
    d = business_days("2024-01-02", 1)[0]
    df = spark.createDataFrame(
        [(d, "A", 1.0, True), (d, "B", 2.0, True), (d, "DEAD", 100.0, False)], "date date, ticker string, f double, tradable boolean"
    )
    z = pp.preprocess(uni.apply_mask(df, ["f"]), ["f"], 2, 0.0, 1.0).orderBy("ticker").collect()
    assert [round(z[0]["f"], 9), round(z[1]["f"], 9), z[2]["f"]] == [-1.0, 1.0, None]


def test_infinity_is_clipped_null_is_not(spark):
    d = business_days("2024-01-02", 1)[0]
    vals = [1.0, 2.0, 3.0, 4.0, INF, None]
    df = spark.createDataFrame([(d, str(i), v) for i, v in enumerate(vals)], "date date, ticker string, f double")
    got = {r["ticker"]: r["f"] for r in pp.winsorize(df, ["f"], 0.0, 1.0, 2).collect()}
    assert got["4"] == 4.0 and got["5"] is None


def test_thin_date_is_null(spark):
    d = business_days("2024-01-02", 1)[0]
    df = spark.createDataFrame([(d, "A", 1.0), (d, "B", 2.0)], "date date, ticker string, f double")
    assert {r["f"] for r in pp.preprocess(df, ["f"], 3).collect()} == {None}


def test_coverage_drop_and_duplicate_drop(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t, d in enumerate(business_days("2024-01-02", 12)):
        for i in range(15):
            b = float(rng.normal())
            rows.append((d, t, f"T{i}", b, -b, float(rng.normal()), None))
    raw = spark.createDataFrame(rows, "date date, t int, ticker string, mom_1 double, rev_1_like double, size double, empty double")
    built = pp.build_exposures(raw, ["mom_1", "rev_1_like", "size", "empty"], 5, corr_min_overlap=50)
    assert built.names == ["mom_1", "size"]
    diag = {r["factor"]: r for r in built.diagnostics.collect()}
    assert diag["rev_1_like"]["drop_reason"] == "high_corr" and diag["rev_1_like"]["corr_with"] == "mom_1"
    assert abs(diag["rev_1_like"]["corr_value"] + 1) < 1e-9
    assert diag["empty"]["drop_reason"] == "low_coverage"
    assert built.table.where("mom_1 IS NULL OR size IS NULL").count() == 0


def test_point_in_time_mask_and_stats(spark):
    days = business_days("2024-01-02", 5)
    df = spark.createDataFrame([(d, tk, True) for d in days for tk in ("A", "B", "C")], "date date, ticker string, tradable boolean")
    meta = spark.createDataFrame(
        [("A", str(days[1]), None), ("A", "1990-01-01", None), ("B", None, f"{days[3]}T00:00:00Z")],
        "ticker string, list_date string, delisted_utc string",
    ).withColumn("seq", F.monotonically_increasing_id())
    got = uni.point_in_time(df, meta.where("seq >= 0 AND NOT (ticker = 'A' AND list_date = '1990-01-01')"))
    on = {(r["ticker"], r["date"]) for r in got.where("tradable").collect()}
    assert on == {("A", d) for d in days[1:]} | {("B", d) for d in days[:3]}
    stats = uni.point_in_time_stats(df, meta.where("list_date IS NULL OR list_date <> '1990-01-01'"), uni.calendar(df)).first()
    assert (stats["blocked_observations"], stats["tickers_missing_metadata"]) == (15 - len(on), 1)


def test_cleaned_table_does_not_pass_over_all_cells_again(spark):
    raw = spark.range(60).selectExpr("date_add(DATE '2024-01-01', int(id % 2)) AS date", "string(id) AS ticker", "double(id * id) AS a", "double(id) AS b")
    z = pp.preprocess(raw, ["a", "b"], 5)
    plan = z._jdf.queryExecution().executedPlan().toString()
    assert z.count() == 60 and "Generate" not in plan and "stddev" not in plan


def test_bars_of_rows_at_one_time_follow_the_whole_row(spark, tmp_path):
    from alphaweave.sources import adapters

    rows = [(7, 1, 2, 9, 4.0, 8.0), (7, 1, 1, 9, 5.0, 5.0), (7, 1, 2, 3, 2.0, 6.0), (7, 2, 1, 9, 1.0, 7.0), (7, 1, 1, 9, 1.0, 5.0)]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double")
    lines.selectExpr("*", "TIMESTAMP '2024-01-05 00:00:00' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    bars = adapters.bars_supplier_month(spark, str(tmp_path))
    r = bars.first()
    assert (r["ticker"], str(r["date"]), r["open"], r["high"], r["low"], r["close"], r["volume"]) == ("S7", "2024-01-01", 5.0, 7.0, 1.0, 7.0, 13.0)
    grouped = bars._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[1].split("]")[0]
    assert grouped.startswith("l_suppkey") and "concat" not in grouped
