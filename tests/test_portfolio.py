"""Weights, turnover, execution policies, costs and risk scaling on small hand-made books."""

from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import business_days
from pyspark.sql import functions as F

from alphaweave.config import BacktestConfig, LiveConfig, from_dict
from alphaweave.operators import performance as perf
from alphaweave.operators import portfolio as pf
from alphaweave.operators.book import run_book
from alphaweave.operators.execution import execution_returns
from alphaweave.operators.forecast import predict_factor_returns, score
from alphaweave.operators.universe import calendar, check_dates, with_t
from alphaweave.plans.daily import after_close_plan, assert_signal_date, mark_next_open, run_backtest, write_daily_report

CFG = replace(BacktestConfig(), min_names_per_side=2, max_position_weight=1.0, max_net_exposure=2.0)
DAYS = business_days("2024-01-02", 6)


def cal_of(spark, days=DAYS):
    return spark.createDataFrame([(d, t) for t, d in enumerate(days)], "date date, t int")


def alphas(spark, values, price=None):
    rows = [(DAYS[0], f"T{i}", float(a), True, 1e6, float(p)) for i, (a, p) in enumerate(zip(values, price or [10.0] * len(values)))]
    return spark.createDataFrame(rows, "date date, ticker string, alpha double, tradable boolean, dollar_volume double, price double")


def weights_of(df):
    return {r["ticker"]: r["weight"] for r in df.collect()}


def test_cost_threshold_keeps_only_strong_alphas(spark):
    cfg = replace(CFG, min_names_per_side=1)
    w, info = pf.rank_weights(alphas(spark, [0.0007, 0.0009, -0.0007, -0.0009]), cfg)
    w = weights_of(w)
    assert w["T0"] == w["T2"] == 0.0 and w["T1"] > 0 > w["T3"]
    row = info.first()
    assert row["filtered_alpha_threshold"] == 2 and abs(row["cost_adjusted_alpha_threshold"] - 0.0008) < 1e-12


def test_price_floor_excludes(spark):
    cfg = replace(CFG, min_names_per_side=1, min_price=5.0)
    w, info = pf.rank_weights(alphas(spark, [0.02, 0.01, -0.01, -0.02], [4.99, 5.0, 6.0, 4.5]), cfg)
    w = weights_of(w)
    assert w["T0"] == w["T3"] == 0.0 and w["T1"] > 0 > w["T2"]
    assert info.first()["filtered_price"] == 2


def test_long_only_net_cap_trims_the_heavy_side(spark):
    cfg = replace(CFG, min_names_per_side=1, allow_short=False, max_net_exposure=0.2, gross_exposure=1.0)
    w = weights_of(pf.rank_weights(alphas(spark, [0.01, 0.02, 0.03, 0.04]), cfg)[0])
    assert abs(sum(w.values()) - 0.2) < 1e-12 and min(w.values()) >= 0


def test_position_caps_keep_the_strongest(spark):
    cfg = replace(CFG, max_positions_long=2, max_positions_short=2, long_quantile=0.6, short_quantile=0.4)
    w = weights_of(pf.rank_weights(alphas(spark, [(i - 5) / 100 for i in range(11)]), cfg)[0])
    assert {t for t, x in w.items() if x > 0} == {"T9", "T10"} and {t for t, x in w.items() if x < 0} == {"T0", "T1"}


def test_split_quantiles_give_the_same_weights(spark):
    df = alphas(spark, [(i * 37 % 23 - 11) / 100 for i in range(23)])
    assert weights_of(pf.rank_weights(df, CFG)[0]) == weights_of(pf.rank_weights(df.repartition(7), CFG)[0])


def test_quantile_legs_gross_and_net(spark):
    s = spark.createDataFrame([(DAYS[0], f"T{i}", float(i), True) for i in range(20)], "date date, ticker string, score double, tradable boolean")
    w = weights_of(pf.quantile_long_short(s, 0.1, 2.0, 2))
    assert abs(sum(w.values())) < 1e-12 and abs(sum(map(abs, w.values())) - 2.0) < 1e-12
    assert {t for t, x in w.items() if x > 0} == {"T18", "T19"}
    assert set(weights_of(pf.quantile_long_short(s, 0.1, 2.0, 5)).values()) == {0.0}
    for bad in ({"quantile": 0.5}, {"gross": 0.0}):
        with pytest.raises(ValueError):
            pf.quantile_long_short(s, **bad)


def book(spark, rows):
    return spark.createDataFrame(rows, "t int, ticker string, weight double")


def test_turnover_counts_entries_and_exits(spark):
    w = book(spark, [(0, "A", 0.5), (0, "B", -0.5), (2, "A", 0.25)])
    got = [r["turnover"] for r in pf.turnover(w, cal_of(spark)).orderBy("t").collect()]
    assert got == [0.5, 0.5, 0.125, 0.125, 0.0, 0.0]


def test_return_coverage_before_return(spark):
    w = spark.createDataFrame([(0, "A", 0.5, 20.0), (0, "B", -0.5, -0.02)], "t int, ticker string, weight double, fwd_ret double")
    r = perf.portfolio_returns(w, cal_of(spark), 0.4, 1.0).orderBy("t").first()
    assert r["return_coverage"] == 0.5 and abs(r["portfolio_return"] - 0.01) < 1e-12
    assert perf.portfolio_returns(w, cal_of(spark), 0.8, 1.0).orderBy("t").first()["portfolio_return"] is None


@pytest.mark.parametrize("penalty", [False, True])
def test_costs_and_turnover_penalty(spark, penalty):
    cfg = replace(CFG, transaction_cost_bps=0.0 if penalty else 10.0, slippage_bps=0.0, turnover_penalty_bps=10.0 if penalty else 0.0)
    w = book(spark, [(0, "A", 0.5), (0, "B", -0.5)]).withColumn("realized", F.lit(0.0))
    cal = cal_of(spark, DAYS[:2])
    daily = perf.gross_returns(w, cal).join(pf.turnover(w, cal).select("t", "turnover"), "t")
    a, b = perf.portfolio_pnl(daily, cfg).orderBy("t").collect()
    assert a["turnover"] == 0.5 and abs(a["transaction_cost"] + a["turnover_penalty"] - 0.001) < 1e-12
    assert abs(a["portfolio_return"] + 0.001) < 1e-12 and b["portfolio_return"] is None and b["turnover"] == 0.5


def test_var_limit_scales_the_book_down(spark):
    cfg = replace(
        CFG, max_daily_var=0.02, var_lookback_days=2, min_risk_scale=0.1, transaction_cost_bps=0.0, slippage_bps=0.0,
    )
    rows = []
    for t in range(5):
        r = 0.10 if t % 2 == 0 else -0.10
        rows += [("p", t, "A", 0.5, r), ("p", t, "B", -0.5, -r)]
    df = spark.createDataFrame(rows, "portfolio_id string, t int, ticker string, weight double, realized double")
    _, scales = run_book(df, cal_of(spark, DAYS[:5]), cfg, risk=True)
    s = [r["risk_scale"] for r in scales.orderBy("t").collect()]
    assert s[0] == 1.0 and s[3] < 1.0


def bars(spark, drop=()):
    rows = [
        (d, f"T{i:02d}", 20.0 + i + t, 20.5 + i + t, 1_000_000.0 + i)
        for t, d in enumerate(DAYS) for i in range(10) if (t, i) not in drop
    ]
    df = spark.createDataFrame(rows, "date date, ticker string, open double, close double, volume double")
    return with_t(df, cal_of(spark))


def test_next_open_execution_prices(spark):
    w = book(spark, [(t, "T03", 0.1) for t in range(6)])
    res = execution_returns(w, bars(spark), cal_of(spark), CFG).check()
    rows = {r["t"]: r for r in res.table.where("ticker = 'T03'").collect()}
    assert rows[0]["execution_price"] == 24.0 and rows[0]["exit_price"] == 25.0
    assert abs(rows[0]["realized"] - (25 / 24 - 1)) < 1e-12
    # The last executable day leaves at its own close, the tail is flat.
    assert rows[4]["execution_price"] == 28.0 and rows[4]["exit_price"] == 28.5
    assert rows[5]["weight"] == 0.0 and rows[5]["realized"] is None and rows[4]["exit_date"] is None
    two = execution_returns(w, bars(spark), cal_of(spark), replace(CFG, holding_period_days=2)).table
    r = {x["t"]: x for x in two.where("ticker = 'T03'").collect()}
    assert r[3]["exit_price"] == 28.0 and r[3]["execution_price"] == 27.0 and r[4]["weight"] == 0.0


def test_missing_prices_follow_the_policy(spark):
    w = book(spark, [(1, "T09", 0.1)])
    gone = bars(spark, drop={(3, 9)})
    with pytest.raises(RuntimeError, match="Missing exit price"):
        execution_returns(w, gone, cal_of(spark), CFG).check()
    cfg = replace(CFG, missing_price_policy="terminal_return")
    t = execution_returns(w, gone, cal_of(spark), cfg).check().table.where("t = 1 AND ticker = 'T09'").first()
    assert t["realized"] == -1.0
    no_fill = bars(spark, drop={(2, 9)})
    with pytest.raises(RuntimeError, match="Missing next-open"):
        execution_returns(w, no_fill, cal_of(spark), CFG).check()
    t = execution_returns(w, no_fill, cal_of(spark), replace(CFG, missing_execution_policy="drop")).check().table
    assert t.where("t = 1 AND ticker = 'T09'").first()["weight"] == 0.0
    with pytest.raises(RuntimeError, match="max_abs_return"):
        execution_returns(w, bars(spark), cal_of(spark), replace(CFG, max_abs_return=0.001)).check()


def test_adjusted_bars_earn_while_raw_bars_trade(spark):
    adj = bars(spark).withColumns({"open": F.col("open") / 2, "close": F.col("close") / 4})
    w = book(spark, [(0, "T01", 0.1)])
    r = execution_returns(w, bars(spark), cal_of(spark), CFG, adj).check().table.where("t = 0 AND ticker = 'T01'").first()
    assert r["execution_price"] == 22.0 and abs(r["realized"] - (23 / 22 - 1)) < 1e-12


NAMES = ["momentum", "quality", "liquidity"]


def processed(spark):
    rows = []
    for t, d in enumerate(DAYS):
        for i in range(10):
            x = -1 + 2 * i / 9
            rows.append((d, t, f"T{i:02d}", True, -0.01 + 0.02 * i / 9, x, -0.2 * x, 0.1))
    x = spark.createDataFrame(rows, "date date, t int, ticker string, tradable boolean, fwd_ret double, momentum double, quality double, liquidity double")
    f = [(d, t, n, v if t else None) for t, d in enumerate(DAYS) for n, v in zip(NAMES, (0.02, -0.01, 0.005))]
    return x, spark.createDataFrame(f, "date date, t int, factor string, f double")


def run(spark, **kw):
    x, f = processed(spark)
    cfg = replace(CFG, min_periods=1, long_quantile=0.8, short_quantile=0.2, use_point_in_time_universe=False, **kw)
    return run_backtest(x, f, NAMES, cal_of(spark), bars(spark), cfg)


def test_backtest_signals_trade_the_next_day_and_contributions_add_up(spark, tmp_path):
    res = run(spark)
    daily = res.daily.orderBy("t").collect()
    assert [r["execution_date"] for r in daily[:-1]] == DAYS[1:] and daily[-1]["execution_date"] is None
    assert str(daily[0]["signal_timestamp"]).endswith("16:00:00")
    # No history before day 2, hence no positions.
    assert daily[0]["gross_exposure"] == daily[1]["gross_exposure"] == 0.0
    assert abs(daily[2]["gross_exposure"] - 2.0) < 1e-9 and daily[5]["gross_exposure"] == 0.0
    rank = res.alpha_rankings.where("t = 3 AND ticker = 'T09'").first()
    parts = eval(rank["factor_contributions"])
    assert abs(sum(parts.values()) - rank["alpha_score"]) < 1e-12 and rank["alpha_rank"] == 1
    q = res.quantile_summary.where(F.col("signal_date") == DAYS[3]).collect()
    assert sum(r["number_of_stocks"] for r in q) == 10 and len(q) == 10
    write_daily_report(res, str(tmp_path), str(DAYS[3]))
    made = {p.name for p in (tmp_path / str(DAYS[3])).iterdir()}
    assert {"orders", "target_positions", "alpha_rankings", "quantile_summary", "residuals", "risk_summary", "metadata"} <= made
    marked = mark_next_open(spark, str(tmp_path), str(DAYS[4]))
    assert {r["date"] for r in marked.collect()} <= {str(DAYS[4])}
    summary = res.risk_summary.first()
    assert summary["gross_exposure"] == 0.0 and summary["max_drawdown"] >= 0.0


def test_turnover_cap_holds_and_splits(spark):
    res = run(spark, turnover_cap=0.25)
    assert max(r["turnover"] for r in res.daily.where("t < 5").collect()) <= 0.25 + 1e-9


def test_date_slice_keeps_full_history_forecasts(spark):
    res = run(spark, start_date=str(DAYS[3]))
    first = res.daily.orderBy("t").first()
    assert first["signal_date"] == DAYS[3] and first["gross_exposure"] > 0


def test_after_close_plan_refuses_a_stale_date(spark):
    x, f = processed(spark)
    cfg = replace(CFG, min_periods=1, long_quantile=0.8, short_quantile=0.2)
    plan = after_close_plan(x, f, NAMES, cal_of(spark), bars(spark), cfg, str(DAYS[5]))
    t = {r["ticker"]: r["target_weight"] for r in plan.target_positions.collect()}
    assert t["T09"] > 0 > t["T00"]
    assert plan.orders.count() == 0  # yesterday's recomputed book is the same
    with pytest.raises(RuntimeError, match="processed data end"):
        assert_signal_date(cal_of(spark), str(DAYS[3]))
    with pytest.raises(RuntimeError, match="not processed"):
        assert_signal_date(cal_of(spark), "2030-01-01")


def test_forecasts_use_only_the_past(spark):
    _, f = processed(spark)
    for method in ("latest", "rolling", "ewma"):
        full = {(r["t"], r["factor"]): r["f_pred"] for r in predict_factor_returns(f, method, min_periods=1).collect()}
        spiked = f.withColumn("f", F.when(F.col("t") == 4, F.lit(9.0)).otherwise(F.col("f")))
        cut = {(r["t"], r["factor"]): r["f_pred"] for r in predict_factor_returns(spiked, method, min_periods=1).collect()}
        assert all(full[k] == cut[k] for k in full if k[0] <= 4)
        assert full[(1, "momentum")] is None and abs(full[(2, "momentum")] - 0.02) < 1e-12
    lag2 = {r["t"]: r["f_pred"] for r in predict_factor_returns(f, "latest", horizon=2).where("factor = 'momentum'").collect()}
    assert lag2[2] is None and lag2[3] == 0.02
    with pytest.raises(ValueError):
        predict_factor_returns(f, "unknown")


def test_score_is_null_without_forecast_or_when_masked(spark):
    x, f = processed(spark)
    pred = predict_factor_returns(f, "latest")
    s = {(r["t"], r["ticker"]): r["score"] for r in score(x.withColumn("tradable", F.expr("ticker <> 'T05'")), pred, NAMES).collect()}
    assert s[(1, "T01")] is None and s[(3, "T05")] is None and abs(s[(3, "T09")] - (0.02 + 0.002 + 0.0005)) < 1e-12


def test_config_validation():
    for bad in (
        {"forecast_method": "oracle"}, {"short_quantile": 0.6}, {"holding_period_days": 0}, {"turnover_cap": -1.0},
        {"missing_price_policy": "x"}, {"max_drawdown_limit": 0.01}, {"start_date": "2024-02-01", "end_date": "2024-01-01"},
    ):
        with pytest.raises(ValueError):
            from_dict(BacktestConfig, bad)
    with pytest.raises(ValueError, match="unknown"):
        from_dict(BacktestConfig, {"nope": 1})
    with pytest.raises(ValueError):
        LiveConfig(delay_minutes=5).validate()


def test_dates_check(spark):
    dup = cal_of(spark).unionByName(cal_of(spark, DAYS[:1]))
    with pytest.raises(ValueError, match="strictly"):
        check_dates(dup, "ewma")
    with pytest.raises(ValueError, match="oracle"):
        check_dates(calendar(cal_of(spark)), "oracle")


def test_drawdown_scale_of_columns_and_numbers(spark):
    cfg = replace(CFG, max_drawdown_limit=0.2, drawdown_control_start=0.05, min_risk_scale=0.25, max_leverage_multiplier=1.5)
    df = spark.createDataFrame([(x / 100,) for x in range(0, 30, 3)], "dd double")
    for r in df.select("dd", perf.drawdown_scale(F.col("dd"), cfg).alias("s")).collect():
        assert abs(r["s"] - perf.drawdown_scale(r["dd"], cfg)) < 1e-12
    assert perf.drawdown_scale(0.05, cfg) == 1.5 and perf.drawdown_scale(0.2, cfg) == 0.25 and abs(perf.drawdown_scale(0.125, cfg) - 0.875) < 1e-12


def test_plans_broadcast_only_day_tables_and_read_few_columns(spark):
    """Weights of a scored table add no exchange of the names beyond per-day aggregates."""
    df = alphas(spark, [(i * 37 % 23 - 11) / 100 for i in range(23)])
    plan = pf.rank_weights(df, CFG)[0]._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    # Windows run over counts of values, never over names.
    assert all("__c" in line and "ticker" not in line for line in plan.splitlines() if "Window [" in line)
