"""State-space filter, regimes, blending, live orders, streaming."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from conftest import business_days
from pyspark.sql import functions as F

from alphaweave.config import LiveConfig, SubmitConfig
from alphaweave.operators import dynamic as dy
from alphaweave.operators import orders as od
from alphaweave.operators import residuals as rs
from alphaweave.sources import sinks
from alphaweave.sources.bars import latest_positions, load_factor_tables, normalize_bars, read_bars_on, read_dimension
from alphaweave.streaming import live


def long_returns(spark, f):
    days = business_days("2020-01-01", len(f))
    rows = [(days[t], t, f"k{k}", None if np.isnan(v) else float(v)) for t, row in enumerate(f) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "date date, t int, factor string, f double")


def test_filter_matches_the_matrix_form_with_gaps(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(0, 0.02, (30, 3))
    f[10, 1] = np.nan
    f[20] = np.nan
    kf, inn = dy.kalman_from_returns(long_returns(spark, f))
    got = {(r["t"], r["factor"]): r["f_kf"] for r in kf.collect()}
    score = {r["t"]: r for r in inn.collect()}
    m, P = np.zeros(3), np.eye(3)
    for t in range(30):
        ok = np.isfinite(f[t])
        assert score[t]["valid_factor_count"] == ok.sum()
        if ok.any():
            P = P + 1e-5 * np.eye(3)
            H = np.eye(3)[ok]
            S = H @ P @ H.T + 1e-3 * np.eye(ok.sum())
            y = f[t][ok] - H @ m
            K = P @ H.T @ np.linalg.inv(S)
            m, P = m + K @ y, P - K @ H @ P
            assert abs(score[t]["innovation_score"] - y @ np.linalg.solve(S, y)) < 1e-9
            assert abs(score[t]["innovation_norm"] - np.linalg.norm(y) / np.sqrt(ok.sum())) < 1e-12
        else:
            assert score[t]["innovation_score"] is None
        np.testing.assert_allclose([got[(t, f"k{k}")] for k in range(3)], m, atol=1e-12)


def scores(spark, values):
    days = business_days("2020-01-01", len(values))
    return spark.createDataFrame([(d, t, v) for t, (d, v) in enumerate(zip(days, values))], "date date, t int, innovation_score double")


def test_regime_spike_and_warmup(spark):
    values = [1.0] * 300
    values[258] = 100.0
    r = {x["t"]: x for x in dy.classify_regimes(scores(spark, values)).collect()}
    assert r[251]["regime_state"] == "warmup" and r[257]["regime_state"] == "normal"
    assert r[258]["regime_state"] == "break" and r[258]["regime_event"] and r[258]["regime_switch"] and r[259]["regime_switch"]
    assert r[258]["break_threshold"] == 1.0  # thresholds see the past only
    with pytest.raises(ValueError):
        dy.classify_regimes(scores(spark, values), warning_q=0.99, break_q=0.95)


def test_regime_unknown_when_history_is_thin(spark):
    r = {x["t"]: x["regime_state"] for x in dy.classify_regimes(scores(spark, [None] * 5 + [1.0] * 5), 5, 0.8, 0.95).collect()}
    assert r[4] == "warmup" and r[5] == "unknown" and r[6] == "unknown" and r[7] == "normal"


def test_blend_uses_whatever_exists(spark):
    f = long_returns(spark, np.array([[1.0, np.nan]]))
    kf = f.select("date", "t", "factor", F.lit(0.5).alias("f_kf"))
    reg = spark.createDataFrame([(0, "normal")], "t int, regime_state string")
    got = {r["factor"]: r["f_blend"] for r in dy.blend(f, kf, reg).collect()}
    assert abs(got["k0"] - (0.3 + 0.7 * 0.5)) < 1e-12 and got["k1"] == 0.5


def series(spark, rows, col):
    return spark.createDataFrame(rows, f"ticker string, {col} double")


def test_signal_filters(spark):
    cfg = LiveConfig(min_dollar_volume=0.0, alpha_z_threshold=0.5)
    c = spark.createDataFrame([("A", 0.02, 1.0), ("B", 0.00001, 2.0), ("C", -0.03, -0.1), ("D", 0.0009, 1.0), ("E", 0.0007, 1.0)], "ticker string, alpha double, z_alpha double")
    quotes = series(spark, [(t, 1e6) for t in "ABCDE"], "dollar_volume")
    got = {r["ticker"]: r["passes_signal"] for r in od.signal_filter(c, quotes, cfg).collect()}
    assert got == {"A": True, "B": False, "C": False, "D": True, "E": False}


def test_turnover_cap_holding_and_weight_limits(spark):
    cfg = LiveConfig(max_position_weight=0.3, max_net_exposure=1.0, max_turnover_per_rebalance=0.1)
    cur, tgt = series(spark, [("A", 0.2)], "weight"), series(spark, [("B", 0.4)], "weight")
    capped = {r["ticker"]: r["weight"] for r in od.cap_turnover(cur, tgt, 0.1).collect()}
    assert abs(od.turnover_between(cur, od.cap_turnover(cur, tgt, 0.1)).first()[0] - 0.1) < 1e-12 and capped["A"] < 0.2
    young = spark.createDataFrame([("A", 1)], "ticker string, bars_held int")
    kept = {r["ticker"]: r["weight"] for r in od.min_holding(tgt, cur, young, cfg).collect()}
    assert kept["A"] == 0.2
    old = {r["ticker"] for r in od.min_holding(tgt, cur, young.limit(0), cfg).collect()}
    assert old == {"B"}
    lim = {r["ticker"]: r["weight"] for r in od.enforce_limits(tgt, cfg).collect()}
    assert lim == {"B": 0.3}


def test_orders_sizes_and_checks(spark):
    cfg = LiveConfig(min_order_dollars=10.0, slippage_bps=0.0)
    pos = spark.createDataFrame([("A", 5)], "ticker string, qty bigint")
    tgt, px = series(spark, [("A", 0.02), ("B", -0.01)], "weight"), series(spark, [("A", 10.0), ("B", 20.0)], "price")
    orders = od.generate_orders(pos, tgt, px, 10_000.0, cfg)
    got = {r["ticker"]: (r["side"], r["quantity"]) for r in orders.collect()}
    assert got == {"A": ("BUY", 15), "B": ("SELL", 5)}
    assert {r["ok"] for r in od.risk_check(orders, 10_000.0, 0.02).collect()} == {True}
    assert {r["reason"] for r in od.risk_check(orders, 1_000.0, 0.02).collect()} == {"size_or_price_limit"}


def test_low_price_filter_lets_missing_prices_pass(spark):
    tgt, px = series(spark, [("A", 0.1), ("B", 0.1), ("C", 0.1)], "weight"), series(spark, [("A", 4.99), ("B", 5.0)], "price")
    assert {r["ticker"] for r in od.drop_low_priced(tgt, px, 5.0).collect()} == {"B", "C"}


def test_recheck_keeps_overriding_zero(spark):
    saved = spark.createDataFrame(
        [("A", 1, "0.1", "0.01"), ("A", 2, "0", "0.01"), ("B", 1, "-0.1", "0.01"), ("C", 1, "x", "0.01"), ("D", 1, "0.1", "0.0007")],
        "ticker string, seq int, target_weight string, alpha_score string",
    )
    assert od.recheck_targets(saved, SubmitConfig(), ["seq"]).collect() == []
    assert {r["ticker"] for r in od.recheck_targets(saved, None, ["seq"]).collect()} == {"B", "D"}


def stamp(minutes):
    return dt.datetime(2024, 1, 2, 10, 0) + dt.timedelta(minutes=minutes)


def intraday(spark, n=80, tickers=("A", "B", "C")):
    rows = [
        (stamp(15 * i), tk, 10.0 + k + (i * 7 % 5) / 10, 11.0 + k, 9.0 + k, 10.2 + k + (i * (k + 3) % 7) / 10, None if tk == "C" else 1000.0 + float(i ** (k + 1)))
        for i in range(n) for k, tk in enumerate(tickers)
    ]
    return spark.createDataFrame(rows, "timestamp timestamp, ticker string, open double, high double, low double, close double, volume double")


def test_history_has_no_look_ahead(spark):
    got = live.recent_history(intraday(spark, 2, ("A",)), 260, "2024-01-02 10:00:00").collect()
    assert [r["timestamp"] for r in got] == [stamp(0)]


def test_live_exposures_drop_poor_coverage(spark):
    cfg = LiveConfig(min_factor_names=2, min_exposure_coverage=0.9)
    x, names = live.latest_exposures(intraday(spark), cfg)
    assert {r["ticker"] for r in x.collect()} == {"A", "B"} and "volume_z_20" in names
    assert x.count() == x.dropna().count()


def test_normalize_bars(spark):
    df = spark.createDataFrame(
        [("2024-01-02T10:00:00Z", "A", "1.5", 1), ("2024-01-02T10:00:00Z", "A", "bad", 2), (None, "A", "1", 3)],
        "timestamp string, ticker string, close string, seq int",
    )
    r = normalize_bars(df, ["seq"]).collect()
    assert len(r) == 1 and r[0]["close"] is None and r[0]["timestamp"] == stamp(0)


def test_stream_drops_late_rows_and_counts_them(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "ts timestamp, ticker string, price double, event_id bigint"
    batches = [[(stamp(0), "A", 1.0, 1), (stamp(5), "A", 2.0, 2)], [(stamp(120), "A", 3.0, 3)], [(stamp(300), "A", 4.0, 4)]]
    # Lateness is judged by the watermark of the batch before, so the late row comes two batches later.
    batches += [[(stamp(1), "A", 9.0, 5)], [(stamp(600), "A", 5.0, 6)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
    stream = live.bar_stream(spark, str(src / "*"), schema, maxFilesPerTrigger="1", latestFirst="false")
    q = live.tumbling_bars(stream, 15).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    first = spark.read.parquet(out).where(F.col("timestamp") == F.lit(stamp(0))).first()
    assert dropped == 1 and (first["open"], first["high"], first["close"], first["volume"]) == (1.0, 2.0, 2.0, 2.0)


def test_rebalance_replay_changes_nothing(spark, tmp_path):
    cfg = LiveConfig(min_factor_names=2, min_exposure_coverage=0.3, min_dollar_volume=0.0, alpha_z_threshold=0.0, min_order_dollars=1.0)
    step = live.Rebalancer(spark, str(tmp_path / "live"), cfg, {"mom_1": 0.05}, ["mom_1", "intraday_return"])
    step(intraday(spark, 40), 0)
    read = lambda name: sorted(map(tuple, spark.read.parquet(str(tmp_path / "live" / name)).collect()))
    before = {n: read(n) for n in ("orders", "holding", "positions")}
    assert before["orders"]
    step(intraday(spark, 40), 0)
    assert {n: read(n) for n in before} == before
    step(intraday(spark, 41), 1)
    ages = {r["ticker"]: r["bars_held"] for r in spark.read.parquet(str(tmp_path / "live" / "holding")).where("batch_id = 1").collect()}
    assert max(ages.values()) == 2


def test_a_batch_that_closes_everything_leaves_nothing_open(spark, tmp_path):
    cfg = LiveConfig(min_factor_names=2, min_exposure_coverage=0.3, min_dollar_volume=0.0, alpha_z_threshold=0.0, min_order_dollars=1.0)
    step = live.Rebalancer(spark, str(tmp_path / "live"), cfg, {"mom_1": 0.05}, ["mom_1", "intraday_return"])
    schema = "ticker string, qty bigint"
    empty = spark.createDataFrame([], schema)
    # An empty first state has a schema, and an empty later one hides the book before it.
    step._save("positions", empty, 0)
    step._save("batches", spark.createDataFrame([(0,)], "id bigint"), 0)
    assert step._state("positions", schema, 1).count() == 0
    step._save("positions", spark.createDataFrame([("A", 5)], schema), 1)
    step._save("batches", spark.createDataFrame([(1,)], "id bigint"), 1)
    assert step._state("positions", schema, 2).count() == 1
    step._save("positions", empty, 2)
    step._save("batches", spark.createDataFrame([(2,)], "id bigint"), 2)
    assert step._state("positions", schema, 3).count() == 0
    # A replay that now closes everything replaces what the first run left.
    step._save("positions", empty, 1)
    assert step._state("positions", schema, 2).count() == 0


def test_split_days_give_the_bars_of_whole_days(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 2) + dt.timedelta(minutes=m)
    ticks = [(at(30 * i), "A", 10.0 + (i * 7) % 5, i) for i in range(12)]
    schema = "ts timestamp, ticker string, price double, event_id long"
    key = lambda df: sorted((r["timestamp"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in df.collect())
    whole = live.tumbling_bars(spark.createDataFrame(ticks, schema), 1440)
    path = str(tmp_path / "ticks")
    # The later half arrives first; replaying it changes nothing.
    for batch_id, part in ((0, ticks[6:]), (0, ticks[6:]), (1, ticks[:6])):
        got = live.rebuilt_bars(spark.createDataFrame(part, schema), batch_id, path, 1440)
        last = key(got)
    assert last == key(whole)


def test_the_last_row_wins_by_place_not_by_value(spark):
    at = dt.datetime(2024, 1, 2)
    rows = [(at, "A", 20.0), (at, "A", 10.0)]
    assert normalize_bars(spark.createDataFrame(rows, "timestamp timestamp, ticker string, open double").coalesce(1)).first()["open"] == 10.0
    staged = spark.createDataFrame([("A", 9), ("A", 4)], "ticker string, qty int").coalesce(1)
    assert latest_positions(staged).first()["qty"] == 4


def test_upsert_rewrites_only_touched_days(spark, tmp_path):
    path = str(tmp_path / "bars")
    sinks.upsert_bars(normalize_bars(intraday(spark, 4)), path, ("timestamp", "ticker"))
    late = intraday(spark, 1).withColumn("close", F.lit(99.0))
    next_day = late.withColumn("timestamp", F.expr("timestamp + INTERVAL 1 DAY"))
    sinks.upsert_bars(normalize_bars(late.unionByName(next_day)), path, ("timestamp", "ticker"))
    df = spark.read.parquet(path)
    assert df.count() == 15 and df.where("close = 99").count() == 6
    assert df.where("day = DATE'2024-01-02'").count() == 12


def test_bars_on_a_day_push_the_date_down(spark, tmp_path):
    path = str(tmp_path / "b")
    intraday(spark, 2).withColumn("date", F.to_date("timestamp")).write.partitionBy("date").parquet(path)
    tickers = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    df = read_bars_on(spark, path, "2024-01-02", tickers, ["timestamp"])
    got = {r["ticker"]: r["close"] for r in df.collect()}
    assert set(got) == {"A", "Z"} and got["Z"] is None and got["A"] is not None
    assert "PartitionFilters: [isnotnull(date" in df._jdf.queryExecution().toString()


def test_dimension_csv_and_artifacts(spark, tmp_path):
    (tmp_path / "tickers.csv").write_text("name,ticker\nx,A\ny,\nz,C\n")
    assert [r["ticker"] for r in read_dimension(spark, str(tmp_path / "tickers.csv"), "ticker").orderBy("position").collect()] == ["A", "missing_ticker_1", "C"]
    x = intraday(spark, 2).withColumn("date", F.to_date("timestamp")).drop("timestamp")
    f = spark.createDataFrame([(dt.date(2024, 1, 2), 0, "mom_1", 0.1)], "date date, t int, factor string, f double")
    sinks.write_artifacts({"exposures": x, "factor_returns": f}, str(tmp_path / "art"))
    tables = load_factor_tables(spark, str(tmp_path / "art"))
    assert tables["exposures"].where("tradable").count() == 6 and tables["returns"] is None
    with pytest.raises(FileNotFoundError):
        load_factor_tables(spark, str(tmp_path))
    calls = []
    build = lambda: calls.append(1) or f
    for _ in range(2):
        assert sinks.build_or_read(spark, str(tmp_path / "cache"), build).count() == 1
    assert len(calls) == 1
    # A write that dies leaves files without the marker; they are built anew, also over an older whole table.
    for path in ("dead", "cache"):
        dying = f.repartition(2).withColumn("f", F.raise_error(F.lit("killed")).cast("double"))
        with pytest.raises(Exception, match="killed"):
            sinks.build_or_read(spark, str(tmp_path / path), lambda: dying, use_cache=False)
        f.withColumn("f", F.lit(9.0)).write.mode("append").parquet(str(tmp_path / path))
        assert [r["f"] for r in sinks.build_or_read(spark, str(tmp_path / path), build).collect()] == [0.1]
    assert len(calls) == 3
    sinks.append_log(f, str(tmp_path / "log"))
    sinks.append_log(f, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2


def test_reports_in_order(spark, tmp_path):
    df = spark.range(4000).selectExpr("id % 7 AS a", "hash(id) AS b", "date'2024-01-02' AS signal_date").repartition(5)
    sinks.write_csv_report({"x": df, "y": df.limit(3)}, str(tmp_path), "2024-01-02", order_by={"x": ["a", "b"]})
    files = sorted((tmp_path / "2024-01-02" / "x").glob("part-*.csv"))
    lines = [tuple(map(int, line.split(",")[:2])) for f in files for line in f.read_text().splitlines()[1:]]
    assert len(lines) == 4000 and lines == sorted(lines)


def test_first_per_key_drops_late_and_repeated_rows(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    deliveries = [
        [(at(9, 0), "A", 1.0), (at(9, 5), "A", 2.0), (at(12, 0), "B", 3.0)],
        # Two repeats that are remembered, a new key.
        [(at(12, 5), "B", 4.0), (at(9, 7), "A", 5.0), (at(12, 30), "A", 7.0)],
        # Behind the watermark: a repeat that is forgotten and a late new key.
        [(at(9, 8), "A", 8.0), (at(9, 1), "D", 9.0), (at(13, 0), "B", 10.0)],
    ]
    schema = "ts timestamp, ticker string, price double"
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
    stream = live.bar_stream(spark, feed, schema, maxFilesPerTrigger=1).withColumn("bar", F.date_trunc("hour", "ts"))
    for _ in range(2):  # started again from its checkpoint it finds nothing new
        query = live.start(live.first_per_key(stream, ["bar", "ticker"], "30 minutes"), live.append_sink(out), str(tmp_path / "cp"))
        query.awaitTermination()
        if _ == 0:
            assert live.rows_dropped(query) == 2
    got = sorted((r["ticker"], r["bar"].hour) for r in spark.read.parquet(out).collect())
    assert got == [("A", 9), ("A", 12), ("B", 12), ("B", 13)]


def test_signed_root_and_outliers(spark):
    days = business_days("2024-01-02", 2)
    df = spark.createDataFrame([(days[0], "A", -4.0), (days[0], "B", 0.0), (days[0], "C", 9.0), (days[1], "A", None), (days[1], "B", 0.25), (days[1], "C", -0.25)], "date date, ticker string, residual_zscore double")
    cells = {(r["date"], r["ticker"]): r["cell"] for r in rs.heatmap_slice(df, None, 3, 2).collect()}
    assert cells[(days[0], "A")] == -2.0 and cells[(days[0], "C")] == 3.0 and cells[(days[1], "A")] is None and cells[(days[1], "B")] == 0.5
    z = df.withColumn("residual", F.col("residual_zscore"))
    out = {r["ticker"]: r["side_implication"] for r in rs.outliers(z, 3.0).collect()}
    assert out == {"A": "negative_outlier", "C": "positive_outlier"}


def test_heatmap_limit_of_few_cells(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "residual double")
    limit = lambda *v: rs.heatmap_limit(df(*v)).first()["limit"]
    assert [limit(), limit(None, float("nan")), limit(0.0, 0.0)] == [1.0, 1.0, 1.0]
    assert limit(-4.0, None, float("inf"), 0.0) == pytest.approx(2 * 0.995)


def test_filter_states_follow_the_recursion(spark):
    rows = [(dt.date(2024, 1, 1 + t), t, n, v) for n, vs in {"a": [0.1, None, 0.3, 0.2], "b": [None, None, -0.1, float("nan")]}.items() for t, v in enumerate(vs)]
    got = {(r.factor, r.t): r for r in dy.kalman_states(spark.createDataFrame(rows, "date date, t int, factor string, f double"), 0.01, 0.1, 2.0).collect()}
    known = {t for _, t, _, v in rows if v is not None and v == v}
    for name in "ab":
        m, p = 0.0, 2.0
        for t in range(4):
            z, r = next(v for _, u, n, v in rows if (n, u) == (name, t)), got[name, t]
            assert r.kalman_forecast_f_hat == pytest.approx(m)
            p += 0.01 if t in known else 0
            if z is None or z != z:
                assert r.kalman_gain is None and r.y is None
            else:
                gain = p / (p + 0.1)
                assert r.kalman_gain == pytest.approx(gain)
                m, p = m + gain * (z - m), (1 - gain) * p
            assert (r.kalman_f_hat, r.state_covariance_diag) == (pytest.approx(m), pytest.approx(p))
