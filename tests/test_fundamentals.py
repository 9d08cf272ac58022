"""Filings: availability, fallback keys, trailing sums with restatements, as-of joins."""

from __future__ import annotations

import json
from datetime import date, timedelta

from conftest import business_days

from alphaweave.operators import fundamentals as fund


def filing(end, filed, income=None, balance=None, cash=None, **kw):
    wrap = lambda d: {k: {"value": v} for k, v in (d or {}).items()}
    return json.dumps(
        {"ticker": "AAPL", "end_date": end, "filing_date": filed, "timeframe": "quarterly",
         "financials": {"income_statement": wrap(income), "balance_sheet": wrap(balance), "cash_flow_statement": wrap(cash)}} | kw
    )


def flat(spark, lines, lag=60):
    return fund.flatten_filings(fund.parse_filing_json(spark.createDataFrame([(x,) for x in lines], "json string")), lag)


def test_availability_date_and_lag(spark):
    a, b = (flat(spark, [filing("2024-03-31", f)]).first() for f in ("2024-05-10", None))
    assert (a["available_date"], a["availability_source"]) == (date(2024, 5, 10), "filing_date")
    assert (b["available_date"], b["availability_source"]) == (date(2024, 5, 30), "end_date_plus_lag")


def test_first_present_key_wins_even_if_unreadable(spark):
    rows = flat(
        spark,
        [
            filing("2024-03-31", "2024-05-01", {"sales": 5}),
            filing("2024-06-30", "2024-08-01", {"revenues": "n/a", "sales": 7}),
            filing("2024-09-30", "2024-11-01", {"revenues": None, "sales": 7}, ticker=None, tickers=["MSFT", "X"]),
        ],
    ).orderBy("end_date").collect()
    assert [r["revenues"] for r in rows] == [5.0, None, None]
    assert rows[2]["ticker"] == "MSFT"


def test_free_cash_flow(spark):
    r = flat(spark, [filing("2024-03-31", "2024-05-01", cash={"net_cash_flow_from_operating_activities": 10, "capital_expenditures": -4})]).first()
    assert r["free_cash_flow"] == 6.0


def quarters(n=5, **over):
    end = [date(2023, 3, 31), date(2023, 6, 30), date(2023, 9, 30), date(2023, 12, 31), date(2024, 3, 31)]
    return [
        filing(str(end[i]), str(over.get(i, end[i] + timedelta(days=40))), {"revenues": 100 * (i + 1), "net_income_loss": 10 * (i + 1)},
               {"assets": 1000 + 100 * i})
        for i in range(n)
    ]


def test_trailing_sums(spark):
    rows = fund.build_ttm(flat(spark, quarters())).orderBy("end_date").collect()
    assert [r["revenues"] for r in rows] == [None, None, None, 1000.0, 1400.0]
    assert [r["assets"] for r in rows] == [1000.0, 1100.0, 1200.0, 1300.0, 1400.0]
    assert [r["ttm_quarters_available"] for r in rows] == [1, 2, 3, 4, 4]


def brute_ttm(rows):
    """Replay of the filings in arrival order."""
    known, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["available_date"], r["end_date"])):
        known[r["end_date"]] = r
        last = sorted(e for e in known if e <= r["end_date"])[-4:]
        vals = [known[e]["revenues"] for e in last if known[e]["revenues"] is not None]
        out[(r["end_date"], r["available_date"])] = (sum(vals) if len(vals) >= 4 else None, len(last))
    return out


def test_late_and_restated_quarters_match_a_replay(spark):
    """Periods arriving out of order and restatements; the look-back must reach over late periods."""
    ends = [date(2018, 3, 31) + timedelta(days=91 * i) for i in range(16)]
    lines = []
    for i, e in enumerate(ends):
        delay = 40 + (400 if i % 5 == 2 else 0) + (900 if i in (6, 7, 8) else 0)
        lines.append(filing(str(e), str(e + timedelta(days=delay)), {"revenues": 100 + i}))
        if i % 4 == 1:
            lines.append(filing(str(e), str(e + timedelta(days=delay + 300)), {"revenues": 1000 + i}))
    f = flat(spark, lines)
    want = brute_ttm(f.collect())
    got = {(r["end_date"], r["available_date"]): (r["revenues"], r["ttm_quarters_available"]) for r in fund.build_ttm(f).collect()}
    assert got == want


def test_as_of_never_backfills(spark):
    f = flat(spark, [filing("2024-03-31", "2024-05-10", {"revenues": 5})])
    days = business_days("2024-05-01", 11)
    asked = spark.createDataFrame([(d, "AAPL") for d in days], "date date, ticker string")
    got = {r["date"]: r["revenues"] for r in fund.daily_fundamentals(f, asked, ["revenues"]).collect()}
    assert len(got) == 11 and all((v == 5.0) == (d >= date(2024, 5, 10)) for d, v in got.items())


def test_columns_fill_independently(spark):
    f = flat(
        spark,
        [filing("2024-03-31", "2024-05-02", {"revenues": 5}, {"assets": 9}), filing("2024-06-30", "2024-05-06", {"revenues": 6})],
    )
    days = business_days("2024-05-01", 6)
    asked = spark.createDataFrame([(d, "AAPL") for d in days], "date date, ticker string")
    last = fund.daily_fundamentals(f, asked, ["revenues", "assets"]).orderBy("date").collect()[-1]
    assert (last["revenues"], last["assets"]) == (6.0, 9.0)


def test_ratio_with_zero_denominator_is_infinite(spark):
    df = spark.createDataFrame(
        [("A", date(2024, 1, 2), 10.0, 5.0, 0.0, 0.0, 3.0)],
        "ticker string, date date, adj_close double, net_income double, equity double, revenues double, shares_basic double",
    )
    r = fund.fundamental_factors(df).first()
    assert r["roe"] == float("inf") and r["net_margin"] == float("inf") and r["earnings_yield"] == 5.0 / 30.0
    assert r["current_ratio"] is None and r["asset_turnover"] is None


def test_ttm_shuffles_filings_once_and_counts_repeated_ones_once(spark):
    rows = [
        ("A", date(2020, 3 * q, 28), date(2020, 3 * q, 28) + timedelta(days=30), 100.0 * q) for q in (1, 2, 3, 4)
    ]
    rows += rows[-1:]  # the vendor sends the last filing twice
    columns = [c for c in fund.VALUE_COLUMNS if c != "revenues"]
    flat = spark.createDataFrame(rows, "ticker string, end_date date, available_date date, revenues double").selectExpr(
        "*", "end_date AS start_date", "available_date AS filing_date", "'filing_date' AS availability_source", "'quarterly' AS timeframe",
        "'Q' AS fiscal_period", "'2020' AS fiscal_year", *[f"CAST(NULL AS DOUBLE) AS {c}" for c in columns],
    )
    ttm = fund.build_ttm(flat)
    last = ttm.where("end_date = DATE '2020-12-28'").collect()
    assert [(r.ttm_quarters_available, r.revenues) for r in last] == [(4, 1000.0)] * 2
    plan = ttm._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
