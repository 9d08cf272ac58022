"""The registry is consistent, and headline queries equal their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare, rows_of

SF = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.parametrize("name", ["momentum_long_short_summary", "ttm_filings", "cost_aware_weights", "regimes", "live_target_weights"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    df = entry.queries()[name](spark, SF)
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(cols, want)
    assert a[0] == b[0] and not compare(a[1], b[1]).strip("~ 0123456789").replace("last-digit", "")


def test_entry(spark):
    assert entry.entry(spark).count() == 1
