"""Registered queries return all that their operators do: against brute force on the smallest tables."""

from __future__ import annotations

import math

import __spark_entry__ as entry
from verification.model import diag

SF = "/root/testdata/sf0.001"


def test_gram_has_every_date_of_the_other_path(spark):
    rows = lambda name: {r[0]: tuple(r)[1:] for r in entry.queries()[name](spark, SF).collect()}
    got, want = rows("ridge_factor_returns_gram"), rows("ridge_factor_returns")
    assert got.keys() == want.keys()
    for d in want:
        assert all(a == b if a is None or b is None else math.isclose(a, b, abs_tol=1e-7) for a, b in zip(got[d], want[d]))


def test_suspicious_days_of_all_reasons(spark):
    rows = diag(spark, SF).collect()
    reasons = {"largest_norm_f": ("norm_f", -1), "largest_max_abs_f": ("max_abs_f", -1), "largest_cond_X": ("cond_X", -1), "worst_centered_R2": ("centered_R2", 1), "largest_residual_norm_ratio": ("residual_norm_ratio", -1)}
    want = {}
    for reason, (column, sign) in reasons.items():
        for lam in {r["lambda"] for r in rows}:
            values = sorted((float(r[column]) for r in rows if r["lambda"] == lam and r[column] is not None), key=lambda v: sign * v)[:10]
            want[reason, lam] = values
    got = {}
    for r in entry.queries()["ridge_suspicious_days"](spark, SF).collect():
        got.setdefault((r.reason, r["lambda"]), []).append(r.value)
    assert {k for k, v in want.items() if v} == got.keys() and len({k[0] for k in got}) == 5
    for k, values in got.items():
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(sorted(values), sorted(want[k]))) and len(values) == len(want[k])


def test_sweep_returns_all_books(spark):
    got = entry.queries()["risk_sweep"](spark, SF).collect()
    assert {"gross_half", "gross_full", "gross_double"} <= set(got[0].asDict())
    assert all(any(r[f"gross_{b}"] != 0 for r in got) for b in ("half", "full", "double")) and len({r.date for r in got}) == len(got)
