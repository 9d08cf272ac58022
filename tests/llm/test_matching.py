"""Running totals and matches in texts with very many of them; sketches of short and of joined texts."""

from __future__ import annotations

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from alphaweave.llm import fingerprints, matching, secrets
from alphaweave.llm.components import components


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_running_totals(spark, levels):
    rng = random.Random(levels)
    rows = [(n, [rng.randint(0, 9) for _ in range(n)]) for n in (0, 1, 2, 63, 64, 65, 128, 4097, 9000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    got = df.select("v", matching.running(F.col("v"), lambda a, b: a + b, F.lit(0), levels).alias("sum"), matching.running(F.col("v"), F.greatest, F.lit(3), levels).alias("most")).collect()
    for r in got:
        assert r["sum"] == (None if r.v is None else list(itertools.accumulate(r.v)))
        assert r.most == (None if r.v is None else list(itertools.accumulate(r.v, max, initial=3))[1:])


def test_matches_and_halving(spark):
    texts = ["", "x", "ab12cd345", "12", "1a2é3", "no digit", "\x0112\x01", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matching.matches(F.col("t"), "[0-9]+").alias("m")).collect()
    for r in got:
        ends = [0, *(m.end() for m in re.finditer("[0-9]+", r.t or ""))]
        want = [(m.start(), m.end(), m[0], (r.t[e : m.start()]).replace("\x01", "\x02")) for m, e in zip(re.finditer("[0-9]+", r.t or ""), ends)]
        assert [tuple(x) for x in r.m or []] == want
    rows = [([1, 3, 3, 7], x) for x in range(9)] + [([], 1)]
    for r in spark.createDataFrame(rows, "v array<int>, x int").select("v", "x", matching.last_at_most(F.col("v"), lambda v: v, F.col("x")).alias("at")).collect():
        assert r["at"] == sum(v <= r.x for v in r.v) - 1


def test_many_matches_take_seconds(spark):
    key = "Zq8Kp2Lw9Xc4Vb7Nm1Rt"
    taken = []
    for n in (10, 10_000, 100_000):
        text = "password=abcdefgh1 " * n + f"{key} " * (n // 10)
        t = time.time()
        r = secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        taken.append(time.time() - t)
        assert r.n_assign == n and r.spans.count("entropy_b64") == n // 10
    assert taken[2] < 60


def test_entropy_spans_within_fixed_ones_are_not_added(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choices("ABCDEFGHJKLMNPQRSTUVabcdefghjkmnpqrstuvwxyz23456789", k=rng.randint(40, 60))) for _ in range(60)]
    text = " ".join(rng.choice(["secret=%s", "see %s", "AKIA%s", "%s"]) % k for k in keys)
    for r in secrets.scan(spark.createDataFrame([(1, text), (2, None), (3, keys[0])], "doc_id long, text string")).collect():
        assert not any(b.start <= a.start and a.end <= b.end for a in r.added for b in r.base)
        for m in re.finditer(r"see ([A-Za-z0-9]+)", r.text or ""):
            assert any(a.start < m.end(1) and m.start(1) < a.end for a in r.added)
    assert secrets.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_edits_change_fingerprints_and_likeness_is_near_the_containment(spark):
    rng = random.Random(2)
    rows, share = [], fingerprints.SHARE
    for n in (10, 40, 200):
        for _ in range(200):
            words = [f"w{rng.random()}" for _ in range(n)]
            rows.append((n, " ".join(words), " ".join([*words[: n // 2], "changed", *words[n // 2 + 1 :]])))
    cols = [fingerprints.sketch(F.col(c)).alias(f"s{c}") for c in "ab"]
    got = spark.createDataFrame(rows, "n int, a string, b string").select("n", *cols).select("*", fingerprints.likeness(F.col("sa"), F.col("sb")).alias("like")).collect()
    for n in (10, 40, 200):
        own = [r for r in got if r.n == n]
        least = 2 * min(5, n - 4)
        assert sum(r.sa == r.sb for r in own) / len(own) < (1 - 1 / share) ** least + 0.06
        true = 1 - min(5, n - 4) / (n - 4)
        assert abs(sum(r.like for r in own) / len(own) - true) < 0.1


def test_merged_sketch_is_that_of_all_shingles(spark):
    rng = random.Random(3)
    rows = [([rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(rng.randint(0, 4))], [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(rng.randint(0, 4))]) for _ in range(300)]
    low = lambda x: F.array_sort(fingerprints.lowest(x, fingerprints.SHARE))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    wrong = df.where(fingerprints.merged(low(F.col("a")), low(F.col("b"))) != low(F.array_union("a", "b")))
    assert wrong.count() == 0


def test_links_that_do_not_settle_are_an_error(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)
