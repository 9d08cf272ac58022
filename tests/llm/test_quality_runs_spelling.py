"""Quality rules, periodic runs and spelling variants against plain versions on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from alphaweave.llm import periodic, quality, spelling

EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id " * 9), (5, "word " * 40_000), (6, "a b\n\nc a b\nc\x0bd e")]
EXTRA = ("n", "word", "words", "vec", "root", "score", "quality", "__good", "__id", "bucket", "runs", "start", "kept", "chunk")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})


# ---- quality -------------------------------------------------------------------------------

def hash64(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def grams(text):
    h = [hash64(p.encode()) for p in re.findall(r"[^\W_]+|(?:[^\w\x20\x09-\x0D]|_)+", text)]
    return [x % quality.BUCKETS for x in h] + [hash64(struct.pack("<q", b), hash64(struct.pack("<q", a))) % quality.BUCKETS for a, b in zip(h, h[1:])]


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_equals_a_plain_version(spark):
    rng = random.Random(1)
    names = "the river house über ça and of 12 l'eau d_e".split()
    rows = []
    for i in range(150):
        words = rng.choices(names, k=rng.randint(0, 60))
        if i % 5 == 0:
            words = [w + rng.choice(["&&&", "###", "%"]) for w in words]
        if i % 7 == 0 and len(words) > 12:
            at = rng.randrange(len(words))
            words[at:at] = words[: rng.randint(8, 12)]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  "]) for w in words)))
    rows += EDGES
    labels = [(i, int(i % 5 != 0)) for i in range(0, 150, 2)] + [(2, 0), (2, 1), (4, 1), (None, 1), (8, None), (5, 0)]
    got = quality.judge(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    least = {}
    for i, q in labels:
        if q is not None:
            least[i] = min(q, least.get(i, 1))
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t or ""))
        if i is not None and least.get(i) == 1:
            good.update(grams(t or ""))
    n, m, b = sum(raw.values()), sum(good.values()), quality.BUCKETS
    ratio = {k: math.log((good[k] / m * m / (m + b)) / (raw[k] / n) + b / (m + b)) for k in raw}
    want = []
    for i, t in rows:
        g = grams(t or "")
        score = sum(ratio[k] for k in g) / len(g) if g else 0.0
        *counts, failed = rules(t or "")
        want.append((str(i), *counts, failed, not failed and score >= quality.LEAST, score))
    have = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.score) for r in got]
    for a, b in zip(sorted(have), sorted(want)):
        assert a[:-1] == b[:-1] and math.isclose(a[-1], b[-1], rel_tol=1e-9, abs_tol=1e-12)
    assert {r.kept for r in got} == {True, False}


def test_quality_without_trust_and_empty(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs(spark, [(1, "w%d " * 1 % 3 + " ".join(f"x{i}" for i in range(30))), (2, "short")]), none).collect()
    assert {(r.doc_id, r.kept, r.score) for r in got} == {(1, True, 0.0), (2, False, 0.0)}
    assert quality.judge(docs(spark, EDGES).limit(0), none.limit(0)).collect() == []
    rated = quality.rate(docs(spark, EDGES), [0.0] * quality.BUCKETS)
    assert [f for f in rated.schema.names if f != "quality"] == [f for f in docs(spark, EDGES).schema.names if f != "quality"]


def test_long_texts_take_linear_time(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(200_000))
    (r,) = quality.judge(docs(spark, [(1, text)]), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (200_000, 200_000, True)


# ---- runs ----------------------------------------------------------------------------------

def plain_runs(s, least):
    n, out = len(s), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(2 * q, least(q)) and not any(all(s[k] == s[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up_words(rng):
    s = [rng.randrange(rng.choice([2, 400])) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 4)):
        block, at = [rng.randrange(30) for _ in range(rng.randint(1, 25))], rng.randint(0, len(s))
        s[at:at] = (block * 120)[: rng.randint(10, 120)]
    return s


def test_all_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
        assert [tuple(r) for r in periodic.all_runs(s).tolist()] == plain_runs(s, lambda q: 0)
    for _ in range(150):
        s = made_up_words(rng)
        assert [tuple(r) for r in periodic.find_runs([str(x) for x in s]).tolist()] == plain_runs(s, lambda q: max(24, 3 * q))


def test_extensions_equal_comparison():
    rng = random.Random(3)
    s = [rng.randrange(2) for _ in range(500)] + [0] * 200
    lce = periodic.Extensions(s)
    import numpy as np

    a, b = (np.array(x) for x in zip(*(rng.sample(range(700), 2) for _ in range(3000))))
    for i, j, got in zip(a.tolist(), b.tolist(), lce(a, b).tolist()):
        k = 0
        while max(i, j) + k < 700 and s[i + k] == s[j + k]:
            k += 1
        assert got == k


def test_run_digests(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in made_up_words(rng))) for i in range(120)] + EDGES
    got = {}
    for r in periodic.digest(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = [(0, n, 1)] if n == 40_000 else plain_runs(words, lambda q: max(24, 3 * q))
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        milli = best[1] * 1000 // best[2] if runs else None
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))
        assert want in got[i], (i, want, got[i])
    assert periodic.digest(docs(spark, rows).limit(0)).collect() == []


# ---- spelling ------------------------------------------------------------------------------

def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = [(-m, x) for x, m in words.items() if x != w and one_edit(x, w)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = [n, form, -best[0] if form else None, len(near)]
    for w in out:
        root = w
        while out[root][1]:
            root = out[root][1]
        out[w].append(root)
    return {(w, *x) for w, x in out.items()}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("most", [40_000, 20, 2])
def test_variants_equal_brute_force(spark, most):
    rng = random.Random(5)
    words = {}
    for _ in range(250):
        w = "".join(rng.choices("abmné𝄞", k=rng.randint(1, 7)))
        words[w] = rng.choice([1, 2, 5, 30, 200, 2000])
    words |= {"".join(rng.sample("abcdef", 6)): 3 for _ in range(40)} | {"x" * 300: 5, "x" * 301: 60}
    rows = list(words.items()) + [(None, 4), ("abc", 0)]
    words.setdefault("abc", 0)
    df = spark.createDataFrame(rows, "word string, n long").withColumn("root", F.lit("x"))
    got = {(r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in spelling.variants(df, most=most).collect()}
    assert got == plain_variants(words)
    assert spelling.variants(df.limit(0), most=most).collect() == []


def test_vocabulary(spark):
    rows = [(i % 50, "Straßeé Überfluß, HARBOUR harbour; short river-boat ×÷×÷×÷ ÀÉÎÕÜÿ") for i in range(400)] + EDGES
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            want[run if h % 7 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r.word: r.n for r in spelling.vocabulary(docs(spark, rows), one_in=7).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
