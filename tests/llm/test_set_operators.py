"""Jaccard join, fingerprints, packing, embedding and pipeline operators against plain versions on small tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import subprocess
import sys
import time
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaweave.llm import fingerprints, jaccard_join, packing, vector_dedup
from alphaweave.llm.components import components
from alphaweave.llm.queries import tokenizer_path

EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "word " * 30_000), (6, "ONE two"), (7, "x" * 50_000)]
EXTRA = ("n", "rep", "region", "h1", "h2", "head", "root", "node", "length", "start", "ids", "piece", "group", "sketch", "edited", "next", "n_chars", "half", "c", "s", "a", "b")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})


def least_root(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def families(seed=1):
    """Copies, near copies of many degrees, a passage that half the texts share, and texts of common lines alone."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    passage, lines = [word() for _ in range(40)], [[word() for _ in range(8)] for _ in range(6)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 120))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 12)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [" ".join(sum(rng.sample(lines, rng.randint(1, 4)), [])) for _ in range(25)]
    texts += [texts[0]] * 6 + [texts[0].upper()]
    rng.shuffle(texts)
    return [(100 + 3 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_join_equals_all_pairs(spark, monkeypatch, small):
    if small:  # every region is split by pivots, cells and tiles
        for name, n in (("LEAF", 1), ("TILE", 4), ("PIVOTS", 2)):
            monkeypatch.setattr(jaccard_join, name, n)
    rows = families() + EDGES
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = least_root(sets, links)
    assert len(set(root.values())) < len(root) - 20
    got = jaccard_join.join(docs(spark, rows), 3, 80).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in sets}
    if not small:
        left = jaccard_join.one_of_each(docs(spark, rows), 3, 80)
        assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if root[i] == i) and left.columns == docs(spark, rows[:1]).columns
        assert jaccard_join.join(docs(spark, rows).limit(0)).collect() == []


def test_join_broadcasts_rows_of_few_numbers(spark, monkeypatch):
    """A row with a list takes kilobytes; as many of them as rows of numbers are too much for a driver."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.dtypes) or broadcast(df))
    rows = families()
    assert 0 < jaccard_join.one_of_each(docs(spark, rows), 3, 80).count() < len(rows)
    assert len(sent) > 5 and {kind for columns in sent for _, kind in columns} <= {"bigint", "int", "boolean"}


def test_shared_counts_equal_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (0, 5, 30, 50, 50)]
    expect = [[len(set(a) & set(b)) for b in sets] for a in sets]
    assert jaccard_join.shared_counts(sets).tolist() == expect and jaccard_join.shared_counts(sets[:2], sets[2:]).tolist() == [r[2:] for r in expect[:2]]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- fingerprints --------------------------------------------------------------------------

def test_edited_texts_and_likeness(spark):
    rows = families(2)[:40] + [(1000, None), (1001, ""), (1002, "é ü ß")]
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        text, half = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - half] + texts[following[i]][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        # Every kept hash but the smallest lies below the threshold.
        kept = [int(h, 16) - (1 << 64 if int(h, 16) >> 63 else 0) for h in r.fingerprint.split()]
        assert kept == sorted(set(kept)) and all(h < -(1 << 63) + (1 << 64) // fingerprints.SHARE for h in kept[1:])
    by_text = defaultdict(set)
    for i, r in got.items():
        by_text[texts[i]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_sketch_estimates_containment(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    whole, part = " ".join(words), " ".join(words[:1500])
    df = spark.createDataFrame([(whole, part)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(F.size("a").alias("n"), fingerprints.likeness(F.col("a"), F.col("b")).alias("in_whole"), (fingerprints.merged(F.col("a"), F.col("b")) == F.col("a")).alias("same")).first()
    assert abs(r.n - 6000 / fingerprints.SHARE) < 150 and r.in_whole > 0.99 and r.same


def test_fingerprints_of_edges(spark):
    got = fingerprints.compare_edited(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and {r.fingerprint for r in got if r.doc_id < 4} == {""}
    assert fingerprints.compare_edited(docs(spark, EDGES).limit(0)).collect() == []
    plan = fingerprints.compare_edited(docs(spark, EDGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- packing -------------------------------------------------------------------------------

def test_every_id_is_packed_once(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BATCH_BYTES", 500)
    rows = EDGES + families(3)[:30] + [(90, "<|endoftext|> it's I'LL á x́ ... a.,b. ΑΣ. <|ENDOFTEXT|>")]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in rows}
    got = packing.pack_documents(docs(spark, rows), tokenizer_path(), 64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    times = {i: sum(j == i for j, _ in rows) for i in ids}
    for i, x in ids.items():
        at = sorted((r.start, r.length) for r in by_doc[i])
        covered = [p for s, n in at for p in range(s, s + n)]
        assert sorted(covered) == sorted(list(range(len(x))) * times[i])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))] and sum(r.length for r in pieces) <= 64
    total = sum(r.length for r in got)
    assert len(by_sequence) <= total / 64 * 1.05 + 1
    assert packing.pack_documents(docs(spark, rows).limit(0), tokenizer_path()).collect() == []


def test_few_encodings_are_held_at_once():
    word_ids = packing.WordIds(tokenizer_path())
    encode, calls = word_ids.encode, []
    word_ids.encode = lambda texts, **kw: calls.append((len(texts), max(len(t.split()) for t in texts))) or encode(texts, **kw)
    words = [f"w{i:x}" for i in range(3 * packing.AT_ONCE)]
    ids, sizes = word_ids([" ".join(words), "w1 w2"])
    assert len(calls) >= 3 and all(n == 1 and size < 2 * packing.AT_ONCE for n, size in calls)
    want = [e.ids for e in encode([" ".join(words), "w1 w2"], add_special_tokens=False)]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_common_words_stay_when_rare_ones_are_forgotten():
    word_ids = packing.WordIds(tokenizer_path(), 50)
    encode, learn, learned = word_ids.encode, word_ids.learn, []
    word_ids.learn = lambda words: learned.extend(words) or learn(words)
    common = [f"Common{i}," for i in range(20)]
    for k in range(30):
        text = " ".join([*common, *(f"rare{k}x{i} a~b{k}{i}..." for i in range(10)), "<|endoftext|>"])
        ids, sizes = word_ids([text, ""])
        assert ids.tolist() == encode([text], add_special_tokens=False)[0].ids and sizes.tolist() == [len(ids), 0]
        assert len(word_ids.index) <= 50 + 41 and len(word_ids.stems) <= 2 * len(word_ids.index) + 1
    # Common words are learned once and not each time that rare ones are forgotten.
    assert all(learned.count(w.encode()) == 1 for w in common)


def test_workers_forget_words_when_no_task_follows(spark, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_SECONDS", 0.5, raising=False)
    path, table = tokenizer_path(), docs(spark, EDGES).select("doc_id", "text")

    def state(batches):
        import pyarrow as pa

        kept = sys.modules.get("_kept_word_ids")
        for batch in batches:
            flags = [pa.array([kept is not None]), pa.array([path in vars(kept or sys)])]
            yield pa.RecordBatch.from_arrays(flags, ["used", "holds"])

    def states():
        return table.mapInArrow(state, "used boolean, holds boolean").collect()

    first = packing.token_pieces(table, path).count()
    time.sleep(3)
    assert any(r.used for r in states()) and not any(r.holds for r in states())
    assert packing.token_pieces(table, path).count() == first


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    for capacity in (1, 7, 8, 100):
        lengths = np.sort(rng.integers(1, capacity + 1, 300))[::-1]
        window, offset = packing.best_fit(lengths, capacity)
        rooms: list[int] = []
        for n, w, o in zip(lengths, window, offset):
            fitting = [r for r in rooms if r >= n]
            if not fitting:
                rooms.append(capacity)
                fitting = [capacity]
            assert rooms[w] == min(fitting) and o == capacity - rooms[w]
            rooms[w] -= n


# ---- embeddings ----------------------------------------------------------------------------

def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (1, 1, 2):
        for _ in range(60):
            v = rng.normal(size=16)
            for _ in range(rng.choice([1, 1, 2, 30])):
                rows.append((i, (v + rng.normal(size=16) * 0.04).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i + k, rows[0][1], 1) for k in range(20)] + [(i + 30, rows[0][1], 2), (i + 31, rows[0][1], None), (i + 32, None, 1), (i + 33, [0.0] * 16, 1)]
    rows += [(i + 34, [float("nan")] * 16, 1), (i + 35, [None] * 16, 1), (i + 36, [float("inf")] * 16, 1), (i + 37, [1.0, 2.0], 1), (i + 38, [2.0, 4.0], 1), (0, rows[0][1], 1)]
    return rows


@pytest.mark.parametrize("tile", [1024, 8])
def test_vector_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    monkeypatch.setattr(vector_dedup, "BLOCK", 100)
    rows = vectors()
    ok = [v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v) for _, v, label in rows]
    near, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    near.append((rows[a][0], rows[b][0]))
                    n[a] += 1
                    n[b] += 1
    root = least_root({r[0] for r in rows}, near)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("rep", "weight", "root", "code", "turn", "dim", "h")})
    got = vector_dedup.deduplicate(df).collect()
    assert len(got) == len(rows) and len(near) > 1000
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((r[0], k, root[r[0]], root[r[0]] == r[0]) for r, k in zip(rows, n))
    assert vector_dedup.deduplicate(df.limit(0)).collect() == []


@pytest.mark.parametrize("topics", [1, 5])
def test_vectors_that_share_a_direction_are_found(spark, topics):
    """Background cosine 0.9 within each topic of one label, every pair planted at the threshold, against brute force."""
    rng = np.random.default_rng(topics)
    one = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, pairs, dim = 12_000, 300, 64
    base = one(rng.normal(size=(topics, dim)))[rng.integers(0, topics, n)]
    x = one(math.sqrt(0.9) * base + math.sqrt(0.1) * one(rng.normal(size=(n, dim))))
    aside = rng.normal(size=(pairs, dim))
    aside = one(aside - (aside * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    x = np.concatenate([x, 0.983 * x[:pairs] + math.sqrt(1 - 0.983**2) * aside]).astype(np.float32)
    y = one(x.astype(np.float64))
    near = np.argwhere(np.triu(y @ y.T >= 0.98, 1))
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[j].tolist(), 1) for i, j in enumerate(order)], "vec_id long, embedding array<float>, label int")
    got = {int(order[r.vec_id]): r.component_id for r in vector_dedup.deduplicate(df).collect()}
    assert len(got) == len(x) and len(near) >= pairs
    found = sum(got[a] == got[b] for a, b in near.tolist())
    assert found >= 0.985 * len(near), (found, len(near))


# ---- pipeline ------------------------------------------------------------------------------

def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x") for i, t in families(5) + EDGES] + [(2000, "call +1 (980) 555-6268", "en", None, 22, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 0) for r in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, str(tmp_path)))
        assert after.columns == before.columns
        kept, had = {r.doc_id for r in after.collect()}, {r.doc_id for r in before.collect()}
        assert kept <= had and (name != "pseudonyms" or after.count() == before.count()) and (name != "toxicity" or kept == had)
        if name == "jaccard_join":
            ids, texts = zip(*[(r[0], r[1]) for r in rows])
            sets = {i: shingles(t, 5) for i, t in zip(ids, texts)}
            root = least_root(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
            assert kept == {i for i in ids if root[i] == i}
        if name == "pseudonyms":
            assert all(r.n_chars == len(r.text) and "555-6268" not in r.text for r in after.collect() if r.text)
        before = after
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] > 0


def test_functions_run_from_another_folder(tmp_path):
    """Workers get the code with the function, not from an installed package."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from alphaweave.session import local_session
from alphaweave.llm import katz, language_id
spark = local_session(2)
df = spark.createDataFrame([(1, "a b", "x"), (2, "c d", "y"), (3, "a c", "x")], "doc_id long, text string, lang string")
print("rows", len(language_id.identify(df).collect()) + len(katz.score(df).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 6" in done.stdout, done.stderr[-2000:]
