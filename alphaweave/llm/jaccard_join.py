"""Exact Jaccard self-join of documents on word shingles, by pivots in the metric space of sets.

Two sets of Jaccard similarity t or more share one of the first `n - ceil(t n) + 1` shingles of each in any common order
(order: shingles found in few documents first, by powers of two, then long ones, then by hash). Documents that share such shingles, directly
or through others, form a region; no link leaves it. A region of up to `LEAF` documents is joined in one task, all its
sets against each other. A larger one is first measured against about `PIVOTS` pivots; the distance 1 - J obeys the
triangle inequality, so with radius r = 1 - t

* members within r of a pivot are linked to it and so with each other; they form its cell, those in no ball one more;
* members of the region's largest component so far need no comparison with each other;
* every other member may link into a pivot's cell only if it is within 2 r of the pivot: it is replicated to those cells,
  and to the cell of those in no ball, and measured there against all.

Cells are dealt in tiles of bounded size. So a group of thousands of near copies costs some comparisons per copy, and no
link is lost. Exact copies (equal sets) are one document throughout.

Defined results: null texts and texts without words have no shingles and link with nothing. Rows that repeat a doc_id
count as one document that links by any of its texts. An empty table gives no rows. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaweave.session import materialize

from .common import BATCH, BATCH_BYTES as SENT_BYTES, discard, settings, small, stored
from .components import components

SHINGLE, PERCENT = 5, 80
#: Documents that one task joins directly, and that meet pivots in one task; about so many pivots of a region.
LEAF, TILE, PIVOTS = 256, 256, 16
#: Bytes of text whose words are hashed at once.
BATCH_BYTES = 2 << 20


def prefix_length(n, percent: int):
    """Shingles of a set of n of which one is shared with every set that is similar enough. Works on columns and numbers."""
    floor = F.floor if isinstance(n, Column) else int
    return n - floor((n * percent + 99) / 100) + 1


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text as 63-bit numbers: the longer a shingle's words, the smaller its number."""
    import xxhash

    split = [t.encode().lower().split() for t in texts]
    words = [w for x in split for w in x]
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    factors = np.random.default_rng(k).integers(1 << 62, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out, at = [], 0
    for x in split:
        h, size = hashed[at : at + len(x)], length[at : at + len(x)]
        at += len(x)
        n = len(x) - k + 1
        if n < 1:  # the whole sequence, told apart from any full shingle
            mixed = (h * factors[: len(x)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(x) + 1) if len(x) else h
            total = size.sum(keepdims=True) if len(x) else size
        else:
            mixed, total = np.zeros(n, np.uint64), np.zeros(n, np.int64)
            for j in range(k):
                mixed += h[j : j + n] * factors[j]
                total += size[j : j + n]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        rank = (63 - np.minimum(63, total)).astype(np.uint64)
        out.append(np.unique(((rank << np.uint64(57)) | (mixed >> np.uint64(7))).view(np.int64)))
    return out


def _in_batches(batch, k: int):
    """(row numbers, sets) of bounded portions of a batch whose last column is the text."""
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch.column(batch.num_columns - 1)):
        text = text.as_py() or ""
        rows.append(i)
        texts.append(text)
        size += len(text)
        if size > BATCH_BYTES:
            yield rows, shingle_sets(texts, k)
            rows, texts, size = [], [], 0
    if rows:
        yield rows, shingle_sets(texts, k)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def heads(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, set size n, a 128-bit digest of the set (h1, h2), and its first shingles, a few more than the prefix."""

    def cut(batches):
        import xxhash

        for batch in batches:
            for rows, sets in _in_batches(batch, k):
                digest = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                first = [s[: (p := prefix_length(len(s), percent)) + p // 4 + 4] for s in sets]
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), n, pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), _lists(first)], ["doc_id", "n", "h1", "h2", "head"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, n long, h1 long, h2 long, head array<long>")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """`docs` with `shingles`, the whole sorted set, in place of the text."""
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def cut(batches):
        for batch in batches:
            for rows, sets in _in_batches(batch, k):
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:-1]), _lists(sets)], [*others, "shingles"])

    return docs.select(*others, "text").mapInArrow(cut, f"{schema}, shingles array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of `left` with all of `right` (or of `left`), by products of 0-1 matrices."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, at, times = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    column = place[at]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right) if right is not None else len(left)))
    step = 4096
    for start in range(0, len(common), step):
        s, e = np.searchsorted(column, (start, start + step))
        x = np.zeros((len(sets), min(step, len(common) - start)), np.float32)
        x[owner[s:e], column[s:e] - start] = 1
        out += x[: len(left)] @ (x[len(left) :] if right is not None else x).T
    if right is None:
        np.fill_diagonal(out, [len(x) for x in left])
    return out.astype(np.int64)


def _sets_of(table: pa.Table, k: int) -> list[np.ndarray]:
    out, texts, size = [], [], 0
    for text in table["text"]:
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size > BATCH_BYTES:
            out += shingle_sets(texts, k)
            texts, size = [], 0
    return out + shingle_sets(texts, k)


def _united(left: list[np.ndarray], right: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    return np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - shared


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class Join:
    """The join of one table: what is stored of it, and the links found so far."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        written = stored(heads(docs, k, percent))
        self.classes = materialize(written.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
        self.n_classes = self.classes.count()
        # First shingles are read several times, and only those of the least document of equal sets.
        first = written.join(small(self.classes.select("h1", "h2", "rep"), self.n_classes), ["h1", "h2"]).where("doc_id = rep")
        self.first = stored(first.select("rep", "n", "head"))
        self.heads = stored(written.drop("head"))
        discard(written)

    def texts_of(self, rows: DataFrame) -> DataFrame:
        """`rows` (rep and others) with the texts."""
        return self.docs.join(small(rows), F.col("doc_id") == F.col("rep")).drop("doc_id")

    def leaves(self, members: DataFrame) -> DataFrame:
        """Links (a, b) that connect what is connected within each region (region, rep); small regions share tasks."""
        k, percent = self.k, self.percent
        tasks = max(1, members.count() // LEAF)

        def joined(table: pa.Table) -> pa.Table:
            region, rep = table["region"].to_numpy(), table["rep"].to_numpy()
            sets = _sets_of(table.select(["text"]), k)
            a, b = [], []
            for r in np.unique(region):
                at = np.flatnonzero(region == r)
                own = [sets[i] for i in at]
                shared = shared_counts(own)
                near = 100 * shared >= percent * _united(own, own, shared)
                root = np.arange(len(at))
                while True:  # each takes the least root among its neighbours
                    least = np.where(near, root[None, :], len(at)).min(axis=1)
                    least = np.minimum(root, least)
                    if (least == root).all():
                        break
                    root = least[least]
                linked = root != np.arange(len(at))
                a.append(rep[at[root[linked]]])
                b.append(rep[at[linked]])
            return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

        dealt = materialize(members.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks))))
        return self.texts_of(dealt).groupBy("task").applyInArrow(joined, "a long, b long")

    def measured(self, rows: DataFrame, least_percent: int) -> DataFrame:
        """(region, rep, pivot, link) of the members and pivots (region, cell, tile, batch, rep, is_pivot) that meet in a
        task and are similar to at least so many per cent."""
        k, percent = self.k, self.percent

        def meet(table: pa.Table) -> pa.Table:
            region, rep, is_pivot = table["region"][0].as_py(), table["rep"].to_numpy(), table["is_pivot"].to_numpy(zero_copy_only=False)
            sets = _sets_of(table.select(["text"]), k)
            left, right = [s for s, p in zip(sets, is_pivot) if not p], [s for s, p in zip(sets, is_pivot) if p]
            shared = shared_counts(left, right)
            united = _united(left, right, shared)
            i, j = np.nonzero(100 * shared >= least_percent * united)
            link = (100 * shared >= percent * united)[i, j]
            return pa.table({"region": pa.array(np.full(len(i), region), pa.int64()), "rep": pa.array(rep[~is_pivot][i], pa.int64()), "pivot": pa.array(rep[is_pivot][j], pa.int64()), "link": pa.array(link, pa.bool_())})

        dealt = materialize(rows.select("region", "cell", "tile", "batch", "rep", "is_pivot"))
        return materialize(self.texts_of(dealt).groupBy("region", "cell", "tile", "batch").applyInArrow(meet, "region long, rep long, pivot long, link boolean"))

    def split(self, members: DataFrame) -> DataFrame:
        """Links (a, b) of the members (region, rep, c) of large regions that connect what is connected."""
        nth = lambda by, size: F.pmod(F.xxhash64(F.lit(by), "rep"), size).cast("int")
        every = lambda size: F.explode(F.sequence(F.lit(0), size - 1))
        # About so many pivots a region, chosen by hash; its least member is one for certain.
        chosen = members.where(F.pmod(F.xxhash64("region", "rep"), F.col("c")) < PIVOTS).select("region", "rep", "c")
        pivots = materialize(chosen.unionByName(members.groupBy("region", "c").agg(F.min("rep").alias("rep")).select("region", "rep", "c")).distinct())
        tiles = F.ceil(F.col("c") / TILE).cast("int")
        one = [F.lit(0).alias("cell"), F.lit(0).alias("batch")]
        rows = members.select("region", "rep", *one, nth("tile", tiles).alias("tile"), F.lit(False).alias("is_pivot"))
        near = self.measured(rows.unionByName(pivots.select("region", "rep", *one, every(tiles).alias("tile"), F.lit(True).alias("is_pivot"))), max(0, 2 * self.percent - 100))
        first = materialize(near.where("link AND rep <> pivot").select(*_ordered(F.col("rep"), F.col("pivot"))).distinct())
        # Two members of a region's largest component need no comparison. Who is in no such is met by all others that may link.
        roots = materialize(components(first))
        rooted = materialize(members.join(small(roots), F.col("rep") == F.col("node"), "left").select("region", "rep", F.coalesce("root", "rep").alias("root")))
        largest = rooted.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.max(F.struct("n", F.col("root").alias("most"))).alias("x")).select("region", F.col("x.most").alias("most"))
        apart = materialize(rooted.join(small(materialize(largest)), "region").where("root <> most").select("region", "rep"))
        ball = near.where("link").groupBy("region", "rep").agg(F.min("pivot").alias("cell"))
        cells = members.select("region", "rep").join(ball, ["region", "rep"], "left").select("region", "rep", F.coalesce("cell", F.lit(-1)).alias("cell"))
        # By the triangle inequality a link into the ball of a pivot comes from within 2 r of it.
        windows = apart.join(near.select("region", "rep", F.col("pivot").alias("cell")), ["region", "rep"]).unionByName(apart.withColumn("cell", F.lit(-1).cast("long"))).distinct()
        cells, windows = materialize(cells), materialize(windows)
        n_tiles = cells.groupBy("region", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
        n_batches = windows.groupBy("region", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("batches"))
        size = materialize(n_tiles.join(n_batches, ["region", "cell"]))
        key = ["region", "cell"]
        met = cells.join(small(size), key).select(*key, "rep", nth("tile", F.col("tiles")).alias("tile"), every(F.col("batches")).alias("batch"), F.lit(False).alias("is_pivot"))
        comers = windows.join(small(size), key).select(*key, "rep", every(F.col("tiles")).alias("tile"), nth("batch", F.col("batches")).alias("batch"), F.lit(True).alias("is_pivot"))
        rest = self.measured(met.unionByName(comers), self.percent).where("rep <> pivot").select(*_ordered(F.col("rep"), F.col("pivot")))
        return first.unionByName(rest)

    def fit(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes allow a link."""
        size = small(materialize(self.classes.groupBy("rep").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))), self.n_classes)
        for side in "ab":
            pairs = pairs.join(size.select(F.col("rep").alias(side), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}")), side)
        allowed = (F.lit(100) * F.col("hi_a") >= F.lit(self.percent) * F.col("lo_b")) & (F.lit(100) * F.col("hi_b") >= F.lit(self.percent) * F.col("lo_a"))
        return pairs.where(allowed).select("a", "b")

    def candidates(self) -> DataFrame:
        """Pairs (a, b) that tie every document to all it may link with, directly or through others."""
        first = self.first
        placed = first.select("rep", F.explode("head").alias("s"))
        shared = materialize(placed.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("c > 1"))
        twice = shared.where("c = 2").select(*_ordered(F.col("lo"), F.col("hi")))
        # Shingles of three documents and more come last, by the power of two of their number, so that what a family of
        # copies shares goes before passages of half the corpus. Who has too many of them needs the whole set.
        frequent = shared.where("c > 2").select("s", F.floor(F.log2(F.col("c").cast("double"))).alias("power"))
        n_frequent = frequent.count()
        hits = placed.join(small(frequent, n_frequent), "s").groupBy("rep").agg(F.count(F.lit(1)).alias("f"))
        p = prefix_length(F.col("n"), self.percent)
        lacking = materialize(first.select("rep", p.alias("p"), F.size("head").alias("size")).join(hits, "rep").where("size - f < p").groupBy("rep").agg(F.max("p").alias("p"), F.max("size").alias("size")))
        whole = stored(whole_sets(self.docs.select(F.col("doc_id").alias("rep"), "text").join(small(lacking), "rep").select("rep", "p", "size", "text"), self.k))
        common = whole.select("rep", F.explode("shingles").alias("s")).join(small(frequent, n_frequent), "s").groupBy("rep").agg(F.collect_set(F.struct("power", "s")).alias("common"))
        none = F.array().cast("array<struct<power:bigint,s:bigint>>")
        late = F.transform(F.array_sort(F.coalesce("common", none)), lambda x: x["s"])
        # Not broadcast: a row holds a whole list, some 4 kB where a row of numbers takes some 100 bytes.
        own = whole.join(common, "rep", "left").select("rep", F.element_at("shingles", F.least(F.col("size"), F.size("shingles"))).alias("edge"), F.slice(F.array_except("shingles", late), F.lit(1), F.col("p").cast("int")).alias("rare"), F.col("p").cast("int").alias("p"), F.array_intersect(late, "shingles").alias("late"))
        filled = own.select("rep", "edge", F.col("rare"), F.slice("late", F.lit(1), F.greatest(F.lit(0), F.col("p") - F.size("rare"))).alias("late"))
        prefixes = stored(filled)
        beyond = prefixes.select(F.col("rep").alias("other"), F.explode(F.filter("rare", lambda s: s > F.col("edge"))).alias("s"))
        reached = beyond.join(placed, "s").select(*_ordered(F.col("rep"), F.col("other")))
        posted = prefixes.select("rep", F.explode(F.concat("rare", "late")).alias("s"))
        lists = posted.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("pivot")).where("c > 1")
        starred = posted.join(lists, "s").select("c", *_ordered(F.col("rep"), F.col("pivot"))).where("a < b").groupBy("a", "b").agg(F.max("c").alias("c"))
        starred = materialize(starred)
        alone = twice.unionByName(reached).unionByName(starred.where("c = 2").select("a", "b")).where("a < b").distinct()
        return self.fit(alone).unionByName(starred.where("c > 2").select("a", "b"))

    def run(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        regions = materialize(components(self.candidates()).select(F.col("root").alias("region"), F.col("node").alias("rep")))
        sizes = materialize(regions.groupBy("region").agg(F.count(F.lit(1)).alias("c")))
        members = materialize(regions.join(small(sizes), "region"))
        links = materialize(self.leaves(members.where(F.col("c") <= LEAF).select("region", "rep")))
        large = members.where(F.col("c") > LEAF)
        if not large.isEmpty():
            links = links.unionByName(materialize(self.split(large)))
        roots = materialize(components(links))
        told = self.classes.join(small(roots), F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id"))
        out = self.heads.select("doc_id", "n", "h1", "h2").join(small(told, self.n_classes), ["h1", "h2"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id: documents link at a Jaccard similarity of `percent` on `shingle`-word shingles."""
    with settings(docs.sparkSession, {BATCH: str(SENT_BYTES)}):
        return Join(docs.select("doc_id", "text"), shingle, percent).run()


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` without the rows of documents that are linked with one of a smaller doc_id, directly or by others."""
    gone = materialize(join(docs, shingle, percent).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
