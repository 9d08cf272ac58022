"""Near duplicates among embeddings by sorted projection passes.

In each pass every vector, less the mean of its label, gets the signs of its products with random directions as one
number, and all vectors are put in the order of (label, number): vectors at a small angle share their first signs and come
close together. Neighbours up to `REACH` places apart are compared exactly, as they were given.

After `PILOT` passes each vector has a measured depth: the signs after which fewer than `REACH` vectors share its number
with it. That and the angle at which a pair at the threshold is seen from the label's mean give the chance of meeting in
one pass; the vector takes part in as many passes as make a pair meet with probability `MEET`. Where so many passes
compare more than the whole label would, the vector is compared with the whole label in tiles. Pairs of all passes join into
groups. A place whose neighbours half a reach away are linked to it does not count as deep: it is inside a group.

A group's links are then counted exactly, all against all in tiles of `TILE` vectors: the reach bounds the search, never
the number of links. Equal vectors are one vector with a weight throughout, so a group of exact copies costs one row.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with
nothing. Vectors of different length do not link. Repeated rows count as vectors of their own with the same id. An empty
table gives no rows; columns besides vec_id, embedding and label are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaweave.session import materialize

from .common import small
from .components import components

COSINE = 0.98
REACH = 64
MEET = 0.995
#: Passes of every vector, in which depths are measured.
PILOT = 4
BITS = 48
BLOCK = 1024
TILE = 1024


def passes_needed(p: pd.Series | float, meet: float = MEET):
    """Passes, a power of two, after which a pair that meets in one with probability p has met with probability `meet`."""
    n = np.log(1 - meet) / np.log1p(-np.clip(p, 1e-9, 1 - 1e-9))
    return 2 ** np.ceil(np.log2(np.maximum(1, n)))


def same_sign(radius, cosine: float = COSINE):
    """Chance that a random plane through the mean leaves a pair at the threshold on one side, at this distance from it."""
    half = math.sqrt((1 - cosine) / 2)
    return 1 - 2 * np.arcsin(np.minimum(1.0, half / np.maximum(radius, 1e-12))) / math.pi


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def label_means(classes: DataFrame) -> DataFrame:
    """label, dim and mean of the unit vectors."""

    def sums(batches):
        for pdf in batches:
            for (label, dim), rows in pdf.groupby(["label", "dim"]):
                x = unit(rows["embedding"])
                yield pd.DataFrame({"label": [label], "dim": [dim], "n": [len(x)], "x": [x.sum(axis=0)]})

    parts = classes.select("label", "dim", "embedding").mapInPandas(sums, "label string, dim int, n long, x array<double>")
    cells = parts.select("label", "dim", "n", F.posexplode("x").alias("at", "x")).groupBy("label", "dim", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    return cells.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("mean"))


def coded(classes: DataFrame, first: int, seed: int) -> DataFrame:
    """Each class (with its label's mean) once per pass from `first` to below its `passes`, with the number of its signs."""

    def signs(batches):
        for pdf in batches:
            for dim, rows in pdf.groupby("dim"):
                x = unit(rows["embedding"]) - np.stack(rows["mean"])
                radius, passes = np.sqrt((x * x).sum(axis=1)), rows["passes"].to_numpy()
                kept = rows[["rep", "label", "dim", "embedding"]].assign(radius=radius)
                for p in range(first, int(passes.max())):
                    own = passes > p
                    directions = np.random.default_rng([seed, int(dim), p]).standard_normal((int(dim), BITS))
                    numbers = (x[own] @ directions > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield kept[own].assign(turn=np.int32(p), code=numbers)

    return classes.select("rep", "label", "dim", "embedding", "mean", "passes").mapInPandas(signs, "rep long, label string, dim int, embedding array<float>, radius double, turn int, code long")


def in_blocks(ordered: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """`ordered` with `place`, its position in the order of `keys`, dealt into blocks that overlap by the reach."""
    ranged = materialize(ordered.repartitionByRange(slices, *keys).withColumn("slice", F.spark_partition_id()))
    # One row per slice.
    before = ranged.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("slice")) - F.col("n")).drop("n")
    at = F.row_number().over(Window.partitionBy("slice").orderBy(*keys)) - 1
    placed = ranged.withColumn("at", at).join(F.broadcast(before), "slice").withColumn("place", F.col("before") + F.col("at")).drop("slice", "at", "before")
    block = F.floor(F.col("place") / BLOCK)
    also = F.when((F.col("place") % BLOCK < REACH) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    return placed.withColumn("block", F.explode(also))


def near_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Stars (least member a, member b) of what is linked within reach; and for each member a its depth in a turn."""
    out = []
    for (turn, _, _), run in rows.groupby(["turn", "label", "dim"], sort=False):
        run = run.sort_values("place")
        if len(run) < 2:
            continue
        x, root = unit(run["embedding"]), np.arange(len(run))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for o in range(1, min(REACH, len(run) - 1) + 1):
            for i in np.flatnonzero(np.einsum("ij,ij->i", x[:-o], x[o:]) >= COSINE):
                a, b = top(i), top(i + o)
                root[max(a, b)] = min(a, b)
        tops = np.array([top(i) for i in range(len(run))])
        rep = run["rep"].to_numpy()
        if (linked := tops != np.arange(len(run))).any():
            out.append(pd.DataFrame({"a": rep[tops[linked]], "b": rep[linked]}))
        if len(run) > (h := REACH // 2):
            code = run["code"].to_numpy()
            # Leading signs that both ends of half a reach share, and one more.
            shared = np.where(np.einsum("ij,ij->i", x[:-h], x[h:]) >= COSINE, 0, BITS - np.frexp((code[:-h] ^ code[h:]).astype(np.float64))[1] + 1)
            depth = np.zeros(len(run), np.int64)
            depth[:-h] = shared
            depth[h:] = np.maximum(depth[h:], shared)
            out.append(pd.DataFrame({"a": rep, "turn": turn, "depth": depth})[depth > 0])
    return pd.concat(out).reindex(columns=["a", "b", "turn", "depth"]).astype("Int64") if out else pd.DataFrame(columns=["a", "b", "turn", "depth"], dtype="Int64")


def near_in_cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Stars of what is linked between the hard vectors of a cell and its others."""
    hard, other = rows[rows["hard"]], rows[~rows["hard"]]
    near = unit(hard["embedding"]) @ unit(other["embedding"]).T >= COSINE if len(hard) and len(other) else np.zeros((0, 0), bool)
    if not near.any():
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    a, b = hard["rep"].to_numpy(), other["rep"].to_numpy()
    far, top = np.iinfo(np.int64).max, a
    while True:
        left = np.where(near, top[:, None], far).min(axis=0)
        left = np.minimum(left, np.where(left < far, b, far))
        new = np.minimum(top, np.where(near, left[None, :], far).min(axis=1))
        if (new == top).all():
            break
        top = new
    linked = left < far
    return pd.DataFrame({"a": np.concatenate([top, left[linked]]), "b": np.concatenate([a, b[linked]])})


def with_whole_label(needed: DataFrame) -> DataFrame:
    """Links of the `hard` classes with all classes of their label and length, in tiles."""
    sizes = materialize(needed.groupBy("label", "dim").agg(F.ceil(F.sum(F.col("hard").cast("int")) / TILE).cast("int").alias("across"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("down")).where("across > 0"))
    tile = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = needed.select("label", "dim", "rep", "embedding", "hard").join(small(sizes), ["label", "dim"])
    own = sized.where("hard").select("label", "dim", "rep", "embedding", "hard", tile("across").alias("i"), every("down").alias("j"))
    all_ = sized.select("label", "dim", "rep", "embedding", F.lit(False).alias("hard"), tile("down").alias("j"), every("across").alias("i"))
    return own.unionByName(all_).groupBy("label", "dim", "i", "j").applyInPandas(near_in_cell, "a long, b long")


def links_in_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Linked weight of each class within its group, between the two tiles of a pair or within one."""
    out = []
    for _, group in rows.groupby("root", sort=False):
        x, weight = unit(group["embedding"]), group["weight"].to_numpy()
        near = x @ x.T >= COSINE
        tile = group["tile"].to_numpy()
        if len(set(tile)) > 1:
            near &= tile[:, None] != tile[None, :]
        np.fill_diagonal(near, False)
        out.append(pd.DataFrame({"rep": group["rep"].to_numpy(), "linked": near @ weight}))
    return pd.concat(out)


def count_links(members: DataFrame) -> DataFrame:
    """rep and linked, the weight of all classes linked directly, for members (rep, root, embedding, weight)."""
    sizes = materialize(members.groupBy("root").agg(F.count(F.lit(1)).alias("k")))
    n = members.count()
    tiles = F.ceil(F.col("k") / TILE).cast("int")
    sized = members.join(small(sizes), "root").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # A large group is dealt to every pair of its tiles; small ones share tasks.
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least(u, "tile").alias("t"), F.greatest(u, "tile").alias("u")))
    single = sized.where("tiles = 1").withColumn("deal", F.struct(F.pmod(F.xxhash64("root"), F.lit(max(1, n // TILE))).alias("r"), F.lit(-1).alias("t"), F.lit(-1).alias("u")))
    large = sized.where("tiles > 1").withColumn("pair", F.explode(pairs)).withColumn("deal", F.struct(F.col("root").alias("r"), F.col("pair.t").alias("t"), F.col("pair.u").alias("u"))).drop("pair")
    dealt = single.unionByName(large).select(F.col("deal.r").alias("r"), F.col("deal.t").alias("t"), F.col("deal.u").alias("u"), "rep", "root", "embedding", "weight", "tile")
    return dealt.groupBy("r", "t", "u").applyInPandas(links_in_tile, "rep long, linked long").groupBy("rep").agg(F.sum("linked").alias("linked"))


def passes_of(centred: DataFrame, pilot: DataFrame) -> DataFrame:
    """rep, passes and hard (cheaper compared with the whole label) of every class, from the depths in the pilot passes."""

    @F.pandas_udf("double")
    def met_once(embedding: pd.Series, mean: pd.Series, depths: pd.Series) -> pd.Series:
        out = np.ones(len(embedding))
        for i, (e, m, d) in enumerate(zip(embedding, mean, depths)):
            if d is not None and len(d):
                x = unit([e])[0] - np.asarray(m)
                # Passes without a depth had few neighbours: a pair surely met.
                out[i] = ((same_sign(math.sqrt(x @ x)) ** np.asarray(d, float)).sum() + PILOT - len(d)) / PILOT
        return pd.Series(out)

    @F.pandas_udf("long")
    def passes(p: pd.Series) -> pd.Series:
        return passes_needed(p).astype("int64")

    deep = pilot.where(F.col("depth").isNotNull()).groupBy("a", "turn").agg(F.max("depth").alias("depth")).groupBy(F.col("a").alias("rep")).agg(F.collect_list("depth").alias("depths"))
    rated = centred.join(deep, "rep", "left").select("rep", "label", "dim", passes(met_once("embedding", "mean", "depths")).alias("passes"))
    sizes = centred.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    hard = (F.col("passes") > PILOT) & (F.col("passes") * REACH >= F.col("n"))
    return rated.join(small(materialize(sizes)), ["label", "dim"]).select("rep", hard.alias("hard"), "passes")


def deduplicate(vectors: DataFrame, seed: int = 9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    e = F.when(usable, F.col("embedding").cast("array<float>"))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), e.alias("embedding")).withColumn("h", F.when(F.col("embedding").isNotNull(), F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(1), "embedding").alias("y"))))
    key = ["label", "h"]
    classes = materialize(
        rows.where(F.col("h").isNotNull()).groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    )
    n = classes.count()
    slices = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["turn", "label", "dim", "code", "rep"]
    means = materialize(label_means(classes))
    centred = classes.join(small(means), ["label", "dim"])
    met = lambda table: in_blocks(table, order, slices).groupBy("block").applyInPandas(near_in_block, "a long, b long, turn int, depth int")
    pilot = materialize(met(coded(centred.withColumn("passes", F.lit(PILOT)), 0, seed)))
    needed = materialize(passes_of(centred, pilot))
    links = pilot.where(F.col("b").isNotNull()).select("a", "b")
    more = needed.where(f"NOT hard AND passes > {PILOT}").select("rep", "passes")
    if more.head(1):
        further = materialize(met(coded(centred.join(small(more), "rep"), PILOT, seed)))
        links = links.unionByName(further.where(F.col("b").isNotNull()).select("a", "b"))
    if needed.where("hard").head(1):
        links = links.unionByName(with_whole_label(classes.join(small(needed.select("rep", "hard")), "rep")))
    groups = materialize(components(links))
    members = materialize(classes.join(small(groups), F.col("rep") == F.col("node")).select("rep", "root", "embedding", "weight"))
    linked = count_links(members)
    told = materialize(classes.select(*key, "rep", "weight").join(groups, F.col("rep") == F.col("node"), "left").join(linked, "rep", "left").select(*key, (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    out = rows.select("vec_id", *key).join(small(told, n), key, "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
