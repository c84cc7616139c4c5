"""Operator 1: approximate nearest neighbours by inner product, with a hash-prefix forest.

A vector's hash string has a symbol for each of some random rotations: the axis that the
rotated vector lies closest to, and on which side. Each of `trees` trees is a sorted array of
such strings. A query descends in every tree to the prefixes that match it longest, its own
and those that differ in the symbols it was closest to next, and goes up or down in all
trees at once, to shorter prefixes where these hold too few rows and to longer ones where
they hold far too many. What the prefixes hold is scored exactly.

A tree is cut into chunks of about CHUNK rows at prefixes, and a prefix with more rows into
parts, to all of which its queries go: no chunk grows with the input, and every row of a
prefix that is reached is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import give_back, small_batches, table, written

#: Trees, symbols of a string, axes that a symbol tells apart, prefixes of one length that a query takes in a tree, at least and at most.
TREES, DEPTH, AXES, LEAST, PROBES = 32, 6, 32, 8, 256
#: Vectors, about, on whose mean the rotations are centred.
SAMPLE = 4096
#: Rows that a query's prefixes hold over all trees, at least, counting a row once a tree: FACTOR * rows ** POWER.
FACTOR, POWER = 10.0, 0.58
#: How far from what was planned the rows of a query's prefixes may be, as a factor.
SPREAD = 8
#: Rows of a chunk; trees of which the nearest prefix is searched first, for a bound on what may still be an answer.
CHUNK, FIRST = 8192, 8


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


class Hashes:
    """Hash strings of vectors and, for a query, the prefixes nearest to it.

    For inner products a vector gets one more component that makes all norms equal, a query's
    is 0: then what is nearest by distance is so by inner product. Both are centred on a
    sample's mean, which changes no distance.
    """

    def __init__(self, sample: np.ndarray, norm: float, trees: int = TREES, depth: int = DEPTH, axes: int = AXES):
        rng = np.random.default_rng(11)
        self.norm, self.trees, self.depth = norm, trees, depth
        dims = sample.shape[1] + 1
        self.axes = min(axes, dims)
        self.bits = (2 * self.axes - 1).bit_length()
        self.rotations = np.stack([np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, : self.axes] for _ in range(trees * depth)]).reshape(trees, depth, dims, self.axes)
        self.mean = self.lifted(sample).mean(axis=0)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(row, tree): strings of `depth` symbols, the first symbol in the highest bits."""
        y = self.lifted(x) - self.mean
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            for r in self.rotations[t]:
                z = y @ r
                axis = np.abs(z).argmax(axis=1)
                out[:, t] = (out[:, t] << self.bits) | (2 * axis + (z[np.arange(len(z)), axis] > 0))
        return out

    def probes(self, x: np.ndarray, length: int, most: int) -> np.ndarray:
        """(row, tree, place): the prefixes of `length` symbols nearest to each query, nearest first; a symbol's distance is the square of what its axis lacks to the best one."""
        y = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))] - self.mean
        out = np.zeros((len(x), self.trees, most), np.int64)
        rows = np.arange(len(x))[:, None]
        for t in range(self.trees):
            prefix, far = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for r in self.rotations[t][:length]:
                z = y @ r
                z = np.stack([-z, z], axis=2).reshape(len(x), -1)
                best = np.argsort(-z, axis=1, kind="stable")[:, : min(most, z.shape[1])]
                lacks = (z[rows, best[:, :1]] - z[rows, best]) ** 2
                prefix = ((prefix << self.bits)[:, :, None] | best[:, None, :]).reshape(len(x), -1)
                far = (far[:, :, None] + lacks[:, None, :]).reshape(len(x), -1)
                near = np.argsort(far, axis=1, kind="stable")[:, :most]
                prefix, far = prefix[rows, near], far[rows, near]
            out[:, t, : prefix.shape[1]] = prefix
            out[:, t, prefix.shape[1] :] = -1
        return out

    def plan(self, n: int, factor: float = FACTOR, power: float = POWER) -> tuple[int, int, int]:
        """(length, most, wanted): the shortest prefixes of which a query takes LEAST or more in a tree, and how many, so that they hold `wanted` rows of n evenly spread ones; length 0 is all rows."""
        wanted = int(factor * n**power)
        if wanted >= n:
            return 0, 1, wanted
        for length in range(1, self.depth + 1):
            most = wanted * float(2 * self.axes) ** length / (self.trees * n)
            if most >= LEAST:
                break
        return length, int(min(PROBES, np.ceil(most))), wanted


def packed(vectors: list, kind: str, dims: int) -> list[bytes]:
    return [x.tobytes() for x in filled(vectors, dims).astype(kind)]


def filled(vectors: list, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros at their end."""
    out = np.zeros((len(vectors), dims))
    for i, r in enumerate(vectors):
        out[i, : len(r)] = r
    return out


def nearest(rows: DataFrame, kind: str, k: int) -> DataFrame:
    """(cid, near, score) of chunks (tree, chunk, part) in which the indexed rows (side 0: key, cid, vec) come before the queries (side 1: cid, prefixes, low, vec).

    Each query is scored against the rows whose keys begin with one of its prefixes, given
    without the `shift` lowest bits; of these the k best, ties and a few more, are handed on
    if they reach `low`. A chunk's rows are held while its queries stream by.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, keys, ids, x = None, [], None, None, None
        for f in batches:
            group = f[["tree", "chunk", "part", "side"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1), True])
            found: list = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(group[a][:3])
                if here != at:
                    at, parts, x = here, [], None
                part = f.iloc[a:b]
                if not group[a][3]:
                    parts.append((part["key"].to_numpy(np.int64), part["cid"].to_numpy(np.int64), b"".join(part["vec"])))
                    continue
                if not parts:
                    continue
                if x is None:
                    keys, ids = (np.concatenate([p[i] for p in parts]) for i in range(2))
                    x = np.frombuffer(b"".join(p[2] for p in parts), kind).reshape(len(keys), -1).astype(float)
                    longest = np.sqrt(np.einsum("ij,ij->i", x, x).max())
                for cid, prefixes, low, shift, vec in zip(part["cid"], part["prefixes"], part["low"], part["shift"], part["vec"], strict=True):
                    p = np.asarray(prefixes, np.int64)
                    lo, hi = np.searchsorted(keys, p << shift), np.searchsorted(keys, ((p + 1) << shift) - 1, "right")
                    full = hi > lo
                    if not full.any():
                        continue
                    rows_ = np.concatenate([np.arange(i, j) for i, j in zip(lo[full], hi[full], strict=True)])
                    q = np.frombuffer(vec, kind).astype(float)
                    s = x[rows_] @ q
                    c = ids[rows_]
                    # the bound was summed in another order: rounding goes with the vectors' lengths
                    fit = (s >= low - 1e-6 - 1e-12 * longest * np.sqrt(q @ q)) & (c != cid)
                    s, c = s[fit], c[fit]
                    if len(s) > k + 4:
                        best = np.partition(s, len(s) - k - 4)[len(s) - k - 4]
                        take = np.flatnonzero(s >= best)
                        take = take[np.lexsort((c[take], -s[take]))][: k + 4]
                        s, c = s[take], c[take]
                    if len(s):
                        found.append((np.full(len(s), cid), c, s))
            if found:
                yield pd.DataFrame({"cid": np.concatenate([r[0] for r in found]), "near": np.concatenate([r[1] for r in found]), "score": np.concatenate([r[2] for r in found])})
        give_back()

    return rows.select("tree", "chunk", "part", "side", "key", "cid", "prefixes", "low", "shift", "vec").mapInPandas(run, "cid long, near long, score double")


def search(embeddings: DataFrame, queries: Column, k: int = 20, trees: int = TREES, factor: float = FACTOR, power: float = POWER) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `queries` holds.

    embeddings: vec_id, embedding; other columns are ignored. Nearness is the inner product
    in double precision; ties go to the smaller vec_id; a query's own id is no answer.
    Vectors that are null, zero or hold a null or non-finite component, and rows without
    a vec_id, take no part. Shorter vectors count as filled up with zeros. Of several vectors
    of one vec_id the first in the order of arrays counts, and the id is a query if one of
    its rows is. Equal vectors are indexed once and answer with their k + 1 smallest ids. No
    rows, or one, give no rows.

    A query whose prefixes hold SPREAD times as many rows as planned goes to longer ones, as
    long as they hold enough, and one whose prefixes hold a SPREADth of them to shorter ones.
    The nearest prefixes of the first trees are searched for a bound on the k-th best score;
    what is under it is not handed on.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    kind = "<f4" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    v = embeddings.select("vec_id", "embedding", queries.alias("query")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    v = v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("query").alias("query"))
    v = written(v.withColumn("place", F.hash("embedding")))
    place = ["place", "embedding"]
    reps = v.groupBy(*place).agg(F.min("vec_id").alias("cid"), F.max("query").alias("query"))
    rows = v.count()
    reps = written(reps.select("cid", "query", "embedding"), rows, 512)
    first = F.row_number().over(W.partitionBy(*place).orderBy("vec_id"))
    members = written(v.withColumn("i", first).where(F.col("i") <= k + 1).join(reps.select("cid", "embedding"), "embedding").select("cid", "vec_id"), rows)
    asked = v.where("query").join(reps.select("cid", "embedding"), "embedding").select("cid", F.col("vec_id").alias("query_id"))

    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, norm, dims = reps.agg(F.count("*"), F.max(F.sqrt(squares)), F.max(F.size("embedding"))).first()
    if not n:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    some = reps.where(F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < max(1, int(1e6 * SAMPLE / n))) if n > SAMPLE else reps
    sample = [r[0] for r in some.select("embedding").collect()] or [r[0] for r in reps.select("embedding").limit(1).collect()]
    hashes = Hashes(filled(sample, dims), norm, trees)
    length, most, wanted = hashes.plan(n, factor, power)
    chunks = -(-n // CHUNK)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for at in range(0, len(f), 2000):
                part = f.iloc[at : at + 2000]
                keys = hashes.keys(filled(list(part["embedding"]), dims))
                yield pd.DataFrame({"tree": np.tile(np.arange(trees), len(part)), "key": keys.ravel(), "cid": np.repeat(part["cid"].to_numpy(), trees)})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({"cid": f["cid"], "vec": packed(list(f["embedding"]), kind, dims)})

    index = written(reps.select("cid", "embedding").mapInPandas(strings, "tree int, key long, cid long"), n * trees, 24)
    packs = written(reps.select("cid", "embedding").mapInPandas(vectors, "cid long, vec binary"), n, 512)
    prefix = lambda d: F.shiftright("key", hashes.bits * (hashes.depth - d)) if d else F.lit(0).cast("long")
    rooted = lambda df, d: df if d else df.where("tree = 0")  # noqa: E731  all rows are found in one tree

    def taken(cids: DataFrame, d: int) -> DataFrame:
        """(cid, tree, j, prefix): the prefixes of d symbols that queries take, in each tree the nearest as number 0."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                for at in range(0, len(f), 200):
                    part = f.iloc[at : at + 200]
                    p = hashes.probes(filled(list(part["embedding"]), dims), d, most)
                    yield pd.DataFrame({"cid": np.repeat(part["cid"].to_numpy(), trees), "tree": np.tile(np.arange(trees), len(part)), "p": list(p.reshape(-1, p.shape[2]))})

        if not d:
            return cids.select("cid", F.lit(0).alias("tree"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("prefix"))
        own = reps.join(cids, "cid", "left_semi").select("cid", "embedding")
        return own.mapInPandas(run, "cid long, tree int, p array<long>").select("cid", "tree", F.posexplode("p").alias("j", "prefix")).where("prefix >= 0")

    def held(d: int) -> DataFrame:
        return rooted(index, d).groupBy("tree", prefix(d).alias("prefix")).agg(F.count("*").alias("n"))

    def sized(cids: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
        """The prefixes taken at d, and (cid, n): how many rows they hold."""
        t = written(taken(cids, d), n)
        return t, written(t.join(held(d), ["tree", "prefix"], "left").groupBy("cid").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")), n)

    plans: list[tuple[int, DataFrame]] = []
    everyone = reps.where("query").select("cid")
    t, size = sized(everyone, length)
    much, little = (F.col("n") > SPREAD * wanted, F.col("n") * SPREAD < wanted) if length else (F.lit(False), F.lit(False))
    plans.append((length, t.join(size.where(~much & ~little), "cid", "left_semi")))
    dense, sparse, before = size.where(much).select("cid"), size.where(little).select("cid"), t
    for d in range(length + 1, hashes.depth + 1):
        if dense.isEmpty():
            break
        t, size = sized(dense, d)
        plans.append((d - 1, before.join(size.where(F.col("n") < wanted), "cid", "left_semi")))
        plans.append((d, t.join(size.where((F.col("n") >= wanted) & (F.lit(d == hashes.depth) | (F.col("n") <= SPREAD * wanted))), "cid", "left_semi")))
        dense, before = size.where((F.col("n") > SPREAD * wanted) & F.lit(d < hashes.depth)).select("cid"), t
    for d in range(length - 1, -1, -1):
        if sparse.isEmpty():
            break
        t, size = sized(sparse, d)
        enough = (F.col("n") * SPREAD >= wanted) | F.lit(d == 0)
        plans.append((d, t.join(size.where(enough), "cid", "left_semi")))
        sparse = size.where(~enough).select("cid")

    def searched(first: bool, low: DataFrame | None) -> DataFrame:
        which = F.col("tree") < FIRST if first else F.lit(True)
        bounded = packs.withColumn("low", F.lit(float("-inf"))) if low is None else packs.join(low, "cid", "left").withColumn("low", F.coalesce("low", F.lit(float("-inf"))))
        out = None
        for d in sorted({d for d, _ in plans}):
            ask = None
            for t in (t for at, t in plans if at == d):
                ask = t if ask is None else ask.unionByName(t)
            here = rooted(index, d).where(which).select("tree", prefix(d).alias("prefix"), "key", "cid")
            split = held(d).where(F.col("n") > CHUNK).select("tree", "prefix", F.ceil(F.col("n") / CHUNK).alias("parts"))
            parts = F.coalesce("parts", F.lit(1).cast("long"))
            chunk = F.pmod(F.xxhash64("prefix"), F.lit(chunks)).alias("chunk")
            if d != length:  # few queries: only what they reach is sent
                here = here.join(ask.select("tree", "prefix").distinct(), ["tree", "prefix"], "left_semi")
            stored = here.join(split, ["tree", "prefix"], "left").select("tree", chunk, F.pmod(F.xxhash64("cid"), parts).alias("part"), F.lit(0).alias("side"), "key", "cid", F.lit(None).cast("array<long>").alias("prefixes"))
            asks = (ask.where(which & (F.col("j") == 0)) if first else ask).join(split, ["tree", "prefix"], "left").select("cid", "tree", chunk, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "prefix")
            asks = asks.groupBy("cid", "tree", "chunk", "part").agg(F.collect_list("prefix").alias("prefixes"))
            both = stored.unionByName(asks.select("tree", "chunk", "part", F.lit(1).alias("side"), F.lit(0).cast("long").alias("key"), "cid", "prefixes"))
            both = both.join(bounded, "cid").withColumn("shift", F.lit(hashes.bits * (hashes.depth - d)).cast("long") if d else F.lit(62).cast("long"))
            both = both.repartition("tree", "chunk", "part").sortWithinPartitions("tree", "chunk", "part", "side", "key", "cid")
            found = nearest(both, kind, k)
            out = found if out is None else out.unionByName(found)
        return written(out.groupBy("cid", "near").agg(F.max("score").alias("score")), n)  # a product's last bits depend on what it is computed with

    # No bound is above the k-th best score of all, and what reaches it is found again among all prefixes.
    nth = F.row_number().over(W.partitionBy("cid").orderBy(F.desc("score"), "near"))
    low = searched(True, None).withColumn("i", nth).where(F.col("i") == k).select("cid", F.col("score").alias("low"))
    found = searched(False, written(low, n)).select("cid", "near")
    own_class = everyone.withColumn("near", F.col("cid"))
    pairs = found.unionByName(own_class)
    pairs = pairs.join(reps.select("cid", F.col("embedding").alias("x")), "cid").join(reps.select(F.col("cid").alias("near"), F.col("embedding").alias("y")), "near")
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    best = F.row_number().over(W.partitionBy("cid").orderBy(F.desc("score"), "near"))
    pairs = pairs.select("cid", "near", product.alias("score")).withColumn("i", best).where(F.col("i") <= k + 1)
    answers = pairs.join(members.withColumnRenamed("cid", "near"), "near").select("cid", "vec_id", "score")
    best = F.row_number().over(W.partitionBy("cid").orderBy(F.desc("score"), "vec_id"))
    answers = answers.withColumn("i", best).where(F.col("i") <= k + 1)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answers = asked.join(answers, "cid").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
