"""Operator 8: near-duplicates by min-max hashing, banding, and links confirmed on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import NO_ID, connected_components, give_back, small_batches, table, written

#: Bands, permutations a band (each gives its minimum and its maximum), and words kept in a worker's cache.
BANDS, PERMS_A_BAND, CACHE = 50, 3, 100_000
#: How many standard deviations below the threshold an estimate may fall before a candidate is dropped unread.
SIGMAS = 6.5
SEED = 20_240_229
#: Ids of documents that may be broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Links up to which one task finds the components.
IN_ONE = 200_000
#: Pairs for which a left side's set is sent once.
ONCE = 1_000


class WordHashes(dict):
    """64-bit hashes of words, kept for later; bounded by `CACHE` entries between texts."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of a 64-bit number spread over all of them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text.

    A-Z are lower-cased, words end at ASCII white space; a text of fewer words, but not
    none, is one shingle; none or null give an empty array.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    if len(words) > CACHE:
        words.clear()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i]
    return np.unique(mixed(out))


def signer(bands: int, perms: int):
    """A function from concatenated sets and their starts to min-max values, a row a set: first minima, then maxima."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, bands * perms, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * perms, np.uint64)

    def sign(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), bands, 2 * perms), np.uint64)
        for p in range(bands * perms):
            x = flat * a[p] + b[p]
            x ^= x >> np.uint64(29)
            out[:, p // perms, p % perms] = np.minimum.reduceat(x, starts)
            out[:, p // perms, perms + p % perms] = np.maximum.reduceat(x, starts)
        return out

    return sign


def signed_documents(docs: DataFrame, k: int, bands: int, perms: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys, sketch): one row a document; the last three null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sign = WordHashes(), signer(bands, perms)
        for frame in batches:
            at = 0
            while at < len(frame):
                ids, sets, total = [], [], 0
                while at < len(frame) and total < 400_000:  # bounded, whatever the batch holds
                    s = shingle_set(frame["text"].iat[at], k, words)
                    ids.append(frame["doc_id"].iat[at])
                    sets.append(s)
                    total += len(s)
                    at += 1
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys, sketch, names = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    values = sign(flat, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
                    band = np.full(values.shape[:2], 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                    for c in range(2 * perms):
                        band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + values[:, :, c])
                    small = (mixed(values) & np.uint64(255)).astype(np.uint8).reshape(len(full), -1)
                    for row, i in enumerate(full):
                        keys[i], sketch[i], names[i] = band[row].view(np.int64), small[row].tobytes(), xxhash.xxh3_128_digest(sets[i].tobytes())
                yield pd.DataFrame({"doc_id": ids, "n_shingles": sizes.astype(np.int64), "set_key": names, "keys": keys, "sketch": sketch})
        words.clear()
        give_back()

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, set_key binary, keys array<long>, sketch binary")


def estimate_floor(threshold: float, n: int) -> float:
    return threshold - SIGMAS * (threshold * (1 - threshold) / n) ** 0.5


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose sizes and sketches allow the threshold."""
    right = reps.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    left = reps.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("sa", "sb"))
                yield f.loc[(x == y).mean(axis=1) >= estimate_floor(threshold, x.shape[1]), ["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int, rows: int) -> DataFrame:
    """(cid, members) of the documents whose doc_id is in wanted, as a written table.

    Up to BROADCAST_IDS ids are broadcast, so that texts stay where they are read; more are joined by shuffling.
    """
    wanted = written(wanted, rows)
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for f in batches:
            for at in range(0, len(f), 200):
                part = f.iloc[at : at + 200]
                yield pd.DataFrame({"cid": part["doc_id"], "members": [shingle_set(t, k, words).tobytes() for t in part["text"]]})
        words.clear()
        give_back()

    return written(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInPandas(sets, "cid long, members binary"))


def compared(pairs: DataFrame, have: DataFrame, threshold: float) -> DataFrame:
    """(a, b, na, nb, linked, apart) of pairs (a, b): set sizes, whether whole sets reach the threshold (taken
    in hundredths, so that nothing is rounded), and the elements in one of the sets only.

    The set of a is sent once for each ONCE of its pairs, before theirs: sorted in, it is
    held while the sets of b stream by. So a hub's set is not a part of every row, and
    no hub's pairs are one task.
    """
    per_cent = round(threshold * 100)
    often = pairs.groupBy("a").agg(F.count("*").alias("often"))
    salted = pairs.join(often, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("often") / ONCE)).alias("salt"))
    right = salted.join(have.withColumnRenamed("cid", "b"), "b").select("a", "salt", F.lit(1).alias("side"), "b", "members")
    sent = often.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("often") / ONCE) - 1)).alias("salt"))
    left = sent.join(have.withColumnRenamed("cid", "a"), "a").select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"), "members")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, x = None, np.empty(0, np.uint64)
        for f in batches:
            rows = []
            for a, side, b, members in zip(f["a"], f["side"], f["b"], f["members"], strict=True):
                y = np.frombuffer(members, np.uint64)
                if not side:
                    own, x = a, y
                elif own == a:
                    apart = np.setxor1d(x, y, assume_unique=True)
                    common = (len(x) + len(y) - len(apart)) // 2
                    rows.append((a, b, len(x), len(y), 100 * common >= per_cent * (len(x) + len(y) - common), apart.view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b", "na", "nb", "linked", "apart"])

    both = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return both.select("a", "side", "b", "members").mapInPandas(run, "a long, b long, na long, nb long, linked boolean, apart array<long>")


def confirmed(pairs: DataFrame, have: DataFrame, threshold: float) -> DataFrame:
    return compared(pairs, have, threshold).where("linked").select("a", "b").distinct()


def residual_links(family: DataFrame, component: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Links (a, b) across components, of members of families around one hub: those that reach the threshold, all of them.

    family: (a: hub, b: member, na, nb, linked, apart). Let D be what sets a member apart
    from the hub. Two members x, y reach the threshold if and only if what sets them apart,
    D(x) + D(y) - 2 * common, is at most c * (size(x) + size(y)), with
    c = (1 - threshold) / (1 + threshold): they need (D(x) + D(y) - c * (size(x) + size(y))) / 2
    elements of D in common. Of two in different components one, x, is not linked with the
    hub, so D(x) > c * (size(x) + size(hub)), and more than half of
    D(y) - c * (size(y) - size(hub)) must be common. So x holds one of so many of the
    elements of D(y) that are rarest in the family, and at the first such element enough
    must be left of both. Edits are rare elements: few pairs are left of a group of any size.
    """
    c = (1 - threshold) / (1 + threshold)
    of = component.select(F.col("node"), "component")
    d = family.join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    d = written(d.select("a", "b", "na", "nb", F.coalesce("cb", "b").alias("cb"), F.coalesce("ca", "a").alias("ca"), "apart"), rows, 4000)
    with_away = d.where("cb <> ca").select("a").distinct()
    d = d.join(with_away, "a", "left_semi")
    tokens = d.select("a", "b", "cb", "ca", "na", "nb", F.size("apart").alias("n"), F.explode("apart").alias("token"))
    often = tokens.groupBy("a", "token").agg(F.count("*").alias("often"))
    rank = F.row_number().over(W.partitionBy("a", "b").orderBy("often", "token"))
    ranked = written(tokens.join(often, ["a", "token"]).withColumn("rank", rank).where("often > 1"), BANDS * rows)
    prefix = F.col("n") - F.greatest(F.lit(0), F.floor((F.col("n") - c * (F.col("nb") - F.col("na"))) / 2 - 1e-6))
    rare = ranked.where(F.col("rank") <= prefix).select("a", "token", "b", "cb", F.col("n").alias("dy"), F.col("nb").alias("ny"), F.col("rank").alias("ry"))
    # Pairs are between components: tokens that one component has to itself make none.
    several = rare.select("a", "token", "cb").unionByName(ranked.where("cb <> ca").select("a", "token", "cb")).groupBy("a", "token")
    several = several.agg(F.min("cb").alias("lo"), F.max("cb").alias("hi")).where("lo <> hi").select("a", "token")
    rare = rare.join(several, ["a", "token"])
    away = ranked.where("cb <> ca").select("a", "token", F.col("b").alias("x"), F.col("cb").alias("cx"), F.col("n").alias("dx"), F.col("nb").alias("nx"), F.col("rank").alias("rx"))
    need = (F.col("dx") + F.col("dy") - c * (F.col("nx") + F.col("ny"))) / 2 - 1e-6
    enough = (1 + F.least(F.col("dx") - F.col("rx"), F.col("dy") - F.col("ry"))) >= need
    met = rare.join(away, ["a", "token"]).where((F.col("cb") != F.col("cx")) & enough)
    met = met.select("a", "b", "x").distinct()
    sides = met.join(d.select("a", F.col("b").alias("x"), F.col("nb").alias("nx"), F.col("apart").alias("dx")), ["a", "x"])
    sides = sides.join(d.select("a", "b", F.col("nb").alias("ny"), F.col("apart").alias("dy")), ["a", "b"])
    between = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    per_cent = round(threshold * 100)
    reached = (100 + per_cent) * between <= (100 - per_cent) * (F.col("nx") + F.col("ny"))
    return sides.where(reached).select(F.least("b", "x").alias("a"), F.greatest("b", "x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = BANDS, perms_a_band: int = PERMS_A_BAND, group: int = 16, hub_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked by Jaccard similarity.

    Documents with the same set are one class. Under each of `bands * perms_a_band`
    permutations a class keeps the minimum and the maximum, and a band is the values of
    `perms_a_band` permutations: six values and 50 bands miss a pair at 0.8 with a chance
    of (1 - 0.8^6)^50, 3 in 10 million. Classes that share a band are candidates, and
    links between candidates are confirmed on whole sets. A group that shares a band is
    not expanded into all pairs: first all are compared with one member, and what one
    component holds by then is finished. The rest of a group of up to `group` is listed in
    pairs across components. In a larger group the member compared with is the one in most
    large groups, a hub that is near the middle; those that stay apart from it get up to
    `hub_rounds` hubs of their own, and pairs across the components that are left are
    linked by residual_links, which loses none that reaches the threshold.

    docs: doc_id (long), text; other columns are ignored. A text that is null or has no
    words is linked with nothing. Repeated rows each get a row; rows with one doc_id count
    as one document. A null doc_id is an id like others, below all. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("doc_id"), "text")
    signed = written(signed_documents(docs, k, bands, perms_a_band))
    n = signed.count()
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("cid"), F.min_by(F.struct("n_shingles", "keys", "sketch"), "doc_id").alias("s"))
    classes = written(classes.select("set_key", "cid", "s.*"), n, 800)
    reps = classes.select("cid", "n_shingles", "sketch")
    banded = classes.select("cid", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = written(banded.join(shared, "key"), bands * n)
    small, large = buckets.where(F.col("c") <= group), buckets.where(F.col("c") > group)
    have = whole_sets(docs, buckets.select(F.col("cid").alias("doc_id")).distinct(), k, n)
    ordered = [F.least("cid", "rep").alias("a"), F.greatest("cid", "rep").alias("b")]

    score = large.groupBy("cid").agg(F.count("*").alias("score"))
    large = written(large.join(score, "cid"), bands * n)
    best = F.struct("score", -F.col("cid"))
    hubs = large.groupBy("key").agg(F.max_by("cid", best).alias("hub"), F.max("score").alias("hub_score"))
    # Groups of one family have several hubs: each gives way to the best hub of any group that it is in, twice.
    better = F.max_by("hub", F.struct("hub_score", -F.col("hub"))).alias("better")
    parents = written(large.join(hubs, "key").groupBy("cid").agg(better).withColumnRenamed("cid", "hub"), n)
    for _ in range(2):
        hubs = hubs.join(parents, "hub").select("key", F.col("better").alias("hub"))
    hubs = written(hubs, n)
    family = large.join(hubs, "key").where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    family = written(compared(written(family, n), have, threshold), n, 4000)
    stars = small.join(small.groupBy("key").agg(F.min("cid").alias("rep")), "key").where("cid <> rep").select(*ordered)
    stars = written(stars.distinct(), n)
    links = family.where("linked").select("a", "b").unionByName(written(confirmed(written(likely(stars, reps, threshold), n), have, threshold), n))
    tested = stars.unionByName(family.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    component = connected_components(links, in_one=IN_ONE, rows=n)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(component.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")

    for _ in range(hub_rounds):
        hub_comp = placed(hubs.withColumnRenamed("hub", "cid")).select("key", F.col("comp").alias("hub_comp"))
        rest = written(placed(large.select("key", "cid", "score")).join(hub_comp, "key").where("comp <> hub_comp"), n)
        if rest.isEmpty():
            break
        split = rest.groupBy("key").agg(F.max_by(F.struct("cid", "comp"), F.struct("score", -F.col("cid"))).alias("r"))
        pairs = rest.join(split, "key").where("comp <> r.comp").withColumn("rep", F.col("r.cid")).select(*ordered)
        pairs = written(pairs.distinct().join(tested, ["a", "b"], "left_anti"), n)
        if pairs.isEmpty():
            break
        links = links.unionByName(written(confirmed(written(likely(pairs, reps, threshold), n), have, threshold), n))
        tested = tested.unionByName(pairs)
        component = connected_components(links, in_one=IN_ONE, rows=n)
    live = written(placed(small.select("key", "cid")), bands * n)
    split = live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    live = live.join(split, "key")
    other = live.select("key", F.col("cid").alias("rep"), F.col("comp").alias("comp2"))
    pairs = live.join(other, "key").where("comp < comp2").select(*ordered).distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), n)
    links = links.unionByName(written(confirmed(written(likely(pairs, reps, threshold), n), have, threshold), n))
    links = links.unionByName(written(residual_links(family, component, threshold, n), n))
    component = connected_components(links, in_one=IN_ONE, rows=n)

    named = full.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "cid"), "set_key")
    named = named.join(component.withColumnRenamed("node", "cid"), "cid", "left").select("doc_id", "n_shingles", F.coalesce("component", "cid").alias("component_id"))
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = named.unionByName(alone)
    ids = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("doc_id", "component_id")]
    return out.select(ids[0], "n_shingles", ids[1], (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, threshold=0.8)
