"""Operator 5: exact removal of repeated passages by a depth-limited radix sort of suffixes.

Only the first `depth` bytes of a suffix count, so equal groups at that depth are exactly
the repeated windows. A pass over more significant digits settles most suffixes before
they are ever listed one by one:

* Digit 1. The suffixes that start between two neighbouring synchronising positions
  (minima of hashes of `K` bytes over `SYNC` places, the same in every copy of a window)
  go together. Their digit is what all their windows hold: the bytes from the
  position on. A group of one is finished: none of its windows repeats.
* Digit 2. In the groups left, the suffixes are dealt into runs of `RUN` starts.
* Digit 3. In the groups still left, single suffixes to the full depth.

Where whole contexts of a run of starts agree, all their windows repeat, and one of the
agreeing contexts goes on for all of them. Digits are grouped by 64-bit polynomial hashes;
that contexts agree is judged by 128 bits of BLAKE2b of their bytes, as different texts can
be made whose polynomial hashes are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import mixed
from .shared import NO_ID, small_batches, table, written

#: Places over which a synchronising minimum is taken, bytes it looks at, starts in a run of digit 2.
SYNC, K, RUN = 200, 16, 16
#: Starts of a long text that are worked on at once, and bytes of texts worked on together.
PIECE, TOGETHER = 1 << 22, 1 << 20
#: A run of starts, with the hash of what all its windows hold and the digest of all that they hold.
ROW = "rk long, p long, lo long, hi long, core long, full long, rest long"
BASE = 0x2B0F1A3C5D7E9B65
U = np.uint64


class Rolling:
    """Hashes of any stretch of a buffer, after one pass over it."""

    def __init__(self) -> None:
        self.table = np.random.default_rng(97).integers(1, 1 << 63, 256, U)
        self.up = self.down = np.ones(1, U)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self.up) <= n:
            self.up = np.cumprod(np.r_[U(1), np.full(n, BASE, U)], dtype=U)
            self.down = np.cumprod(np.r_[U(1), np.full(n, pow(BASE, -1, 1 << 64), U)], dtype=U)
        self.sums = np.empty(n + 1, U)
        self.sums[0] = 0
        np.cumsum(self.table[data] * self.up[:n], dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def tagged(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for x in more:
        h = mixed(h * U(0x9E3779B97F4A7C15) + x.astype(U))
    return h.view(np.int64)


def agreed(data: np.ndarray, start: np.ndarray, end: np.ndarray, *more: np.ndarray) -> dict[str, np.ndarray]:
    """Columns full and rest, equal only where the bytes from start to end and all of more are."""
    view = memoryview(data)
    found = np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), U)
    return {"full": tagged(found[::2], *more), "rest": found[1::2].view(np.int64)}


def widths(depth: int) -> tuple[int, int, int]:
    """(SYNC, K, RUN), smaller where depth is: what a window's first digits look at must lie inside of it."""
    return tuple(max(1, min(x, depth // 2)) for x in (SYNC, K, RUN))


def sync_runs(data: np.ndarray, starts: np.ndarray, roll: Rolling, sync: int, look: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, first and last of each run of window starts that share a synchronising position."""
    at = np.arange(len(data) - look + 1)
    low = (mixed(roll.of(at, at + look)) & U(0xFFFFFFFF00000000)) | at.astype(U)
    width = 1
    while width * 2 <= sync:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < sync:
        low = np.minimum(low[: len(low) - (sync - width)], low[sync - width :])
    p = (low[starts] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return p[new], starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]


def digit_one(docs: DataFrame, depth: int) -> DataFrame:
    """(rk, p, lo, hi, core, full, rest): runs of starts of all texts."""
    sync, look, _ = widths(depth)

    def flush(parts: list, roll: Rolling) -> pd.DataFrame:
        data = np.concatenate([x[2] for x in parts])
        off = np.cumsum([0, *(len(x[2]) for x in parts)])[:-1]
        starts = np.concatenate([np.arange(o, o + len(x[2]) - depth + 1) for o, x in zip(off, parts, strict=True)])
        roll.load(data)
        p, lo, hi = sync_runs(data, starts, roll, sync, look)
        core = tagged(roll.of(p, p + depth - sync + 1), np.full(len(p), 1))
        full = agreed(data, lo, hi + depth, p - lo, p - hi)
        own = np.searchsorted(off, lo, side="right") - 1
        shift = np.array([x[1] for x in parts])[own] - off[own]
        return pd.DataFrame({"rk": np.array([x[0] for x in parts])[own], "p": p + shift, "lo": lo + shift, "hi": hi + shift, "core": core, **full})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, parts, held = Rolling(), [], 0
        for f in batches:
            for rk, raw in zip(f["rk"], f["raw"], strict=True):
                data = np.frombuffer(raw or b"", np.uint8)
                for c in range(0, len(data) - depth + 1, PIECE):
                    parts.append((rk, c, data[c : c + PIECE + depth - 1]))
                    held += len(parts[-1][2])
                    if held >= TOGETHER:
                        yield flush(parts, roll)
                        parts, held = [], 0
        if parts:
            yield flush(parts, roll)

    return docs.select("rk", "raw").mapInPandas(run, ROW)


def next_digit(docs: DataFrame, reps: DataFrame, depth: int, single: bool) -> DataFrame:
    """The next digit's rows, of the same form, for the runs of starts in reps."""
    lists = reps.groupBy("rk").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("runs"))
    both = docs.select("rk", "raw").join(lists, "rk")
    _, _, step = widths(depth)

    def flush(parts: list, roll: Rolling) -> pd.DataFrame:
        data = np.concatenate([x[4] for x in parts])
        off = np.cumsum([0, *(len(x[4]) for x in parts)])[:-1]
        rk, p, lo, hi = (np.array([x[i] for x in parts], np.int64) for i in range(4))
        roll.load(data)
        shift = off - lo
        if single:
            n = hi - lo + 1
            own = np.repeat(np.arange(len(n)), n)
            s = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own]
            at = s + shift[own]
            core = tagged(roll.of(at, at + depth), np.full(len(s), 3))
            return pd.DataFrame({"rk": rk[own], "p": s, "lo": s, "hi": s, "core": core, **agreed(data, at, at + depth)})
        first, last = (p - hi) // step, (p - lo) // step
        n = last - first + 1
        own = np.repeat(np.arange(len(n)), n)
        m = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]
        q, a, b = p[own], np.maximum(lo[own], p[own] - m * step - step + 1), np.minimum(hi[own], p[own] - m * step)
        c = q - m * step + shift[own]
        core = tagged(roll.of(c, c - step + 1 + depth), np.full(len(q), 2), m)
        full = agreed(data, a + shift[own], b + depth + shift[own], q - a, q - b)
        return pd.DataFrame({"rk": rk[own], "p": q, "lo": a, "hi": b, "core": core, **full})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, parts, held = Rolling(), [], 0
        for f in batches:
            for rk, raw, runs in zip(f["rk"], f["raw"], f["runs"], strict=True):
                data = np.frombuffer(raw, np.uint8)
                for r in runs:
                    parts.append((rk, r["p"], r["lo"], r["hi"], data[r["lo"] : r["hi"] + depth]))
                    held += len(parts[-1][4])
                    if held >= TOGETHER:
                        yield flush(parts, roll)
                        parts, held = [], 0
        if parts:
            yield flush(parts, roll)

    return both.mapInPandas(run, ROW)


def settled(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Covered bytes (rk, a, b) of the runs whose contexts agree, and one run a context where a group holds several."""
    rows = written(rows)
    n = rows.count()
    # Written, so that the join reads it through an exchange of its own and can split a core that very many rows have.
    many = written(rows.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"), n)
    live = written(rows.join(many, "core"), n)
    one = [F.first(c).alias(c) for c in ("rk", "p", "lo", "hi")]
    contexts = written(live.groupBy("core", "full", "rest").agg(F.count("*").alias("c"), *one), n)
    agree = contexts.where("c > 1").select("core", "full", "rest")
    cover = live.join(agree, ["core", "full", "rest"]).select("rk", F.col("lo").alias("a"), (F.col("hi") + depth).alias("b"))
    mixed_groups = contexts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    return cover, contexts.join(mixed_groups, "core").select("rk", "p", "lo", "hi")


def remove_repeats(docs: DataFrame, depth: int = 400) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text without the bytes in windows of `depth` bytes that repeat.

    spans: the maximal removed runs (a, b), in bytes, end exclusive; kept: the bytes that
    remain. A window repeats if it also starts anywhere else, in the same text or in
    another; every copy goes. Windows never cross texts.

    docs: doc_id, text; other columns are ignored. A null text is empty. Texts shorter than
    `depth` bytes lose nothing. Repeated rows count as texts of their own. Long texts are
    read in pieces of bounded size. No rows give no rows. depth: 1 or more.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")).withColumn("rk", F.xxhash64("doc_id", "raw"))
    cover, reps = settled(digit_one(d, depth), depth)
    for single in (False, True):
        more, reps = settled(next_digit(d, reps, depth, single), depth)
        cover = cover.unionByName(more)
    lists = cover.groupBy("rk").agg(F.collect_list(F.struct("a", "b")).alias("cover"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            spans, kept = [], []
            for raw, found in zip(f["raw"], f["cover"], strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in (found if found is not None else ())):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                ends = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                spans.append([{"a": a, "b": b} for a, b in runs])
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_bytes": [len(x) for x in f["raw"]], "spans": spans, "kept": kept})

    out = d.join(lists, "rk", "left").select("doc_id", "raw", "cover").mapInPandas(run, "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], depth: int) -> list[tuple[list[tuple[int, int]], str]]:
    """For tests: spans and hash of what remains, by a table of all windows."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - depth + 1):
            count[t[i : i + depth]] = count.get(t[i : i + depth], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if count[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        edges = [i for i in range(len(t) + 1) if (gone[i - 1] if i else 0) != (gone[i] if i < len(t) else 0)]
        out.append((list(zip(edges[::2], edges[1::2], strict=True)), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
