"""What several of the operators need: written intermediate tables and connected components."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of 8 bytes that may be broadcast.
BROADCAST_KEYS = 1_000_000
#: Bytes, before compression, that one file of a written table is planned for.
FILE_BYTES = 8 << 20
#: Paths of the tables written so far, oldest first.
MADE: list[str] = []
#: Stands for a null id where Python would turn a column with nulls into floats; below all ids.
NO_ID = -(1 << 63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """In a Python worker at a partition's end: memory that is free goes back to the system, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(spark: SparkSession, size: str = "2m") -> None:
    """Python workers get Arrow batches of at most `size`, where the session has Spark's own default of 64 MB.

    The setting stays: results are computed after the operator has returned.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, size)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset the warehouse, and a folder of our own in local mode, where there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        folder = shared_folder.own = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="taskloom-")
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    if path not in MADE:
        return
    MADE.remove(path)
    if spark.sparkContext._jsc is None:  # the session has ended; a local folder can go without it
        if os.path.isdir(path):
            shutil.rmtree(path)
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that goes when the driver's process ends, or with drop_tables()."""
    path = f"{shared_folder(spark)}/taskloom-{uuid.uuid4().hex}"
    MADE.append(path)
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors cost no recomputation.

    rows: about how many there are, if that is known, of row_bytes each. The table gets no
    more files than these fill, but enough for all cores unless rows are few: many small files
    cost more than what is in them. The table goes when the driver's process ends, or with
    drop_tables().
    """
    spark = df.sparkSession
    path = new_path(spark)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows * row_bytes // FILE_BYTES), min(4 * spark.sparkContext.defaultParallelism, rows // 500)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Removes the tables written since there were `since`, but for the last `keep`; nothing may read them any more."""
    for path in MADE[since : len(MADE) - keep]:
        _remove(spark, path)


def without(df: DataFrame, keys: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Rows of df whose column `name` is in no row of keys (null equals null).

    Up to BROADCAST_KEYS keys are broadcast, so that rows stay where they are; more are joined by
    shuffling. rows: about how many keys there are, if that is known.
    """
    keys = written(keys, rows)
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    keys = keys.select(F.col(name).alias("_key"))
    return df.join(keys, F.col(name).eqNullSafe(F.col("_key")), "left_anti")


def _joined_in_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    above: dict = {}

    def root(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for f in batches:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in above if root(x) != x]
    if found:
        yield pd.DataFrame(found, columns=["a", "b"])


def connected_components(edges: DataFrame, in_one: int = 0, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Components of an undirected graph given as edges (a, b) of one ordered type.

    Returns (node, component) with component the smallest node of the component; the
    smallest node itself has no row, nor has a node without an edge. Alternates
    large-star and small-star steps until the edges stand still; every step is a
    partially aggregated minimum and an equi-join that adaptive execution can split
    where a node has very many edges. Up to `in_one` edges, counted first, are joined in
    one Python task instead. Null ends and loops are ignored; no edges give no rows. rows: about
    how many edges there are, if that is known.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = written(e.select(big.alias("a"), small.alias("b")).distinct(), rows)
    if in_one and e.count() <= in_one:
        e = written(e.coalesce(1).mapInPandas(_joined_in_one, e.schema))
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    last = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if not now[0] or now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a"))
        large = large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        e = written(joined.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a != b").distinct(), rows)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
