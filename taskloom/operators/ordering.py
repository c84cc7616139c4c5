"""Orders over all rows without one task for all: range partitions, sorted where they are, and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch


def placed(df: DataFrame, by: list[str], order: list[Column], weight: Column) -> DataFrame:
    """df with before: the sum of weight over the rows of the same `by` that come earlier in `order`, which must leave no ties.

    Rows are cut into ranges and sorted there; each range sums what it has of a group, and
    these sums, one for each range and group that meet, are added up in the order of the ranges.
    """
    keys = [F.col(c) for c in by]
    path = scratch(df.sparkSession)
    cut = df.withColumn("_w", weight.cast("long")).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    cut.write.parquet(path)  # the ranges are found by sampling: all that follows must see the same ones
    cut = df.sparkSession.read.schema(cut.schema).parquet(path)
    inner = F.sum("_w").over(W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    sums = cut.groupBy("_range", *by).agg(F.sum("_w").alias("_w"))
    earlier = F.sum("_w").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_{c}") for c in by], F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    on = F.col("_range") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return cut.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(sums, on).select(*df.columns, (F.col("_inner") + F.col("_earlier")).alias("before"))


def ranked(df: DataFrame, order: list[str], name: str, dense: bool) -> DataFrame:
    """df with its rank, or dense rank, by columns in descending order over all rows: distinct values are counted and placed, then met by equality."""
    values = df.groupBy(*order).agg(F.count("*").alias("_n"))
    at = placed(values, [], [F.desc(c) for c in order], F.lit(1) if dense else F.col("_n"))
    return df.join(at.select(*order, (F.col("before") + 1).cast("int").alias(name)), order)


def percentiles(df: DataFrame, by: str, x: str, at: tuple[float, ...]) -> DataFrame:
    """(by, q): exact percentiles of x in each group, interpolated between ranks, nulls left out.

    Values are counted before anything is ordered, so a group is as many rows as it has
    different values, and these lie in ranges of their own.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count("*").alias("_n"))
    total = counts.groupBy(by).agg(F.sum("_n").alias("_total"))
    p = placed(counts, [by], [F.col(x)], F.col("_n")).join(total, by)
    out = []
    for i, q in enumerate(at):
        h = (F.col("_total") - 1) * F.lit(float(q))
        value = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("_n")), F.col(x)))
        out += [value(F.floor(h)).alias(f"_lo{i}"), value(F.ceil(h)).alias(f"_hi{i}"), F.max(h - F.floor(h)).alias(f"_part{i}")]
    g = p.groupBy(by).agg(*out)
    return g.select(by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}") for i in range(len(at))]).alias("q"))
