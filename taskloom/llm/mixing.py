"""Operator 7: mix sources to target weights with Efraimidis-Spirakis sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows of sources that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Weights of documents by label: quality 1, quality 0, no label.
QUALITY = {"good": 2.0, "poor": 0.5, "none": 1.0}


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1] that depends on the id and the seed only: 52 bits of SHA-256."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256), 1, 13), 16, 10)
    return (bits.cast("double") + 1.0) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(no_source, source_key, source_size, source_rows, target) from rows with no_source, source_key, size.

    One row a source. Weights go round by code point of the source, null last. Shares of
    `share` times all words go by weight; a target stops at `epochs` times its source's
    size and the excess is dealt again by weight. The level at which no target is above
    its cap is found in one ordered pass, over one row a source.
    """
    stats = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    everything = W.partitionBy()
    turn = F.row_number().over(W.orderBy("no_source", "source_key"))
    s = stats.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "no_source", "source_key")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight)
    found = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True)
    s = s.withColumn("level", found.over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return s.select("no_source", "source_key", "source_size", "source_rows", target.alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights=(3.0, 1.0, 2.0), share: float = 1.5, epochs: int = 2, seed: str = "mix", rows_a_bucket: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes.

    A source's target is met with complete epochs first: each takes every document once.
    What is left of the target is a draw without replacement, by keys -ln(u) / weight in
    ascending order, up to the budget; the document at the budget's end is cut to fit.
    Keys fall into ranges of about `rows_a_bucket` rows, by default as many ranges as each has
    rows. Sums of the ranges tell the one range of a source in which its budget ends, and
    only that range is sorted: of a source with a third of all rows no task gets more than
    about the square root of their number.

    docs: doc_id, text, source; other columns are ignored. quality: doc_id, weight; without
    a row, or with a weight that is null or not positive, a document weighs 1; of several
    rows the largest counts. Null or empty texts have size 0 and are taken with 0 words. A
    null source is a source of its own. Repeated rows are documents of their own; rows
    equal in id and size are interchangeable. No rows give no rows.
    """
    d = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if quality is not None:
        q = quality.where(F.col("weight") > 0).groupBy("doc_id").agg(F.max("weight").alias("weight"))
        d = d.join(q, "doc_id", "left")
    else:
        d = d.withColumn("weight", F.lit(None).cast("double"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce("weight", F.lit(1.0))
    d = written(d.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), "size", key.alias("key")))
    at = ["no_source", "source_key"]
    targets = written(source_targets(d, weights, share, epochs), 1)
    few = (targets.agg(F.sum(F.octet_length("source_key") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    sent = F.broadcast if few else (lambda df: df)  # a row a source: so documents stay where they are
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    buckets = F.ceil(F.col("source_rows") / float(rows_a_bucket) if rows_a_bucket else F.sqrt("source_rows"))
    bucket = F.floor((1.0 - F.exp(-F.col("key"))) * buckets)
    rows = d.join(sent(targets), at).withColumn("bucket", bucket)
    sums = rows.groupBy(*at, "bucket").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    before = F.coalesce(F.sum("words").over(W.partitionBy(*at).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget")))
    ends = written(ends.select(*at, F.col("bucket").alias("end_bucket"), "before"))
    rows = rows.join(sent(ends), at, "left")
    out = ["doc_id", "no_source", "source_key", "size", "source_size", "target", "whole"]
    inside = F.col("end_bucket").isNotNull() & (F.col("bucket") == F.col("end_bucket"))
    plain = rows.where(~inside).select(*out, F.when(F.col("bucket") < F.coalesce("end_bucket", F.lit(-1)), F.col("size")).otherwise(F.lit(0)).alias("part"))
    running = F.coalesce(F.sum("size").over(W.partitionBy(*at).orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - running))
    edge = rows.where(inside).select(*out, part.alias("part"))
    both = plain.unionByName(edge)
    return both.select("doc_id", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels: quality 1 and 0 weigh QUALITY's good and poor."""
    w = F.when(F.col("quality") == 1, QUALITY["good"]).when(F.col("quality") == 0, QUALITY["poor"]).otherwise(QUALITY["none"])
    return labels.select("doc_id", w.alias("weight"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE q AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END) AS weight FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(sha256('mix:' || d.doc_id::VARCHAR), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / coalesce(q.weight::DOUBLE, 1.0::DOUBLE) AS k
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) / (SELECT sum(weight) FROM s) AS level, 0::BIGINT AS full_n
  UNION ALL
  SELECT step + 1, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(2 * source_size), 0) FROM s WHERE 2 * source_size < fill.level * weight))
         / (SELECT sum(weight) FROM s WHERE 2 * source_size >= fill.level * weight), (SELECT count(*) FROM s WHERE 2 * source_size < fill.level * weight)
  FROM fill WHERE step < 40),
t AS (
  SELECT source, source_size, least(2 * source_size, weight * (SELECT level FROM fill WHERE step = 40)) AS target FROM s),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (whole * size + greatest(0, least(size, round(target - whole * source_size) - before)))::BIGINT AS taken
FROM r
"""
