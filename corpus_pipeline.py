"""A corpus pipeline of five stages: language ID, near-dedup, decontamination, secret scan, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in
the shared folder and reads it again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import decontamination, language, minhash, mixing, secrets
from taskloom.llm.shared import MADE, drop_tables, table, without, written

#: A document goes if no language has this chance, given that it is one of them; language.floors() bounds what is none of them.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a language that is likelier than the others together, or improbable in it letter by letter, go."""
    predict = language.predictor(spark, language.train(docs))
    judged = written(docs.withColumn("_taskloom_judged", predict("text")))  # once: floors come from all training documents
    by_lang = language.floors(judged)
    j = F.col("_taskloom_judged")
    return judged.where((j["lang_pred"] != "und") & (j["score"] >= LEAST_SCORE) & language.likely(j, by_lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more. Of rows with one doc_id the one with the smallest text stays, null before all; of equal texts the smallest row."""
    rows = docs.count()
    found = written(minhash.near_duplicates(docs, k=5, threshold=0.8), rows)
    kept = without(docs, found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", rows)
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), rows)
    if again.isEmpty():
        return kept
    twice = again.select(F.col("doc_id").alias("_taskloom_id"))
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("text", *rest)
    once = kept.join(twice, F.col("doc_id").eqNullSafe(F.col("_taskloom_id")), "left_semi").groupBy("doc_id").agg(F.min(row).alias("_taskloom_row"))
    return without(kept, again, "doc_id").unionByName(once.select("doc_id", "_taskloom_row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = written(found.where("contaminated").select(F.col("rk").alias("_taskloom_rk")).distinct(), docs.count())
    return without(docs.withColumn("_taskloom_rk", F.xxhash64("doc_id", "text")), hit, "_taskloom_rk").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, source, size, source_size, target, taken; documents that it takes nothing of go."""
    return mixing.mix_sources(docs, mixing.label_weights(table(spark, sf_dir, "labels"))).where("taken > 0")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", benchmark_decontamination), ("secret_scan", secret_scan), ("mix", mix)]

#: The stages hash, train and sample; SQL does not express them. tests/llm/test_edges.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = table(spark, sf_dir, "documents"), len(MADE)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        drop_tables(spark, began)  # what the stage needed, and the documents that it read
    return docs
