"""Catalogs of tables: profiles, keys, joins, duplicates, layers, graphs and digests.

Metadata tables have a row a column or a table, so what they are joined with grows with
the schema and not with the data; the data is read in aggregates only.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import identifier_words, normalize_identifier, singular
from .ordering import percentiles

# Words that tell what a column is for, names that say nothing, and what keys look like.
GENERIC = ("id", "key", "code", "no", "number", "index")
IDENTIFIER_WORDS = ("id", "key", "code", "ref", "number", "no", "index")
ID_ENDINGS = ("id", "key", "code", "ref")
TEMPORAL_WORDS = ("date", "datetime", "timestamp", "time", "year", "month", "day", "week")
MEASURE_WORDS = (
    "amount", "price", "cost", "sales", "revenue", "salary", "value", "fee", "total", "points", "score", "distance", "duration", "quantity", "qty", "count", "rate", "pct",
    "percent", "discount", "weight", "height", "runs", "wins", "losses", "average", "avg",
)
DIMENSION_WORDS = (
    "status", "type", "category", "segment", "state", "country", "city", "region", "name", "gender", "sex", "rating", "rank", "position", "channel", "platform", "class", "division",
    "department", "method", "mode", "role", "nationality", "genre",
)
KEYISH = r"(?:^id$|_id$|_ids$|^.*_key$|^key$|_sk$|_pk$|_guid$|_uuid$|^.*_code$|^code$|_number$)"
#: Different values up to which a profile counts them exactly unless told which columns to count.
EXACT_VALUES = 1_000_000
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}"


def type_family(declared: Column) -> Column:
    """blob, numeric, temporal, text or unknown, by what the declared type holds; the first that fits."""
    t = F.upper(F.coalesce(declared, F.lit("")))
    has = lambda *words: F.coalesce(t.rlike("|".join(words)), F.lit(False))
    return F.when(has("BLOB", "BINARY"), "blob").when(has("INT", "REAL", "FLOA", "DOUB", "NUM", "DEC", "BOOL"), "numeric").when(has("DATE", "TIME"), "temporal").when(has("CHAR", "TEXT", "CLOB", "JSON", "STRING", "UUID"), "text").otherwise("unknown")


def compatible(left: Column, right: Column) -> Column:
    """Equal families but blob; text with temporal; unknown with any."""
    return ((left == right) & (left != "blob")) | (left.isin("text", "temporal") & right.isin("text", "temporal")) | (left == "unknown") | (right == "unknown")


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, declared, family, words): a row a column."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema)]
    d = spark.createDataFrame(rows, "table string, position int, column string, declared string")
    return d.withColumn("family", type_family(F.col("declared"))).withColumn("words", identifier_words(F.col("column")))


def semantic_tags(columns: DataFrame) -> DataFrame:
    """columns with tags, sorted: what the words of a name say it is for, its family, and, of what is no identifier, whether it can be a measure or a dimension."""
    lit = lambda words: F.array(*map(F.lit, words))
    compact = normalize_identifier(F.col("column"))
    ident = compact.isin(*GENERIC) | F.arrays_overlap("words", lit(IDENTIFIER_WORDS)) | compact.rlike(f"(?:{'|'.join(ID_ENDINGS)})$")
    by_words = [("temporal", TEMPORAL_WORDS), ("measure", MEASURE_WORDS), ("dimension", DIMENSION_WORDS)]
    by_family = [("measure_candidate", "numeric"), ("dimension_candidate", "text")]
    tags = [F.when(ident, "identifier"), F.col("family"), *(F.when(F.arrays_overlap("words", lit(w)), t) for t, w in by_words), *(F.when((F.col("family") == f) & ~ident, t) for t, f in by_family)]
    return columns.withColumn("tags", F.array_sort(F.array_distinct(F.array_compact(F.array(*tags)))))


def simple(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]


def profile(df: DataFrame, name: str, top: int = 5, exact: list[str] | None = None) -> DataFrame:
    """(table, column, rows, nulls, distinct, null_fraction, uniqueness, top).

    One pass counts rows and nulls and estimates distinct values by a sketch a column. The
    columns in `exact`, by default those of EXACT_VALUES values at most by that estimate, are
    then laid out as (column, value) and counted, combined before the shuffle: their distinct
    values are exact and their most frequent ones known. For others distinct is the
    estimate and top is null, so keys and long texts of large tables are not moved.
    """
    cols = simple(df)
    first = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)], *[F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    counted = [c for i, c in enumerate(cols) if (first[f"d{i}"] <= EXACT_VALUES if exact is None else c in exact)]
    known = df.sparkSession.createDataFrame([(c, first["rows"], first["rows"] - first[f"n{i}"], first[f"d{i}"]) for i, c in enumerate(cols)], "column string, rows long, nulls long, estimate long")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in counted])) if counted else F.explode(F.array().cast("array<struct<column:string,value:string>>"))
    n = df.select(pairs.alias("p")).where("p.value IS NOT NULL").groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    best = n.withColumn("r", place).where(F.col("r") <= top).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("r", "value", "n"))).alias("t"))
    g = known.join(n.groupBy("column").agg(F.count("value").alias("distinct")), "column", "left").join(best, "column", "left")
    g = g.withColumn("distinct", F.when(F.col("column").isin(counted), F.coalesce("distinct", F.lit(0))).otherwise(F.col("estimate")))
    return g.select(F.lit(name).alias("table"), "column", "rows", "nulls", "distinct", F.round(F.try_divide(F.col("nulls"), F.col("rows")), 6).alias("null_fraction"), F.round(F.col("distinct") / F.nullif(F.col("rows") - F.col("nulls"), F.lit(0)), 6).alias("uniqueness"), F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("top"))


def numeric_stats(df: DataFrame, name: str, share: float = 0.8) -> DataFrame:
    """(table, column, least, p25, median, p75, most, mean) of numeric columns, and of text columns of whose values `share` or more read as numbers; the others' values do not count."""
    cols = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")]
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    if texts:
        read = df.agg(*[(F.count(number(c)) >= share * F.greatest(F.lit(1), F.count(F.col(f"`{c}`")))).alias(f"t{i}") for i, c in enumerate(texts)]).first()
        cols += [c for i, c in enumerate(texts) if read[f"t{i}"]]
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("x")) for c in cols])).alias("p")).select("p.*") if cols else df.sparkSession.createDataFrame([], "column string, x double")
    g = x.groupBy("column").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean")).join(percentiles(x, "column", "x", (0.25, 0.5, 0.75)), "column", "left")
    return g.select(F.lit(name).alias("table"), "column", "least", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "most", "mean")


def text_stats(df: DataFrame, name: str) -> DataFrame:
    """(table, column, shortest, longest, mean_length, empty_fraction, dates, first_date, last_date) of text columns."""
    cols = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("x")) for c in cols])).alias("p")).select("p.*") if cols else df.sparkSession.createDataFrame([], "column string, x string")
    date = F.when(F.col("x").rlike(DATE_TEXT), F.col("x"))
    g = x.where("x IS NOT NULL").groupBy("column").agg(
        F.min(F.char_length("x")).alias("shortest"), F.max(F.char_length("x")).alias("longest"), F.avg(F.char_length("x")).alias("mean_length"), (F.count_if(F.col("x") == "") / F.count("*")).alias("empty_fraction"),
        (F.count(date) / F.count("*")).alias("dates"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
    )
    dated = F.col("dates") >= 0.8
    return g.select(F.lit(name).alias("table"), "column", "shortest", "longest", "mean_length", "empty_fraction", F.when(dated, F.col("first_date")).alias("first_date"), F.when(dated, F.col("last_date")).alias("last_date"))


def spread_sample(df: DataFrame, key: str, cap: int = 256) -> DataFrame:
    """About cap rows, evenly spread over the range of an integer key: the same rows at every run, found by equality."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None or cap < 2:
        return df.orderBy(key).limit(max(cap, 0))
    at = sorted({int(lo + (hi - lo) * i // (cap - 1)) for i in range(cap)})
    return df.where(F.col(key).isin(at))


def sampled(df: DataFrame, key: str, cap: int = 256) -> tuple[DataFrame, str]:
    """A sample and how it was taken: `disabled` with a cap of none, `prefix` for a table of cap rows at most, which it holds whole, else `spread`.

    Keys with gaps may give few rows: under the smaller of 32 and a third of cap the first cap
    rows in the order of the key are added, equal rows counted once, as `spread_plus_prefix`,
    or taken alone, as `prefix_fallback`, if the spread found none.
    """
    if cap < 1:
        return df.limit(0), "disabled"
    first = df.orderBy(key).limit(cap)
    if df.limit(cap + 1).count() <= cap:
        return first, "prefix"
    spread = spread_sample(df, key, cap)
    n = spread.count()
    if n >= min(32, cap // 3):
        return spread, "spread"
    return (spread.unionByName(first).distinct(), "spread_plus_prefix") if n else (first, "prefix_fallback")


def distinct_candidates(profiles: DataFrame, tags: DataFrame, most: int = 20, keep: int = 3) -> DataFrame:
    """(table, column, score): the columns of each table most worth listing all values of."""
    d = profiles.join(tags.select("table", "column", "tags"), ["table", "column"])
    few = (F.col("distinct") <= most) & ~((F.col("uniqueness") >= 0.995) & F.array_contains("tags", "identifier"))
    score = F.array_contains("tags", "dimension").cast("int") + (1 - F.col("distinct") / F.greatest(F.lit(1), F.col("rows")))
    d = d.where(few).withColumn("score", F.round(score, 6))
    return d.withColumn("r", F.row_number().over(W.partitionBy("table").orderBy(F.desc("score"), "column"))).where(F.col("r") <= keep).select("table", "column", "score")


def exact_distinct(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """(value, n, truncated): the most frequent values, and whether there are more than limit."""
    n = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n")).where("value IS NOT NULL")
    first = n.orderBy(F.desc("n"), "value").limit(limit + 1)
    return first.withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "value"))).withColumn("truncated", F.count("*").over(W.partitionBy()) > limit).where(F.col("r") <= limit).drop("r")


def looks_like_key(column: Column) -> Column:
    """Names of keys, and names that end in one without a sign before it, as those of tables do whose columns have a prefix (c_custkey)."""
    c = F.lower(column)
    return c.rlike(KEYISH) | normalize_identifier(c).rlike(f"(?:{'|'.join(ID_ENDINGS)})$")


def unique_columns(df: DataFrame, name: str, named: bool = False) -> DataFrame:
    """(table, position, column, rows, unique): the columns that may be keys, and whether their values are all rows, more than one, and all different, by an exact count.

    Whole numbers, texts, dates and times may be, in tables of any size, or of these only those with a key's name (`named`). A column with a null, or of which
    two of a few rows are equal, is not counted.
    """
    kinds = ("byte", "short", "integer", "long", "string", "date", "timestamp", "timestamp_ntz")
    spark, rows = df.sparkSession, df.count()
    fields = [(i, f.name) for i, f in enumerate(df.schema) if f.dataType.typeName().split("(")[0] in kinds]
    known = spark.createDataFrame(fields, "position int, column string").withColumn("key", looks_like_key(F.col("column")))
    chosen = [(r.position, r.column) for r in known.orderBy("position").collect() if r.key or not named]
    few = df.limit(1000).select(*[F.col(f"`{c}`") for _, c in chosen]).toPandas() if chosen else None
    open_ = [(i, c) for k, (i, c) in enumerate(chosen) if rows > 1 and few.iloc[:, k].notna().all() and few.iloc[:, k].is_unique]
    found = {}
    if open_:
        counts = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in open_], *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in open_]).first()
        found = {i: counts[f"d{i}"] == counts[f"n{i}"] == rows for i, _ in open_}
    return spark.createDataFrame([(name, i, c, rows, found.get(i, False)) for i, c in chosen], "table string, position int, column string, rows long, unique boolean")


def key_choice(uniques: DataFrame) -> DataFrame:
    """(table, primary_key): of the unique columns that look like a key the best: id, then <table>_id, then any _id, then _key, _sk and _pk, then other names of keys, then names that only end in one; of equal ones the first of the table."""
    c = F.lower("column")
    grade = F.when(c == "id", 0).when(c == F.concat(F.lower("table"), F.lit("_id")), 1).when(c.endswith("_id"), 2).when(c.rlike("_(?:key|sk|pk)$"), 3).when(c.rlike(KEYISH), 4).otherwise(5)
    return uniques.where(F.col("unique") & looks_like_key(F.col("column"))).groupBy("table").agg(F.min_by("column", F.struct(grade, "position")).alias("primary_key"))


def strip_prefix(columns: DataFrame) -> DataFrame:
    """Names without a prefix of one or two letters that all columns of a table share (c_custkey): a documented adapter for such schemas."""
    lead = F.regexp_extract("column", "^([a-z]{1,2})_", 1)
    shared = F.size(F.collect_set(lead).over(W.partitionBy("table"))) == 1
    bare = F.when(shared & (lead != ""), F.regexp_replace("column", "^[a-z]{1,2}_", "")).otherwise(F.col("column"))
    # custkey reads as cust key
    return columns.withColumn("bare", F.regexp_replace(bare, "(?<=[a-z])(key|id|code)$", "_$1"))


def probe(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """One row (left_distinct, right_distinct, common, left_unique, right_unique) of a join of two columns, exactly."""
    side = lambda df, c: df.groupBy(F.col(f"`{c}`").cast("string").alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL")
    a, b = side(left, left_column).withColumnRenamed("n", "a"), side(right, right_column).withColumnRenamed("n", "b")
    return a.join(b, "v", "full").agg(F.count("a").alias("left_distinct"), F.count("b").alias("right_distinct"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), (F.coalesce(F.max("a"), F.lit(0)) <= 1).alias("left_unique"), (F.coalesce(F.max("b"), F.lit(0)) <= 1).alias("right_unique"))


def composite_joins(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(left_table, right_table, columns, confidence): pairs of tables that share two or more identifiers, of which the first four together match a row."""
    c = semantic_tags(columns_of(spark, tables)).where(F.array_contains("tags", "identifier") & ~F.lower("column").isin(*GENERIC)).select("table", F.lower("column").alias("column"))
    p = c.select(F.col("table").alias("left_table"), "column").join(c.select(F.col("table").alias("right_table"), "column"), "column").where("left_table < right_table")
    p = p.groupBy("left_table", "right_table").agg(F.slice(F.sort_array(F.collect_set("column")), 1, 4).alias("columns")).where(F.size("columns") >= 2)
    rows = [(r.left_table, r.right_table, r.columns, 0.82) for r in p.collect() if not tables[r.left_table].join(tables[r.right_table].select(*r.columns), r.columns, "left_semi").isEmpty()]
    return spark.createDataFrame(rows, "left_table string, right_table string, columns array<string>, confidence double")


def summary(spark: SparkSession, tables: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """One row: numbers of tables, columns, rows and joins."""
    n = columns_of(spark, tables).agg(F.countDistinct("table").alias("tables"), F.count("*").alias("columns"))
    rows = None
    for df in tables.values():
        r = df.agg(F.count("*").alias("rows"))
        rows = r if rows is None else rows.union(r)
    return n.join(F.broadcast(rows.agg(F.sum("rows").alias("rows"))), F.lit(True)).join(F.broadcast(edges.agg(F.count("*").alias("joins"))), F.lit(True))  # one row each


def flattened(relations: DataFrame) -> DataFrame:
    """relations (schema, name) with flat names.

    A relation of main keeps its name, so does one whose name begins with its schema's, main_ taken off; others are named schema__name.
    Of several with one flat name main's keeps it, else the first by schema and name; the others get their whole schema's name and theirs, as schema__name.
    """
    short = F.regexp_replace("schema", "^main_", "")
    flat = F.when((F.col("schema") == "main") | F.col("name").startswith(short), F.col("name")).otherwise(F.concat_ws("__", short, "name"))
    d = relations.withColumn("flat", flat)
    first = F.row_number().over(W.partitionBy("flat").orderBy((F.col("schema") != "main").cast("int"), "schema", "name")) == 1
    return d.withColumn("_first", first).withColumn("flat", F.when(F.col("_first"), F.col("flat")).otherwise(F.concat_ws("__", "schema", "name"))).drop("_first")


def layer(name: Column, sources: Column | None = None) -> Column:
    """source, staging, intermediate or mart: a name among `sources` (an array of normalised names) is a source; then by how it begins, or ends; else mart."""
    n = F.lower(name)
    known = F.coalesce(F.array_contains(sources, normalize_identifier(name)), F.lit(False)) if sources is not None else F.lit(False)
    begins = lambda *words: n.rlike(f"^(?:{'|'.join(words)})_")
    return F.when(known, "source").when(begins("stg"), "staging").when(begins("int"), "intermediate").when(begins("dim", "fct", "fact", "rpt", "mart"), "mart").when(n.rlike("_(?:data|seed)$"), "source").otherwise("mart")


def duplicate_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(left, right, rows, jaccard, confident): pairs of tables with as many rows and .6 or more of their columns in common."""
    rows = None
    for n, df in tables.items():
        r = df.agg(F.lit(n).alias("table"), F.count("*").alias("rows"), F.lit(sorted(c.lower() for c in df.columns)).alias("columns"))
        rows = r if rows is None else rows.unionByName(r)
    a, b = rows.toDF("left", "rows", "lc"), rows.toDF("right", "rows", "rc")
    p = a.join(b, "rows").where("left < right AND rows > 0")
    p = p.withColumn("jaccard", F.round(F.size(F.array_intersect("lc", "rc")) / F.size(F.array_union("lc", "rc")), 6)).where("jaccard >= 0.6")
    return p.select("left", "right", "rows", "jaccard", ((F.col("rows") >= 20) & (F.col("jaccard") >= 0.7)).alias("confident"))


def overflow_census(df: DataFrame) -> DataFrame:
    """(column, too_wide, nans, infinities) of numeric columns, in one pass."""
    cols = [f.name for f in df.schema if f.dataType.typeName() in ("float", "double") or f.dataType.typeName().startswith("decimal")]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, too_wide long, nans long, infinities long")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        real = x.cast("double")
        aggs += [F.count_if(F.abs(real) > 9.223372036854775e18).alias(f"w{i}"), F.count_if(F.isnan(real)).alias(f"n{i}"), F.count_if(F.abs(real) == float("inf")).alias(f"i{i}")]
    items = [F.struct(F.lit(c).alias("column"), F.col(f"w{i}").alias("too_wide"), F.col(f"n{i}").alias("nans"), F.col(f"i{i}").alias("infinities")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.explode(F.array(*items)).alias("x")).select("x.*")


def documented(names: DataFrame, docs: DataFrame) -> DataFrame:
    """names (name) with description: of the name itself, else of <name>_data, else of what follows a double underscore."""
    d = docs.groupBy("name").agg(F.first("description", ignorenulls=True).alias("description"))
    keys = F.array(F.struct(F.lit(0).alias("o"), F.col("name").alias("k")), F.struct(F.lit(1).alias("o"), F.concat("name", F.lit("_data")).alias("k")), F.struct(F.lit(2).alias("o"), F.regexp_extract("name", "__(.+)$", 1).alias("k")))
    found = names.select("name", F.explode(keys).alias("x")).select("name", "x.*").join(d.withColumnRenamed("name", "k"), "k").groupBy("name").agg(F.min_by("description", "o").alias("description"))
    return names.join(found, "name", "left")


def representative(databases: DataFrame) -> DataFrame:
    """One database of each family, the one with most bytes, ties to the larger name; (family, name, bytes)."""
    return databases.groupBy("family").agg(F.max(F.struct("bytes", "name")).alias("m")).select("family", "m.name", "m.bytes")


def corpus_summary(tables: DataFrame) -> DataFrame:
    """(n, usable, large, documented, with_key, median_rows) of tables (rows, description, primary_key)."""
    return tables.agg(F.count("*").alias("n"), F.count_if(F.col("rows") >= 100).alias("usable"), F.count_if(F.col("rows") >= 10_000).alias("large"), F.count_if(F.coalesce(F.trim("description"), F.lit("")) != "").alias("documented"), F.count("primary_key").alias("with_key"), F.median("rows").alias("median_rows"))


def layer_joins(edges: DataFrame) -> DataFrame:
    """(layers, n, share): joins by the pair of layers of their tables."""
    pair = F.concat_ws("-", F.array_sort(F.array(layer(F.col("left_table")), layer(F.col("right_table")))))
    n = edges.groupBy(pair.alias("layers")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def table_selection(tables: DataFrame, edges: DataFrame, seed: str, limit: int = 12) -> DataFrame:
    """(catalog, table, place): for each catalog at most `limit` tables of its richest component of joins, from an anchor outwards.

    tables (catalog, table, position, temporal, numeric): numbers of columns of a kind. edges (catalog, left_table, right_table). A catalog of `limit` tables or
    fewer is taken whole, by position. Richest is the component with most temporal columns, then joins, then numeric columns. The anchor is a
    table with a temporal column and a join, else one with a join, else any: the one with most temporal columns, then numeric ones, then joins. Tables
    follow by rounds: the neighbours of a table that was taken, those with more temporal columns first, then with more joins. Ties go by
    SHA-256 of the seed and the names. Catalogs are spread over tasks; one catalog, tens of tables, is one task's.
    """
    linked = edges.where("left_table <> right_table").select("catalog", F.explode(F.array(F.struct(F.col("left_table").alias("table"), F.col("right_table").alias("other")), F.struct(F.col("right_table").alias("table"), F.col("left_table").alias("other")))).alias("x")).select("catalog", "x.*")
    near = linked.groupBy("catalog", "table").agg(F.collect_set("other").alias("near"))
    known = tables.join(near, ["catalog", "table"], "left").select("catalog", "table", "position", "temporal", "numeric", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    return known.groupBy("catalog").applyInPandas(lambda f: _walked(f, seed, limit), f"catalog {tables.schema['catalog'].dataType.simpleString()}, table string, place int")


def _walked(f: pd.DataFrame, seed: str, limit: int) -> pd.DataFrame:
    f = f.sort_values("position")
    names = f["table"].tolist()

    def out(taken: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"catalog": f["catalog"].iloc[0], "table": taken, "place": range(1, len(taken) + 1)})

    if len(names) <= limit:
        return out(names)
    near = {t: set(n) & set(names) for t, n in zip(names, f["near"], strict=True)}
    signal = {t: (int(a), int(b), len(near[t])) for t, a, b in zip(names, f["temporal"], f["numeric"], strict=True)}
    order = lambda x: hashlib.sha256(f"{seed}\0{x}".encode()).hexdigest()
    component = {}
    for t in sorted(names):
        if t not in component:
            reached, frontier = {t}, {t}
            while frontier:
                frontier = set().union(*(near[x] for x in frontier)) - reached
                reached |= frontier
            component |= dict.fromkeys(reached, frozenset(reached))
    totals = lambda c, i: sum(signal[t][i] for t in c)
    richest = max(set(component.values()), key=lambda c: (totals(c, 0), totals(c, 2), totals(c, 1), order("|".join(sorted(c)))))
    joined = [t for t in richest if near[t]]
    anchor = max([t for t in joined if signal[t][0]] or joined or richest, key=lambda t: (signal[t], order(t)))
    taken, waiting = [], deque([anchor])
    while waiting and len(taken) < limit:
        now = waiting.popleft()
        if now not in taken:
            taken.append(now)
            waiting.extend(sorted(near[now] - set(taken), key=lambda t: (-signal[t][0], -signal[t][2], order(f"{now}|{t}"))))
    return out(taken)


def digest(columns: DataFrame, edges: DataFrame, tables: list[str], most_columns: int = 60) -> DataFrame:
    """(table, columns, joins): a bounded view of a catalog: the chosen tables' columns and the joins among them."""
    c = columns.where(F.col("table").isin(tables)).groupBy("table").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("position", "column", "family"))), lambda x: F.concat_ws(":", x["column"], x["family"])), 1, most_columns).alias("columns"))
    inside = edges.where(F.col("left_table").isin(tables) & F.col("right_table").isin(tables))
    line = F.concat(F.col("left_table"), F.lit("."), F.col("left_column"), F.lit("="), F.col("right_table"), F.lit("."), F.col("right_column"))
    j = inside.groupBy(F.col("left_table").alias("table")).agg(F.sort_array(F.collect_set(line)).alias("joins"))
    return c.join(j, "table", "left").withColumn("joins", F.coalesce("joins", F.array().cast("array<string>")))
