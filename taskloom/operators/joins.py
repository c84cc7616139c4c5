"""Joins inferred from names and from sketches of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import identifier_words, normalize_identifier, sequence_ratio, singular
from ..sources import scratch
from .catalog import GENERIC, columns_of, compatible, semantic_tags, simple, strip_prefix

# Words of a name that say that it is a key, and words that say which of two it is.
KEY_WORDS = ("id", "key", "code", "ref", "no")
CORE_WORDS = (*KEY_WORDS, "number")
DIRECTIONS = ("arrival", "departure", "source", "target", "from", "to", "origin", "destination")
#: Values of a column that its sketch holds, those with the smallest digests; joins kept of a pair of tables, and of a schema.
SKETCH, KEPT, MOST = 256, 3, 400
#: A name that points at the other table counts as this alike at least; likeness that identifiers need.
POINTS, ALIKE = 0.92, 0.9
ENDS = ("left_table", "left_column", "right_table", "right_column")


def _lit(words) -> Column:
    return F.array(*map(F.lit, words))


def named(columns: DataFrame) -> DataFrame:
    """columns (table, bare, ...) with what the rules of names ask: norm, words, base, core, generic, table_name, table_token, key_base, table_key."""
    less = lambda drop: F.array_except("words", _lit(drop))
    kept = lambda drop: F.array_join(F.filter("words", lambda w: ~w.isin(*drop)), "")
    d = columns.withColumns({"norm": normalize_identifier(F.col("bare")), "words": identifier_words(F.col("bare"))})
    d = d.withColumns({"base": kept(KEY_WORDS), "core": F.array_sort(less(CORE_WORDS + DIRECTIONS)), "generic": F.col("norm").isin(*GENERIC), "table_name": singular(F.col("table")), "table_words": identifier_words(F.col("table")), "key_base": kept(CORE_WORDS)})
    token = F.coalesce(singular(F.try_element_at("table_words", F.lit(-1))), F.lit(""))
    d = d.withColumn("table_token", token)
    return d.withColumn("table_key", F.col("key_base").isin(F.col("table_name"), F.col("table_token")) | F.col("generic"))


def _two(s: str, name: str) -> Column:
    return F.col(f"{s}.{name}")


def name_score() -> Column:
    """Likeness of two columns' names, of structs left and right as named() makes them; the first rule that fits."""
    l, r = (lambda n: _two("left", n)), (lambda n: _two("right", n))
    both = (F.size(l("core")) > 0) & (F.size(r("core")) > 0)
    shared = F.size(F.array_intersect(l("core"), r("core"))) / F.greatest(F.size(l("core")), F.size(r("core")))
    at = lambda a, b: a("generic") & ((b("base") == a("table_name")) | b("norm").startswith(a("table_name")))
    rules = F.when(l("generic") & r("generic"), 0.0).when((l("norm") == r("norm")) & ~l("generic"), 1.0).when((l("base") != "") & (l("base") == r("base")), 0.94).when(both & (l("core") == r("core")), 0.9)
    return rules.when(both & (shared >= 0.5), 0.78 + 0.12 * shared).when(at(l, r) | at(r, l), 0.92).otherwise(0.82 * sequence_ratio(l("norm"), r("norm")))


def points() -> Column:
    """Whether one column is the key of its table by its name and the other names that table."""
    way = lambda s, t: _two(s, "table_key") & F.array_contains(_two(t, "words"), _two(s, "table_token"))
    return F.coalesce(way("right", "left") | way("left", "right"), F.lit(False))


def join_candidates(columns: DataFrame, declared: DataFrame | None = None, keep: int = KEPT, most: int = MOST) -> DataFrame:
    """(left_table, left_column, right_table, right_column, name_similarity, explicit_foreign_key): pairs of columns of different tables that are worth a look at their values.

    columns: as semantic_tags() gives them. Types must be compatible. A pair is declared, or both are identifiers with names alike by
    ALIKE or more, or the name of one points at the other's table, which counts as POINTS at least. The best `keep` of a
    pair of tables stay, declared ones first, then by the columns' places, and the best `most` of all.
    Columns meet by what such a pair must have in common: the name, its words without those of keys, the table that a
    general name stands for, or a table's name among the words; no column meets all others.
    """
    c = named(strip_prefix(columns)).withColumn("ident", F.array_contains("tags", "identifier"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("norm")), lambda n: F.concat(F.lit("t "), F.substring("norm", F.lit(1), n)))
    tell = lambda kind, x: F.concat(F.lit(f"{kind} "), x)
    keys = F.concat(
        F.array(tell("n", F.col("norm"))), F.when(F.col("base") != "", F.array(tell("b", F.col("base")), tell("t", F.col("base")))).otherwise(F.array().cast("array<string>")), F.when(F.size("core") > 0, F.array(tell("c", F.array_join("core", " ")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("norm") != "", prefixes).otherwise(F.array().cast("array<string>")), F.when(F.col("generic"), F.array(tell("t", F.col("table_name")))).otherwise(F.array().cast("array<string>")),
        F.transform("words", lambda w: F.concat(F.lit("w "), w)), F.when(F.col("table_key") & (F.col("table_token") != ""), F.array(tell("w", F.col("table_token")))).otherwise(F.array().cast("array<string>")),
    )
    side = c.select(F.struct("table", "column", "position", "family", "ident", "norm", "words", "base", "core", "generic", "table_name", "table_token", "table_key").alias("x"), F.explode(F.array_distinct(keys)).alias("key"))
    p = side.select("key", F.col("x").alias("left")).join(side.select("key", F.col("x").alias("right")), "key").where("left.table < right.table").drop("key").distinct()
    p = p.where(compatible(F.col("left.family"), F.col("right.family"))).withColumn("explicit", F.lit(False))
    if declared is not None:
        whole = c.select(F.struct("table", "column", "position", "family", "ident", "norm", "words", "base", "core", "generic", "table_name", "table_token", "table_key").alias("x"))
        d = declared.distinct().join(whole.select(F.col("x").alias("left")), (F.col("left.table") == F.col("left_table")) & (F.col("left.column") == F.col("left_column")))
        d = d.join(whole.select(F.col("x").alias("right")), (F.col("right.table") == F.col("right_table")) & (F.col("right.column") == F.col("right_column"))).select("left", "right")
        d = d.where(compatible(F.col("left.family"), F.col("right.family")))
        p = p.unionByName(d.withColumn("explicit", F.lit(True))).groupBy("left", "right").agg(F.max("explicit").alias("explicit"))
    # of the rules only the last needs Python, and what it gives is under ALIKE: those pairs count only by pointing or if declared
    p = p.withColumn("points", points()).withColumn("score", name_score())
    p = p.where(F.col("explicit") | F.col("points") | (F.col("left.ident") & F.col("right.ident") & (F.col("score") >= ALIKE)))
    p = p.withColumn("score", F.when(F.col("points"), F.greatest("score", F.lit(POINTS))).otherwise(F.col("score")))
    rank = F.desc(F.col("score") + F.when(F.col("explicit"), 0.4).otherwise(0.0))
    p = p.withColumn("r", F.row_number().over(W.partitionBy("left.table", "right.table").orderBy(rank, "left.position", "right.position"))).where(F.col("r") <= keep)
    p = p.orderBy(rank, "left.table", "right.table", "r").limit(most)
    return p.select(F.col("left.table").alias("left_table"), F.col("left.column").alias("left_column"), F.col("right.table").alias("right_table"), F.col("right.column").alias("right_column"), F.col("score").alias("name_similarity"), F.col("explicit").alias("explicit_foreign_key"))


def sketches(tables: dict[str, DataFrame], wanted: dict[str, list[str]], size: int = SKETCH) -> DataFrame:
    """(table, column, value, n, digest, whole): the `size` values of each column, as text, with the smallest MD5, how often each occurs, and whether these are all.

    One pass over each table, whatever the number of columns; nulls are no values. As all columns choose by the same
    digests, the sketches of two columns hold the same ones of the values that both have.
    """
    out = None
    for t, names in wanted.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]))
        d = tables[t].select(pairs.alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
        d = d.withColumn("digest", F.md5(F.col("value").cast("binary")))
        d = d.withColumn("r", F.row_number().over(W.partitionBy("column").orderBy("digest"))).where(F.col("r") <= size + 1)
        d = d.withColumn("whole", F.max("r").over(W.partitionBy("column")) <= size).where(F.col("r") <= size).select(F.lit(t).alias("table"), "column", "value", "n", "digest", "whole")
        out = d if out is None else out.unionByName(d)
    return out


def join_edges(spark: SparkSession, tables: dict[str, DataFrame], foreign_keys: set[tuple] = frozenset(), least: float = 0.55) -> DataFrame:
    """Inferred joins: ends, name_similarity, explicit_foreign_key, overlap, relationship, confidence.

    Declared keys, (table, column, other table, other column), are candidates whatever their names are, and stay whatever their values
    are; they count from either side. Each table with a candidate is read once, for sketches. overlap is the share of common values
    in the smaller of the two sketches, up to the digest that both reach; of columns of few values it is exact.
    That a join meets is known from a common value of the sketches, that a column is not unique from a value that occurs twice there;
    only what they leave open is looked up in the tables: a first row of a semi-join, a first value that is
    there twice. A join that nobody declared needs a unique end, a row that meets, and a confidence of `least`: .45 times the likeness of
    names, .25 if it meets, .2 if declared, .1 times twice the overlap up to 1, and .05 for a unique end.
    """
    every = semantic_tags(columns_of(spark, {n: df.select(*simple(df)) for n, df in tables.items()}))
    turned = [k if k[0] < k[2] else (*k[2:], *k[:2]) for k in foreign_keys]
    declared = [k for k in dict.fromkeys(turned) if k[0] in tables and k[2] in tables]
    schema = ", ".join(f"{e} string" for e in ENDS)
    rows = join_candidates(every, spark.createDataFrame(declared, schema) if declared else None).collect()  # MOST at most
    result = f"{schema}, name_similarity double, explicit_foreign_key boolean, overlap double, relationship string, confidence double"
    if not rows:
        return spark.createDataFrame([], result)
    ends = sorted({(r.left_table, r.left_column) for r in rows} | {(r.right_table, r.right_column) for r in rows})
    path = scratch(spark)
    sketches(tables, {t: [c for x, c in ends if x == t] for t, _ in ends}).write.parquet(path)
    held = spark.read.parquet(path)
    of = held.groupBy("table", "column").agg(F.max("digest").alias("last"), F.first("whole").alias("whole"), (F.max("n") > 1).alias("twice"))
    pairs = spark.createDataFrame([tuple(r[e] for e in ENDS) for r in rows], schema)
    for s in ("left", "right"):
        pairs = pairs.join(of.select(*[F.col(c).alias(f"{s}_{c}") for c in of.columns]), [f"{s}_table", f"{s}_column"], "left")
    reach = lambda s: F.when(F.coalesce(f"{s}_whole", F.lit(True)), "g").otherwise(F.col(f"{s}_last"))
    pairs = pairs.withColumn("reach", F.least(reach("left"), reach("right")))
    values = None
    for s in ("left", "right"):
        v = pairs.join(held.select(F.col("table").alias(f"{s}_table"), F.col("column").alias(f"{s}_column"), "value", "digest"), [f"{s}_table", f"{s}_column"]).where("digest <= reach").select(*ENDS, "value", F.lit(s).alias("side"))
        values = v if values is None else values.unionByName(v)
    met = values.groupBy(*ENDS, "value").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r")).groupBy(*ENDS).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum(F.least("l", "r")).alias("common"))
    known = {tuple(r[e] for e in ENDS): r for r in pairs.join(met, list(ENDS), "left").collect()}
    unique: dict[tuple[str, str], bool] = {}

    def is_unique(t: str, c: str, twice: bool | None, whole: bool | None) -> bool:
        if twice is None or twice or whole:
            return not twice
        if (t, c) not in unique:
            unique[t, c] = tables[t].where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("v")).agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()
        return unique[t, c]

    out = []
    for r in rows:
        k = known[tuple(r[e] for e in ENDS)]
        common, overlap = k.common or 0, (k.common or 0) / max(1, min(k.l or 0, k.r or 0))
        meets = common > 0
        if not meets and not (k.left_whole and k.right_whole) and k.left_whole is not None and k.right_whole is not None:
            right = tables[r.right_table].select(F.col(f"`{r.right_column}`").cast("string").alias("v"))
            meets = not tables[r.left_table].select(F.col(f"`{r.left_column}`").cast("string").alias("v")).join(right, "v", "left_semi").limit(1).isEmpty()
        one = [is_unique(r[f"{s}_table"], r[f"{s}_column"], k[f"{s}_twice"], k[f"{s}_whole"]) for s in ("left", "right")]
        sure = round(min(1.0, 0.45 * r.name_similarity + 0.25 * meets + 0.2 * r.explicit_foreign_key + 0.1 * min(1.0, 2 * overlap) + 0.05 * any(one)), 4)
        if r.explicit_foreign_key or (any(one) and meets and sure >= least):
            kind = ("n:m", "n:1", "1:n", "1:1")[2 * one[0] + one[1]]
            out.append((*(r[e] for e in ENDS), round(r.name_similarity, 4), r.explicit_foreign_key, round(overlap, 4), kind, sure))
    return spark.createDataFrame(out, result)
