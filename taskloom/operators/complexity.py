"""Structure of SQL texts: feature counts, tokens, depth, score, families, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import percentiles

# What each feature counts, in a text with white space collapsed, in either case. CTEs have a pattern of their own, as only names that are defined count.
FEATURES = {
    "cte": r"(?:\bWITH\s+(?:RECURSIVE\s+)?|,)\s*([A-Za-z_][\w$]*)\s+AS\s*\(",
    "recursive": r"\bWITH\s+RECURSIVE\b",
    "join": r"\bJOIN\b",
    "left_join": r"\bLEFT(?:\s+OUTER)?\s+JOIN\b",
    "select": r"\bSELECT\b",
    "group_by": r"\bGROUP\s+BY\b",
    "having": r"\bHAVING\b",
    "distinct": r"\bDISTINCT\b",
    "case": r"\bCASE\b",
    "window": r"\bOVER\s*\(",
    "window_navigation": r"\b(?:LAG|LEAD|FIRST_VALUE|LAST_VALUE|NTH_VALUE)\s*\(",
    "window_ranking": r"\b(?:ROW_NUMBER|RANK|DENSE_RANK|NTILE|PERCENT_RANK|CUME_DIST)\s*\(",
    "window_frame": r"\b(?:ROWS|RANGE|GROUPS)\s+BETWEEN\b",
    "set_operation": r"\b(?:UNION(?:\s+ALL)?|INTERSECT|EXCEPT)\b",
    "exists": r"\b(?:NOT\s+)?EXISTS\s*\(",
    "in_subquery": r"\bIN\s*\(\s*SELECT\b",
    "scalar_subquery": r"\(\s*SELECT\b",
    "conditional_aggregate": r"\b(?:SUM|COUNT|AVG|MIN|MAX)\s*\(\s*(?:DISTINCT\s+)?CASE\b",
    "date_time": r"\b(?:DATE|DATETIME|JULIANDAY|STRFTIME|TIMESTAMPDIFF|DATE_TRUNC)\s*\(",
    "json": r"\bJSON_(?:EXTRACT|EACH|ARRAY|OBJECT|TYPE)\s*\(",
    "string_transform": r"\b(?:SUBSTR|REPLACE|INSTR|LOWER|UPPER|TRIM|PRINTF)\s*\(",
    "math": r"\b(?:ABS|ROUND|POWER|SQRT|EXP|LOG|LN|SIN|COS|ACOS|RADIANS)\s*\(",
    "null_handling": r"\b(?:COALESCE|NULLIF|IFNULL)\s*\(",
    "limit": r"\bLIMIT\b",
}
TOKEN = r"[A-Za-z_][\w$]*|\d+(?:\.\d+)?|<>|!=|<=|>=|\S"
WEIGHTS = {"tokens": 0.012, "cte": 1.2, "join": 0.8, "more_selects": 1.4, "window": 2.2, "set_operation": 2.0, "exists": 1.5, "conditional_aggregate": 1.2, "case": 0.8, "date_time": 1.0, "json": 1.0, "depth": 1.2}
QUOTED = r"'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\""
SUMMARY = ("tokens", "score", "cte", "join", "select", "window", "depth")


def profile(texts: DataFrame) -> DataFrame:
    """texts (id, sql, ...) with a count for each feature, chars, tokens, depth, score and families.

    Counts are of the collapsed text; depth, of the original with quoted parts taken out, is
    the most open parentheses around any SELECT. scalar_subquery is less the CTEs. Null
    texts count as empty.
    """
    d = texts.withColumn("_flat", F.trim(F.regexp_replace(F.coalesce("sql", F.lit("")), r"\s+", " ")))
    counts = {name: F.regexp_count("_flat", F.lit(f"(?i){pattern}")) for name, pattern in FEATURES.items()}
    d = d.withColumns(counts).withColumn("scalar_subquery", F.greatest(F.lit(0), F.col("scalar_subquery") - F.col("cte")))
    d = d.withColumn("chars", F.char_length(F.coalesce("sql", F.lit("")))).withColumn("tokens", F.size(F.regexp_extract_all("_flat", F.lit(TOKEN), F.lit(0))))
    marks = F.regexp_extract_all(F.regexp_replace(F.coalesce("sql", F.lit("")), QUOTED, " "), F.lit(r"(?i)[()]|\bSELECT\b"), F.lit(0))
    begin = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))
    step = lambda a, m: F.when(m == "(", F.struct((a["open"] + 1).alias("open"), a["most"].alias("most"))).when(m == ")", F.struct(F.greatest(F.lit(0), a["open"] - 1).alias("open"), a["most"].alias("most"))).otherwise(F.struct(a["open"].alias("open"), F.greatest(a["most"], a["open"]).alias("most")))
    d = d.withColumn("depth", F.aggregate(marks, begin, step)["most"]).withColumn("more_selects", F.greatest(F.lit(0), F.col("select") - 1))
    score = sum((F.col(name) * w for name, w in WEIGHTS.items()), F.lit(0.0))
    some = lambda *names: sum((F.col(n) for n in names), F.lit(0)) > 0
    families = [
        F.when(F.col("cte") >= 3, "multi_stage_cte"), F.when(F.col("window") > 0, "window"), F.when(some("set_operation", "exists", "in_subquery"), "set_or_anti_join"), F.when((F.col("scalar_subquery") >= 2) | (F.col("depth") >= 2), "nested_subquery"),
        F.when((F.col("join") >= 3) & (F.col("cte") >= 2), "grain_safe_multi_fact"), F.when(some("date_time", "window_navigation", "recursive"), "temporal_cohort_or_sequence"), F.when((F.col("case") >= 2) | (F.col("conditional_aggregate") > 0), "nontrivial_derived_classification"),
    ]
    return d.withColumn("score", F.round(score, 3)).withColumn("families", F.array_compact(F.array(*families))).drop("_flat", "more_selects")


def distribution(profiles: DataFrame, features: tuple[str, ...] = SUMMARY) -> DataFrame:
    """(feature, least, p25, p50, p75, p90, most, mean) over all profiles; percentiles interpolate between ranks."""
    long = profiles.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select("s.*")
    g = long.groupBy("feature").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"))
    g = g.join(percentiles(long, "feature", "x", (0.25, 0.5, 0.75, 0.9)), "feature")
    return g.select("feature", "least", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90"))], "most", "mean")


def prevalence(profiles: DataFrame) -> DataFrame:
    """(family, n, share): how many texts are of each family."""
    total = profiles.agg(F.count("*").alias("total"))
    n = profiles.select(F.explode("families").alias("family")).groupBy("family").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total), F.lit(True)).select("family", "n", (F.col("n") / F.col("total")).alias("share"))  # total is one row


def compared(profiles: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Each text against targets: meets_<feature> for each, and meets_all."""
    flags = {f"meets_{f}": F.col(f) >= t for f, t in targets.items()}
    d = profiles.withColumns(flags)
    meets = F.lit(True)
    for f in flags:
        meets = meets & F.col(f)
    return d.withColumn("meets_all", meets)


def reference_rows(correct_ids: DataFrame, tasks: DataFrame, sql: DataFrame, risks: DataFrame) -> DataFrame:
    """(instance_id, db, question, sql, risks): ids that were answered correctly with their task and text; a prefix sf_ does not count."""
    ids = correct_ids.select(F.regexp_replace("instance_id", "^sf_", "").alias("instance_id")).distinct()
    r = risks.groupBy("instance_id").agg(F.sort_array(F.collect_set("risk")).alias("risks"))
    out = ids.join(tasks, "instance_id").join(sql, "instance_id").join(r, "instance_id", "left")
    return out.withColumn("risks", F.coalesce("risks", F.array().cast("array<string>")))


def corpus(spark: SparkSession) -> DataFrame:
    """The library's own authored queries as texts (id, sql)."""
    from ..plans.authored import AUTHORED
    from ..plans.dialect import SPARK

    return spark.createDataFrame([(name, text(SPARK)) for name, text in AUTHORED.items()], "id string, sql string")
