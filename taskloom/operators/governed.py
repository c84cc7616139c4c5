"""Read-only execution of SQL: audit, authorizer, deadline, caps, null counts and result hashes."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import canonical_json, json_safe, stable_hash
from .authorizer import Authorizer

# Words that a read-only text must not hold, in the strict audit.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE", "ATTACH", "DETACH", "PRAGMA", "VACUUM", "REINDEX")
HEAD = r"(?i)^\s*(?:WITH|SELECT)\b"
HARNESS_HEAD = r"(?i)^\s*(?:WITH|SELECT|EXPLAIN|PRAGMA\s+table_info)\b"


def audit(sql: Column, mode: str = "strict") -> Column:
    """Struct (ok, errors) of a text, by looking at the text only.

    `strict`: begins with WITH or SELECT, no FORBIDDEN word anywhere, one statement, and no
    fewer ON than JOIN. `relaxed`: the same, but nothing is asked of joins. `harness`: also
    EXPLAIN and PRAGMA table_info, one statement, nothing else. Words and semicolons in
    literals and comments count, as in the texts' own gate. Null is an error.
    """
    body = F.regexp_replace(F.coalesce(sql, F.lit("")), r"[;\s]+$", "")
    head = HARNESS_HEAD if mode == "harness" else HEAD
    errors = [F.when(~body.rlike(head), "not a query"), F.when(body.contains(";"), "more than one statement")]
    if mode != "harness":
        errors += [F.when(body.rlike(rf"(?i)\b{w}\b"), f"forbidden {w}") for w in FORBIDDEN]
    if mode == "strict":
        errors += [F.when(F.regexp_count(body, F.lit(r"(?i)\bON\b")) < F.regexp_count(body, F.lit(r"(?i)\bJOIN\b")), "join without ON")]
    found = F.array_compact(F.array(*errors))
    return F.struct((F.size(found) == 0).alias("ok"), found.alias("errors"))


def audit_text(sql: str, mode: str = "strict") -> list[str]:
    """audit() of one text, on the driver."""
    body = re.sub(r"[;\s]+$", "", sql or "")
    errors = [] if re.match(HARNESS_HEAD if mode == "harness" else HEAD, body) else ["not a query"]
    errors += ["more than one statement"] * (";" in body)
    if mode != "harness":
        errors += [f"forbidden {w}" for w in FORBIDDEN if re.search(rf"(?i)\b{w}\b", body)]
    if mode == "strict":
        errors += ["join without ON"] * (len(re.findall(r"(?i)\bON\b", body)) < len(re.findall(r"(?i)\bJOIN\b", body)))
    return errors


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a query, before any pruning within them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    null_counts: dict[str, int]
    ordered_sha256: str
    unordered_sha256: str
    plan: str
    elapsed_ms: float
    audit: list[str] = field(default_factory=list)

    @property
    def preview(self) -> list[list]:
        return self.rows[:10]


class Rejected(ValueError):
    """The text is no read-only query, costs too much, or gives too many rows."""


class Deadline(TimeoutError):
    """The query ran longer than it may."""


def hashes(columns: list[str], rows: list[list]) -> tuple[str, str]:
    """SHA-256 over the rows in order, and over the rows sorted as text; names of columns count in both."""
    return stable_hash({"columns": columns, "rows": rows}), stable_hash({"columns": columns, "rows": sorted(map(canonical_json, rows))})


def execute(spark: SparkSession, sql: str, max_rows: int = 10_000, seconds: float = 30.0, max_scan_bytes: int | None = None, mode: str = "strict", relations: Collection[str] | None = None) -> Result:
    """Audit, authorize, plan, run and hash one query.

    What is not refused by audit_text() is judged by Authorizer(spark, relations), before anything in it
    is looked up or run. Only max_rows + 1 rows ever reach the driver; one more than max_rows is an error. The deadline
    counts from the beginning: when it has passed, jobs are cancelled, and nothing is begun after a plan that took too long.
    """
    return _executed(spark, sql, max_rows, seconds, max_scan_bytes, mode, relations)[0]


def _executed(spark: SparkSession, sql: str, max_rows: int = 10_000, seconds: float = 30.0, max_scan_bytes: int | None = None, mode: str = "strict", relations: Collection[str] | None = None) -> tuple[Result, list[Row], StructType]:
    errors = audit_text(sql, mode)
    if errors:
        raise Rejected("; ".join(errors))
    began, tag, late, over = time.monotonic(), f"governed-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        late.set()
        while not over.is_set():  # a job may begin just after the first time
            spark.sparkContext.cancelJobsWithTag(tag)
            over.wait(0.2)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        refused, df = Authorizer(spark, relations).judged(re.sub(r"[;\s]+$", "", sql))
        if refused:
            raise Rejected("; ".join(refused))
        if max_scan_bytes is not None and scanned_bytes(df) > max_scan_bytes:
            raise Rejected(f"it reads {scanned_bytes(df)} bytes; {max_scan_bytes} are allowed")
        capped = df.limit(max_rows + 1)
        capped._jdf.queryExecution().executedPlan()
        if late.is_set():
            raise Deadline(f"its plan took more than {seconds} s")
        got = capped.collect()
    except (Rejected, Deadline):
        raise
    except Exception as e:
        if late.is_set():
            raise Deadline(f"stopped after {seconds} s") from e
        raise
    finally:
        over.set()
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    if len(got) > max_rows:
        raise Rejected(f"more than {max_rows} rows")
    rows = [[json_safe(v) for v in r] for r in got]
    ordered, unordered = hashes(df.columns, rows)
    nulls = {c: sum(r[i] is None for r in rows) for i, c in enumerate(df.columns)}
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return Result(df.columns, rows, nulls, ordered, unordered, plan, (time.monotonic() - began) * 1000), got, df.schema


def submit(spark: SparkSession, sql: str, path: str, **limits) -> Result:
    """A query's final run: executed behind the audit like any other, and the rows that were hashed, in their order, stored as one Parquet file in place of what was there."""
    result, got, schema = _executed(spark, sql, **limits)
    spark.createDataFrame(got, schema).coalesce(1).write.mode("overwrite").parquet(path)
    return result


def result_hash(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """(n_rows, result_hash): an order-free hash of a result of any size, as DataFrame operations.

    Rows are hashed where they are; hashes are counted, and equal ones summed into `buckets`
    partial digests, so no task holds more than its share.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    n = F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")
    m = F.conv(F.substring("h", 13, 12), 16, 10).cast("decimal(38,0)")
    part = df.select(row.alias("h")).groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("b")).agg(F.count("*").alias("c"), F.sum(n).alias("n"), F.sum(m).alias("m"))
    total = part.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    return total.select("n_rows", F.sha2(F.concat_ws(":", F.lit(",".join(df.columns)), "n_rows", "n", "m"), 256).alias("result_hash"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls): in one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(df.columns)])).alias("x")).select("x.*")


def shard_families(names: DataFrame) -> DataFrame:
    """Tables that differ in a date suffix only, as one family: (family, n, first, last)."""
    pattern = r"^(.*_)([0-9]{8})$"
    f = names.select("name", F.regexp_extract("name", pattern, 1).alias("stem"), F.regexp_extract("name", pattern, 2).alias("day"))
    f = f.withColumn("family", F.when(F.col("stem") != "", F.concat("stem", F.lit("*"))).otherwise(F.col("name")))
    return f.groupBy("family").agg(F.count("*").alias("n"), F.min(F.nullif("day", F.lit(""))).alias("first"), F.max(F.nullif("day", F.lit(""))).alias("last"))


def budgeted(actions: DataFrame, budget: float) -> DataFrame:
    """actions (task, seq, cost, ...) with spent, remaining and allowed: an action runs while all before it left something."""
    from pyspark.sql import Window as W

    w = W.partitionBy("task").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    a = actions.withColumn("spent", F.sum("cost").over(w))
    return a.withColumn("remaining", F.greatest(F.lit(0.0), F.lit(budget) - F.col("spent"))).withColumn("allowed", F.col("spent") - F.col("cost") < budget)


def clipped(df: DataFrame, max_chars: int = 300) -> DataFrame:
    """Cells for display: long texts cut, bytes as their length."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "binary":
            c = F.when(c.isNotNull(), F.concat(F.lit("<"), F.length(c).cast("string"), F.lit(" bytes>")))
        else:
            s = c.cast("string")
            c = F.when(F.char_length(s) > max_chars, F.concat(F.substring(s, 1, max_chars), F.lit("..."))).otherwise(s)
        cells.append(F.coalesce(c, F.lit("NULL")).alias(f.name))
    return df.select(*cells)


def rendered(df: DataFrame, max_rows: int = 50, max_chars: int = 300) -> str:
    """A text table of at most max_rows rows, with the number of all rows."""
    rows, total = clipped(df, max_chars).limit(max_rows).collect(), df.count()
    lines = [" | ".join(df.columns), *(" | ".join(r) for r in rows)]
    return "\n".join([*lines, f"{total} rows total, {len(rows)} shown"])


def list_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, rows) of tables or views by name."""
    parts = [spark.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe(spark: SparkSession, names: list[str], samples: int = 3) -> dict[str, dict]:
    """Columns with types, and a few rows, of up to 20 tables."""
    return {n: {"columns": [(f.name, f.dataType.simpleString()) for f in spark.table(n).schema], "rows": [[json_safe(v) for v in r] for r in spark.table(n).limit(samples).collect()]} for n in names[:20]}
