"""Batches of tasks, run again: concurrent governed queries, and a checkpoint from which a stopped run goes on."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .governed import Deadline, Rejected, Result, execute

REPLAYED = "slot string, database string, status string, reward double, row_count int, columns_exact boolean, error string"
#: Results that are committed together.
BATCH = 32


class Slots:
    """Results by slot in a folder of a shared store, a batch at a time.

    A batch is written beside its place and renamed to it, so a reader, or a run that goes on after a stop, sees all of it
    or nothing; what was begun and not renamed is not read. A slot is committed once: a later result for it is left out.
    The driver holds the names of the slots, one short text a task.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.folder(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.folder(self.path))
        self.done = {r.slot for r in self.rows().select("slot").collect()}

    def rows(self) -> DataFrame:
        batches = [s.getPath().toString() for s in self.fs.listStatus(self.folder(self.path)) if s.getPath().getName().startswith("batch-")]
        return self.spark.read.schema(self.schema).parquet(*sorted(batches)) if batches else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: list[tuple]) -> None:
        """rows with the slot first."""
        new = list({r[0]: r for r in reversed(rows) if r[0] not in self.done}.values())[::-1]
        if not new:
            return
        name = uuid.uuid4().hex
        self.spark.createDataFrame(new, self.schema).coalesce(1).write.parquet(f"{self.path}/_begun-{name}")
        if not self.fs.rename(self.folder(f"{self.path}/_begun-{name}"), self.folder(f"{self.path}/batch-{name}")):
            raise OSError(f"{self.path}/batch-{name} could not be put in its place")
        self.done |= {r[0] for r in new}


def first_completed(tasks: Iterable, work: Callable[[Any], Any], workers: int) -> Iterable:
    """Results of work(task) as they come, with at most `workers` under way; tasks are taken one by one as there is room."""
    with ThreadPoolExecutor(workers) as pool:
        waiting, running = iter(tasks), set[Future]()
        while True:
            for task in waiting:
                running.add(pool.submit(work, task))
                if len(running) == workers:
                    break
            if not running:
                return
            ended, running = wait(running, return_when=FIRST_COMPLETED)
            for f in ended:
                yield f.result()


def judged(task: Any, run: Callable[[str], Result]) -> tuple:
    """(slot, database, status, reward, row_count, columns_exact, error) of one task; whatever happens to it is its own.

    ok: the result has the task's hash, with rows in their order where the task is ordered, and counts 1. mismatch: it has another. rejected, timeout, error: it
    gave no result.
    """
    head = (task.slot, task.database)
    try:
        r = run(task.sql)
    except Rejected as e:
        return (*head, "rejected", 0.0, None, None, str(e)[:500])
    except Deadline as e:
        return (*head, "timeout", 0.0, None, None, str(e)[:500])
    except PySparkException as e:
        return (*head, "error", 0.0, None, None, e.getCondition() or type(e).__name__)
    except Exception as e:  # a task that fails in a way of its own must not end the others
        return (*head, "error", 0.0, None, None, f"{type(e).__name__}: {e}"[:500])
    same = (r.ordered_sha256 if task.ordered else r.unordered_sha256) == task.sha256
    return (*head, "ok" if same else "mismatch", float(same), len(r.rows), list(r.columns) == list(task.columns), None)


def replay(spark: SparkSession, tasks: DataFrame, path: str, workers: int = 8, batch: int = BATCH, **limits) -> DataFrame:
    """Runs each task's query again, behind the gate, and tells whether it gives what it gave: rows as REPLAYED says.

    tasks: slot (unique, not null), database, sql, ordered, sha256, columns. They come to the driver one partition at a time. `workers`
    queries run at once; the next begins as soon as one ends. Results are committed to `path` in batches as they come; called
    again with the same path, tasks whose slots are there are not run again. limits: of execute().
    """
    slots = Slots(spark, path, REPLAYED)
    held: list[tuple] = []
    open_ = (t for t in tasks.toLocalIterator() if t.slot not in slots.done)
    for row in first_completed(open_, lambda t: judged(t, lambda sql: execute(spark, sql, **limits)), workers):
        held.append(row)
        if len(held) >= batch:
            slots.commit(held)
            held = []
    slots.commit(held)
    return slots.rows()


def replay_report(replayed: DataFrame) -> DataFrame:
    """(database, tasks, reproducible, share, statuses, excluded): by database, statuses as `status:n` in order, and the slots that cannot be used."""
    bad = F.col("reward") != 1.0
    by_status = replayed.groupBy("database", "status").agg(F.count("*").alias("n"))
    statuses = by_status.groupBy("database").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "status", F.col("n").cast("string")))), ",").alias("statuses"))
    d = replayed.groupBy("database").agg(F.count("*").alias("tasks"), F.count_if(~bad).alias("reproducible"), F.array_join(F.sort_array(F.collect_list(F.when(bad, F.col("slot")))), ",").alias("excluded"))
    return d.join(statuses, "database").select("database", "tasks", "reproducible", F.round(F.col("reproducible") / F.col("tasks"), 4).alias("share"), "statuses", "excluded")
