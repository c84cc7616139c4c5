"""The Parquet tables of a scale directory."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES[:8]) -> None:
    """Temporary views of the tables, by name."""
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession) -> str:
    """A new path for files that go when the driver's process ends: below spark.checkpoint.dir, else the warehouse, which executors share; in local mode, where there is one machine, in a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = tempfile.gettempdir() if spark.sparkContext.master.split("[")[0] == "local" else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/taskloom-{uuid.uuid4().hex}"

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        elif os.path.isdir(path):  # the session has ended; a local folder can go without it
            shutil.rmtree(path)

    atexit.register(remove)
    return path
