"""All queries of the library itself (the training-data subpackage has its own) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.ordering import ranked
from .plans.authored import AUTHORED, NET
from .plans import micro, more, tasks
from .plans.dialect import DUCK, SPARK, Text
from .sources import read, register

#: Rows of the largest table that p01 deals to a task.
ROWS_A_TASK = 500_000


def from_text(text: Text) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(text(SPARK))

    run.__doc__ = text.__doc__
    return run


def placed(text: Text, order: list[str], dense: bool) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose last step ranks all its rows: Spark's window would have one task for it."""
    run = from_text(text)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked(run(spark, sf_dir).drop("place"), order, "place", dense)

    query.__doc__ = text.__doc__
    return query


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by revenue: three tables, distinct counts, HAVING.

    The text's two distinct counts would have each task keep all its rows three times, in as many tasks as the session has partitions. Here there are as many
    tasks as the lines fill; pairs of brand and order, then of brand and customer, are made equal one after the other.
    """
    lines, orders, parts = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    n = max(1, -(-lines.count() // ROWS_A_TASK))
    net = F.expr(f"CAST({NET} AS DECIMAL(18, 4))").alias("net")
    sold = lines.select("l_orderkey", "l_partkey", net).repartition(n, "l_partkey").join(parts.select("p_partkey", "p_brand").repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    sold = sold.select("l_orderkey", "p_brand", "net").repartition(n, "l_orderkey").join(orders.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = sold.groupBy("p_brand", "l_orderkey", "o_custkey").agg(F.sum("net").alias("net"))
    # an order counts with one of its rows, should it have several customers
    d = d.withColumn("n_orders", (F.row_number().over(W.partitionBy("p_brand", "l_orderkey").orderBy("o_custkey")) == 1).cast("int"))
    d = d.repartition(n, "o_custkey").groupBy("p_brand", "o_custkey").agg(F.sum("n_orders").alias("n_orders"), F.sum("net").alias("net"))
    d = d.groupBy("p_brand").agg(F.sum("n_orders").alias("n_orders"), F.count("o_custkey").alias("n_customers"), F.sum("net").cast("double").alias("revenue"))
    return d.where("n_orders >= 5").orderBy(F.desc("revenue"), "p_brand").limit(15)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: from_text(text) for name, text in AUTHORED.items()}
    found |= {"p01": brands, "c03": placed(AUTHORED["c03"], ["years", "spent"], True), "c09": placed(AUTHORED["c09"], ["spent"], False)}
    return found | micro.QUERIES | tasks.QUERIES | more.QUERIES


def oracle_sql() -> dict[str, str]:
    found = {name: text(DUCK) for name, text in AUTHORED.items()}
    return found | micro.SQL | tasks.SQL | more.SQL
