"""One small query for each relational operator and scalar function, with SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import compat
from ..functions import text as X
from ..sources import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def checked(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def money(c):
    return c.cast("decimal(18,4)")


# Projections, filters and predicates


@checked("SELECT o_orderkey, o_totalprice * 2 AS doubled, o_orderstatus AS status FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
def scan_half_open_range(spark, d):
    o = read(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1996-02-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-03-01").cast("timestamp")))
    return o.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"), F.col("o_orderstatus").alias("status"))


@checked("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 12 AND (p_type LIKE '%A%' OR p_retailprice > 1500) AND p_name IS NOT NULL AND p_brand <> 'Brand#11'")
def filter_predicates(spark, d):
    p = read(spark, d, "part")
    return p.where(F.col("p_size").between(10, 12) & (F.col("p_type").like("%A%") | (F.col("p_retailprice") > 1500)) & F.col("p_name").isNotNull() & (F.col("p_brand") != "Brand#11")).select("p_partkey", "p_name")


@checked("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS level, c.* EXCLUDE (c_custkey) FROM customer c")
def project_star_and_case(spark, d):
    c = read(spark, d, "customer")
    return c.select("*", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 1000, "low").otherwise("high").alias("level"))


@checked("SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE nullif(event_type, 'view') IS NOT NULL")
def filter_sentinel(spark, d):
    e = read(spark, d, "events")
    return e.where(compat.missing(F.col("event_type"), "view").isNotNull()).select("event_id", compat.missing(F.col("event_type"), "error").alias("kind"))


@checked("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def filter_having(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@checked("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.95 FROM orders)")
def filter_scalar_subquery(spark, d):
    o = read(spark, d, "orders")
    top = o.agg((F.max("o_totalprice") * 0.95).alias("bound"))
    return o.join(F.broadcast(top), F.col("o_totalprice") > F.col("bound")).select("o_orderkey", "o_totalprice")  # one row


@checked("WITH RECURSIVE cal(day) AS (SELECT DATE '2024-01-01' UNION ALL SELECT CAST(day + INTERVAL 1 DAY AS DATE) FROM cal WHERE day < DATE '2024-02-15') SELECT day, day(day) AS n FROM cal")
def recursive_calendar(spark, d):
    return spark.sql("WITH RECURSIVE cal(day) AS (SELECT DATE'2024-01-01' UNION ALL SELECT date_add(day, 1) FROM cal WHERE day < DATE'2024-02-15') SELECT day, day(day) AS n FROM cal")


# Joins


@checked("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    big = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@checked("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def join_in_subquery(spark, d):
    large = read(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part").join(large, "p_partkey", "left_semi").select("p_partkey")


@checked("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@checked("SELECT event_id, bucket FROM events JOIN (SELECT 'low' AS bucket, 0.0::DOUBLE AS lo, 10.0::DOUBLE AS hi UNION ALL SELECT 'middle', 10.0, 50.0 UNION ALL SELECT 'high', 50.0, 1e9) b ON value >= lo AND value < hi")
def join_range(spark, d):
    """A few ranges that are known in the plan: broadcast and compared row by row."""
    ranges = spark.createDataFrame([("low", 0.0, 10.0), ("middle", 10.0, 50.0), ("high", 50.0, 1e9)], "bucket string, lo double, hi double")
    return read(spark, d, "events").join(F.broadcast(ranges), (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))).select("event_id", "bucket")


@checked("SELECT a.event_id AS event_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def join_range_binned(spark, d):
    """Events followed within a span of time: both sides meet in bins of that span, so the join is by equality at any size."""
    span = 7200 * 1_000_000
    e = read(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    a = e.where("event_type = 'view'").select("user_id", "event_id", F.col("t").alias("ta"))
    a = a.withColumn("bin", F.explode(F.array(F.floor(F.col("ta") / span), F.floor(F.col("ta") / span) + 1)))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("next_id"), F.col("t").alias("tb"), F.floor(F.col("t") / span).alias("bin"))
    return a.join(b, ["user_id", "bin"]).where((F.col("tb") > F.col("ta")) & (F.col("tb") <= F.col("ta") + span)).select("event_id", "next_id")


@checked("SELECT r_name, event_type, count(e.event_id) AS n FROM region CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN (SELECT *, user_id % 5 AS r FROM events) e USING (event_type) WHERE e.r = r_regionkey OR e.r IS NULL GROUP BY r_name, event_type")
def join_cross_grid(spark, d):
    """A dense grid of two dimensions, filled with counts."""
    e = read(spark, d, "events")
    grid = read(spark, d, "region").select("r_regionkey", "r_name").crossJoin(e.select("event_type").distinct())
    n = e.groupBy((F.col("user_id") % 5).alias("r_regionkey"), "event_type").agg(F.count("*").alias("n"))
    return grid.join(n, ["r_regionkey", "event_type"], "left").select("r_name", "event_type", F.coalesce("n", F.lit(0)).alias("n"))


@checked("SELECT c_custkey, coalesce(sum(CASE WHEN o_orderkey IS NOT NULL THEN 1 END), 0)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY c_custkey")
def join_left_zero(spark, d):
    o = read(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@checked("WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.o_custkey, a.y, a.n, b.n AS n_next FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.y = a.y + 1")
def join_self_shifted(spark, d):
    y = read(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return y.join(y.select("o_custkey", (F.col("y") - 1).alias("y"), F.col("n").alias("n_next")), ["o_custkey", "y"])


@checked("SELECT l_orderkey, l_linenumber, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS share FROM lineitem WHERE l_quantity > 0")
def join_total_to_detail(spark, d):
    """Totals beside details, without a join."""
    return read(spark, d, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / F.sum("l_quantity").over(W.partitionBy("l_orderkey"))).alias("share"))


@checked("SELECT (SELECT count(*) FROM (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey LIMIT 1)) AS orders_customer, (SELECT count(*) FROM (SELECT 1 FROM nation JOIN region ON n_nationkey = r_regionkey + 1000 LIMIT 1)) AS nation_region")
def join_existence_probe(spark, d):
    def probe(left, right, on):
        return left.join(right, on, "left_semi").limit(1).agg(F.count("*").alias("n"))

    a = probe(read(spark, d, "orders"), read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("n", "orders_customer")
    b = probe(read(spark, d, "nation"), read(spark, d, "region"), F.col("n_nationkey") == F.col("r_regionkey") + 1000).withColumnRenamed("n", "nation_region")
    return a.join(F.broadcast(b), F.lit(True))  # one row each


@checked(
    """SELECT (SELECT count(*) FROM (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_returnflag = 'R' AND b.l_returnflag <> 'R' LIMIT 1)) AS returned_and_kept,
    (SELECT count(*) FROM (SELECT 1 FROM lineitem a JOIN part b ON a.l_partkey = b.p_partkey AND a.l_suppkey = -b.p_size LIMIT 1)) AS part_and_size,
    (SELECT count(*) FROM (SELECT 1 FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND a.s_suppkey = b.c_custkey LIMIT 1)) AS same_key_and_nation"""
)
def join_composite_probe(spark, d):
    """Whether two keys together meet: lines of one order and part with and without a return, never-met keys, and suppliers with a customer's number and nation."""
    li, part = read(spark, d, "lineitem"), read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (-F.col("p_size")).cast("long").alias("l_suppkey"))
    probe = lambda a, b, on, name: a.select(*on).join(b.select(*on), on, "left_semi").limit(1).agg(F.count("*").alias(name))
    a = probe(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"), ["l_orderkey", "l_partkey"], "returned_and_kept")
    b = probe(li, part, ["l_partkey", "l_suppkey"], "part_and_size")
    c = probe(read(spark, d, "supplier").toDF("key", "name", "nation", "balance"), read(spark, d, "customer").toDF("key", "name", "nation", "balance", "segment"), ["key", "nation"], "same_key_and_nation")
    return a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(c), F.lit(True))  # one row each


@checked("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_normalized_key(spark, d):
    """Names of one customer in two spellings, joined by the whole normalised key."""
    spelled = F.concat(F.lit("CUSTOMER "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("."))
    a = read(spark, d, "orders").select("o_orderkey", X.normalize_identifier(spelled).alias("k"))
    b = read(spark, d, "customer").select("c_custkey", X.normalize_identifier(F.col("c_name")).alias("k"))
    return a.join(b, "k").select("o_orderkey", "c_custkey")


# Aggregates


@checked("SELECT p_type, count(*) AS n, quantile_cont(p_retailprice::DOUBLE, 0.25) AS p25, quantile_cont(p_retailprice::DOUBLE, 0.5) AS p50, quantile_cont(p_retailprice::DOUBLE, 0.9) AS p90, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part GROUP BY p_type")
def agg_percentile(spark, d):
    q = F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))
    g = read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), q.alias("q"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"))
    return g.select("p_type", "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "least", "most")


@checked("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS users_high, count(DISTINCT event_type || '->' || user_id) AS pairs FROM events GROUP BY event_type")
def agg_cond_distinct(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("users_high"), F.countDistinct(F.concat("event_type", F.lit("->"), F.col("user_id").cast("string"))).alias("pairs"))


@checked("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_f, min(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS first_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_custkey")
def agg_conditional_pivot(spark, d):
    s = F.col("o_orderstatus")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(s == "F", F.col("o_orderdate"))).alias("last_f"), F.min(F.when(s == "O", F.col("o_orderdate"))).alias("first_o"), F.count(F.when(s == "P", 1)).alias("n_p"))


@checked("SELECT sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)::BIGINT AS n_zero, count(*) AS n, 100.0::DOUBLE * sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) / nullif(count(*), 0) AS pct, 1.0::DOUBLE / nullif(sum(0), 0) AS none FROM lineitem")
def agg_protected_ratio(spark, d):
    zero = F.sum(F.when(F.col("l_discount") == 0, 1).otherwise(0))
    return read(spark, d, "lineitem").agg(zero.alias("n_zero"), F.count("*").alias("n"), (F.lit(100.0) * zero / F.nullif(F.count("*"), F.lit(0))).alias("pct"), compat.div(F.lit(1.0), F.sum(F.lit(0))).alias("none"))


@checked("SELECT c_mktsegment, avg(n) AS mean_orders, max(n) AS most FROM (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey) GROUP BY c_mktsegment")
def agg_two_grains(spark, d):
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = read(spark, d, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.groupBy("c_mktsegment").agg(F.avg("n").alias("mean_orders"), F.max("n").alias("most"))


@checked("SELECT 'lineitem' AS t, count(*) AS n, count(l_tax) AS nn_tax, count(DISTINCT l_tax) AS nd_tax, count(DISTINCT l_linenumber) AS nd_line, count(*) FILTER (isnan(l_tax)) AS n_nan, count(*) FILTER (isinf(l_tax)) AS n_inf FROM lineitem")
def agg_single_pass(spark, d):
    t = F.col("l_tax")
    return read(spark, d, "lineitem").agg(F.lit("lineitem").alias("t"), F.count("*").alias("n"), F.count(t).alias("nn_tax"), F.countDistinct(t).alias("nd_tax"), F.countDistinct("l_linenumber").alias("nd_line"), F.count_if(F.isnan(t)).alias("n_nan"), F.count_if(F.abs(t) == float("inf")).alias("n_inf"))


@checked("SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 LIMIT 1)")
def agg_duplicate_exists(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).where("c > 1").limit(1).agg(F.count("*").alias("n"))


@checked("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 7")
def agg_top_values(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(7)


@checked("SELECT median(n) AS median_n, list_sort(list(n))[((count(*) + 1) * 9 // 10)::INT] + ((count(*) + 1) * 0.9::DOUBLE - ((count(*) + 1) * 9 // 10)) * (list_sort(list(n))[least(count(*), (count(*) + 1) * 9 // 10 + 1)::INT] - list_sort(list(n))[((count(*) + 1) * 9 // 10)::INT]) AS decile FROM (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey)")
def agg_median_decile(spark, d):
    """Median, and the ninth exclusive decile: place (n + 1) * 9 / 10 among sorted values, between neighbours in proportion."""
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"))
    counted = n.groupBy("n").agg(F.count("*").alias("c"))  # few distinct values stand for all rows
    run = counted.withColumn("upto", F.sum("c").over(W.orderBy("n"))).withColumn("total", F.sum("c").over(W.partitionBy()))
    place = (F.col("total") + 1) * 0.9
    low, high = F.least(F.floor(place), F.col("total")), F.least(F.floor(place) + 1, F.col("total"))
    cut = run.agg(F.min(F.when(F.col("upto") >= low, F.col("n"))).alias("a"), F.min(F.when(F.col("upto") >= high, F.col("n"))).alias("b"), F.max(place - F.floor(place)).alias("f"))
    return cut.select((F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("decile")).join(F.broadcast(n.agg(F.median("n").alias("median_n"))), F.lit(True))


@checked("SELECT event_type, day(ts) AS d, count(*) AS n FROM events GROUP BY event_type, day(ts)")
def agg_counter_merge(spark, d):
    """Counters of parts merged by sum."""
    part = read(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").alias("d"), (F.col("event_id") % 7).alias("part")).agg(F.count("*").alias("n"))
    return part.groupBy("event_type", "d").agg(F.sum("n").alias("n"))


# Windows


@checked("SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, first_value(event_type) OVER w AS first, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_nav(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = F.col("event_type")
    return read(spark, d, "events").select("event_id", F.lag(e).over(w).alias("before"), F.lead(e).over(w).alias("after"), F.first(e).over(w).alias("first"), F.last(e).over(whole).alias("last"), F.nth_value(e, 2).over(whole).alias("second"))


@checked("SELECT p_partkey, row_number() OVER w AS rn, rank() OVER r AS rk, dense_rank() OVER r AS dr, ntile(4) OVER w AS nt, percent_rank() OVER r AS pr, cume_dist() OVER r AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), r AS (PARTITION BY p_brand ORDER BY p_size)")
def win_rank(spark, d):
    w, r = W.partitionBy("p_brand").orderBy("p_size", "p_partkey"), W.partitionBy("p_brand").orderBy("p_size")
    return read(spark, d, "part").select("p_partkey", F.row_number().over(w).alias("rn"), F.rank().over(r).alias("rk"), F.dense_rank().over(r).alias("dr"), F.ntile(4).over(w).alias("nt"), F.percent_rank().over(r).alias("pr"), F.cume_dist().over(r).alias("cd"))


@checked("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)::BIGINT AS prior3, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS groups1 FROM part")
def win_frames(spark, d):
    """ROWS and RANGE as they are; GROUPS as RANGE over the dense rank."""
    p = read(spark, d, "part").withColumn("g", F.dense_rank().over(W.partitionBy("p_brand").orderBy("p_size")))
    b = W.partitionBy("p_brand")
    return p.select("p_partkey", F.sum("p_size").over(b.orderBy("p_partkey").rowsBetween(-3, -1)).alias("prior3"), F.count("*").over(b.orderBy("p_size").rangeBetween(-2, 2)).alias("near"), F.sum("p_size").over(b.orderBy("g").rangeBetween(-1, 0)).alias("groups1"))


@checked("SELECT o_custkey, o_orderkey, sum(o_totalprice::DECIMAL(18,4)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS running, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM orders")
def win_running(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(money(F.col("o_totalprice"))).over(w).cast("double").alias("running"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).over(w).alias("island"))


@checked("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def win_argmax(spark, d):
    """The row of each group's maximum as one aggregate, which combines before the shuffle."""
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


# Order, limits and sets


@checked("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_totalprice ASC, o_orderkey LIMIT 40")
def sort_top_k(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_orderpriority"), F.asc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority")


@checked("SELECT p_partkey, p_size, r FROM (SELECT *, dense_rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 2")
def sort_top_k_ties(spark, d):
    """Ties kept: the few largest values first, then the rows that have one."""
    p = read(spark, d, "part")
    top = p.select("p_size").distinct().orderBy(F.desc("p_size")).limit(2).withColumn("r", F.dense_rank().over(W.orderBy(F.desc("p_size"))))
    return p.join(F.broadcast(top), "p_size").select("p_partkey", "p_size", "r")


@checked("SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3")
def sort_partitioned_top_k(spark, d):
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(w).alias("rn")).where("rn <= 3")


@checked("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@checked("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@checked("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersect(spark, d):
    e = read(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@checked("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_except(spark, d):
    e = read(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").subtract(e.where("event_type = 'purchase'").select("user_id"))


@checked("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def set_distinct(spark, d):
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@checked("WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS s, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, len(list_intersect(s, ['F', 'O']))::INT AS common, len(list_distinct(list_concat(s, ['F', 'X'])))::INT AS either, len(list_filter(s, lambda x: NOT list_contains(['F'], x)))::INT AS without FROM a")
def set_arrays(spark, d):
    s = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    lit = lambda *x: F.array(*map(F.lit, x))
    return s.select("o_custkey", F.size(F.array_intersect("s", lit("F", "O"))).alias("common"), F.size(F.array_union("s", lit("F", "X"))).alias("either"), F.size(F.array_except("s", lit("F"))).alias("without"))


# Scalar functions


@checked("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, year(o_orderdate) AS y, month(o_orderdate) AS mo, (year(o_orderdate) // 10 * 10)::BIGINT AS decade, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_m, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 DAY AS DATE) AS day_before, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) / 86400000000.0::DOUBLE AS julian, ((year(o_orderdate) * 12 + month(o_orderdate)) - (1995 * 12 + 1))::INT AS months, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::INT AS days FROM orders")
def fn_date(spark, d):
    x, origin = F.col("o_orderdate"), F.lit("1995-01-01")
    return read(spark, d, "orders").select(
        "o_orderkey", compat.date_of(x).alias("d"), compat.start_of_month(x).alias("m"), compat.start_of_quarter(x).alias("q"), F.year(x).alias("y"), F.month(x).alias("mo"), compat.decade(x).cast("long").alias("decade"),
        compat.plus_months(compat.start_of_month(x), 1).alias("next_m"), F.date_sub(compat.date_of(x), 1).alias("day_before"), compat.julian_days(x, origin).alias("julian"), compat.month_difference(x, origin.cast("date")).alias("months"), F.date_diff(compat.date_of(x), origin.cast("date")).alias("days"),
    )


@checked("SELECT p_partkey, p_brand || '/' || p_type AS both, substr(p_name, 2, 4) AS part, instr(p_name, 'a')::INT AS at, replace(p_name, 'a', 'A') AS r, lower(p_name) AS lo, upper(p_name) AS up, trim('  ' || p_name || ' ') AS t, printf('%05d-%s', p_size, p_brand) AS f, p_name ILIKE '%A%' AS has_a, length(p_name)::INT AS n FROM part")
def fn_string(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select(
        "p_partkey", compat.concat(F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("both"), F.substring(n, 2, 4).alias("part"), F.instr(n, "a").alias("at"), F.replace(n, F.lit("a"), F.lit("A")).alias("r"), F.lower(n).alias("lo"), F.upper(n).alias("up"),
        F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.format_string("%05d-%s", "p_size", "p_brand").alias("f"), compat.like(n, "%a%").alias("has_a"), F.length(n).alias("n"),
    )


@checked("SELECT p_partkey, abs(p_size - 25)::INT AS a, round(power(p_size, 2), 6) AS p, round(sqrt(p_size), 6) AS s, round(exp(p_size / 50.0), 6) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS lg, round(sin(p_size), 6) AS si, round(cos(p_size), 6) AS co, round(acos(p_size / 100.0), 6) AS ac, round(radians(p_size), 6) AS ra, (p_size // 7)::BIGINT AS q FROM part WHERE p_size > 0")
def fn_math(spark, d):
    s = F.col("p_size")
    r = lambda c, name: F.round(c, 6).alias(name)
    return read(spark, d, "part").where("p_size > 0").select("p_partkey", F.abs(s - 25).alias("a"), r(F.pow(s, 2), "p"), r(F.sqrt(s), "s"), r(F.exp(s / 50.0), "e"), r(F.ln(s), "l"), r(compat.log10(s), "lg"), r(F.sin(s), "si"), r(F.cos(s), "co"), r(F.acos(s / 100.0), "ac"), r(F.radians(s), "ra"), compat.int_div(s, F.lit(7)).alias("q"))


@checked("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1, len(json_keys(props))::INT AS n_keys, '[' || event_id || ',\"' || event_type || '\"]' AS pair, '{\"id\":' || event_id || '}' AS obj FROM events")
def fn_json(spark, d):
    p = F.col("props")
    kind = F.when(p.startswith("{"), "OBJECT").when(p.startswith("["), "ARRAY")
    pair = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(',"'), "event_type", F.lit('"]'))
    return read(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").alias("k"), kind.alias("kind"), (F.get_json_object(p, "$.k").cast("long") + 1).alias("k1"), F.size(F.json_object_keys(p)).alias("n_keys"), pair.alias("pair"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("obj"))


@checked("SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) , LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def fn_json_each(spark, d):
    m = F.from_json("props", "map<string,string>")
    return read(spark, d, "events").select("event_id", F.explode(m).alias("key", "value"))


@checked("SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS kind, ifnull(nullif(event_type, 'view'), '?') AS other, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS maybe FROM events")
def fn_null(spark, d):
    e = F.col("event_type")
    return read(spark, d, "events").select("event_id", F.coalesce(F.nullif(e, F.lit("error")), F.lit("none")).alias("kind"), F.ifnull(F.nullif(e, F.lit("view")), F.lit("?")).alias("other"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("maybe"))


@checked("SELECT s, coalesce(TRY_CAST(nullif(regexp_extract(s, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS i, TRY_CAST(s AS DATE) AS d FROM (SELECT unnest(['12abc', ' -7', 'x', '', '3.9', '2020-01-31', '2020-13-01']) AS s)")
def fn_cast(spark, d):
    s = spark.createDataFrame([(x,) for x in ("12abc", " -7", "x", "", "3.9", "2020-01-31", "2020-13-01")], "s string")
    return s.select("s", compat.to_int(F.col("s")).alias("i"), compat.date_of(F.col("s")).alias("d"))


@checked("SELECT a, b, CASE WHEN b <> 0 THEN (a / b)::DOUBLE END AS real, CASE WHEN b <> 0 THEN trunc(a / b)::BIGINT END AS whole FROM (SELECT p_partkey % 11 - 5 AS a, p_size % 4 - 1 AS b FROM part)")
def fn_division(spark, d):
    p = read(spark, d, "part").select((F.col("p_partkey") % 11 - 5).alias("a"), (F.col("p_size") % 4 - 1).cast("long").alias("b"))
    return p.select("a", "b", compat.div(F.col("a"), F.col("b")).alias("real"), compat.int_div(F.col("a"), F.col("b")).alias("whole"))


@checked("SELECT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm, lower(trim(regexp_replace(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS words, (SELECT array_to_string(w[:-2], '') || CASE WHEN regexp_matches(w[-1], '^.+ies$') THEN regexp_replace(w[-1], 'ies$', 'y') WHEN regexp_matches(w[-1], '^.+[^s]s$') THEN regexp_replace(w[-1], 's$', '') ELSE w[-1] END FROM (SELECT string_split(lower(trim(regexp_replace(CASE p_partkey % 3 WHEN 0 THEN p_type || '_categories' WHEN 1 THEN p_type || 'Is' ELSE p_type || ' classes_boss' END, '[^A-Za-z0-9]+|([a-z0-9])([A-Z])', '\\1 \\2', 'g'))), ' ') AS w)) AS one, sha256('7' || chr(0) || p_partkey::VARCHAR) AS ord FROM part")
def text_identifiers(spark, d):
    return read(spark, d, "part").select("p_name", X.normalize_identifier(F.col("p_name")).alias("norm"), X.humanize(F.col("p_type")).alias("words"), X.singular(F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, "_categories").when(F.col("p_partkey") % 3 == 1, "Is").otherwise(" classes_boss"))).alias("one"), X.stable_order_key("7", F.col("p_partkey")).alias("ord"))
