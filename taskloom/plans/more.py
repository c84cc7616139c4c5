"""Queries for sources, sinks and small operators: what is written is read again, and inputs are made of the tables."""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, complexity, curriculum, governed, joins, messages, trajectories, validate
from ..operators.authorizer import Authorizer
from ..sources import databases, files, read, register, scratch
from .authored import AUTHORED
from .dialect import DUCK, SPARK
from .tasks import Query, quoted

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def checked(sql: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# Sources


@checked("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def src_table_scan(spark, d):
    """A read-only scan: the filter and the two columns reach the Parquet reader."""
    return read(spark, d, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'").select("o_orderkey", "o_totalprice")


@checked("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def src_jsonl(spark, d):
    """Events as JSON lines, written with blank lines between and read with a required field."""
    path = scratch(spark)
    e = read(spark, d, "events").where("event_type <> 'error'").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    e.unionByName(spark.range(20).select(F.lit("  ").alias("value"))).write.text(path)
    return files.read_jsonl(spark, path, "event_id long, user_id long, event_type string", required=("event_id",))


@checked("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS broken, count(DISTINCT event_id) FILTER (event_type <> 'error') AS good FROM events")
def src_jsonl_loose(spark, d):
    """Lines that do not parse are kept as they are."""
    path = scratch(spark)
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{oops "), "event_id")).otherwise(F.to_json(F.struct("event_id")))
    read(spark, d, "events").select(line.alias("value")).write.text(path)
    r = files.read_jsonl(spark, path, "event_id long", strict=False)
    return r.agg(F.count("*").alias("n"), F.count("_corrupt_record").alias("broken"), F.countDistinct("event_id").alias("good"))


@checked("SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def src_sessions(spark, d):
    """Session logs, compressed, with lines that do not parse among them."""
    path = scratch(spark)
    c = read(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role")).alias("value"))
    c.unionByName(spark.range(7).select(F.lit("{").alias("value"))).write.option("compression", "gzip").text(path)
    s = files.read_sessions(spark, path, "conv_id long, turn long, role string").where("event.conv_id IS NOT NULL")
    return s.groupBy("event.conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("event.role") == "assistant").alias("answers"))


@checked("SELECT doc_id::VARCHAR AS instance_id FROM labels")
def src_ids(spark, d):
    path = scratch(spark)
    ids = read(spark, d, "labels").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "sf_").otherwise(""), F.col("doc_id").cast("string")).alias("instance_id"), F.lit("x").alias("other"))
    ids.write.csv(path, header=True)
    return files.read_ids(spark, path)


@checked("SELECT r_regionkey, r_name FROM region")
def src_json_tree(spark, d):
    """One document a file, in folders."""
    path = scratch(spark)
    read(spark, d, "region").withColumn("k", F.col("r_regionkey") % 2).write.partitionBy("k").option("maxRecordsPerFile", 1).json(path)
    return files.read_json_tree(spark, path, "r_regionkey int, r_name string")


@checked("SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'own ' || n_name WHEN 1 THEN 'data of ' || n_name WHEN 2 THEN 'tail of ' || n_name END AS description FROM nation")
def src_docs_lookup(spark, d):
    """Descriptions of a name itself, of <name>_data, and of what follows a double underscore."""
    n = read(spark, d, "nation")
    k = F.col("n_nationkey") % 4
    names = n.select(F.concat(F.when(k == 2, "x__").otherwise(""), "n_name").alias("name"))
    key = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("n_name", F.lit("_data"))).when(k == 2, F.col("n_name")).otherwise("unheard of")
    text = F.concat(F.when(k == 0, "own ").when(k == 1, "data of ").otherwise("tail of "), "n_name")
    found = catalog.documented(names, n.select(key.alias("name"), text.alias("description")))
    return found.select(F.regexp_replace("name", "^x__", "").alias("name"), "description")


@checked(
    """SELECT 't_' || n_nationkey AS "table", NULL AS "column", CASE n_nationkey % 4 WHEN 0 THEN 'Told by ' || n_name WHEN 1 THEN 'Block of ' || n_nationkey WHEN 2 THEN 'Lines of ' || n_nationkey || ' in two' ELSE 'Late ' || n_nationkey END AS description FROM nation
    UNION ALL SELECT 't_' || n_nationkey, 'c', 'Column of ' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0"""
)
def src_yaml_docs(spark, d):
    """A YAML file a nation: quoted, by doc(), in a block, or nothing but in a later file; columns of some; models, seeds and sources by turns."""
    k, key = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    n = read(spark, d, "nation")
    said = F.when(k % 4 == 0, F.concat(F.lit("description: 'Told by "), "n_name", F.lit("'"))).when(k % 4 == 1, F.concat(F.lit("description: \"{{ doc('b_"), key, F.lit("') }}\""))).when(k % 4 == 2, F.concat(F.lit("description: >\n        Lines of "), key, F.lit("\n        in two"))).otherwise("description: \"{{ doc('missing') }}\"")
    column = F.when(k % 2 == 0, F.concat(F.lit("\n    columns:\n      - name: c\n        description: Column of "), key)).otherwise("")
    head = F.when(k % 3 == 0, "models:").otherwise("seeds:")
    first = F.concat(F.lit("version: 2\n# tables\n"), head, F.lit("\n  - name: t_"), key, F.lit("\n    "), said, column, F.lit("\n"))
    late = F.concat(F.lit("sources:\n  - name: raw\n    description: of no table\n    tables:\n      - name: t_"), key, F.lit("\n        description: Late "), key)
    yaml = n.select(F.lit("a.yml").alias("path"), first.alias("text")).unionByName(n.select(F.lit("b.yml").alias("path"), late.alias("text")))
    docs = files.doc_blocks(n.select(F.lit("c.md").alias("path"), F.concat(F.lit("{% docs b_"), key, F.lit(" %}Block of "), key, F.lit("{% enddocs %}")).alias("text")))
    return files.harvested(yaml, docs)


def _file(spark, d) -> str:
    """A folder of SQLite files that executors see too: the two small tables in one, orders in as many as tasks write."""
    folder = scratch(spark).removeprefix("file:")
    os.makedirs(folder)
    path = f"{folder}/tables.sqlite"
    databases.write_sqlite(read(spark, d, "region"), path, "region", ("r_regionkey",))
    databases.write_sqlite(read(spark, d, "nation"), path, "nation", ("n_nationkey",), {"n_regionkey": "region"})
    databases.write_sqlite_parts(read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("half"), "o_orderdate"), folder, "orders", ("o_orderkey", "half"))
    return folder


@checked("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS half, year(o_orderdate)::VARCHAR AS y FROM orders")
def src_sqlite(spark, d):
    """Orders through a SQLite file: written, and scanned read-only in ranges of row ids."""
    o = databases.read_database(spark, "sqlite", _file(spark, d), "orders", 4)
    return o.select("o_orderkey", "o_totalprice", "half", F.substring("o_orderdate", 1, 4).alias("y"))


@checked("SELECT n_nationkey, n_name, n_regionkey, n_nationkey % 2 = 0 AS even FROM nation")
def src_duckdb(spark, d):
    """Nations through a DuckDB file."""
    import duckdb

    folder = scratch(spark).removeprefix("file:")
    os.makedirs(folder)
    path = f"{folder}/tables.duckdb"
    con = duckdb.connect(path)
    con.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name VARCHAR, n_regionkey INTEGER, even BOOLEAN)")
    con.executemany("INSERT INTO nation VALUES (?, ?, ?, ?)", [(*r, r[0] % 2 == 0) for r in map(tuple, read(spark, d, "nation").collect())])
    con.close()
    return databases.read_database(spark, "duckdb", path, "nation", 3)


@checked(
    """SELECT * FROM (VALUES ('nation', 0, 'n_nationkey', 'INTEGER', 1, true, NULL), ('nation', 1, 'n_name', 'TEXT', 0, false, NULL), ('nation', 2, 'n_regionkey', 'INTEGER', 0, false, 'region.r_regionkey'), ('region', 0, 'r_regionkey', 'INTEGER', 1, true, NULL), ('region', 1, 'r_name', 'TEXT', 0, false, NULL),
    ('orders', 0, 'o_orderkey', 'INTEGER', 1, false, NULL), ('orders', 1, 'o_totalprice', 'REAL', 0, false, NULL), ('orders', 2, 'half', 'TEXT', 2, false, NULL), ('orders', 3, 'o_orderdate', 'TEXT', 0, false, NULL)) t("table", position, "column", declared, key, "unique", "references")"""
)
def src_introspected(spark, d):
    """Columns, keys and references of the file's tables."""
    return databases.introspected(spark, "sqlite", _file(spark, d)).drop("not_null")


@checked("SELECT 'nation' AS left_table, 'n_regionkey' AS left_column, 'region' AS right_table, 'r_regionkey' AS right_column, true AS explicit_foreign_key, 'n:1' AS relationship")
def cat_file_joins(spark, d):
    """Joins of the file's tables, with the keys that it declares."""
    path = _file(spark, d)
    known = databases.introspected(spark, "sqlite", path).where("references IS NOT NULL").collect()
    keys = {(r.table, r.column, *r.references.split(".")) for r in known}
    tables = {t: databases.read_database(spark, "sqlite", path, t, 2) for t in ("nation", "region")}
    return joins.join_edges(spark, tables, keys).drop("name_similarity", "overlap", "confidence")


# Sinks


@checked("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def sink_table(spark, d):
    """Written twice into one place: the second replaces the first, and the folder tells the key."""
    path = scratch(spark)
    n = read(spark, d, "nation")
    for part in (n.limit(3), n):
        files.write_table(part, path, ("n_regionkey",))
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@checked("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer")
def sink_jsonl(spark, d):
    """Null fields are written too."""
    path = scratch(spark)
    files.write_jsonl(read(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance")), path)
    lines = spark.read.text(path)
    return lines.where(F.contains("value", F.lit('"balance":'))).select(F.from_json("value", "c_custkey long, c_name string, balance double").alias("x")).select("x.*")


@checked("SELECT s_suppkey, s_name || ', \"' || s_nationkey || '\"' AS label FROM supplier")
def sink_csv(spark, d):
    """Commas and quotes in cells come back."""
    path = scratch(spark)
    files.write_csv(read(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "'), "s_nationkey", F.lit('"')).alias("label")), path)
    return spark.read.option("escape", "\\").csv(path, header=True, schema="s_suppkey long, label string")


@checked("SELECT p_partkey AS id, 'Describe ' || p_name AS prompt FROM part")
def sink_prompts(spark, d):
    """Prompts, read again and counted before they are given out."""
    path = scratch(spark)
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Describe "), "p_name").alias("prompt"))
    files.write_verified(p, path, "id")
    return spark.read.schema(p.schema).json(path)


@checked("SELECT line, row_number() OVER (ORDER BY o) AS no FROM (SELECT '# Regions' AS line, -5 AS o UNION ALL SELECT '', -4 UNION ALL SELECT '| r_regionkey | r_name |', -3 UNION ALL SELECT '|---|---|', -2 UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' \\| |', r_regionkey FROM region)")
def sink_markdown(spark, d):
    r = read(spark, d, "region").orderBy("r_regionkey").select("r_regionkey", F.concat("r_name", F.lit(" |")).alias("r_name"))
    lines = files.markdown(r, "Regions").rstrip("\n").split("\n")
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(lines)], "line string, no long")


@checked("SELECT line, row_number() OVER (ORDER BY o) AS no FROM (SELECT 'n_nationkey | n_name' AS line, -1 AS o UNION ALL SELECT n_nationkey || ' | ' || CASE WHEN length(n_name) > 6 THEN left(n_name, 6) || '...' ELSE n_name END, n_nationkey FROM nation WHERE n_nationkey < 10 UNION ALL SELECT (SELECT count(*) FROM nation) || ' rows total, 10 shown', 1000)")
def sink_text_table(spark, d):
    text = governed.rendered(read(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name"), 10, 6)
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(text.split("\n"))], "line string, no long")


@checked(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, sha256(coalesce(string_agg(k, ',' ORDER BY k), '')) AS digest FROM (SELECT {c}::VARCHAR AS k FROM {t})" for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("labels", "doc_id"))))
def sink_catalog(spark, d):
    """Catalog documents with a manifest: what the manifest says of each is what is read back from it."""
    path = scratch(spark)
    tables = {"region": "r_regionkey", "nation": "n_nationkey", "labels": "doc_id"}
    return files.write_catalog(spark, {t: read(spark, d, t).select(F.col(c).cast("string").alias("k")) for t, c in tables.items()}, path)


# Governed execution


#: A statement for each nation, in eighteen forms, in a text that is the same in both dialects.
_STATEMENT = """SELECT n_nationkey, CASE n_nationkey % 18
    WHEN 0 THEN concat('SELECT count(*) FROM nation WHERE n_name = ', chr(39), n_name, chr(39))
    WHEN 1 THEN concat('DROP TABLE ', n_name)
    WHEN 2 THEN concat('SELECT reflect(', chr(39), 'java.lang.System', chr(39), ', ', chr(39), 'getProperty', chr(39), ', ', chr(39), n_name, chr(39), ')')
    WHEN 3 THEN concat('SELECT * FROM text.`/data/', n_name, '`')
    WHEN 4 THEN concat('WITH a AS (SELECT java_method(n_name, ', chr(39), 'x', chr(39), ') AS j FROM nation) SELECT * FROM a WHERE j <> ', chr(39), n_name, chr(39))
    WHEN 5 THEN concat('SELECT n_name FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM parquet.`s3://bucket/', n_name, '`)')
    WHEN 6 THEN concat('SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE EXISTS (SELECT 1 FROM range(', n_nationkey, '))')
    WHEN 7 THEN concat('SELECT (SELECT max(try_reflect(', chr(39), n_name, chr(39), ', ', chr(39), 'm', chr(39), ')) FROM region) FROM nation')
    WHEN 8 THEN concat('CREATE TABLE t', n_nationkey, ' AS SELECT * FROM nation')
    WHEN 9 THEN concat('SELECT shouted(n_name) FROM nation WHERE n_regionkey = ', n_regionkey)
    WHEN 10 THEN concat('SELECT n_regionkey, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS s FROM nation WHERE n_nationkey > ', n_nationkey)
    WHEN 11 THEN concat('SELECT * FROM unknown_', n_nationkey)
    WHEN 12 THEN concat('SELECT x FROM nation LATERAL VIEW explode(array(', n_nationkey, ', 2)) AS x')
    WHEN 13 THEN concat('SELECT TRANSFORM(n_name) USING ', chr(39), 'cat ', n_name, chr(39), ' FROM nation')
    WHEN 14 THEN concat('SELECT * FROM IDENTIFIER(', chr(39), n_name, chr(39), ')')
    WHEN 15 THEN concat('INSERT INTO nation SELECT * FROM nation WHERE n_name = ', chr(39), n_name, chr(39))
    WHEN 16 THEN concat('SELECT upper(n_name), ', n_nationkey, ' AS k FROM nation UNION ALL SELECT r_name, 0 FROM region')
    ELSE concat('SELECT * FROM VALUES (reflect(', chr(39), n_name, chr(39), ', ', chr(39), 'x', chr(39), ')) AS v(a)') END AS statement FROM nation"""


@checked(
    f"""WITH s AS ({_STATEMENT}), paths AS (SELECT *, regexp_extract(statement, '(text|parquet)\\.`([^`]*)`', 0) AS path, regexp_extract(lower(statement), '\\b(try_reflect|reflect|java_method|shouted) *\\(', 1) AS fn FROM s)
    SELECT n_nationkey, statement, CASE WHEN regexp_matches(statement, '^(DROP|CREATE|INSERT)\\b') THEN 'command' WHEN contains(statement, ' USING ') THEN 'operator ScriptTransformation' WHEN contains(statement, 'IDENTIFIER(') THEN 'name by expression'
      WHEN fn <> '' THEN 'function ' || fn WHEN path <> '' THEN 'relation ' || replace(path, '`', '') WHEN contains(statement, 'unknown_') THEN 'relation ' || regexp_extract(statement, 'unknown_[0-9]+', 0) ELSE '' END AS refused FROM paths"""
)
def gov_authorizer(spark, d):
    """Statements made of rows, with the reasons for which their plans are refused: commands, paths, methods of classes, functions that are not Spark's own, scripts."""
    register(spark, d)
    spark.udf.register("shouted", lambda x: x)
    judge = Authorizer(spark)
    rows = spark.sql(_STATEMENT).collect()  # one a nation
    return spark.createDataFrame([(r.n_nationkey, r.statement, "; ".join(judge.refusals(r.statement))) for r in rows], "n_nationkey int, statement string, refused string")


@checked("SELECT * FROM (VALUES ('none', true), ('huge', true), ('tiny', false)) t(cap, ran)")
def gov_scan_cap(spark, d):
    """A query that may read everything, much, or one byte."""
    register(spark, d)
    rows = []
    for cap, most in (("none", None), ("huge", 1 << 60), ("tiny", 1)):
        ran = False
        with contextlib.suppress(governed.Rejected):
            ran = bool(governed.execute(spark, AUTHORED["c01"](SPARK), max_scan_bytes=most).rows)
        rows.append((cap, ran))
    return spark.createDataFrame(rows, "cap string, ran boolean")


@checked(
    """SELECT table_name AS "table", column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' END AS declared, CASE table_name WHEN 'region' THEN least(3, (SELECT count(*) FROM region)) WHEN 'nation' THEN least(3, (SELECT count(*) FROM nation)) ELSE least(3, (SELECT count(*) FROM customer)) END::INT AS shown
    FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer')"""
)
def gov_describe(spark, d):
    register(spark, d)
    known = governed.describe(spark, ["region", "nation", "customer"])
    return spark.createDataFrame([(t, c, kind, len(x["rows"])) for t, x in known.items() for c, kind in x["columns"]], "table string, column string, declared string, shown int")


@checked(f"SELECT * FROM ({AUTHORED['c01'](DUCK)})")
def gov_submit(spark, d):
    """A query that was tried, submitted: executed once more, and the rows that were hashed then read from where they are stored."""
    register(spark, d)
    tried = governed.execute(spark, AUTHORED["c01"](SPARK))
    path = scratch(spark)
    if governed.submit(spark, AUTHORED["c01"](SPARK), path).ordered_sha256 != tried.ordered_sha256:
        raise ValueError("a second run differs")
    return spark.read.parquet(path)


@checked("SELECT year(o_orderdate) AS y, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished FROM orders GROUP BY y HAVING n > 1")
def agg_by_alias(spark, d):
    """GROUP BY and HAVING name what the select list has made."""
    register(spark, d, ("orders",))
    return spark.sql("SELECT year(o_orderdate) AS y, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished FROM orders GROUP BY y HAVING n > 1").withColumn("y", F.col("y").cast("long"))


@checked("""SELECT n_name AS "a`b", n_nationkey AS "select" FROM nation""")
def text_quoted(spark, d):
    register(spark, d, ("nation",))
    return spark.sql(f"SELECT n_name AS {X.quote_identifier('a`b')}, n_nationkey AS {X.quote_identifier('select')} FROM nation")


@checked("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '{\"a\": {\"b\": ' || n_nationkey || '}}' WHEN n_nationkey % 3 = 1 THEN '{\"c\": \"' || n_name || '\"}' END AS object FROM nation")
def text_json_object(spark, d):
    """A fenced object, a loose one, and one that does not parse."""
    text = F.expr("""CASE n_nationkey % 3 WHEN 0 THEN concat('see ```json\n{"a": {"b": ', n_nationkey, '}}\n``` and {') WHEN 1 THEN concat('it is {"c": "', n_name, '"} then') ELSE concat('{"c": ', n_name, '}') END""")
    return read(spark, d, "nation").select("n_nationkey", X.json_object(text).alias("object"))


# Catalog


@checked("SELECT count(*) AS n, count(*) FILTER (p_size >= 10) AS usable, count(*) FILTER (p_size >= 40) AS large, count(*) FILTER (p_partkey % 3 = 0) AS documented, count(*) FILTER (p_partkey % 2 = 0) AS with_key, median(p_size)::DOUBLE * 100 AS median_rows FROM part")
def cat_corpus_summary(spark, d):
    """Parts as tables: their size tells the rows."""
    k = F.col("p_partkey")
    rows = F.when(F.col("p_size") >= 40, F.col("p_size") * 1000).when(F.col("p_size") >= 10, F.col("p_size") * 10).otherwise(F.col("p_size"))
    t = read(spark, d, "part").select(rows.alias("rows"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "  ").alias("description"), F.when(k % 2 == 0, "id").alias("primary_key"))
    s = catalog.corpus_summary(t).drop("median_rows")
    return s.join(F.broadcast(read(spark, d, "part").agg((F.median("p_size") * 100).alias("median_rows"))), F.lit(True))  # one row each


@checked("WITH e AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'mart' ELSE 'mart' END AS l, CASE WHEN n_regionkey % 2 = 0 THEN 'staging' ELSE 'mart' END AS r FROM nation), p AS (SELECT least(l, r) || '-' || greatest(l, r) AS layers FROM e) SELECT layers, count(*) AS n, count(*) / (SELECT count(*) FROM p)::DOUBLE AS share FROM p GROUP BY layers")
def cat_layer_joins(spark, d):
    n = read(spark, d, "nation")
    left = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "dim_").otherwise(""), "n_name")
    right = F.concat(F.when(F.col("n_regionkey") % 2 == 0, "stg_").otherwise("fct_"), "n_name")
    return catalog.layer_joins(n.select(left.alias("left_table"), right.alias("right_table")))


@checked(
    """SELECT 'customer' AS left_table, 'c_mktsegment' AS left_column, 'region' AS right_table, 'r_name' AS right_column, (SELECT count(*) FROM customer WHERE c_mktsegment IN (SELECT r_name FROM region))::DOUBLE AS overlap,
    CASE WHEN (SELECT count(DISTINCT c_mktsegment) < count(*) FROM customer) AND (SELECT count(DISTINCT r_name) = count(*) FROM region) THEN 'n:1' ELSE 'other' END AS relationship, true AS explicit_foreign_key"""
)
def cat_declared_key(spark, d):
    """A declared key between names that are nothing alike, and between values that never meet, is a join all the same, if the types can be compared."""
    t = {"customer": read(spark, d, "customer").select("c_mktsegment", "c_nationkey"), "region": read(spark, d, "region").select("r_name")}
    return joins.join_edges(spark, t, {("customer", "c_mktsegment", "region", "r_name"), ("customer", "c_nationkey", "region", "r_name")}).drop("name_similarity", "confidence")


@checked(
    """WITH k AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), g AS (SELECT o_orderkey * o_orderkey * 1000 AS key, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders), gk AS (SELECT min(key) AS lo, max(key) AS hi FROM g),
    s AS (SELECT key, rn FROM g WHERE key IN (SELECT lo + (hi - lo) * i // 59 FROM gk, range(60) r(i)))
    SELECT 'regions' AS name, 'prefix' AS mode, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'orders', 'spread', (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT lo + (hi - lo) * i // 59 FROM k, range(60) r(i)))
    UNION ALL SELECT 'gaps', 'spread_plus_prefix', (SELECT count(*) FROM (SELECT key FROM s UNION SELECT key FROM g WHERE rn <= 60)) UNION ALL SELECT 'none', 'disabled', 0"""
)
def cat_sample_modes(spark, d):
    """A small table, one of dense keys, one whose keys lie apart so that the spread meets few, and no sample at all."""
    orders = read(spark, d, "orders").select("o_orderkey")
    gaps = orders.select((F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("key"))
    taken = {"regions": (read(spark, d, "region"), "r_regionkey", 60), "orders": (orders, "o_orderkey", 60), "gaps": (gaps, "key", 60), "none": (orders, "o_orderkey", 0)}
    rows = []
    for name, (df, key, cap) in taken.items():
        sample, mode = catalog.sampled(df, key, cap)
        rows.append((name, mode, sample.count()))
    return spark.createDataFrame(rows, "name string, mode string, n long")


@checked(
    """WITH t AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS mostly, CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS partly, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END AS price FROM part),
    x AS (SELECT 'mostly' AS "column", try_cast(mostly AS DOUBLE) AS x FROM t UNION ALL SELECT 'price', price FROM t)
    SELECT 't' AS "table", "column", min(x) AS least, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS most, avg(x) AS mean FROM x GROUP BY "column\""""
)
def cat_mixed_numbers(spark, d):
    """Numbers kept as text: a column of which nine in ten read as numbers, one of which two in three do, and a numeric one with nulls."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    t = read(spark, d, "part").select(F.when(k % 10 == 0, "n/a").otherwise(size).alias("mostly"), F.when(k % 3 == 0, "n/a").otherwise(size).alias("partly"), F.when(k % 4 > 0, F.col("p_retailprice")).alias("price"))
    return catalog.numeric_stats(t, "t")


# Complexity and curriculum


@checked(
    "SELECT substr(p_name, 1, 3) || p_partkey AS instance_id, p_brand AS db, p_name AS question, 'SELECT ' || p_size AS \"sql\", CASE WHEN p_partkey % 6 = 0 THEN 'grain,nulls' WHEN p_partkey % 2 = 0 THEN 'grain' ELSE '' END AS risks FROM part WHERE p_partkey % 5 <> 0"
)
def sql_reference_rows(spark, d):
    p = read(spark, d, "part").withColumn("instance_id", F.concat(F.substring("p_name", 1, 3), "p_partkey"))
    ids = p.where("p_partkey % 5 <> 0").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "sf_").otherwise(""), "instance_id").alias("instance_id"))
    risks = p.where("p_partkey % 2 = 0").select("instance_id", F.lit("grain").alias("risk")).unionByName(p.where("p_partkey % 6 = 0").select("instance_id", F.lit("nulls").alias("risk")))
    r = complexity.reference_rows(ids.unionByName(ids), p.select("instance_id", F.col("p_brand").alias("db"), F.col("p_name").alias("question")), p.select("instance_id", F.concat(F.lit("SELECT "), "p_size").alias("sql")), risks)
    return r.withColumn("risks", F.array_join("risks", ","))


@checked("SELECT * FROM (VALUES ('foundation', 0.25::DOUBLE), ('core', 0.5), ('growth', 0.25), ('stretch', 0.0)) t(band, share)")
def mix_parsed(spark, d):
    return spark.createDataFrame(list(curriculum.parse_mix("core=2, growth = 1,foundation=1").items()), "band string, share double")


@checked("SELECT event_id, event_id % 70 <= 60 AND user_id % 30 <= 25 AND value * 100000 <= 2000000 AS fits FROM events")
def mix_within_caps(spark, d):
    return read(spark, d, "events").select("event_id", curriculum.within_caps(F.col("event_id") % 70, F.col("user_id") % 30, F.col("value") * 100000).alias("fits"))


@checked("SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 10 THEN 'p_size below 10' END, CASE WHEN p_retailprice < 950.5 THEN 'p_retailprice below 950.5' END) AS errors FROM part")
def mix_floors(spark, d):
    f = curriculum.floors(read(spark, d, "part"), {"p_size": 10, "p_retailprice": 950.5})
    return f.select("p_partkey", F.array_join("floor_errors", ",").alias("errors"))


# Validation and export


#: Items of a log, made of turns: users' and developers' messages, an assistant's message, calls with and without one before them, their outputs, and reasoning.
_ITEMS = """SELECT conv_id, turn * 4 + k AS seq, CASE WHEN k = 1 THEN 'function_call' WHEN k = 2 THEN CASE WHEN turn % 5 = 0 THEN 'reasoning' ELSE 'function_call_output' END WHEN k = 3 THEN 'function_call' ELSE 'message' END AS type, CASE WHEN k = 0 THEN CASE WHEN turn % 4 = 0 THEN 'developer' ELSE role END END AS role,
    CASE WHEN k = 0 THEN text END AS text, CASE WHEN k > 0 THEN concat('c', CAST(turn * 4 + CASE WHEN k = 2 THEN 1 ELSE k END AS VARCHAR(20))) END AS call_id, CASE WHEN k IN (1, 3) AND turn % 2 = 0 THEN 'db' END AS namespace, CASE WHEN k = 1 THEN 'exec' WHEN k = 3 THEN 'db__list' END AS name,
    CASE WHEN k = 1 THEN concat('{"t":', CAST(turn AS VARCHAR(20)), '}') END AS arguments, CASE WHEN k = 2 THEN text END AS output
    FROM conversations CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks WHERE k = 0 OR (role = 'assistant' AND (k < 3 OR turn % 3 = 0))"""


@checked(
    f"""WITH i AS ({_ITEMS}), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n FROM i WHERE type <> 'reasoning'),
    m AS (SELECT c.*, p.n IS NOT NULL AS joins FROM k c LEFT JOIN k p ON p.conv_id = c.conv_id AND p.n = c.n - 1 AND p.type = 'message' AND p.role = 'assistant' AND c.type = 'function_call'),
    j AS (SELECT a.*, CASE WHEN a.type = 'function_call' THEN a.call_id WHEN a.role = 'assistant' THEN b.call_id END AS call, CASE WHEN a.type = 'function_call' THEN a.name WHEN a.role = 'assistant' THEN b.name END AS called, CASE WHEN a.type = 'function_call' THEN a.namespace WHEN a.role = 'assistant' THEN b.namespace END AS space,
      CASE WHEN a.type = 'function_call' THEN coalesce(a.arguments, '{{}}') WHEN a.role = 'assistant' AND b.n IS NOT NULL THEN coalesce(b.arguments, '{{}}') END AS args FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.n = a.n + 1 AND b.joins WHERE NOT a.joins)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq)::INT AS place, CASE type WHEN 'function_call' THEN 'assistant' WHEN 'function_call_output' THEN 'tool' ELSE if(role = 'developer', 'system', role) END AS role,
      CASE type WHEN 'function_call_output' THEN CASE WHEN length(coalesce(output, '')) > 40 THEN left(output, 40) || chr(10) || '... [truncated ' || (length(output) - 40) || ' chars]' ELSE coalesce(output, '') END WHEN 'message' THEN coalesce(text, '') END AS content,
      CASE WHEN call IS NOT NULL THEN call || ' ' || CASE WHEN space IS NULL OR starts_with(called, space || '__') THEN called ELSE space || '__' || called END || ' ' || args END AS tool_call, CASE WHEN type = 'function_call_output' THEN call_id END AS tool_call_id FROM j"""
)
def msg_to_chat(spark, d):
    """Items folded into chat messages: calls join the message before them, names are flat, long outputs are cut."""
    register(spark, d, ("conversations",))
    c = messages.to_chat(spark.sql(_ITEMS), 40)
    call = F.when(F.size("tool_calls") == 1, F.concat_ws(" ", F.col("tool_calls")[0]["id"], F.col("tool_calls")[0]["name"], F.col("tool_calls")[0]["arguments"]))
    return c.withColumn("tool_call", call).drop("tool_calls")


@checked(
    f"""WITH i AS ({_ITEMS}), k AS (SELECT *, lead(type) OVER (PARTITION BY conv_id ORDER BY seq) AS following FROM i WHERE type <> 'reasoning'),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq)::INT AS n FROM k WHERE type <> 'message' OR role <> 'assistant' OR (coalesce(following, '') <> 'function_call' AND trim(coalesce(text, '')) <> ''))
    SELECT conv_id, n AS seq, type, if(role = 'developer', 'system', role) AS role, CASE WHEN type = 'message' THEN coalesce(text, '') END AS text, call_id, CASE WHEN type = 'function_call' AND (namespace = 'db' OR name = 'db__list') THEN 'db' END AS namespace,
      CASE WHEN name = 'db__list' THEN 'list' ELSE name END AS name, CASE WHEN type = 'function_call' THEN coalesce(arguments, '{{}}') END AS arguments, CASE WHEN type = 'function_call_output' THEN coalesce(output, '') END AS output FROM r"""
)
def msg_round_trip(spark, d):
    """Items to chat messages and back: what an assistant says beside its calls goes, names get their namespace back."""
    register(spark, d, ("conversations",))
    tools = spark.createDataFrame([("db__exec", "db", "exec"), ("db__list", "db", "list")], "flat string, namespace string, name string")
    return messages.to_items(messages.to_chat(spark.sql(_ITEMS)), tools)


@checked(
    f"""WITH i AS ({_ITEMS}), c AS (SELECT conv_id, call_id, CASE WHEN namespace = 'db' AND name = 'exec' THEN 'db__exec' ELSE name END AS name, arguments FROM i WHERE type = 'function_call'), o AS (SELECT conv_id, call_id, coalesce(output, '') AS output FROM i WHERE type = 'function_call_output' AND seq % 7 <> 0)
    SELECT conv_id, call_id, name, arguments, output, CASE WHEN output IS NULL THEN 'unanswered' ELSE 'paired' END AS state FROM c LEFT JOIN o USING (conv_id, call_id)"""
)
def msg_paired_calls(spark, d):
    register(spark, d, ("conversations",))
    return messages.paired_calls(spark.sql(_ITEMS).where("type <> 'function_call_output' OR seq % 7 <> 0"))


_BLUEPRINT = "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'growth' WHEN p_size % 4 = 1 THEN '' END AS band, p_size % 3 = 0 AS target, p_partkey % 5 AS joins, p_partkey % 8 AS operators FROM part"


@checked(f"SELECT p_partkey, CASE WHEN band <> '' THEN 'bench_' || band ELSE CASE WHEN target THEN 'bench_hard' ELSE CASE WHEN NOT (joins < 3 AND operators < 6) THEN 'hard' ELSE 'medium' END END END AS level FROM ({_BLUEPRINT})")
def val_level(spark, d):
    register(spark, d, ("part",))
    return spark.sql(_BLUEPRINT).select("p_partkey", validate.level(F.col("band"), F.col("target"), F.col("joins"), F.col("operators"), "bench_").alias("level"))


#: What is known of a rollout, of each event: every mix of the seven signs.
_ROLLOUT = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('SELECT ', CAST(event_id AS STRING)) WHEN event_id % 10 = 1 THEN '' END AS final_sql, user_id % 3 AS n_executed, event_id % 5 < 2 AS empty_response, event_id % 7 < 2 AS out_of_budget, event_id % 11 < 2 AS stalled, event_id % 13 < 5 AS failed, event_type = 'error' AS protocol FROM events"""


@checked(
    f"""WITH r AS ({_ROLLOUT.replace('AS STRING', 'AS VARCHAR')}), f AS (SELECT *, CASE WHEN final_sql IS NULL AND n_executed > 0 THEN 'SELECT run ' || n_executed ELSE final_sql END AS sql,
      CASE WHEN final_sql <> '' THEN 'clean_final' WHEN final_sql IS NULL AND n_executed > 0 THEN 'recovered_execution' ELSE 'no_sql' END AS s0 FROM r),
    e AS (SELECT *, CASE WHEN empty_response AND sql IS NULL THEN 'empty_response_exhausted' ELSE s0 END AS s1 FROM f)
    SELECT event_id, nullif(sql, '') AS sql, CASE WHEN out_of_budget AND sql IS NULL AND n_executed = 0 THEN 'model_timeout' WHEN stalled THEN 'infra_stall' WHEN failed AND sql IS NULL AND n_executed = 0 THEN if(protocol, 'model_protocol_error', 'infra_error') ELSE s1 END AS status FROM e"""
)
def val_rollout_status(spark, d):
    """All eight statuses, from every mix of signs."""
    register(spark, d, ("events",))
    r = spark.sql(_ROLLOUT).withColumn("executed", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_executed").cast("int"))), lambda i: F.concat(F.lit("SELECT run "), i.cast("string"))))
    r = r.withColumn("executed", F.slice("executed", F.lit(1), F.col("n_executed").cast("int")))
    s = validate.rollout_status(*[F.col(c) for c in ("final_sql", "executed", "empty_response", "out_of_budget", "stalled", "failed", "protocol")])
    return r.select("event_id", s.alias("s")).select("event_id", "s.sql", "s.status")


_REPLAY = """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'replay' WHEN 1 THEN 'stream' END AS source, CASE conv_id % 6 WHEN 0 THEN concat('Well: There Was NO thinking. ', text) WHEN 1 THEN concat(text, ' I didn''t produce any thinking here') WHEN 2 THEN 'There is nothing to copy, nothing to reproduce' WHEN 3 THEN concat('I cannot share my thinking. ', text)
    WHEN 4 THEN text END AS recovered FROM conversations"""


@checked(
    f"""SELECT conv_id, turn, CASE WHEN source = 'replay' AND regexp_matches(lower(coalesce(recovered, '')), 'nothing to (reproduce|copy)|no (thinking|reasoning) block|no prior thinking|(didn.t|did not) produce any thinking|there was no thinking|there wasn.t any|reasoning budget went unused') THEN 'replay_refused' ELSE source END AS source FROM ({_REPLAY})"""
)
def val_refusals(spark, d):
    """Replayed turns that say there is no reasoning, and turns of other sources that say the same."""
    register(spark, d, ("conversations",))
    return spark.sql(_REPLAY.replace("didn''t", "didn\\'t")).select("conv_id", "turn", validate.reasoning_source(F.col("source"), F.col("recovered")).alias("source"))


@checked("SELECT p_partkey AS sample_id, p_name AS instruction, 'SELECT ' || p_size AS oracle_sql, p_size AS gold_rows FROM part")
def val_public_part(spark, d):
    """What is public has no hidden column, and both parts together are the tasks."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("instruction"), F.concat(F.lit("SELECT "), "p_size").alias("oracle_sql"), F.col("p_size").alias("gold_rows"))
    shown, hidden = validate.public_part(p)
    return shown.select("sample_id", "instruction").join(hidden, "sample_id")


@checked("SELECT conv_id AS id, 2::BIGINT AS n FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'system') >= 2) WHERE conv_id % 3 = 0")
def traj_merged_sets(spark, d):
    """Two parts of packed conversations that share a third of their ids."""
    p = trajectories.packed(read(spark, d, "conversations"))
    _, twice = trajectories.merged_sets([p.where("id % 3 <> 1"), p.where("id % 3 <> 2")])
    return twice


@checked("SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 3 = 0 AND user_id % 4 <> 0")
def traj_verified(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("event_type") != "error").alias("exec_ok"), (F.col("event_id") % 3 == 0).alias("correct"), F.when(F.col("user_id") % 4 != 0, "s").alias("session_path"))
    return trajectories.verified(e).select("event_id")



@checked("SELECT o_orderkey AS instance_id, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 = 0 ELSE false END AS correct FROM orders")
def traj_gold_compare(spark, d):
    """Results against gold: equal hashes, other hashes, none of their own, and none in the gold."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders")
    results = o.select(k.alias("instance_id"), F.when(k % 4 != 2, F.concat(F.lit("h"), F.when(k % 4 == 0, k).otherwise(-k))).alias("res_hash"))
    gold = o.where("o_orderkey % 4 <> 3").select(k.alias("instance_id"), F.concat(F.lit("h"), k).alias("gold_res_hash"))
    return trajectories.gold_compared(results, gold).select("instance_id", "correct")


@checked(
    """WITH t AS (SELECT p_brand AS source, p_size AS batch, p_partkey AS task FROM part WHERE p_size > 5), r AS (SELECT *, row_number() OVER (ORDER BY sha256('11' || chr(0) || source || '/' || task)) AS place FROM t) SELECT source, batch, task, place::INT AS place FROM r WHERE place <= 50"""
)
def rl_flattened(spark, d):
    """Tasks of all batches of all sources, in a seeded order, the first fifty."""
    b = read(spark, d, "part").where("p_size > 5").groupBy(F.col("p_brand").alias("source"), F.col("p_size").alias("batch")).agg(F.collect_list("p_partkey").alias("tasks"))
    return trajectories.flattened_tasks(b, "11", 50)
