"""Rules of operators on small made inputs."""

import re

import pytest
from pyspark.sql import functions as F

from taskloom.functions import compat
from taskloom.functions import text as X
from taskloom.operators import catalog, complexity, curriculum, governed, trajectories, validate
from taskloom.sources import files


def test_compat(spark):
    d = spark.createDataFrame([(7, 2), (-7, 2), (1, 0)], "a long, b long")
    assert [r[0] for r in d.select(compat.int_div(F.col("a"), F.col("b"))).collect()] == [3, -3, None]
    assert [r[0] for r in d.select(compat.div(F.col("a"), F.col("b"))).collect()] == [3.5, -3.5, None]
    t = spark.createDataFrame([("12abc",), ("x",), (None,)], "s string")
    assert [r[0] for r in t.select(compat.to_int(F.col("s"))).collect()] == [12, 0, None]


def test_final_sql_takes_the_last_answer(spark):
    d = spark.createDataFrame([("```sql\nSELECT 1;\n``` text FINAL ANSWER: ```sql\nSELECT 2;\n```",)], "t string")
    assert d.select(X.final_sql(F.col("t"))).first()[0] == "SELECT 2;"


def test_execute_rejects(spark):
    spark.range(5).createOrReplaceTempView("five")
    got = governed.execute(spark, "SELECT sum(id) AS total FROM five;")
    assert got.rows == [[10]] and got.columns == ["total"] and "five" not in got.null_counts
    for bad in ("DROP TABLE five", "SELECT 1; SELECT 2", "SELECT * FROM five a JOIN five b USING (id)"):
        with pytest.raises(governed.Rejected):
            governed.execute(spark, bad)
    with pytest.raises(governed.Rejected):
        governed.execute(spark, "SELECT id FROM five", max_rows=4)


REFUSED = {
    "SELECT java_method('java.lang.System', 'setProperty', 'taskloom.gate', 'open')": "function java_method",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')": "function reflect",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')": "function try_reflect",
    "SELECT * FROM text.`/etc/hostname`": "relation text./etc/hostname",
    "SELECT * FROM five WHERE id IN (SELECT length(value) FROM text.`/etc/hostname`)": "relation text./etc/hostname",
    "WITH a AS (WITH b AS (SELECT reflect('a', 'b') AS x) SELECT * FROM b) SELECT (SELECT max(x) FROM a) FROM five": "function reflect",
    "SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM five WHERE reflect('a', 'b') = 'x')) FROM five": "function reflect",
    "SELECT sum(id) OVER (ORDER BY reflect('a', 'b')) FROM five": "function reflect",
    "SELECT * FROM VALUES (reflect('java.lang.System', 'setProperty', 'taskloom.gate', 'open')) AS v(a)": "function reflect",
    "SELECT * FROM five LATERAL VIEW explode(array(reflect('a', 'b'))) AS x": "function reflect",
    "SELECT * FROM five ORDER BY reflect('a', 'b')": "function reflect",
    "SELECT transform(array(1), x -> reflect('a', string(x))) FROM five": "function reflect",
    "SELECT system.builtin.reflect('a', 'b')": "function system.builtin.reflect",
    "SELECT IDENTIFIER('reflect')('a', 'b')": "name by expression",
    "SELECT * FROM IDENTIFIER('five')": "name by expression",
    "SELECT own_python(id) FROM five": "function own_python",
    "SELECT upper(id) FROM five": "function upper",
    "SELECT five_rows.* FROM own_rows() five_rows": "function own_rows",
    "SELECT * FROM nowhere": "relation nowhere",
    "SELECT * FROM five TABLESAMPLE (5 ROWS) UNION SELECT * FROM csv.`/tmp`": "relation csv./tmp",
    "SELECT TRANSFORM(id) USING 'cat' FROM five": "operator ScriptTransformation",
    "BEGIN SELECT 1; END": "command", "SET spark.sql.ansi.enabled = false": "command", "INSERT INTO five VALUES (1)": "command", "CACHE TABLE five": "command", "EXPLAIN SELECT 1": "command",
}
ALLOWED = [
    "SELECT * FROM five",
    "WITH a AS (SELECT id FROM five), b AS (SELECT * FROM a) SELECT a.id, to_json(named_struct('x', b.id)) FROM a JOIN b ON a.id = b.id",
    "SELECT CASE WHEN id BETWEEN 1 AND 2 THEN 'a' ELSE concat('x', id) END, count(*) FROM five GROUP BY ALL HAVING count(*) > 0 ORDER BY 1 LIMIT 3",
    "SELECT id, lag(id) OVER w AS l FROM five WINDOW w AS (ORDER BY id)", "FROM five |> WHERE id > 1 |> AGGREGATE sum(id) AS s", "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS v(x, y)", "SELECT x FROM five LATERAL VIEW posexplode(array(1, 2)) AS p, x",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT sum(n) FROM r", "SELECT * FROM range(3) EXCEPT SELECT id FROM five", "SELECT * FROM five WHERE id > (SELECT avg(id) FROM five)", "SELECT shouting FROM loud",
    "SELECT date_trunc('month', current_date), percentile_cont(0.5) WITHIN GROUP (ORDER BY id) FROM five", "SELECT filter(array(1, 2), x -> x > 1), try_cast('a' AS int), extract(YEAR FROM DATE'2020-01-01')", "SELECT * FROM five PIVOT (count(*) FOR id IN (1, 2))", "SELECT id, t.* FROM five, LATERAL (SELECT id + 1 AS j) t",
]


def test_authorizer(spark):
    """Nothing runs that is refused, nothing plain is refused, and a view may do what its owner meant."""
    from pyspark.sql.functions import udf, udtf

    from taskloom.operators.authorizer import Authorizer

    spark = spark.newSession()
    spark.range(5).createOrReplaceTempView("five")
    spark.udf.register("own_python", lambda x: x)
    spark.range(2).select(udf(lambda x: "a", "string")("id").alias("shouting")).createOrReplaceTempView("loud")

    class Rows:
        def eval(self):
            yield (1,)

    spark.udtf.register("own_rows", udtf(Rows, returnType="x int"))
    judge = Authorizer(spark)
    assert {q: judge.refusals(q) for q in ALLOWED} == {q: [] for q in ALLOWED}
    spark.udf.register("upper", lambda x: x)  # in this session only
    assert {q: "; ".join(judge.refusals(q)) for q in REFUSED} == REFUSED
    assert spark._jvm.java.lang.System.getProperty("taskloom.gate") is None
    assert Authorizer(spark, ["five"]).refusals("SELECT * FROM FIVE JOIN loud ON true") == ["relation loud"]
    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM text.`/etc/hostname`"):
        with pytest.raises(governed.Rejected):
            governed.execute(spark, bad)


def test_authored_queries_are_allowed(spark):
    from taskloom.operators.authorizer import Authorizer
    from taskloom.plans.authored import AUTHORED
    from taskloom.plans.dialect import SPARK
    from taskloom.sources import register

    register(spark, "/root/testdata/sf0.001")
    assert {k: Authorizer(spark).refusals(f(SPARK)) for k, f in AUTHORED.items()} == dict.fromkeys(AUTHORED, [])


def test_submit_stores_what_it_hashed(spark, tmp_path):
    """The stored rows are those of the result, even of a query that never gives the same rows twice; caps hold."""
    r = governed.submit(spark, "SELECT id, uuid() AS u, DATE'2024-02-29' AS d, CAST(1.5 AS DECIMAL(9, 2)) AS m FROM range(20)", f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a")
    assert governed.hashes(stored.columns, [[governed.json_safe(v) for v in x] for x in stored.collect()])[0] == r.ordered_sha256
    with pytest.raises(governed.Rejected):
        governed.submit(spark, "SELECT id FROM range(20)", f"{tmp_path}/b", max_rows=5)
    with pytest.raises(governed.Deadline):
        governed.execute(spark, "SELECT count(*) FROM range(4000000000) WHERE sha2(string(id), 512) LIKE '%00000000000000%'", seconds=0.5)


def test_hashes_order():
    a, b = governed.hashes(["x"], [[1], [2]]), governed.hashes(["x"], [[2], [1]])
    assert a[0] != b[0] and a[1] == b[1] and governed.hashes(["y"], [[1], [2]])[1] != a[1]


def test_result_hash_sees_each_row(spark):
    one = governed.result_hash(spark.createDataFrame([(1, None), (2, "a")], "x long, y string")).first()
    same = governed.result_hash(spark.createDataFrame([(2, "a"), (1, None)], "x long, y string")).first()
    other = governed.result_hash(spark.createDataFrame([(2, "a"), (1, "")], "x long, y string")).first()
    assert one == same != other
    assert governed.result_hash(spark.createDataFrame([], "x long")).first().n_rows == 0


def test_mix(spark):
    assert curriculum.parse_mix("core=1,growth=1") == {"foundation": 0.0, "core": 0.5, "growth": 0.5, "stretch": 0.0}
    for bad in ("x=1", "core=1,core=1", "core=-1", "core=0"):
        with pytest.raises(ValueError):
            curriculum.parse_mix(bad)
    order = [r.band for r in curriculum.band_schedule(spark, {"foundation": 2, "core": 4, "growth": 2, "stretch": 1}).orderBy("place").collect()]
    assert sorted(order) == ["core"] * 4 + ["foundation"] * 2 + ["growth"] * 2 + ["stretch"] and order[0] == "core"


@pytest.mark.parametrize("count", [0, 1, 7, 100])
def test_allocation_adds_up(spark, count):
    assert sum(r.quota for r in curriculum.allocate_mix(spark, count).collect()) == count


def test_depth_and_families(spark):
    texts = [("a", "SELECT (SELECT max(x) FROM (SELECT 1 AS x)) FROM t WHERE s = '(SELECT ((('"), ("b", None)]
    got = {r.id: r for r in complexity.profile(spark.createDataFrame(texts, "id string, sql string")).collect()}
    assert got["a"].depth == 2 and "nested_subquery" in got["a"].families
    assert got["b"].tokens == 0 and got["b"].families == []


def test_vote_fallbacks(spark):
    rows = [("t", 1, False, "error", "z", "SELECT NULL;"), ("t", 2, False, "timeout", "y", "SELECT x"), ("t", 3, True, "timeout", "w", "SELECT 3"), ("u", 1, True, "ok", "b", "a"), ("u", 2, True, "ok", "a", "a"), ("u", 3, True, "cached", "a", "a"), ("v", 1, None, None, None, None), ("v", 2, True, "no_sql", "q", "")]
    got = {r.instance_id: (r.res_hash, r.votes, r.seed, r.method) for r in trajectories.majority_vote(spark.createDataFrame(rows, "instance_id string, seed long, exec_ok boolean, outcome string, res_hash string, sql string")).collect()}
    assert got == {"t": ("y", 0, 2, "fallback_non_empty"), "u": ("b", 1, 1, "majority_vote"), "v": (None, 0, 1, "fallback_default")}


def test_leaks(spark):
    p = spark.createDataFrame([(1, "well then  the secret\nanswer is forty two ok"), (2, "nothing")], "prompt_id long, text string")
    h = spark.createDataFrame([(7, "The secret answer is forty two"), (8, "short"), (9, None)], "item_id long, text string")
    assert [tuple(r) for r in validate.leaks(p, h).collect()] == [(1, 7)]


def test_leaks_anywhere(spark):
    """Short texts, texts after signs or inside words and texts with a final `;`, as by containment of every one in every prompt."""
    texts = ["SELECT a, b FROM t;", "select A ,\n b", "forty two", "x", "42", "count(*)", "Straße", "a b", "the long and winding road", " ;", "", None, "SELECT a, b FROM t ;", "antidisestablishment", "ab;c ", "road ends"]
    prompts = ["`select a, b\tfrom t`", "(SELECT A, B FROM T", "I'm forty twofold", "xx", "n=42.", "see:count(*)!", "STRASSE", "ba bb", "the\u00a0long and winding roads end", "", None, "ab;cd", "\"SELECT a, b FROM t ;\"", "preantidisestablishmentarian", "railroad endsong", "a  b", "select a , b"]
    p = spark.createDataFrame(list(enumerate(prompts)), "prompt_id long, text string")
    h = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")

    def norm(s):
        return re.sub(r"\s+", " ", (s or "").strip().rstrip(";")).casefold()

    want = [(i, j) for i, a in enumerate(prompts) for j, b in enumerate(texts) if norm(b) and norm(b) in norm(a)]
    got = sorted(tuple(r) for r in validate.leaks(p, h).collect())
    assert got == want and len(want) >= 16 and {(0, 0), (1, 0), (2, 2), (4, 4), (5, 5), (6, 6)} <= set(got)


def test_table_selection():
    edges = [("a", "b"), ("b", "c"), ("x", "y")]
    assert catalog.table_selection(edges, {"a": False, "b": False, "c": True, "x": True, "y": False}, {}, 2) == ["c", "b"]
    assert catalog.table_selection([], {}, {}) == []


def test_spread_sample_of_nothing(spark):
    assert catalog.spread_sample(spark.range(0), "id").count() == 0


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("sf_1", 1), ("2", None)], "instance_id string, n long")
    assert files.write_verified(d, str(tmp_path / "j"), "instance_id") == 2
    assert files.read_jsonl(spark, str(tmp_path / "j"), "instance_id string, n long", ("instance_id",)).count() == 2
    (tmp_path / "ids.csv").write_text("instance_id\nsf_a\nb\n")
    assert sorted(r[0] for r in files.read_ids(spark, str(tmp_path / "ids.csv")).collect()) == ["a", "b"]
    files.write_csv(d, str(tmp_path / "c"))
    files.write_table(d, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert "| instance_id | n |" in files.markdown(d, "r")
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.json").write_text('{"x": 1}')
    (tmp_path / "tree" / "bad.json").write_text("{")
    assert [r.x for r in files.read_json_tree(spark, str(tmp_path / "tree"), "x long").collect()] == [1]


def test_sessions(spark, tmp_path):
    import zstandard

    (tmp_path / "s.jsonl").write_text('{"type": "user/message"}\n\nbroken\n')
    got = files.read_sessions(spark, str(tmp_path / "s.jsonl"), "type string").collect()
    assert sorted(str(r.event.type) for r in got) == ["None", "user/message"]
    (tmp_path / "a.zst").write_bytes(zstandard.ZstdCompressor().compress(b"x\ny\n"))
    (tmp_path / "b.zst").write_bytes(b"no zstd")
    assert [r.line for r in files.read_zstd_sessions(spark, str(tmp_path / "*.zst")).orderBy("line_no").collect()] == ["x", "y"]


def test_schedule_stays_near_the_quotas(spark):
    quotas = {"foundation": 21, "core": 48, "growth": 27, "stretch": 11}
    order = [r.band for r in curriculum.band_schedule(spark, quotas).orderBy("place").collect()]
    for k in range(len(order) + 1):
        assert all(abs(order[:k].count(b) - k * q / 107) < 1 for b, q in quotas.items())
    assert curriculum.band_schedule(spark, {}).count() == 0


def test_json_safe():
    from taskloom.functions.text import json_safe

    got = json_safe({1: [float("nan"), -0.5, True, None], "b": (b"\x01" * 30, bytearray(b"z")), "c": {"d": float("-inf")}, "e": object})
    assert got == {"1": [None, -0.5, True, None], "b": [{"blob_bytes": 30, "hex_preview": "01" * 24}, {"blob_bytes": 1, "hex_preview": "7a"}], "c": {"d": None}, "e": str(object)}


def test_sessions_take_the_prompt_before_the_submission(spark):
    from taskloom.operators import trajectories

    e = [(1, 0, "user/message", "user", "first", None), (1, 1, "user/message", "user", "second", None), (1, 2, "assistant/message", "assistant", "a", "sql_submit"), (1, 3, "user/message", "user", "thanks", None), (2, 0, "user/message", "user", "never", None), (3, 0, "assistant/message", "assistant", "b", "sql_submit"), (3, 1, "user/message", "user", "late", None)]
    got = trajectories.parse_sessions(spark.createDataFrame(e, "session long, seq long, type string, role string, text string, tool string")).collect()
    assert [(r.session, r.prompt, [t.text for t in r.turns]) for r in got] == [(1, "second", ["a"])]


def test_ranks_and_percentiles(spark):
    """Against pandas and numpy: ties, nulls, one value, groups of all sizes."""
    import numpy as np
    import pandas as pd

    from taskloom.operators import ordering

    rng = np.random.default_rng(2)
    f = pd.DataFrame({"g": rng.integers(0, 4, 3_000), "x": rng.integers(-50, 50, 3_000).astype(float)})
    f.loc[f.g == 3, "x"] = 7.0
    d = spark.createDataFrame(f).repartition(7)
    for dense in (False, True):
        got = ordering.ranked(d, ["x"], "place", dense).toPandas()
        want = got.x.rank(method="dense" if dense else "min", ascending=False)
        assert len(got) == len(f) and (got.place == want).all()
    with_null = d.unionByName(spark.createDataFrame([(0, None), (9, None)], "g long, x double"))
    got = {r.g: r.q for r in ordering.percentiles(with_null, "g", "x", (0.0, 0.1, 0.5, 0.975, 1.0)).collect()}
    assert set(got) == {0, 1, 2, 3} and all(np.allclose(q, np.quantile(f.x[f.g == g], [0.0, 0.1, 0.5, 0.975, 1.0])) for g, q in got.items())


def test_leaks_with_a_common_opening(spark):
    """Texts that share all but one word with every prompt meet only the prompts that have it."""
    from taskloom.operators import validate

    p = spark.createDataFrame([(i, f"please look at the following question carefully number{i} and answer it") for i in range(50)], "prompt_id long, text string")
    h = spark.createDataFrame([(7, "please look at the following question carefully number7 and answer"), (8, "following question carefully number8 and"), (8, "the following question carefully number9 and answer it"), (9, "look at the following question")], "item_id long, text string")
    got = sorted(tuple(r) for r in validate.leaks(p, h).collect())
    assert got == sorted([(7, 7), (8, 8), (9, 8), *((i, 9) for i in range(50))])


def test_databases(spark, tmp_path):
    """Files with odd names and values: types by affinity, values against them, tables without row ids, empty tables, keys and references; and no write through a reader."""
    import sqlite3

    import duckdb

    from taskloom.sources import databases

    path = str(tmp_path / "x.sqlite")
    con = sqlite3.connect(path)
    con.executescript("""CREATE TABLE "a""b" (id INTEGER PRIMARY KEY, "odd name" VARCHAR(9) UNIQUE, r DECIMAL(3,1), raw BLOB, up INTEGER REFERENCES "a""b");
        CREATE TABLE bare (k TEXT, n INT, PRIMARY KEY (k, n)) WITHOUT ROWID; CREATE TABLE none (x REAL); CREATE VIEW v AS SELECT n FROM bare""")
    con.execute('INSERT INTO "a""b" VALUES (1, 5, 2.5, x\'00ff\', NULL), (7, NULL, \'n/a\', \'t\', 1), (900, \'z\', 3, NULL, 1)')
    con.execute("INSERT INTO bare VALUES ('q', 1), ('q', 2)")
    con.commit()
    con.close()
    got = sorted(tuple(r) for r in databases.read_database(spark, "sqlite", path, 'a"b', 3).collect())
    assert got == [(1, "5", 2.5, b"\x00\xff", None), (7, None, None, b"t", 1), (900, "z", 3.0, None, 1)]
    assert sorted(tuple(r) for r in databases.read_database(spark, "sqlite", path, "bare").collect()) == [("q", 1), ("q", 2)]
    assert databases.read_database(spark, "sqlite", path, "none").count() == 0 and databases.read_database(spark, "sqlite", path, "v").count() == 2
    keys = {(r.table, r.column): (r.key, r.unique, r.references) for r in databases.introspected(spark, "sqlite", path).collect()}
    assert keys['a"b', "id"] == (1, True, None) and keys['a"b', "odd name"] == (0, True, None) and keys['a"b', "up"] == (0, False, 'a"b.id') and keys["bare", "n"] == (2, False, None)
    with pytest.raises(sqlite3.OperationalError):
        databases.opened("sqlite", path).execute("DROP TABLE bare")
    with pytest.raises(Exception, match="no table"):
        databases.read_database(spark, "sqlite", path, "absent").count()
    path = str(tmp_path / "x.duckdb")
    con = duckdb.connect(path)
    con.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, name VARCHAR NOT NULL); CREATE TABLE c (p INTEGER REFERENCES p(id), t TIMESTAMP); INSERT INTO p VALUES (1, 'a'), (2, 'b'); INSERT INTO c VALUES (1, '2024-01-02 03:04:05')")
    con.close()
    assert sorted(tuple(r) for r in databases.read_database(spark, "duckdb", path, "p").collect()) == [(1, "a"), (2, "b")]
    assert [tuple(r) for r in databases.read_database(spark, "duckdb", path, "c").collect()] == [(1, "2024-01-02 03:04:05")]
    keys = {(r.table, r.column): (r.key, r.unique, r.not_null, r.references) for r in databases.introspected(spark, "duckdb", path).collect()}
    assert keys["p", "id"][:2] == (1, True) and keys["p", "name"][2] and keys["c", "p"] == (0, False, False, "p.id")


def test_yaml_descriptions():
    from taskloom.sources.files import described

    text = "version: 2\nmodels:\n  - name: a\n    description: x\n    columns:\n      - name: id\n        description: \"key: one\"\n      - description: before\n        name: z\n        tests: [unique]\n      - name: w\n        description: |\n          l1\n\n          l2\n  - name: b\n    description: >\n      in\n      two\nother:\n  - name: q\n    description: not read\nsources:\n- name: s\n  description: of no table\n  tables:\n  - name: t\n    description: tt\n    columns:\n    - name: c\n      description: cc\n"
    assert described(text) == [("models", "a", None, "x"), ("models", "a", "id", "key: one"), ("models", "a", "z", "before"), ("models", "a", "w", "l1\n\nl2"), ("models", "b", None, "in two"), ("sources", "t", None, "tt"), ("sources", "t", "c", "cc")]
    assert described(None) == described("") == described("- a\n- b\n") == described("description: x") == []


def plain_search(queries, items, ratio):
    """All pairs by the formula: {(query, family): [(name, score)] in order}."""
    words = lambda x: [w for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x or "").lower()) if w]
    plain = lambda x: re.sub("[^a-z0-9]", "", (x or "").lower())
    out = {}
    for query, family in queries:
        q = set(words(query))
        scored = []
        for name, text, tags, kind in items:
            if name is None or family is not None and family != kind:
                continue
            n = max(1, len(q))
            s = 0.45 * len(q & set(words(text or ""))) / n + 0.25 * len(q & set(words(name))) / n + 0.2 * ratio(plain(query), plain(name)) + 0.1 * len(q & set(tags or [])) / n
            scored.append((-round(s, 6), name.lower(), name))
        out[query, family] = [(x[2], -x[0]) for x in sorted(scored)]
    return out


def test_search(spark):
    """The first of each query and the place of any item, against all pairs; null and empty texts, equal names, families."""
    import difflib
    import random

    from taskloom.operators import search

    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    rng = random.Random(11)
    parts = ["customer", "Order", "date", "acct", "balance", "id", "name", "region", "x1", "total", "Qty"]
    items = [("_".join(rng.choices(parts, k=rng.randint(1, 4))), " ".join(rng.choices(parts, k=rng.randint(0, 6))), rng.sample(parts, 2), rng.choice(["text", "numeric", None])) for _ in range(150)]
    items += [("same", "same", [], "text")] * 3 + [(None, "customer", [], "text"), ("", "date", None, None), ("zzzz", None, None, "numeric"), ("Zzzz", None, None, "numeric")]
    queries = [(" ".join(rng.choices(parts, k=rng.randint(1, 4))), rng.choice([None, "text", "numeric"])) for _ in range(25)]
    queries += [("zzz", None), ("unlike anything", None), ("", None), ("balances", "numeric"), ("customerName", None), (None, None), ("none of it", "absent")]
    d = spark.createDataFrame(queries, "query string, family string")
    c = spark.createDataFrame(items, "name string, text string, tags array<string>, family string")
    want = plain_search(queries, items, ratio)
    for most in (1, 10):
        got = {}
        for r in search.search(d, c, most).collect():
            got.setdefault((r.query, r.family), []).append((r.place, r.name, r.score))
        assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: v[:most] for k, v in want.items() if v}
    chosen = [(q, f, rng.choice(items)[0] or "absent") for q, f in queries for _ in range(3)]
    r = search.selected_places(spark.createDataFrame(chosen, "query string, family string, selected string"), c).collect()
    assert len(r) == len(chosen)
    flat = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    for x in r:
        at = [i for i, (name, _) in enumerate(want[x.query, x.family]) if flat(name) == flat(x.selected)]
        assert (x.place, x.score) == ((at[0] + 1, want[x.query, x.family][at[0]][1]) if at else (None, None))


def test_role_errors(spark):
    from taskloom.operators import search

    columns = spark.createDataFrame([("Orders", f"c{i}", f"c{i} total", [], "numeric") for i in range(15)] + [("Orders", "o_date", "o_date", ["temporal"], "temporal")], "table string, name string, text string, tags array<string>, family string")
    tables = spark.createDataFrame([("Orders", "Orders o_date"), ("other", "other")], "name string, text string")
    roles = [
        ("a", "table", "orders date", None, "orders", None), ("b", "table", "orders", None, "gone", None), ("c", "column", "date", "ORDERS", "O_Date", None), ("d", "column", "date", "orders", "o_date", "numeric"),
        ("e", "column", "total c3", "orders", "c14", None), ("f", "column", "date", "nowhere", "o_date", None), ("g", "column", "date", "orders", "o_date", "temporal"),
    ]
    got = {r.role: (r.place, r.errors) for r in search.role_errors(spark.createDataFrame(roles, "role string, kind string, query string, table string, selected string, type string"), tables, columns).collect()}
    late = got.pop("e")
    assert late[0] > 10 and late[1] == [f"column role e selected rank {late[0]} is outside constrained top-10 candidates"]
    assert got == {"a": (1, []), "b": (None, ["table role b selected missing table gone"]), "c": (1, []), "d": (None, ["column role d missing/incompatible column orders.o_date"]), "f": (None, ["column role f missing table nowhere"]), "g": (1, [])}




def plain_name_score(lt, l, rt, r):
    """The rules of names, each as it is said."""
    import difflib

    words = lambda x: [w for w in re.split(r"[^a-z0-9]+", x.lower()) if w]
    flat = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    general, key, way = {"id", "key", "code", "no", "number", "index"}, {"id", "key", "code", "ref", "no"}, {"arrival", "departure", "source", "target", "from", "to", "origin", "destination"}
    one = lambda t: "".join([*words(t)[:-1], re.sub("(?<!s)s$", "", re.sub("ies$", "y", words(t)[-1]))])  # noqa: E731  for the names here
    base = lambda x, no: "".join(w for w in words(x) if w not in no)
    core = lambda x: {w for w in words(x)} - key - {"number"} - way
    gl, gr = flat(l) in general, flat(r) in general
    shared = len(core(l) & core(r)) / max(1, len(core(l)), len(core(r)))
    if gl and gr:
        score = 0.0
    elif flat(l) == flat(r):
        score = 1.0
    elif base(l, key) and base(l, key) == base(r, key):
        score = 0.94
    elif core(l) and core(l) == core(r):
        score = 0.9
    elif core(l) and core(r) and shared >= 0.5:
        score = 0.78 + 0.12 * shared
    elif gl and (base(r, key) == one(lt) or flat(r).startswith(one(lt))) or gr and (base(l, key) == one(rt) or flat(l).startswith(one(rt))):
        score = 0.92
    else:
        score = 0.82 * difflib.SequenceMatcher(None, flat(l), flat(r)).ratio()
    token = lambda t: one(words(t)[-1])
    is_key = lambda t, x: base(x, key | {"number"}) in (one(t), token(t)) or flat(x) in general
    points = is_key(rt, r) and token(rt) in words(l) or is_key(lt, l) and token(lt) in words(r)
    return score, points


def test_join_candidates(spark):
    """Columns of every rule, against all pairs of all tables."""
    from taskloom.operators import joins

    names = {
        "teams": ["id", "team_id", "name", "home_city", "code"], "team_batting": ["id", "team_id", "player_id", "arrival_team", "team_name"], "players": ["player_id", "number", "player_code", "birth_city", "teams"],
        "cities": ["city_id", "city", "origin_city_code", "name", "key"], "home_games": ["game_id", "city_from", "home_team_id", "player", "playerid", "index"], "entries": ["entry_id", "id", "entry", "game_no", "ref"],
    }
    tables = {t: spark.createDataFrame([], ", ".join(f"{c} long" for c in cs)) for t, cs in names.items()}
    declared = [("cities", "name", "players", "teams")]
    c = catalog.semantic_tags(catalog.columns_of(spark, tables))
    tags = {(r.table, r.column): r.tags for r in c.collect()}
    want = []
    for lt in names:
        for rt in names:
            if lt < rt:
                found = []
                for i, l in enumerate(names[lt]):
                    for j, r in enumerate(names[rt]):
                        score, points = plain_name_score(lt, l, rt, r)
                        told = (lt, l, rt, r) in declared
                        keys = "identifier" in tags[lt, l] and "identifier" in tags[rt, r]
                        if told or points or keys and score >= 0.9:
                            score = max(score, 0.92) if points else score
                            found.append((-(score + 0.4 * told), i, j, (lt, l, rt, r, round(score, 6), told)))
                want += [f[3] for f in sorted(found)[:3]]
    schema = "left_table string, left_column string, right_table string, right_column string"
    got = [(*r[:4], round(r[4], 6), r[5]) for r in joins.join_candidates(c, spark.createDataFrame(declared, schema)).collect()]
    assert sorted(got) == sorted(want) and len({w[4] for w in want}) >= 3
    few = joins.join_candidates(c, spark.createDataFrame(declared, schema), most=5).collect()
    assert len(few) == 5 and min(r.name_similarity for r in few) >= 0.94


def test_join_edges_values(spark):
    """Edges of columns that meet, never meet, meet outside of the sketches, and are unique but for one value outside of them."""
    from taskloom.operators import joins

    wide = spark.range(5000).selectExpr("id AS user_id")
    seldom = spark.range(5000).selectExpr("CASE WHEN id = 7 THEN 8 ELSE id + 1000000 END AS user_id")
    never = spark.range(3000).selectExpr("id + 2000000 AS user_id")
    almost = spark.range(4000).selectExpr("CASE WHEN id = 5 THEN 6 ELSE id END AS user_id")
    many = spark.range(9000).selectExpr("id % 300 AS user_id", "id % 7 AS kind")
    t = {"a": wide, "b": seldom, "c": never, "d": almost, "e": many, "f": spark.createDataFrame([(None,)], "user_id long")}
    got = {(r.left_table, r.right_table): r for r in joins.join_edges(spark, t).collect()}
    values = {k: [r.user_id for r in v.collect() if r.user_id is not None] for k, v in t.items()}
    for l in t:
        for r in t:
            if l < r:
                x, y = values[l], values[r]
                one = len(set(x)) == len(x), len(set(y)) == len(y)
                assert ((l, r) in got) == bool(set(x) & set(y) and any(one)), (l, r)
                if (l, r) in got:
                    exact = len(set(x) & set(y)) / min(len(set(x)), len(set(y)))
                    assert got[l, r].relationship == ("n:m", "n:1", "1:n", "1:1")[2 * one[0] + one[1]] and abs(got[l, r].overlap - exact) < 0.1, (l, r, got[l, r], exact)
    told = joins.join_edges(spark, {"c": never, "e": many}, {("e", "user_id", "c", "user_id")}).collect()
    assert [(r.relationship, r.overlap, r.explicit_foreign_key, r.confidence) for r in told] == [("1:n", 0.0, True, 0.7)]


def test_table_selection(spark):
    """Random graphs of joins, against a plain walk over a matrix of links."""
    import hashlib
    import random

    rng, tables, edges = random.Random(6), [], []
    for g in range(30):
        n = rng.choice([3, 12, 20, 90])
        tables += [(g, f"t{g}_{i}", i, rng.choice([0, 0, 1, 2]), rng.randint(0, 5)) for i in range(n)]
        edges += [(g, f"t{g}_{rng.randrange(n)}", f"t{g}_{rng.randrange(n)}") for _ in range(rng.choice([0, n // 2, n]))]
    d, e = spark.createDataFrame(tables, "catalog int, table string, position int, temporal int, numeric int"), spark.createDataFrame(edges, "catalog int, left_table string, right_table string")
    sha = lambda x: hashlib.sha256(("s\0" + x).encode()).hexdigest()
    for limit in (12, 60):
        got = {}
        for r in catalog.table_selection(d, e, "s", limit).collect():
            got.setdefault(r.catalog, []).append((r.place, r.table))
        for g in range(30):
            names = [t[1] for t in tables if t[0] == g]
            kinds = {t[1]: t[3:] for t in tables if t[0] == g}
            link = {(a, b) for x, a, b in edges for a, b in ((a, b), (b, a)) if x == g and a != b}
            degree = {t: sum((t, u) in link for u in names) for t in names}
            if len(names) <= limit:
                want = names
            else:
                group = {t: t for t in names}
                for _ in names:
                    group = {t: min([group[t], *(group[u] for u in names if (t, u) in link)]) for t in names}
                parts = [[t for t in names if group[t] == k] for k in set(group.values())]
                part = max(parts, key=lambda p: (sum(kinds[t][0] for t in p), sum(degree[t] for t in p), sum(kinds[t][1] for t in p), sha("|".join(sorted(p)))))
                start = [t for t in part if kinds[t][0] and degree[t]] or [t for t in part if degree[t]] or part
                line, want = [max(start, key=lambda t: (*kinds[t], degree[t], sha(t)))], []
                for t in line:
                    if t not in want and len(want) < limit:
                        want.append(t)
                        line += sorted([u for u in names if (t, u) in link and u not in want], key=lambda u: (-kinds[u][0], -degree[u], sha(f"{t}|{u}")))
            assert [t for _, t in sorted(got[g])] == want


def test_replay_goes_on(spark, tmp_path, monkeypatch):
    """Hundreds of tasks; a run that is stopped between and within commits goes on without a lost, doubled or repeated slot."""
    import collections

    from taskloom.operators import replay

    spark.range(50).createOrReplaceTempView("fifty")
    tasks = []
    for i in range(240):
        sql = {0: "DROP TABLE fifty", 1: "SELECT nothing FROM fifty", 2: "SELECT id FROM fifty", 3: "SELECT CAST('x' AS int) AS n"}.get(i % 12, f"SELECT max(id) + {i} AS n FROM fifty")
        tasks.append((f"s{i:03d}", f"db{i % 3}", sql, i % 2 == 0, governed.hashes(["n"], [[49 + i + (i % 12 == 5)]])[i % 2], ["n"]))
    t = spark.createDataFrame(tasks, "slot string, database string, sql string, ordered boolean, sha256 string, columns array<string>").repartition(3)
    ran = collections.Counter()
    own = replay.execute

    def counting(s, sql, **limits):
        ran[sql] += 1
        return own(s, sql, **limits)

    commits = []
    commit = replay.Slots.commit

    def failing(self, rows):
        commits.append(len(rows))
        if len(commits) == 3:
            raise OSError("stopped")
        if len(commits) == 5:  # between the write and the rename
            monkeypatch.setattr(self, "fs", type("Fs", (), {"rename": lambda *_: False})(), raising=False)
        return commit(self, rows)

    monkeypatch.setattr(replay, "execute", counting)
    monkeypatch.setattr(replay.Slots, "commit", failing)
    path = str(tmp_path / "slots")
    for _ in range(2):
        with pytest.raises(OSError):
            replay.replay(spark, t, path, workers=8, batch=40, max_rows=10)
    kept = {r.slot for r in replay.Slots(spark, path, replay.REPLAYED).rows().collect()}
    assert 0 < len(kept) < 240
    before = sum(ran.values())
    got = {r.slot: r for r in replay.replay(spark, t, path, workers=8, batch=40, max_rows=10).collect()}
    assert sum(ran.values()) - before == 240 - len(kept)
    assert replay.Slots(spark, path, replay.REPLAYED).rows().count() == len(got) == 240
    want = {0: "rejected", 1: "error", 2: "rejected", 3: "error", 5: "mismatch"}
    assert {s: r.status for s, r in got.items()} == {f"s{i:03d}": want.get(i % 12, "ok") for i in range(240)}
    report = {r.database: r for r in replay.replay_report(replay.Slots(spark, path, replay.REPLAYED).rows()).collect()}
    assert sum(r.reproducible for r in report.values()) == 140 and report["db0"].excluded.split(",")[0] == "s000" and "ok:" in report["db1"].statuses
    assert replay.replay(spark, t.limit(0), str(tmp_path / "none")).count() == 0


def test_token_labels(spark):
    """Ids are those of the whole rendered text; labels, read back, are the assistants' texts with END; marks inside texts are text; cuts; nulls."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from taskloom.operators import tokens

    convs = [
        (1, [("system", "be brief"), ("user", "Hällo\n\nthere"), ("assistant", "fine é 漢字"), ("user", ""), ("assistant", "\n\nafter newlines\nof it")]), (2, [("assistant", "")]), (3, [("user", "only")]), (4, []), (5, None),
        (6, [("assistant", f"a {tokens.END} b {tokens.START}user\nx"), (None, None), ("assistant", None)]), (7, [("assistant", "one two three four five six")]),
    ]
    d = spark.createDataFrame(convs, "conv_id int, messages array<struct<role:string,text:string>>")
    got = {r.conv_id: r for r in tokens.token_labels(d).collect()}
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    t.add_special_tokens([tokens.START, tokens.END])
    whole = "".join(f"{tokens.START}{r}\n{x}{tokens.END}\n" for r, x in convs[0][1])
    assert got[1].input_ids == t.encode(whole, add_special_tokens=False).ids
    assert all(len(r.input_ids) == len(r.labels) and all(b in (a, tokens.IGNORED) for a, b in zip(r.input_ids, r.labels)) for r in got.values())
    texts = {r.conv_id: r.texts for r in tokens.labelled_texts(tokens.token_labels(d)).collect()}
    assert texts == {1: ["fine é 漢字", "after newlines\nof it"], 2: [""], 3: [], 4: [], 5: [], 6: [f"a {tokens.END} b {tokens.START}user\nx", ""], 7: ["one two three four five six"]}
    cut = {r.conv_id: r for r in tokens.token_labels(d, most=6).collect()}
    assert all(r.input_ids == got[i].input_ids[:6] and r.labels == got[i].labels[:6] for i, r in cut.items())
    assert {r.conv_id: r.texts for r in tokens.labelled_texts(tokens.token_labels(d, most=6)).collect()}[7][0] in "one two three four five six"


def test_holdout(spark):
    """Exact quotas where one stratum has nearly all rows, others fewer than the quota, one none but nulls; the same rows whatever the partitions."""
    import collections
    import hashlib

    rows = [(i, "hot") for i in range(4000)] + [(4000 + i, "small") for i in range(5)] + [(5000 + i, None) for i in range(60)] + [(None, "hot")]
    d = spark.createDataFrame(rows, "k long, s string")
    for quota, buckets in ((0, 1 << 16), (37, 1 << 16), (37, 4), (5000, 16)):
        got = trajectories.holdout(d.repartition(5), "s", "k", quota, "seed", buckets).collect()
        assert sorted((r.k or -1, r.s or "") for r in got) == sorted((k or -1, s or "") for k, s in rows)
        held = collections.Counter(r.s for r in got if r.held_out)
        assert {s: held[s] for s in ("hot", "small", None)} == {"hot": min(quota, 4001), "small": min(quota, 5), None: min(quota, 60)}
        if quota == 37:
            sha = lambda k: hashlib.sha256(f"seed\0{k}".encode()).hexdigest()
            at = lambda k: (int(sha(k)[:8], 16) % buckets, sha(k), k)
            want = sorted((k for k, s in rows if s == "hot" and k is not None), key=at)[:36]
            assert {r.k for r in got if r.held_out and r.s == "hot"} == {None, *want}


def test_stream_restarts(spark, tmp_path):
    """Alarms after several restarts are those of the batch, each once; a file that comes twice, and one after the alarm, change nothing."""
    import json
    import random

    from taskloom.streaming import guard

    rng = random.Random(1)
    rows = [{"run": f"r{r}", "rollout_id": i, "mean_reward": rng.choice([0.0, 0.0, 0.0, 0.5]) if r % 3 else 0.0} for r in range(12) for i in range(1 + 2 * r)]
    folder, out, checkpoint, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "run string, rollout_id long, mean_reward double"
    (tmp_path / "in").mkdir()
    for n, (a, b) in enumerate([(0, 3), (3, 4), (4, 9), (3, 9), (9, 30)]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(x) for x in rows if a <= x["rollout_id"] < b))
        guard.watch(spark, folder, out, checkpoint, schema)
    got = sorted((r.run, r.first_alarm) for r in spark.read.parquet(out).collect())
    want = trajectories.collapse(spark.createDataFrame([(x["run"], x["rollout_id"], x["mean_reward"]) for x in rows], schema)).collect()
    assert got == sorted((r.run, r.first_alarm) for r in want) and len(got) > 3


def test_search_copies(spark):
    """Equal items are scored as one and counted as many: in the first ones, in bounds, and before another's place."""
    from taskloom.operators import search

    c = spark.createDataFrame([("red bolt", "red bolt of steel", ["bolt"], None)] * 700 + [("red nut", "red nut", [], None)] * 4 + [("ring", "blue", [], None)] * 900, "name string, text string, tags array<string>, family string")
    d = spark.createDataFrame([("red nut",), ("steel bolt",), ("xyz",)], "query string")
    assert search._items(c).count() == 3
    got = {}
    for r in search.search(d, c, 10).collect():
        got.setdefault(r.query, []).append((r.place, r.name))
    assert {q: [n for _, n in sorted(v)] for q, v in got.items()} == {"red nut": ["red nut"] * 4 + ["red bolt"] * 6, "steel bolt": ["red bolt"] * 10, "xyz": ["red bolt"] * 10}
    chosen = spark.createDataFrame([("red nut", "red bolt"), ("steel bolt", "red nut"), ("steel bolt", "ring")], "query string, selected string")
    places = {(r.query, r.selected): r.place for r in search.selected_places(chosen, c).collect()}
    assert places["red nut", "red bolt"] == 5 and places["steel bolt", "red nut"] == 701


def test_leak_audit_odd_rows(spark, tmp_path):
    """Equal rows and null ids stay, and blanks and cases are those of the SQL."""
    import duckdb

    from taskloom.plans import tasks

    docs = [(1, "say red fox runs; now"), (1, "say red fox runs; now"), (None, "RED  fox\nruns"), (2, "red fox runs"), (3, "red\x0bfox runs"), (4, "gross straße hier"), (5, "gross strasse hier"), (6, "x ΟΔΟΣ y İ"), (7, "ab ;"), (8, None), (9, " red fox runs　;")]
    items = [(1, " Red fox runs ; ; "), (1, "red fox runs ;"), (2, "STRASSE"), (3, "straße"), (4, "ΟΔΟΣ"), (5, "ab ;;"), (6, " ; ;"), (7, None), (8, "red\x0bfox"), (9, "Y I"), (10, "fox runs　")]
    for name, rows, names in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(tasks.SQL["leak_audit"]).fetchall(), key=str)
    got = sorted((tuple(r) for r in tasks.QUERIES["leak_audit"](spark, str(tmp_path)).collect()), key=str)
    assert got == want and len(want) > 8


def test_unique_columns_of_a_large_table(spark):
    """Every column that may be a key is counted, however many rows or columns there are."""
    n = 100_001
    d = spark.range(n).select("id", *[(F.col("id") + i).cast("string").alias(f"text{i}") for i in range(33)], (F.col("id") % (n - 1)).alias("almost"))
    got = {r.column: r.unique for r in catalog.unique_columns(d.select("id", "text0", "almost"), "t").collect()}
    assert got == {"id": True, "text0": True, "almost": False}
    wide = {r.column: r.unique for r in catalog.unique_columns(d.limit(50), "t").collect()}
    assert len(wide) == 35 and all(wide.values())


def test_sqlite_parts(spark, tmp_path):
    """A table in files that tasks write: rows, keys and types are as in one file, and nothing passes through the driver."""
    from taskloom.sources import databases

    d = spark.range(500, numPartitions=3).select((F.col("id") % 250).alias("k"), F.when(F.col("id") < 250, F.lit("a")).otherwise("b").alias("half"), (F.col("id") / 2).alias("x"), F.current_date().alias("at"))
    assert databases.write_sqlite_parts(d, str(tmp_path), "t", ("k", "half")) == 500
    databases.write_sqlite(d.limit(2), f"{tmp_path}/other.sqlite", "other")
    read = databases.read_database(spark, "sqlite", str(tmp_path), "t", 4)
    assert sorted(map(tuple, read.select("k", "half", "x").collect())) == sorted(map(tuple, d.select("k", "half", "x").collect()))
    found = databases.introspected(spark, "sqlite", str(tmp_path)).where("table = 't'").orderBy("position").collect()
    assert [(r.column, r.declared, r.key) for r in found] == [("k", "INTEGER", 1), ("half", "TEXT", 2), ("x", "REAL", 0), ("at", "TEXT", 0)]
    with pytest.raises(Exception, match="UNIQUE"):
        databases.write_sqlite_parts(d.unionByName(d.limit(1)), str(tmp_path), "again", ("k", "half"))


def test_token_labels_in_small_batches(spark):
    """Workers get batches of 2 MB, not of 64 MB, and the labels are the same."""
    from taskloom.operators import tokens

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        d = spark.range(300).selectExpr("id AS conv_id", "array(struct('user' AS role, 'ask' AS text), struct('assistant' AS role, concat('\nsay ', id) AS text)) AS messages")
        got = {r.conv_id: r.texts for r in tokens.labelled_texts(tokens.token_labels(d)).collect()}
        assert spark.conf.get(key) in ("2m", "2097152b") and got == {i: [f"say {i}"] for i in range(300)}
    finally:
        spark.conf.set(key, before)
