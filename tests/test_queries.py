"""Every query of the library against its SQL on DuckDB; those without SQL must give rows and repeat."""

import duckdb
import pytest

from taskloom import registry

from .comparing import duck, rows

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_repeats(spark, name):
    query = registry.queries()[name]
    first = rows(query(spark, SF).toPandas())
    assert first
    assert first == rows(query(spark, SF).toPandas())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_p01_deals_by_rows(spark, tmp_path, monkeypatch):
    """As many tasks as the lines fill, whatever the session's partitions are, no row kept for each distinct count, and the text's result where orders repeat, with several customers or none, and parts have no brand."""
    from taskloom import registry

    duckdb.execute(f"COPY (SELECT i % 700 AS l_orderkey, i * 7 % 90 AS l_partkey, 10.0 + i % 13 AS l_extendedprice, (i % 9) / 100 AS l_discount FROM range(4000) t(i)) TO '{tmp_path}/lineitem.parquet'")
    duckdb.execute(f"COPY (SELECT i % 600 AS o_orderkey, CASE WHEN i % 11 > 0 THEN i % 37 END AS o_custkey FROM range(1000) t(i)) TO '{tmp_path}/orders.parquet'")
    duckdb.execute(f"COPY (SELECT i AS p_partkey, CASE WHEN i % 10 > 0 THEN 'Brand#' || (i % 10) END AS p_brand FROM range(80) t(i)) TO '{tmp_path}/part.parquet'")
    text = registry.oracle_sql()["p01"]
    for name in ("lineitem", "orders", "part"):
        text = text.replace(f" {name} ", f" '{tmp_path}/{name}.parquet' AS {name} ")
    want = [tuple(r) for r in duckdb.sql(text).fetchall()]
    monkeypatch.setattr(registry, "ROWS_A_TASK", 100)
    got = registry.queries()["p01"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == want and len(want) == 10
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(o_custkey" in plan and ", 40)" in plan and "Expand" not in plan
