"""Every registered query against its SQL twin, and the shape of its plan."""

import glob
import os

import duckdb
import pytest

from catalogue import entries
from check import normal

ENTRIES = entries()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, sf_dir, sql, name):
    entry = ENTRIES[name]
    df = entry.run(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = df.collect()
    if entry.sql is None:
        assert rows
        return
    cursor = sql.execute(entry.sql)
    names = [d[0] for d in cursor.description]
    assert normal(df.columns, rows) == normal(names, cursor.fetchall())


@pytest.fixture
def long_keys(spark, tmp_path):
    """Customers whose keys have six digits, like postal codes."""
    rows = [(411_000 + i, f"Customer#{i}", 1, 5.0, "X") for i in range(40)]
    spark.createDataFrame(
        rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ).write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["i08_scrub_columns_marked", "i08_scrub_whole_cells"])
def test_scrubbing_keeps_long_keys(spark, long_keys, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{long_keys}/customer.parquet/*.parquet'")
    df = ENTRIES[name].run(spark, long_keys)
    cursor = con.execute(ENTRIES[name].sql)
    names = [d[0] for d in cursor.description]
    assert normal(df.columns, df.collect()) == normal(names, cursor.fetchall())


def test_synthetic_checks_send_no_rows_through_the_driver(spark, sf_dir):
    df = ENTRIES["i07_synthetic_checks"].run(spark, sf_dir)
    assert len(df.collect()) == 8
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
