"""Replay, versions, SQL, planted issues, streams, and the shape of query plans."""

import time

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tablewise.operators import clean
from tablewise.operators.dirty import inject_issues
from tablewise.plans.replay import check_recipe, replay, to_json
from tablewise.plans.sql import QueryLog, query, register
from tablewise.plans.versions import TableVersions, fingerprint


def test_replay_runs_the_same_operators(dirty_table):
    steps = [
        ("drop_duplicates", {}),
        ("fill_missing", {"columns": ["age"], "strategy": "median"}),
        ("filter_rows", {"column": "city", "op": "in", "value": ["Pune"]}),
    ]
    by_hand = clean.drop_duplicates(dirty_table).df
    by_hand = clean.fill_missing(by_hand, ["age"], "median").df
    by_hand = clean.filter_rows(by_hand, "city", "in", ["Pune"]).df
    assert rows_of(replay(dirty_table, to_json(steps)), "*") == rows_of(by_hand, "*")
    assert replay(dirty_table, "[]") is dirty_table


def test_recipe_checks():
    assert check_recipe([("nope", {}), ("drop_missing", None), 7]) == [("drop_missing", {})]
    for bad in ({"mapping": {"x\n)": "y"}}, {"columns": ["a`b"]}, {"value": "a\rb"}):
        with pytest.raises(ValueError):
            check_recipe([{"op": "rename_columns", "params": bad}])


def test_versions(spark, tmp_path):
    store = TableVersions(spark, str(tmp_path / "v"))
    assert store.undo() is None and store.depth() == 0
    one, two = spark.range(3), spark.range(3, 6)
    assert store.push(one, "first") and store.push(two, "second")
    assert not store.push(two.repartition(3), "same again")
    assert rows_of(store.undo(), "id") == rows_of(two, "id")
    assert store.depth() == 1
    for i in range(12):
        store.push(spark.range(i + 10), f"v{i}")
    assert store.depth() == 10
    assert [e["label"] for e in store.entries()] == [f"v{i}" for i in range(2, 12)]
    assert store.table().count() == 10


def test_fingerprint_sees_copies_and_types(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert fingerprint(a) == fingerprint(a.orderBy(F.col("x").desc()).repartition(2))
    assert fingerprint(a) != fingerprint(a.distinct())
    assert fingerprint(a) != fingerprint(a.selectExpr("CAST(x AS bigint) AS x"))


def test_sql(spark, clean_table):
    r = query(spark, "SELECT city, count(*) AS n FROM df GROUP BY city", clean_table)
    assert sum(x["n"] for x in r.df.collect()) == 50 and not r.truncated
    few = query(spark, "SELECT * FROM df", clean_table, max_rows=5)
    assert few.df.count() == 5 and few.truncated
    joined = query(spark, "SELECT count(*) AS n FROM a JOIN b USING (id)", {"a": clean_table, "b": spark.range(9)})
    assert joined.df.first()["n"] == 9
    assert query(spark, "WITH t AS (SELECT 1 AS x) SELECT * FROM t LIMIT 1 -- end").df.first()["x"] == 1
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            query(spark, bad)
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "CREATE TABLE y AS SELECT 1"):
        with pytest.raises(Exception):
            query(spark, bad)
    for bad in ("1abc", "a-b", "a b", "", None):
        with pytest.raises(ValueError):
            register(bad, clean_table)


def test_query_log(spark, tmp_path, clean_table):
    log = QueryLog(spark, str(tmp_path / "log"))
    log.run("SELECT 1 AS x")
    with pytest.raises(Exception):
        log.run("SELECT nope FROM df", clean_table)
    rows = log.entries().collect()
    assert [r["row_count"] for r in rows] == [0, 1]
    assert rows[0]["error"] and rows[1]["error"] is None
    log.clear()
    assert log.entries().count() == 0


def test_issues(spark):
    df = spark.range(4000).selectExpr(
        "id", "id * 1.5 AS x", "'male' AS sex", "timestamp_ntz'2024-05-06' AS day"
    )
    spec = [
        {"issue": "nulls", "column": "x", "share": 0.1},
        {"issue": "variants", "column": "sex", "share": 0.2, "variants": ["Male", "M"]},
        {"issue": "number_words", "column": "id", "share": 0.05},
        {"issue": "mixed_dates", "column": "day"},
        {"issue": "duplicates", "share": 0.01},
    ]
    one, two = (inject_issues(d, ["id"], spec[:2], 7) for d in (df, df.repartition(17)))
    assert one.exceptAll(two).count() == 0
    full = inject_issues(df, ["id"], spec, 7)
    assert full.count() > 4000
    assert full.select("day").distinct().count() == 4
    assert {r[0] for r in full.select("sex").distinct().collect()} == {"male", "Male", "M"}
    assert 250 < full.where("x IS NULL").count() < 550
    with pytest.raises(ValueError):
        inject_issues(df, ["id"], [{"issue": "gremlins"}])


def test_streams_refuse_whole_table_operators(spark, sf_dir):
    from catalogue.streams import event_stream

    stream = event_stream(spark, sf_dir)
    for call in (
        lambda: clean.fill_missing(stream, ["value"], "mean"),
        lambda: clean.normalize_minmax(stream, ["value"]),
        lambda: clean.cap_outliers_iqr(stream, ["value"]),
        lambda: clean.reset_index(stream, ["ts"]),
    ):
        with pytest.raises((clean.CleaningError, ValueError)):
            call()


# ------------------------------------------------------------------ plan shape

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = clean.filter_rows(orders, "o_custkey", ">=", 50).df.select("o_orderkey")
    plan = plan_of(out)
    assert "GreaterThanOrEqual(o_custkey,50)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_row_local_chain_stays_in_one_stage(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = clean.strip_whitespace(orders).df
    df = clean.standardize_case(df, ["o_orderpriority"], "title").df
    df = clean.clip_range(df, ["o_totalprice"], 0, 1e5).df
    assert "Exchange" not in plan_of(df)


CHAIN = [
    {"op": "fill_missing", "params": {"columns": ["l_quantity", "l_tax"], "strategy": "median"}},
    {"op": "cap_outliers_iqr", "params": {"columns": ["l_quantity", "l_extendedprice"]}},
    {"op": "normalize_minmax", "params": {"columns": ["l_quantity", "l_discount"]}},
    {"op": "standardize_zscore", "params": {"columns": ["l_quantity", "l_extendedprice"]}},
    {"op": "fill_missing", "params": {"columns": ["l_returnflag"], "strategy": "mode"}},
]


def test_recipes_grow_the_plan_step_by_step(spark, sf_dir):
    """Ten statistic steps: each adds about as much to the plan as the one before."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    once = len(plan_of(replay(lines, CHAIN)))
    started = time.perf_counter()
    twice = replay(lines, CHAIN * 2)
    plan = plan_of(twice)
    assert "Subquery" not in plan and "Exchange" not in plan
    assert len(plan) < 3 * once
    assert twice.count() == lines.count()
    assert time.perf_counter() - started < 120


def test_logs_are_planned_on_demand(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    result = clean.strip_whitespace(lines)
    assert "log" not in vars(result) and result.log.first()["rows_before"] == lines.count()
    assert result.log is result.log


def test_replay_groups_copies_once(dirty_table):
    """Steps that read statistics do not drop the duplicates again."""
    steps = [("drop_duplicates", {}), ("normalize_minmax", {"columns": ["age"]})]
    out = replay(dirty_table, to_json(steps))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    by_hand = clean.normalize_minmax(clean.drop_duplicates(dirty_table).df, ["age"]).df
    assert rows_of(out, "*") == rows_of(by_hand, "*") and out.columns == by_hand.columns
