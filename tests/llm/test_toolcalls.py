import json

import pytest
from pyspark.sql import functions as F

from tablewise.llm import queries, toolcalls

MESSAGES = "conv_id long, turn int, role string, text string"
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("sum", "values", "array", True),
    ("sum", "exact", "boolean", False),
    ("sum", "scale", "number", False),
]


@pytest.fixture(scope="module")
def tools(spark):
    return spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")


def call(call_id, name, arguments, after=None):
    own = {"name": name, "id": call_id, "arguments": arguments}
    return own | ({"after": after} if after is not None else {})


def message(conv, turn, *calls):
    return (conv, turn, "assistant", json.dumps({"tool_calls": list(calls)}))


def answer(conv, turn, call_id, content="done"):
    return (conv, turn, "tool", json.dumps({"tool_call_id": call_id, "content": content}))


def linked(spark, tools, rows):
    return toolcalls.link_calls(spark.createDataFrame(rows, MESSAGES), tools).collect()


def test_against_sql(spark, sf_dir):
    import duckdb

    from check import normal

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cursor = con.execute(queries.SQL["op6_tool_calls"])
    df = queries.op6_tool_calls(spark, sf_dir)
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    assert normal(df.columns, df.collect()) == want


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op6_tool_calls(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_validation_and_canonical_json(spark, tools):
    rows = [
        message(1, 0,
                call("a", "search", {"query": "q", "limit": 3}),
                call("b", "search", {"limit": "3", "else": 1}),
                call("c", "sum", {"values": [2, {"z": 1, "a": None}], "scale": 1.50, "exact": True}),
                call("d", "fly", {}),
                call("e", "search", "[1]"),
                call("f", "search", '{"query": "é\\"", "limit": 1}'),
                call("g", "search", "no json"),
                call("h", "sum", {"values": "x", "exact": 1, "scale": True})),
    ]
    got = {r["call_id"]: r for r in linked(spark, tools, rows)}
    assert {k: r["errors"] for k, r in got.items()} == {
        "a": "",
        "b": "limit is no integer; missing query; unexpected else",
        "c": "",
        "d": "unknown tool",
        "e": "arguments are no object",
        "f": "",
        "g": "arguments are no object",
        "h": "exact is no boolean; scale is no number; values is no array",
    }
    assert got["c"]["json"] == (
        '{"arguments":{"exact":true,"scale":1.5,"values":[2,{"a":null,"z":1}]},'
        '"id":"c","name":"sum","type":"call"}'
    )
    assert json.loads(got["f"]["json"])["arguments"] == {"limit": 1, "query": 'é"'}
    assert got["g"]["json"] == '{"id":"g","name":"search","type":"call"}'


def test_order_and_status(spark, tools):
    ok = {"query": "q"}
    rows = [
        message(1, 1, call("a", "search", ok), call("b", "search", ok, "a")),
        message(1, 3, call("c", "search", ok, "b"), call("d", "search", ok, "gone")),
        message(1, 5, call("x", "search", ok, "y"), call("y", "search", ok, "x")),
        message(1, 6, call("z", "search", ok, "x"), call("s", "search", ok, "s")),
        message(1, 7, call("two", "search", ok)), message(1, 8, call("two", "search", ok)),
        answer(1, 2, "a"), answer(1, 2, "a"), answer(1, 4, "c"), answer(1, 0, "b"),
        answer(1, 9, "nobody"), answer(2, 9, "a"), answer(1, 9, "x"), answer(1, 9, "two"),
    ]
    got = linked(spark, tools, rows)
    calls = {r["call_id"]: r for r in got if r["kind"] == "call"}
    assert {k: (r["level"], r["status"]) for k, r in calls.items()} == {
        "a": (0, "ok"), "b": (2, "ok"), "c": (4, "ok"), "d": (0, "ok"),
        "x": (None, "cycle"), "y": (None, "cycle"), "z": (None, "cycle"), "s": (None, "cycle"),
        "two": (0, "ambiguous"),
    }
    assert calls["d"]["errors"] == "unknown parent"
    results = [
        (r["conv_id"], r["call_id"], r["level"], r["status"]) for r in got if r["kind"] == "result"
    ]
    assert sorted(results, key=repr) == sorted([
        (1, "a", 1, "ok"), (1, "a", 1, "ok"), (1, "c", 5, "ok"), (1, "b", 3, "early"),
        (1, "nobody", None, "orphan"), (2, "a", None, "orphan"), (1, "x", None, "cycle"),
        (1, "two", 1, "ambiguous"),
    ], key=repr)


def test_long_chain(spark, tools):
    rows = [
        message(7, i, call(f"k{i}", "search", {"query": "q"}, f"k{i - 1}" if i else None))
        for i in range(200)
    ]
    got = {r["call_id"]: r["level"] for r in linked(spark, tools, rows)}
    assert got == {f"k{i}": 2 * i for i in range(200)}


def test_awkward(spark, tools):
    rows = [
        (None, None, None, None), (1, 1, "assistant", None), (1, 1, "assistant", ""),
        (1, 1, "assistant", "{not json"), (1, 2, "assistant", '{"other": 1}'),
        (1, 2, "assistant", '{"tool_calls": null}'), (1, 3, "tool", "plain"),
        (None, 1, "assistant", json.dumps({"tool_calls": [{"arguments": None}]})),
        (None, 2, "tool", json.dumps({"content": "c"})),
        message(3, None, call("a", "search", {"query": "x" * 100_000})),
        (1, 9, "user", '{"tool_calls": [{"id": "u"}]}'),
    ]
    wide = spark.createDataFrame(rows, MESSAGES).withColumns(
        {c: F.lit("own") for c in ("call_id", "name", "level", "k_id", "errors")}
    )
    got = toolcalls.link_calls(wide, tools).collect()
    assert {(r["conv_id"], r["kind"], r["call_id"], r["status"]) for r in got} == {
        (None, "call", "", "ok"), (None, "result", "", "ok"), (3, "call", "a", "ok"),
    }
    assert len(got) == 3
    empty = spark.createDataFrame([], MESSAGES)
    assert toolcalls.link_calls(empty, tools).collect() == []
    assert toolcalls.link_calls(empty, tools.limit(0)).collect() == []
