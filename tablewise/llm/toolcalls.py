"""Tool calls and their results in conversations: linked, ordered, validated, serialised.

Everything here is DataFrame operations; calls, results and parents find each other by hash
joins.  An assistant's message that is a JSON object
with ``tool_calls`` issues calls (id, name, arguments, and optionally ``after``: the call
whose result it builds on); a tool's message answers one call by its id.  Rows stay rows:
no conversation is gathered, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import checkpointed

_CALLS = (
    "struct<tool_calls: array<struct<id: string, name: string, after: string, "
    "arguments: variant>>>"
)
_RESULT = "struct<tool_call_id: string, content: string>"


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, call_id, name, after, arguments) of the assistants' messages.

    ``arguments`` is canonical JSON: keys sorted, no blanks.  Arguments given as a string
    are parsed once more; where they are no JSON the column is null.  A missing id is "".
    """
    parsed = F.from_json("text", _CALLS)["tool_calls"]
    as_text = F.expr("try_variant_get(c.arguments, '$', 'string')")
    plain = F.expr("schema_of_variant(c.arguments)") == "STRING"
    return (
        messages.where((F.col("role") == "assistant") & F.col("text").rlike(r"^\s*\{"))
        .select("conv_id", "turn", F.posexplode(parsed).alias("nth", "c"))
        .select(
            "conv_id",
            "turn",
            "nth",
            F.coalesce("c.id", F.lit("")).alias("call_id"),
            F.coalesce("c.name", F.lit("")).alias("name"),
            F.col("c.after").alias("after"),
            F.when(plain, F.to_json(F.try_parse_json(as_text)))
            .otherwise(F.to_json("c.arguments"))
            .alias("arguments"),
        )
    )


def results_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, content) of the tools' messages that are JSON objects."""
    parsed = F.from_json("text", _RESULT)
    return (
        messages.where((F.col("role") == "tool") & F.col("text").rlike(r"^\s*\{"))
        .select("conv_id", "turn", parsed.alias("r"))
        .select(
            "conv_id",
            "turn",
            F.coalesce("r.tool_call_id", F.lit("")).alias("call_id"),
            F.col("r.content").alias("content"),
        )
    )


def _levels(ids: DataFrame) -> DataFrame:
    """(conv_id, call_id, steps): calls to go back to the first of the chain; null in a cycle.

    Every round doubles the distance looked back, so a chain of any length takes a
    logarithmic number of rounds.  What a round leaves as it was hangs on a cycle.
    """
    parents = ids.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"))
    state = checkpointed(
        ids.join(
            parents.hint("shuffle_hash"),
            F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("after") == F.col("p_id")),
            "left",
        ).select(
            "conv_id",
            "call_id",
            F.col("p_id").alias("up"),
            F.when(F.col("p_id").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        )
    )
    open_ = state.where("up IS NOT NULL").count()
    while open_:
        back = state.select(
            F.col("conv_id").alias("b_conv"),
            F.col("call_id").alias("b_id"),
            F.col("up").alias("b_up"),
            F.col("steps").alias("b_steps"),
        )
        state = checkpointed(
            state.join(
                back.hint("shuffle_hash"),
                F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("up") == F.col("b_id")),
                "left",
            ).select(
                "conv_id",
                "call_id",
                F.col("b_up").alias("up"),
                (F.col("steps") + F.coalesce("b_steps", F.lit(0))).alias("steps"),
            )
        )
        left = state.where("up IS NOT NULL").count()
        if left == open_:
            break
        open_ = left
    return state.select(
        "conv_id", "call_id", F.when(F.col("up").isNull(), F.col("steps")).alias("steps")
    )


def _fits(found: Column, wanted: Column) -> Column:
    return (
        F.when(wanted == "string", found == "STRING")
        .when(wanted == "integer", found == "BIGINT")
        .when(wanted == "number", found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        .when(wanted == "boolean", found == "BOOLEAN")
        .when(wanted == "object", found.startswith("OBJECT"))
        .when(wanted == "array", found.startswith("ARRAY"))
        .otherwise(F.lit(False))
    )


def _errors(arguments: Column, params: Column) -> Column:
    """What is wrong with a call's arguments, in a fixed order; empty if nothing is."""
    none = F.array().cast("array<string>")
    given = F.expr("try_cast(try_parse_json(arguments) AS map<string, variant>)")
    keys = F.map_keys(given)
    types = F.transform_values(given, lambda _, v: F.schema_of_variant(v))
    missing = F.transform(
        F.filter(params, lambda p: p["required"] & ~F.map_contains_key(given, p["param"])),
        lambda p: F.concat(F.lit("missing "), p["param"]),
    )
    wrong = F.transform(
        F.filter(
            params,
            lambda p: F.map_contains_key(given, p["param"])
            & ~_fits(F.try_element_at(types, p["param"]), p["type"]),
        ),
        lambda p: F.concat(p["param"], F.lit(" is no "), p["type"]),
    )
    extra = F.transform(
        F.array_except(keys, F.transform(params, lambda p: p["param"])),
        lambda k: F.concat(F.lit("unexpected "), k),
    )
    return (
        F.when(params.isNull(), F.array(F.lit("unknown tool")))
        .when(given.isNull(), F.array(F.lit("arguments are no object")))
        .otherwise(F.coalesce(F.array_sort(F.concat(missing, wrong, extra)), none))
    )


def link_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per call and per result in ``messages`` (conv_id, turn, role, text):
    conv_id, turn, kind, call_id, name, level, status, errors, json.

    ``tools`` has a row (name, param, type, required) for each parameter; types are
    string, integer, number, boolean, object and array.

    Sorted by (conv_id, level, turn, call_id, kind) the rows are in a topological order:
    a call has level 0, or two more than the call it comes after, its results one more
    than itself.  Status of calls: ``ok``; ``ambiguous`` if the conversation issues the id
    more than once (repeated rows do), the earliest one then giving the level; ``cycle``
    with null level if it comes after itself.  Status of results: ``ok``; ``orphan`` with
    null level and name if nobody called; ``early`` if it does not follow its call; else
    that of its call.  ``errors`` joins what validation finds with "; ", and "unknown
    parent" if ``after`` names no call (such a call has level 0).  ``json`` is canonical:
    sorted keys, no blanks, nulls left out.  Messages that are no JSON objects are passed
    over; null turns come first; empty tables give an empty table.
    """
    calls, results = calls_of(messages), results_of(messages)
    ids = checkpointed(
        calls.groupBy("conv_id", "call_id")
        .agg(
            F.count(F.lit(1)).alias("issued"),
            F.min(F.struct("turn", "nth", "name", "after")).alias("first"),
        )
        .select("conv_id", "call_id", "issued", "first.turn", "first.name", "first.after")
    )
    levels = _levels(ids.select("conv_id", "call_id", "after"))
    known = ids.join(
        levels.toDF("l_conv", "l_id", "steps").hint("shuffle_hash"),
        F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("call_id") == F.col("l_id")),
    ).select(
        F.col("conv_id").alias("k_conv"),
        F.col("call_id").alias("k_id"),
        F.col("issued"),
        F.col("turn").alias("k_turn"),
        F.col("name").alias("k_name"),
        F.col("steps"),
    )
    state = F.when(F.col("issued") > 1, "ambiguous").when(F.col("steps").isNull(), "cycle")
    same = F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("call_id") == F.col("k_id"))
    params = tools.groupBy(F.col("name").alias("t_name")).agg(
        F.sort_array(F.collect_set(F.struct("param", "type", "required"))).alias("params")
    )
    parents = ids.select(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_id"))
    lost = F.when(
        F.col("after").isNotNull() & F.col("a_id").isNull(), F.array(F.lit("unknown parent"))
    ).otherwise(F.array().cast("array<string>"))
    errors = F.concat(_errors(F.col("arguments"), F.col("params")), lost)
    linked_calls = (
        calls.join(known.hint("shuffle_hash"), same)
        .join(
            parents.hint("shuffle_hash"),
            F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("after") == F.col("a_id")),
            "left",
        )
        .join(params, F.col("name") == F.col("t_name"), "left")
        .select(
            "conv_id",
            "turn",
            F.lit("call").alias("kind"),
            "call_id",
            "name",
            (F.col("steps") * 2).alias("level"),
            F.coalesce(state, F.lit("ok")).alias("status"),
            F.array_join(errors, "; ").alias("errors"),
            F.to_json(
                F.struct(
                    "after",
                    F.try_parse_json("arguments").alias("arguments"),
                    F.col("call_id").alias("id"),
                    "name",
                    F.lit("call").alias("type"),
                )
            ).alias("json"),
        )
    )
    linked_results = results.join(known.hint("shuffle_hash"), same, "left").select(
        "conv_id",
        "turn",
        F.lit("result").alias("kind"),
        "call_id",
        F.col("k_name").alias("name"),
        (F.col("steps") * 2 + 1).alias("level"),
        F.when(F.col("k_id").isNull(), "orphan")
        .when(state.isNotNull(), state)
        .when(F.col("turn") <= F.col("k_turn"), "early")
        .otherwise("ok")
        .alias("status"),
        F.lit("").alias("errors"),
        F.to_json(
            F.struct(
                "content", F.col("call_id").alias("id"), F.lit("result").alias("type")
            )
        ).alias("json"),
    )
    return linked_calls.unionByName(linked_results)


#: Calls and results derived from plain conversations, in SQL that Spark and others read.
#: ``k`` spreads the kinds of calls and faults over all rows; ``body`` is the whole text as it
#: stands between the quotes of JSON.
_SLASH = "chr(92)"
BODY = f"replace(coalesce(text, ''), {_SLASH}, concat({_SLASH}, {_SLASH}))"
for _code, _letter in ((34, '"'), (10, "n"), (13, "r"), (9, "t"), (8, "b"), (12, "f")):
    BODY = f"replace({BODY}, chr({_code}), concat({_SLASH}, '{_letter}'))"
VIEW = f"""
SELECT conv_id, turn, CAST(conv_id * 31 + turn AS BIGINT) AS k,
       CAST(length(coalesce(text, '')) AS BIGINT) AS n, {BODY} AS body, role
FROM conversations
"""


def _turn(step: int) -> str:
    return f"concat('c', CAST(turn + {step} AS STRING))"


NAME = "CASE WHEN k % 11 = 5 THEN 'teleport' WHEN k % 2 = 0 THEN 'search' ELSE 'convert' END"
#: Some calls repeat an earlier call's id; some come after themselves or after a later call.
CALL_ID = f"CASE WHEN k % 29 = 6 AND turn >= 3 THEN {_turn(-2)} ELSE {_turn(0)} END"
AFTER = (
    f"CASE WHEN k % 37 = 8 THEN {CALL_ID} WHEN k % 31 = 9 THEN {_turn(2)} "
    f"WHEN turn >= 3 AND k % 3 <> 0 THEN {_turn(-2)} END"
)
_N = "CAST(n AS STRING)"
ARGUMENTS = f"""CASE
    WHEN k % 11 = 5 THEN '{{ "to": "x" }}'
    WHEN k % 2 = 0 AND k % 5 = 1 THEN concat('{{"query": ', {_N}, ', "limit": ', {_N}, '}}')
    WHEN k % 2 = 0 AND k % 5 = 2 THEN concat('{{"limit": ', {_N}, ', "more": true}}')
    WHEN k % 2 = 0 THEN concat('{{"query": "', body, '", "limit": ', {_N}, '}}')
    WHEN k % 7 = 3 THEN '["m"]'
    ELSE concat('{{"unit": "m", "options": {{"b": 1, "a": [1, 2]}}, "amount": ', {_N}, '.5}}') END"""
#: Answers to nobody, to the next call (too early), or to the last one.
ANSWERS = f"CASE WHEN k % 13 = 4 THEN 'lost' WHEN k % 17 = 2 THEN {_turn(1)} ELSE {_turn(-1)} END"
TOOLS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("convert", "amount", "number", True),
    ("convert", "unit", "string", True),
    ("convert", "options", "object", False),
)
MESSAGES = f"""
SELECT conv_id, turn, 'assistant' AS role,
       concat('{{"tool_calls": [{{"name": "', {NAME}, '", "id": "', {CALL_ID}, '", ',
              coalesce('"after": "' || {AFTER} || '", ', ''),
              '"arguments": ', {ARGUMENTS}, '}}]}}') AS text
FROM derived WHERE role = 'assistant'
UNION ALL
SELECT conv_id, turn, 'tool' AS role,
       concat('{{"tool_call_id": "', {ANSWERS}, '", "content": "', body, '"}}') AS text
FROM derived WHERE role <> 'assistant'
"""

#: The same links by plain SQL: recursion for the levels, and spelled-out canonical JSON.
#: Calls that recursion does not reach hang on a cycle.
ORACLE = f"""
WITH RECURSIVE derived AS ({VIEW}),
calls AS (
  SELECT conv_id, turn, {CALL_ID} AS call_id, {NAME} AS name, {AFTER} AS after, k, n, body
  FROM derived WHERE role = 'assistant'),
ids AS (
  SELECT conv_id, call_id, turn, name, after, issued FROM (
    SELECT c.*, count(*) OVER (PARTITION BY conv_id, call_id) AS issued,
      row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn) AS place FROM calls c)
  WHERE place = 1),
linked AS (
  SELECT i.*, p.call_id AS parent
  FROM ids i LEFT JOIN ids p ON p.conv_id = i.conv_id AND p.call_id = i.after),
levels AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS level FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.conv_id, l.call_id, v.level + 2
  FROM linked l JOIN levels v ON v.conv_id = l.conv_id AND v.call_id = l.parent),
known AS (
  SELECT i.*, v.level,
    CASE WHEN i.issued > 1 THEN 'ambiguous' WHEN v.level IS NULL THEN 'cycle' END AS fault
  FROM ids i LEFT JOIN levels v ON v.conv_id = i.conv_id AND v.call_id = i.call_id),
results AS (
  SELECT conv_id, turn, {ANSWERS} AS call_id, body FROM derived WHERE role <> 'assistant')
SELECT l.conv_id, l.turn, 'call' AS kind, l.call_id, l.name, i.level,
  coalesce(i.fault, 'ok') AS status,
  concat_ws('; ',
    CASE WHEN l.name = 'teleport' THEN 'unknown tool'
         WHEN l.name = 'search' AND k % 5 = 1 THEN 'query is no string'
         WHEN l.name = 'search' AND k % 5 = 2 THEN 'missing query; unexpected more'
         WHEN l.name = 'convert' AND k % 7 = 3 THEN 'arguments are no object' END,
    CASE WHEN l.after IS NOT NULL AND p.call_id IS NULL THEN 'unknown parent' END) AS errors,
  concat('{{', coalesce('"after":"' || l.after || '",', ''), '"arguments":',
    CASE WHEN l.name = 'teleport' THEN '{{"to":"x"}}'
         WHEN l.name = 'search' AND k % 5 = 1 THEN concat('{{"limit":', {_N}, ',"query":', {_N}, '}}')
         WHEN l.name = 'search' AND k % 5 = 2 THEN concat('{{"limit":', {_N}, ',"more":true}}')
         WHEN l.name = 'search' THEN concat('{{"limit":', {_N}, ',"query":"', body, '"}}')
         WHEN k % 7 = 3 THEN '["m"]'
         ELSE concat('{{"amount":', {_N}, '.5,"options":{{"a":[1,2],"b":1}},"unit":"m"}}') END,
    ',"id":"', l.call_id, '","name":"', l.name, '","type":"call"}}') AS json
FROM calls l JOIN known i ON i.conv_id = l.conv_id AND i.call_id = l.call_id
LEFT JOIN ids p ON p.conv_id = l.conv_id AND p.call_id = l.after
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.call_id, i.name, i.level + 1,
  CASE WHEN i.call_id IS NULL THEN 'orphan' WHEN i.fault IS NOT NULL THEN i.fault
       WHEN r.turn <= i.turn THEN 'early' ELSE 'ok' END, '',
  concat('{{"content":"', r.body, '","id":"', r.call_id, '","type":"result"}}')
FROM results r LEFT JOIN known i ON i.conv_id = r.conv_id AND i.call_id = r.call_id
"""


def derived_messages(conversations: DataFrame) -> DataFrame:
    """Messages with calls and results made from every turn of plain conversations."""
    spark = conversations.sparkSession
    derived = spark.sql(VIEW.replace("FROM conversations", "FROM {c}"), c=conversations)
    return spark.sql(_for_spark(MESSAGES), d=derived)


def _for_spark(query: str) -> str:
    """The query with its table as a parameter; other braces are doubled."""
    return query.replace("{", "{{").replace("}", "}}").replace("FROM derived", "FROM {d}")


def tool_table(conversations: DataFrame) -> DataFrame:
    return conversations.sparkSession.createDataFrame(
        list(TOOLS), "name string, param string, type string, required boolean"
    )
