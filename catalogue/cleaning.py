"""Cleaning queries (C1-C21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Entry, columns_of, listed, over, view
from tablewise.operators import clean
from tablewise.plans.registry import apply_op, preview
from tablewise.plans.replay import replay, to_json
from tablewise.plans.versions import TableVersions, fingerprint
from tablewise.sources.scratch import scratch_path

ENTRIES: dict[str, Entry] = {}


def add(name: str, source: str, body: str | None, run) -> None:
    """``run(df)`` over a dirty view against ``body`` over the same view ``d``."""
    ENTRIES[name] = Entry(
        lambda spark, sf: run(view(spark, sf, source)), over(source, body) if body else None
    )


def replaced(source: str, exprs: dict[str, str], extra: str = "") -> str:
    return f"SELECT {listed(source, exprs)} FROM d {extra}"


LINES, ORDERS, EVENTS = "dirty_lines", "dirty_orders", "gappy_events"
UNTIDY = "untidy_customers"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]

# ----------------------------------------------------------- C1 fill missing


def _rounded(df, names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


add(
    "c01a_fill_mean", LINES,
    replaced(LINES, {
        c: f"round(coalesce({c}, (SELECT avg({c}) FROM d)), 4)" for c in NUMBERS
    }),
    lambda df: _rounded(clean.fill_missing(df, [*NUMBERS, "l_returnflag"], "mean").df, NUMBERS, 4),
)
add(
    "c01b_fill_median", LINES,
    replaced(LINES, {
        c: f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM d)), 4)" for c in NUMBERS
    }),
    lambda df: _rounded(clean.fill_missing(df, NUMBERS, "median").df, NUMBERS, 4),
)
_MODE = (
    "(SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
)
add(
    "c01c_fill_mode", ORDERS,
    replaced(ORDERS, {
        c: f"coalesce({c}, {_MODE.format(c=c)})" for c in ("o_orderstatus", "o_totalprice")
    }),
    lambda df: clean.fill_missing(df, ["o_orderstatus", "o_totalprice"], "mode").df,
)
add(
    "c01d_fill_constant", ORDERS,
    replaced(ORDERS, {"o_orderstatus": "coalesce(o_orderstatus, 'none')"}),
    lambda df: clean.fill_missing(df, ["o_orderstatus", "o_totalprice"], "constant", "none").df,
)
_W = "OVER ({keys} ORDER BY ts, event_id ROWS BETWEEN {frame})"
_UP, _DOWN = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"


def _fill_sql(fn: str, keys: str, frame: str) -> str:
    w = _W.format(keys=keys, frame=frame)
    return replaced(
        EVENTS, {c: f"{fn}({c} IGNORE NULLS) {w}" for c in ("value", "event_type")}
    )


add(
    "c01e_fill_forward", EVENTS, _fill_sql("last_value", "", _UP),
    lambda df: clean.fill_missing(
        df, ["value", "event_type"], "ffill", order_by=["ts", "event_id"]
    ).df,
)
add(
    "c01e_fill_forward_keyed", EVENTS, _fill_sql("last_value", "PARTITION BY user_id", _UP),
    lambda df: clean.fill_missing(
        df, ["value", "event_type"], "ffill", order_by=["ts", "event_id"], keys=["user_id"]
    ).df,
)
add(
    "c01f_fill_backward", EVENTS, _fill_sql("first_value", "", _DOWN),
    lambda df: clean.fill_missing(
        df, ["value", "event_type"], "bfill", order_by=["ts", "event_id"]
    ).df,
)

# ----------------------------------------------------------- C2 drop missing

_HELD = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in NUMBERS)
for _name, _need, _args in (
    ("c02_drop_missing_any", 3, {"how": "any"}),
    ("c02_drop_missing_all", 1, {"how": "all"}),
    ("c02_drop_missing_thresh", 2, {"how": "all", "thresh": 2}),
):
    add(
        _name, LINES, f"SELECT * FROM d WHERE {_HELD} >= {_need}",
        lambda df, a=_args: clean.drop_missing(df, NUMBERS, **a).df,
    )

# -------------------------------------------------------------- C3 duplicates

_OCOLS = ", ".join(columns_of(ORDERS))
add("c03_dedupe_rows", ORDERS, "SELECT DISTINCT * FROM d", lambda df: clean.drop_duplicates(df).df)
add(
    "c03_dedupe_rows_none", ORDERS,
    f"SELECT {_OCOLS} FROM d GROUP BY {_OCOLS} HAVING count(*) = 1",
    lambda df: clean.drop_duplicates(df, keep="none").df,
)
_SUBSET = ["o_custkey", "o_orderstatus"]
for _keep, _dir in (("first", "ASC"), ("last", "DESC")):
    add(
        f"c03_dedupe_{_keep}", ORDERS,
        f"SELECT {_OCOLS} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, "
        f"o_orderstatus ORDER BY o_orderkey {_dir}) AS rn FROM d) WHERE rn = 1",
        lambda df, k=_keep: clean.drop_duplicates(df, _SUBSET, k, order_by=["o_orderkey"]).df,
    )
add(
    "c03_dedupe_none", ORDERS,
    f"SELECT {_OCOLS} FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) "
    "AS n FROM d) WHERE n = 1",
    lambda df: clean.drop_duplicates(df, _SUBSET, "none").df,
)

# ---------------------------------------------------------------- C4, C5 fences

_FENCE = (
    "f AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) "
        f"AS lo_{c}, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) "
        f"- quantile_cont({c}, 0.25)) AS hi_{c}" for c in ("l_quantity", "l_extendedprice")
    ) + " FROM d)"
)
_FENCED = ["l_quantity", "l_extendedprice"]
ENTRIES["c04_cap_outliers"] = Entry(
    lambda spark, sf: _rounded(
        clean.cap_outliers_iqr(view(spark, sf, LINES), [*_FENCED, "l_returnflag"]).df, _FENCED, 4
    ),
    over(LINES, "").rstrip() + ", " + _FENCE + " SELECT " + listed(LINES, {
        c: f"round(CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END, 4)"
        for c in _FENCED
    }) + " FROM d, f",
)
ENTRIES["c05_remove_outliers"] = Entry(
    lambda spark, sf: clean.remove_outliers_iqr(view(spark, sf, LINES), _FENCED).df,
    over(LINES, "").rstrip() + ", " + _FENCE + " SELECT " + ", ".join(columns_of(LINES))
    + " FROM d, f WHERE " + " AND ".join(
        f"({c} IS NULL OR {c} BETWEEN lo_{c} AND hi_{c})" for c in _FENCED
    ),
)

# ---------------------------------------------------------------- C6, C7 text

add(
    "c06_strip", UNTIDY, replaced(UNTIDY, {c: f"trim({c})" for c in ("c_name", "segment", "label")}),
    lambda df: clean.strip_whitespace(df).df,
)
for _case in ("lower", "upper"):
    add(
        f"c07_{_case}", UNTIDY,
        replaced(UNTIDY, {c: f"{_case}({c})" for c in ("c_name", "segment")}),
        lambda df, k=_case: clean.standardize_case(df, ["c_name", "segment"], k).df,
    )
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all(label, '([A-Za-z]+|[^A-Za-z]+)'), "
    "lambda w: concat(upper(w[1]), lower(w[2:]))), '')"
)
add(
    "c07_title", UNTIDY, replaced(UNTIDY, {"label": _TITLE}),
    lambda df: clean.standardize_case(df, ["label", "c_acctbal"], "title").df,
)

# -------------------------------------------------------------- C8, C9 schema

add(
    "c08_rename", ORDERS,
    "SELECT " + ", ".join(
        {"o_orderkey": "o_orderkey AS id", "date_text": 'date_text AS "order date"'}.get(c, c)
        for c in columns_of(ORDERS)
    ) + " FROM d",
    lambda df: clean.rename_columns(df, {"o_orderkey": "id", "date_text": "order date"}).df,
)
add(
    "c09_drop_columns", ORDERS,
    "SELECT " + ", ".join(c for c in columns_of(ORDERS) if c not in ("constant_col", "mixed_col"))
    + " FROM d",
    lambda df: clean.drop_columns(df, ["constant_col", "mixed_col"]).df,
)

# ----------------------------------------------------------- C10-C12 types

add(
    "c10_dates_infer", ORDERS,
    replaced(ORDERS, {"date_text": "try_strptime(date_text, '%Y-%m-%d')"}),
    lambda df: clean.parse_dates(df, ["date_text"]).df,
)
add(
    "c10_dates_pattern", ORDERS,
    replaced(ORDERS, {"date_text": "try_strptime(date_text, '%d/%m/%Y')"}),
    lambda df: clean.parse_dates(df, ["date_text"], "%d/%m/%Y").df,
)
add(
    "c11_int", UNTIDY, replaced(UNTIDY, {"c_acctbal": "CAST(trunc(c_acctbal) AS BIGINT)"}),
    lambda df: clean.cast_dtype(df, ["c_acctbal"], "int").df,
)
add(
    "c11_float", ORDERS, replaced(ORDERS, {"o_custkey": "CAST(o_custkey AS DOUBLE)"}),
    lambda df: clean.cast_dtype(df, ["o_custkey"], "float").df,
)
add(
    "c11_str", LINES,
    replaced(LINES, {c: f"CAST({c} AS STRING)" for c in ("l_extendedprice", "l_partkey")}),
    lambda df: clean.cast_dtype(df, ["l_extendedprice", "l_partkey"], "str").df,
)
add(
    "c11_category", ORDERS, "SELECT * FROM d",
    lambda df: clean.cast_dtype(df, ["o_orderstatus"], "category").df,
)
add(
    "c11_bool", LINES,
    replaced(LINES, {
        "l_tax": "l_tax <> 0",
        "l_discount": "CASE WHEN l_discount IS NULL THEN TRUE ELSE l_discount <> 0 END",
        "l_returnflag": "l_returnflag <> ''",
    }),
    lambda df: clean.cast_dtype(df, ["l_tax", "l_discount", "l_returnflag"], "bool").df,
)
add(
    "c12_downcast", LINES,
    replaced(LINES, {
        **{c: f"CAST({c} AS INT)" for c in ("l_orderkey", "l_partkey")},
        **{c: f"CAST({c} AS FLOAT)" for c in ("l_quantity", "l_discount", "l_tax")},
    }),
    lambda df: clean.downcast_numeric(df).df,
)

# --------------------------------------------------------- C13-C15 numbers

add(
    "c13_clip", LINES,
    replaced(LINES, {
        "l_quantity": "CASE WHEN l_quantity < 5 THEN 5.0 WHEN l_quantity > 40 THEN 40.0 "
        "ELSE l_quantity END",
        "l_linenumber": "CASE WHEN l_linenumber < 5 THEN 5 WHEN l_linenumber > 40 THEN 40 "
        "ELSE l_linenumber END",
    }),
    lambda df: clean.clip_range(df, ["l_quantity", "l_linenumber", "l_returnflag"], 5, 40).df,
)
_SCALED = ["l_quantity", "l_extendedprice"]
add(
    "c14_minmax", LINES,
    replaced(LINES, {
        **{c: f"round(({c} - (SELECT min({c}) FROM d)) / (SELECT max({c}) - min({c}) FROM d), 6)"
           for c in _SCALED},
        "level": "0.0",
    }).replace("0.0 AS level", "CAST(0 AS DOUBLE) AS level"),
    lambda df: _rounded(clean.normalize_minmax(df, [*_SCALED, "level"]).df, _SCALED),
)
add(
    "c15_zscore", LINES,
    replaced(LINES, {
        **{c: f"round(({c} - (SELECT avg({c}) FROM d)) / (SELECT stddev_pop({c}) FROM d), 6)"
           for c in _SCALED},
        "level": "CAST(0 AS DOUBLE)",
    }),
    lambda df: _rounded(clean.standardize_zscore(df, [*_SCALED, "level"]).df, _SCALED),
)

# ------------------------------------------------------------- C16 filters

for _name, _col, _op, _val, _cond in (
    ("eq", "o_orderstatus", "==", "F", "o_orderstatus = 'F'"),
    ("ne", "o_orderstatus", "!=", "F", "o_orderstatus IS NULL OR o_orderstatus <> 'F'"),
    ("gt", "o_totalprice", ">", 250000.0, "o_totalprice > 250000"),
    ("ge", "o_custkey", ">=", 700, "o_custkey >= 700"),
    ("lt", "o_totalprice", "<", 250000.0, "o_totalprice < 250000"),
    ("le", "o_custkey", "<=", 700, "o_custkey <= 700"),
    ("in", "o_orderstatus", "in", ["F", "P"], "o_orderstatus IN ('F', 'P')"),
    (
        "notin", "o_orderstatus", "notin", ["F", "P"],
        "o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'P')",
    ),
    ("contains", "o_orderpriority", "contains", "-H", "contains(o_orderpriority, '-H')"),
    (
        "contains_number", "o_totalprice", "contains", "99",
        "contains(CAST(o_totalprice AS STRING), '99')",
    ),
):
    add(
        f"c16_{_name}", ORDERS, f"SELECT * FROM d WHERE {_cond}",
        lambda df, c=_col, o=_op, v=_val: clean.filter_rows(df, c, o, v).df,
    )

# ---------------------------------------------------------- C17-C21 and logs

add(
    "c17_reset_index", ORDERS,
    "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM d",
    lambda df: clean.reset_index(df, ["o_orderkey"]).df,
)
ENTRIES["c17_reset_index_keep"] = Entry(
    lambda spark, sf: clean.reset_index(
        view(spark, sf, EVENTS).withColumnRenamed("event_id", "row_no"), ["ts", "row_no"],
        drop=False,
    ).df,
    over(
        EVENTS,
        "SELECT ts, user_id, value, event_type, event_id AS index, "
        "row_number() OVER (ORDER BY ts, event_id) - 1 AS row_no FROM d",
    ),
)


def _log(result) -> object:
    return result.log.select(
        "op", "rows_before", "rows_after", "cells_changed",
        F.array_join("affected_columns", ",").alias("affected"),
        F.size("warnings").alias("n_warnings"),
    )


add(
    "c18_log_fill", ORDERS,
    "SELECT 'fill_missing' AS op, count(*) AS rows_before, count(*) AS rows_after, "
    "count(*) FILTER (WHERE o_totalprice IS NULL) AS cells_changed, "
    "'o_totalprice' AS affected, CAST(1 AS INT) AS n_warnings FROM d",
    lambda df: _log(
        apply_op(df, "fill_missing", columns=["o_totalprice", "o_custkey", "o_orderstatus"])
    ),
)
add(
    "c18_log_filter", ORDERS,
    "SELECT 'filter_rows' AS op, count(*) AS rows_before, "
    "count(*) FILTER (WHERE o_totalprice > 250000) AS rows_after, "
    "CAST(0 AS BIGINT) AS cells_changed, 'o_totalprice' AS affected, "
    "CAST(0 AS INT) AS n_warnings FROM d",
    lambda df: _log(apply_op(df, "filter_rows", column="o_totalprice", op=">", value=250000.0)),
)
add(
    "c18_log_dedupe", ORDERS,
    "SELECT 'drop_duplicates' AS op, count(*) AS rows_before, "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS rows_after, "
    f"CAST(0 AS BIGINT) AS cells_changed, '{','.join(columns_of(ORDERS))}' AS affected, "
    "CAST(0 AS INT) AS n_warnings FROM d",
    lambda df: _log(apply_op(df, "drop_duplicates")),
)
add(
    "c19_preview", UNTIDY,
    "SELECT 'segment' AS \"column\", segment AS old, trim(segment) AS new FROM d "
    "WHERE segment <> trim(segment)",
    lambda df: preview(df, "strip_whitespace", n=10_000_000, columns=["segment"]),
)


add(
    "c19_preview_limit", UNTIDY,
    "SELECT least(7, count(*)) AS shown, TRUE AS all_changed FROM d WHERE segment <> trim(segment)",
    lambda df: preview(df, "strip_whitespace", n=7, columns=["segment"]).agg(
        F.count(F.lit(1)).alias("shown"), F.bool_and(F.expr("old <> new")).alias("all_changed")
    ),
)


def _versions(df):
    """Store three states, one of them twice, and undo one: what is left on the stack."""
    store = TableVersions(df.sparkSession, scratch_path(df.sparkSession, "versions"))
    store.push(df, "raw")
    store.push(df, "again")
    store.push(clean.fill_missing(df, ["o_totalprice"], "constant", 0).df, "filled")
    store.push(clean.drop_duplicates(df).df, "deduped")
    top = store.undo()
    return top.select(F.lit(store.depth()).alias("depth"), "*")


add("c20_versions", ORDERS, "SELECT DISTINCT CAST(2 AS INT) AS depth, * FROM d", _versions)
add(
    "c20_fingerprint", ORDERS, "SELECT TRUE AS same, TRUE AS changed, TRUE AS shortened",
    lambda df: df.sparkSession.range(1).select(
        F.lit(fingerprint(df) == fingerprint(df.repartition(7))).alias("same"),
        F.lit(fingerprint(df) != fingerprint(_one_cell_changed(df))).alias("changed"),
        F.lit(fingerprint(df) != fingerprint(df.where("o_orderkey > 1"))).alias("shortened"),
    ),
)


def _one_cell_changed(df):
    first = F.col("o_orderkey") == df.agg(F.max("o_orderkey")).first()[0]
    return df.withColumn("o_orderpriority", F.when(first, "changed").otherwise(F.col("o_orderpriority")))


_RECIPE = to_json(
    [
        ("drop_duplicates", {}),
        ("fill_missing", {"columns": ["o_totalprice"], "strategy": "median"}),
        ("standardize_case", {"columns": ["o_orderpriority"], "case": "lower"}),
        ("no_such_step", {}),
        ("filter_rows", {"column": "o_totalprice", "op": ">=", "value": 1000}),
        ("drop_columns", {"columns": ["constant_col"]}),
    ]
)
_KEPT = [c for c in columns_of(ORDERS) if c != "constant_col"]
add(
    "c21_replay", ORDERS,
    ", u AS (SELECT DISTINCT * FROM d), m AS (SELECT quantile_cont(o_totalprice, 0.5) AS q FROM u), "
    "x AS (SELECT " + listed(ORDERS, {
        "o_totalprice": "round(coalesce(o_totalprice, q), 4)",
        "o_orderpriority": "lower(o_orderpriority)",
    }) + " FROM u, m) SELECT " + ", ".join(_KEPT) + " FROM x WHERE o_totalprice >= 1000",
    lambda df: _rounded(replay(df, _RECIPE), ["o_totalprice"], 4),
)

# ------------------------------------------------- a recipe of statistic steps

_CHAINED = ["l_quantity", "l_extendedprice", "l_discount"]
_CHAIN = to_json(
    [
        ("drop_duplicates", {}),
        ("fill_missing", {"columns": _CHAINED, "strategy": "median"}),
        ("cap_outliers_iqr", {"columns": _CHAINED}),
        ("normalize_minmax", {"columns": _CHAINED}),
        ("standardize_zscore", {"columns": _CHAINED}),
    ]
)


def _step(name: str, before: str, exprs: str, extra: str = "") -> str:
    """One step as a CTE; ``exprs`` is written for a column {c}."""
    return (
        f"{name} AS (SELECT " + listed(LINES, {c: exprs.format(c=c) for c in _CHAINED})
        + f" FROM {before}{extra})"
    )


def _facts(name: str, before: str, aggs: str) -> str:
    return f"{name} AS (SELECT " + ", ".join(aggs.format(c=c) for c in _CHAINED) + f" FROM {before})"


_LO = "quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}"
_HI = "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
ENTRIES["c21_replay_chain"] = Entry(
    lambda spark, sf: _rounded(replay(view(spark, sf, LINES), _CHAIN), _CHAINED, 4),
    over(LINES, "").rstrip() + ", u AS (SELECT DISTINCT * FROM d), "
    + ", ".join([
        _facts("m", "u", "quantile_cont({c}, 0.5) AS m_{c}"),
        _step("a", "u", "coalesce({c}, m_{c})", ", m"),
        _facts("f", "a", _LO + ", " + _HI),
        _step("b", "a", "CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END",
              ", f"),
        _facts("r", "b", "min({c}) AS min_{c}, max({c}) AS max_{c}"),
        _step("n", "b", "({c} - min_{c}) / (max_{c} - min_{c})", ", r"),
        _facts("z", "n", "avg({c}) AS avg_{c}, stddev_pop({c}) AS sd_{c}"),
    ])
    + " SELECT " + listed(LINES, {c: f"round(({c} - avg_{c}) / sd_{c}, 4)" for c in _CHAINED})
    + " FROM n, z",
)

# ------------------------------------------------------ null and NaN are missing

NANS = "nan_lines"
_NUMBERS = ("l_quantity", "l_extendedprice")


def add_nan(name: str, body: str, run) -> None:
    """SQL over the view with NaN read as null (``p``), which no result shows as NaN."""
    plain = listed(NANS, {c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" for c in _NUMBERS})
    ENTRIES[name] = Entry(
        lambda spark, sf: _no_nan(run(view(spark, sf, NANS))),
        over(NANS, "").rstrip() + f", p AS (SELECT {plain} FROM d){body}",
    )


def _no_nan(df):
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in _NUMBERS if c in df.columns})


_ALL = ", ".join(columns_of(NANS))
add_nan(
    "c01a_fill_mean_nan",
    " SELECT " + listed(NANS, {c: f"round(coalesce({c}, (SELECT avg({c}) FROM p)), 4)" for c in _NUMBERS})
    + " FROM p",
    lambda df: _rounded(clean.fill_missing(df, list(_NUMBERS), "mean").df, _NUMBERS, 4),
)
add_nan(
    "c01c_fill_mode_nan",
    " SELECT " + listed(NANS, {
        "l_quantity": "coalesce(l_quantity, (SELECT l_quantity FROM p WHERE l_quantity IS NOT NULL "
        "GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1))"
    }) + " FROM p",
    lambda df: clean.fill_missing(df, ["l_quantity"], "mode").df,
)
add_nan(
    "c02_drop_missing_nan",
    f" SELECT {_ALL} FROM p WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL",
    lambda df: clean.drop_missing(df).df,
)
add_nan(
    "c03_dedupe_nan",
    f" SELECT {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY l_quantity, l_returnflag "
    "ORDER BY l_orderkey, l_linenumber) AS r FROM p) WHERE r = 1",
    lambda df: clean.drop_duplicates(
        df, ["l_quantity", "l_returnflag"], order_by=["l_orderkey", "l_linenumber"]
    ).df,
)
# The row that stays keeps its kind of missing number.
ENTRIES["c03_dedupe_nan_kept"] = Entry(
    lambda spark, sf: clean.drop_duplicates(
        view(spark, sf, NANS), ["l_quantity"], order_by=["l_orderkey", "l_linenumber"]
    ).df.agg(
        F.count_if(F.isnan("l_quantity")).alias("nan_rows"),
        F.count_if(F.col("l_quantity").isNull()).alias("null_rows"),
    ),
    over(NANS, "").rstrip() + ", f AS (SELECT l_quantity FROM d WHERE l_quantity IS NULL OR "
    "isnan(l_quantity) ORDER BY l_orderkey, l_linenumber LIMIT 1) "
    "SELECT count(*) FILTER (WHERE l_quantity IS NOT NULL) AS nan_rows, "
    "count(*) FILTER (WHERE l_quantity IS NULL) AS null_rows FROM f",
)
add_nan(
    "c04_cap_outliers_nan",
    ", f AS (SELECT " + ", ".join(x.format(c="l_extendedprice") for x in (_LO, _HI)) + " FROM p) SELECT "
    + listed(NANS, {
        "l_extendedprice": "round(CASE WHEN l_extendedprice < lo_l_extendedprice THEN lo_l_extendedprice "
        "WHEN l_extendedprice > hi_l_extendedprice THEN hi_l_extendedprice ELSE l_extendedprice END, 4)"
    }) + " FROM p, f",
    lambda df: _rounded(clean.cap_outliers_iqr(df, ["l_extendedprice"]).df, ["l_extendedprice"], 4),
)
add_nan(
    "c13_clip_nan",
    " SELECT " + listed(NANS, {"l_quantity": "CASE WHEN l_quantity < 5 THEN 5 WHEN l_quantity > 20 THEN 20 "
                                "ELSE l_quantity END"}) + " FROM p",
    lambda df: clean.clip_range(df, ["l_quantity"], 5, 20).df,
)
add_nan(
    "c15_zscore_nan",
    " SELECT " + listed(NANS, {
        c: f"round(({c} - (SELECT avg({c}) FROM p)) / (SELECT stddev_pop({c}) FROM p), 4)" for c in _NUMBERS
    }) + " FROM p",
    lambda df: _rounded(clean.standardize_zscore(df, list(_NUMBERS)).df, _NUMBERS, 4),
)
for _name, _op, _val, _cond in (
    ("ne", "!=", 7.0, "l_quantity IS NULL OR l_quantity <> 7"),
    ("gt", ">", 7.0, "l_quantity > 7"),
    ("notin", "notin", [7.0, 8.0], "l_quantity IS NULL OR l_quantity NOT IN (7, 8)"),
):
    add_nan(
        f"c16_{_name}_nan",
        f" SELECT {_ALL} FROM p WHERE {_cond}",
        lambda df, op=_op, val=_val: clean.filter_rows(df, "l_quantity", op, val).df,
    )
