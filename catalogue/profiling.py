"""Profiling queries (P1-P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import VIEWS, Entry, columns_of, over, table, view
from tablewise.operators import clean, compare, correlate, footprint, health, profile

ENTRIES: dict[str, Entry] = {}
LINES, ORDERS = "dirty_lines", "dirty_orders"


def add(name: str, source: str, body: str | None, run) -> None:
    ENTRIES[name] = Entry(
        lambda spark, sf: run(view(spark, sf, source)), over(source, body) if body else None
    )


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "level",
]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_TEXTS = [
    "o_orderstatus", "o_orderpriority", "date_text", "constant_col", "mixed_col", "rare_class",
]

# ---------------------------------------------------------------- P1, P18

_MISSING = union([
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
    f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS missing_pct FROM d"
    for c in columns_of(ORDERS)
])
add("p01_missing_summary", ORDERS, _MISSING, profile.missing_summary)
_ORDINAL = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(columns_of(LINES)))
add(
    "p18_rank_by_missing", LINES,
    "SELECT CAST(row_number() OVER (ORDER BY missing_share DESC, i) AS INT) AS place, "
    "\"column\", round(missing_share, 6) AS missing_share FROM ("
    + union([
        f"SELECT {i} AS i, '{c}' AS \"column\", "
        f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS missing_share FROM d"
        for i, c in enumerate(columns_of(LINES))
    ]) + ") ORDER BY place LIMIT 20",
    lambda df: profile.rank_columns_by_missing(df, 20),
)

add(
    "p01_missing_nan", "nan_lines",
    "SELECT * FROM (" + union([
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {t}) AS missing_count, "
        f"round(100.0 * count(*) FILTER (WHERE {t}) / count(*), 4) AS missing_pct FROM d"
        for c, t in (
            ("l_orderkey", "FALSE"), ("l_linenumber", "FALSE"), ("l_returnflag", "FALSE"),
            *((c, f"{c} IS NULL OR isnan({c})") for c in ("l_quantity", "l_extendedprice")),
        )
    ]) + ")",
    profile.missing_summary,
)

# ---------------------------------------------------------------- P2

_COLS = ", ".join(columns_of(ORDERS))
_DUP = f"(SELECT count(*) AS n FROM d GROUP BY {_COLS})"
add(
    "p02_duplicate_summary", ORDERS,
    "SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS total, "
    f"round(100.0 * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS pct FROM {_DUP}",
    profile.duplicate_summary,
)
# Which five copies are shown is free, that all of them have a copy is not.
add(
    "p02_duplicate_sample", ORDERS,
    f"SELECT CAST(least(5, sum(n)) AS BIGINT) AS shown, CAST(least(5, sum(n)) AS BIGINT) AS copied "
    f"FROM {_DUP} WHERE n > 1",
    lambda df: profile.duplicate_sample(df).agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if(F.col("o_orderkey") % 100 == 1).alias("copied"),
    ),
)

# ---------------------------------------------------------------- P3


def _numeric_facts(names: list[str]) -> str:
    return union([
        f"SELECT {i} AS i, '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, "
        f"stddev_pop({c}) AS sd, stddev_samp({c}) AS sds, "
        f"CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, "
        f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
        f"quantile_cont({c}, 0.75) AS q75 FROM d"
        for i, c in enumerate(names)
    ])


def _long(names: list[str]) -> str:
    return union([
        f"SELECT {i} AS i, CAST({c} AS DOUBLE) AS v FROM d WHERE {c} IS NOT NULL"
        for i, c in enumerate(names)
    ])


def _outliers(names: list[str]) -> str:
    return (
        f"f AS ({_numeric_facts(names)}), "
        "g AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lower, q75 + 1.5 * (q75 - q25) AS upper "
        "FROM f WHERE n >= 4 AND sd > 0), "
        f"l AS ({_long(names)}), "
        "o AS (SELECT g.i, g.\"column\", g.n, lower, upper, "
        "count(*) FILTER (WHERE v < lower OR v > upper) AS iqr_outliers, "
        "count(*) FILTER (WHERE abs(v - mean) / sd > 3) AS zscore_outliers "
        "FROM l JOIN g ON l.i = g.i GROUP BY ALL)"
    )


add(
    "p03_outlier_summary", LINES,
    f", {_outliers(LINE_NUMBERS)} SELECT \"column\", iqr_outliers, zscore_outliers, "
    "round(lower, 6) AS lower_bound, round(upper, 6) AS upper_bound FROM o",
    lambda df: profile.outlier_summary(df, "both"),
)

# ---------------------------------------------------------------- P4


def _gini(names: list[str]) -> str:
    counts = union([
        f"SELECT {i} AS i, '{c}' AS \"column\", CAST({c} AS STRING) AS v, count(*) AS x FROM d "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for i, c in enumerate(names)
    ])
    return (
        f"c AS ({counts}), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY x) AS pos "
        "FROM c), k AS (SELECT i, \"column\", count(*) AS k, sum(x) AS n, "
        "sum(CAST(x AS DOUBLE) * x) AS sq, greatest(0.0, least(1.0, 2.0 * sum(CAST(pos AS DOUBLE) * x) "
        "/ (count(*) * sum(x)) - (count(*) + 1.0) / count(*))) AS gini FROM r GROUP BY i, \"column\")"
    )


# Chi-squared tail for even degrees of freedom: e^-h times a Poisson-like sum.
_TAIL = (
    "list_sum(list_transform(range(0, CAST((k - 1) / 2 AS BIGINT)), "
    "lambda a: exp(a * ln(h) - h - lgamma(a + 1))))"
)
add(
    "p04_imbalance_summary", ORDERS,
    f", {_gini([c for c in ORDER_TEXTS])}, x AS (SELECT *, (k / n * sq - n) / 2 AS h FROM k "
    "WHERE k BETWEEN 2 AND 50) SELECT \"column\", k AS n_classes, round(gini, 6) AS gini, "
    f"round({_TAIL}, 6) AS chi2_p_value, gini > 0.7 AS is_imbalanced FROM x",
    profile.imbalance_summary,
)

# ---------------------------------------------------------------- P5-P7

_PAIRS = [(a, b) for i, a in enumerate(LINE_NUMBERS[:-1]) for b in LINE_NUMBERS[i + 1:-1]]
_R4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql(names: list[str], pair) -> str:
    rows = []
    for a in names:
        for b in names:
            r = "CAST(1 AS DOUBLE)" if a == b else f"round({pair(*sorted((a, b), key=names.index))}, 6)"
            rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r} AS r")
    return union(rows)


def _round_r(df):
    return df.withColumn("r", F.round("r", 6))


add(
    "p05_pearson", LINES,
    _matrix_sql(LINE_NUMBERS[:-1], lambda a, b: f"(SELECT corr({a}, {b}) FROM d)"),
    lambda df: _round_r(correlate.correlation_matrix(df.drop("level"))),
)


# Infinities in the price of some rows, which correlations leave out pair by pair.
_ENDLESS = "CASE WHEN l_orderkey % 50 = 3 THEN CAST('Infinity' AS DOUBLE) WHEN l_orderkey % 50 = 4 " \
    "THEN CAST('-Infinity' AS DOUBLE) ELSE l_extendedprice END"
_ENDLESS_NAMES = ["l_quantity", "price", "l_discount"]
add(
    "p05_pearson_infinite", LINES,
    f"SELECT * FROM (WITH e AS (SELECT l_quantity, {_ENDLESS} AS price, l_discount FROM d) "
    + _matrix_sql(
        _ENDLESS_NAMES,
        lambda a, b: f"(SELECT corr({a}, {b}) FROM e WHERE isfinite({a}) AND isfinite({b}))",
    ) + ")",
    lambda df: _round_r(
        correlate.correlation_matrix(
            df.select("l_quantity", F.expr(_ENDLESS).alias("price"), "l_discount")
        )
    ),
)


def _spearman_sql(a: str, b: str) -> str:
    rank = (
        "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    )
    return (
        f"(SELECT corr(ra, rb) FROM (SELECT {rank.format(c=a)} AS ra, {rank.format(c=b)} AS rb "
        f"FROM d WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"
    )


add(
    "p06_spearman", LINES, _matrix_sql(_R4, _spearman_sql),
    lambda df: _round_r(correlate.correlation_matrix(df, "spearman", _R4)),
)
ENTRIES["p06_spearman_complete"] = Entry(
    lambda spark, sf: _round_r(
        correlate.correlation_matrix(table(spark, sf, "lineitem"), "spearman", _R4)
    ),
    "WITH d AS (SELECT * FROM lineitem) " + _matrix_sql(_R4, _spearman_sql),
)
_ALL_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
ENTRIES["p06_spearman_all_columns"] = Entry(
    lambda spark, sf: _round_r(
        correlate.correlation_matrix(table(spark, sf, "lineitem"), "spearman")
    ),
    "WITH d AS (SELECT * FROM lineitem) " + _matrix_sql(_ALL_NUMBERS, _spearman_sql),
)
add(
    "p07_top_correlations", LINES,
    "SELECT col_a, col_b, round(r, 6) AS r FROM (" + union([
        f"SELECT {k} AS k, '{a}' AS col_a, '{b}' AS col_b, (SELECT corr({a}, {b}) FROM d) AS r"
        for k, (a, b) in enumerate(_PAIRS)
    ]) + ") ORDER BY abs(r) DESC, k LIMIT 5",
    lambda df: _round_r(correlate.top_correlations(df, 5)),
)

# ---------------------------------------------------------------- P8, P17


def _digits(df, names, n):
    return df.withColumns({c: F.round(c, n) for c in names})


_SHAPE = [c for c in LINE_NUMBERS if c != "level"]
add(
    "p08_distribution", LINES,
    union([
        f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 4) AS q25, "
        f"round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, "
        f"round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM d"
        for c in _SHAPE
    ]) + " UNION ALL SELECT 'level', 3.0, 0.0, 3.0, 3.0, 3.0, 3.0, 3.0, 0.0, 0.0",
    lambda df: _digits(
        _digits(
            profile.distribution_summary(df), ["mean", "std", "q25", "q50", "q75"], 4
        ),
        ["skew", "kurtosis"], 6,
    ),
)
add(
    "p17_describe_numeric", LINES,
    f", f AS ({_numeric_facts(LINE_NUMBERS)}) SELECT \"column\", n AS count, "
    "round(mean, 2) AS mean, round(sds, 2) AS std, round(lo, 2) AS min, round(q25, 2) AS q25, "
    "round(q50, 2) AS q50, round(q75, 2) AS q75, round(hi, 2) AS max FROM f",
    profile.describe_numeric,
)

# ---------------------------------------------------------------- P9, P10

_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double",
}
add(
    "p09_cardinality", ORDERS,
    union([
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, "
        f"round(CAST(count(DISTINCT {c}) AS DOUBLE) / count(*), 6) AS uniqueness_ratio, "
        f"'{_TYPES.get(c, 'string')}' AS dtype, count(DISTINCT {c}) >= 50 AND "
        f"CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) >= 0.5 AS is_high_cardinality FROM d"
        for c in columns_of(ORDERS)
    ]),
    profile.cardinality_summary,
)
# The sketch must stay within three of its standard errors of the exact count.
add(
    "p09_cardinality_approx", ORDERS,
    union([f"SELECT '{c}' AS \"column\", TRUE AS close" for c in columns_of(ORDERS)]),
    lambda df: profile.cardinality_summary(df, approx=True)
    .select("column", F.col("unique_count").alias("u"))
    .join(profile.cardinality_summary(df).select("column", "unique_count"), "column")
    .select("column", (F.abs(F.col("u") / F.col("unique_count") - 1) <= 0.06).alias("close")),
)
add(
    "p10_constant_columns", ORDERS,
    "SELECT \"column\" FROM (" + union([
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS k FROM d" for c in columns_of(ORDERS)
    ]) + ") WHERE k = 1",
    profile.constant_columns,
)

# ---------------------------------------------------------------- P11, P12

_KINDS = {
    "integer": "regexp_matches(trim({c}), '^[+-]?[0-9]+$')",
    "decimal": "regexp_matches(trim({c}), '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')",
    "boolean": "lower(trim({c})) IN ('true', 'false')",
}


def _class_sql(names: list[str]) -> str:
    rows = []
    for i, c in enumerate(names):
        tests = {k: t.format(c=c) for k, t in _KINDS.items()}
        tests["text"] = "NOT (" + " OR ".join(tests.values()) + ")"
        cells = ", ".join(
            f"count(*) FILTER (WHERE {c} IS NOT NULL AND {t}) AS n_{k}" for k, t in tests.items()
        )
        rows.append(f"SELECT {i} AS i, '{c}' AS \"column\", {cells} FROM d")
    return union(rows)


_USED = " + ".join(
    f"CASE WHEN n_{k} > 0 THEN 1 ELSE 0 END" for k in ("integer", "decimal", "boolean", "text")
)
add(
    "p11_mixed_types", ORDERS,
    f", m AS ({_class_sql(ORDER_TEXTS)}) SELECT \"column\", n_integer, n_decimal, n_boolean, "
    f"n_text FROM m WHERE {_USED} >= 2",
    profile.mixed_type_columns,
)

# strptime twins of the layouts; the rest never applies to these tables.
_STRP = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y")


def _dates_sql(names: list[str]) -> str:
    rows = []
    for i, c in enumerate(names):
        hits = ", ".join(f"count(try_strptime({c}, '{f}'))" for f in _STRP)
        rows.append(f"SELECT {i} AS i, '{c}' AS \"column\", count({c}) AS n, [{hits}] AS hits FROM d")
    return (
        f"t AS ({union(rows)}), s AS (SELECT i, \"column\", n, list_max(hits) AS ok, "
        "list_position(hits, list_max(hits)) AS best, "
        "n > 0 AND list_max(hits) / n > 0.5 AS suspected, "
        "n > 0 AND list_max(hits) / n > 0.5 AND (n - list_max(hits)) / n > 0.1 AS bad FROM t)"
    )


add(
    "p12_date_consistency", ORDERS,
    f", {_dates_sql(ORDER_TEXTS)} SELECT 'date_text' AS \"column\", "
    "(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT date_text AS v FROM d "
    "WHERE date_text IS NOT NULL AND try_strptime(date_text, '%Y-%m-%d') IS NULL "
    "ORDER BY v LIMIT 5)) AS samples FROM s WHERE \"column\" = 'date_text' AND bad AND best = 1",
    lambda df: profile.date_consistency(df).select(
        "column", F.array_join("samples", ",").alias("samples")
    ),
)

add(
    "p12_padded_dates", "padded_orders",
    "SELECT 'date_text' AS \"column\", (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT "
    "date_text AS v FROM d WHERE o_orderkey % 5 = 0 ORDER BY v LIMIT 5)) AS samples",
    lambda df: profile.date_consistency(df).select(
        "column", F.array_join("samples", ",").alias("samples")
    ),
)

# ---------------------------------------------------------------- P13, P14

_BYTES = {
    c: f"CAST(coalesce(sum(octet_length(encode({c}))), 0) AS BIGINT)" for c in ORDER_TEXTS
} | {c: "count(*) * 8" for c in ORDER_NUMBERS}
add(
    "p13_footprint", ORDERS,
    union([
        f"SELECT '{c}' AS \"column\", {b} AS bytes, round({b} / 1048576.0, 6) AS mb FROM d"
        for c, b in _BYTES.items()
    ]),
    footprint.memory_footprint,
)


def _narrow(c: str) -> str:
    b = _BYTES[c]
    if c in ORDER_TEXTS:
        thin = f"count(DISTINCT {c}) / count(*) < 0.5"
        words = f"(SELECT coalesce(sum(octet_length(encode(v))), 0) FROM (SELECT DISTINCT {c} AS v FROM d))"
        return (
            f"SELECT '{c}' AS \"column\", round({b} / 1048576.0, 6) AS mb, 'string' AS dtype, "
            f"CASE WHEN {thin} THEN 'category' END AS suggested_dtype, "
            f"round(CASE WHEN {thin} THEN greatest(0, {b} - count(*) * 4 - {words}) ELSE 0 END "
            "/ 1048576.0, 6) AS savings_mb FROM d"
        )
    to, dtype = ("float", "double") if c == "o_totalprice" else ("int", "bigint")
    return (
        f"SELECT '{c}' AS \"column\", round({b} / 1048576.0, 6) AS mb, '{dtype}' AS dtype, "
        f"'{to}' AS suggested_dtype, round(count(*) * 4 / 1048576.0, 6) AS savings_mb FROM d"
    )


add("p14_narrowing", ORDERS, union([_narrow(c) for c in _BYTES]), footprint.narrowing_suggestions)

# ---------------------------------------------------------------- P15, P16, P19


def health_sql(texts: list[str], numbers: list[str], names: list[str]) -> str:
    """CTEs ending in ``a``: one row (category, amount, affected) per category."""
    cols, k = ", ".join(names), len(names)
    holes = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in names)

    def joined(flags: list[tuple[str, str]]) -> str:
        return "concat_ws(',', " + ", ".join(
            f"CASE WHEN {test} THEN '{c}' END" for c, test in flags
        ) + ")"

    lines = [
        f"SELECT 'missing' AS category, least(30.0, 60.0 * ({holes}) / (count(*) * {k})) AS amount, "
        + joined([(c, f"count({c}) < count(*)") for c in names]) + " AS affected FROM d",
        "SELECT 'duplicates', least(15.0, 50.0 * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)), "
        f"'' FROM (SELECT count(*) AS n FROM d GROUP BY {cols})",
        "SELECT 'outliers', least(10.0, 100.0 * avg(CAST(iqr_outliers AS DOUBLE) / n)), "
        "coalesce(string_agg(\"column\", ',' ORDER BY i) FILTER (WHERE iqr_outliers > 0), '') FROM o",
        "SELECT 'imbalance', CASE WHEN max(gini) FILTER (WHERE k >= 2) > 0.7 THEN "
        "10.0 * (max(gini) FILTER (WHERE k >= 2) - 0.7) / 0.3 ELSE 0 END, "
        "coalesce(string_agg(\"column\", ',' ORDER BY i) FILTER (WHERE k >= 2 AND gini > 0.7), '') "
        "FROM k",
        f"SELECT 'mixed_dtype', least(10.0, 50.0 * count(*) FILTER (WHERE {_USED} >= 2) / {k}), "
        f"coalesce(string_agg(\"column\", ',' ORDER BY i) FILTER (WHERE {_USED} >= 2), '') FROM m",
        "SELECT 'cardinality', least(5.0, 10.0 * count(*) FILTER (WHERE k >= 50 AND "
        f"CAST(k AS DOUBLE) / (SELECT count(*) FROM d) >= 0.5) / {max(1, len(texts))}), "
        "coalesce(string_agg(\"column\", ',' ORDER BY i) FILTER (WHERE k >= 50 AND "
        "CAST(k AS DOUBLE) / (SELECT count(*) FROM d) >= 0.5), '') FROM k",
        "SELECT 'constant', least(10.0, 50.0 * (" + " + ".join(
            f"CASE WHEN count(DISTINCT {c}) = 1 THEN 1 ELSE 0 END" for c in names
        ) + f") / {k}), " + joined([(c, f"count(DISTINCT {c}) = 1") for c in names]) + " FROM d",
        "SELECT 'date_inconsistency', least(10.0, 10.0 * count(*) FILTER (WHERE bad) / "
        "greatest(1, count(*) FILTER (WHERE suspected))), "
        "coalesce(string_agg(\"column\", ',' ORDER BY i) FILTER (WHERE bad), '') FROM s",
    ]
    return (
        f"{_outliers(numbers)}, {_gini(texts)}, m AS ({_class_sql(texts)}), {_dates_sql(texts)}, "
        f"a AS ({union(lines)})"
    )


_HEALTH = health_sql(ORDER_TEXTS, ORDER_NUMBERS, columns_of(ORDERS))
_ZONE = (
    "CASE WHEN score <= 40 THEN 'Critical' WHEN score <= 60 THEN 'Needs Work' "
    "WHEN score <= 80 THEN 'Good' ELSE 'Excellent' END"
)
_SCORE = "z AS (SELECT CAST(greatest(0, least(100, floor(100.0 - sum(amount)))) AS INT) AS score FROM a)"
add(
    "p15_health_deductions", ORDERS,
    f", {_HEALTH} SELECT category, round(amount, 2) AS deduction, affected FROM a",
    lambda df: health.health_deductions(df).select(
        "category", "deduction", F.array_join("affected_columns", ",").alias("affected")
    ),
)


def flat_health(df):
    scored = health.health_score(df)
    return scored.select(
        "score", "zone", *[F.col("deductions")[c].alias(c) for c in health.CAPS]
    )


HEALTH_SQL = over(
    ORDERS,
    f", {_HEALTH}, {_SCORE} SELECT score, {_ZONE} AS zone, " + ", ".join(
        f"(SELECT round(amount, 2) FROM a WHERE category = '{c}') AS {c}" for c in health.CAPS
    ) + " FROM z",
)
ENTRIES["p15_health_score"] = Entry(
    lambda spark, sf: flat_health(view(spark, sf, ORDERS)), HEALTH_SQL
)
ENTRIES["p16_health_zone"] = Entry(
    lambda spark, sf: table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 101).alias("score"),
        health.zone_of(F.col("o_orderkey") % 101).alias("zone"),
    ).distinct(),
    f"SELECT DISTINCT score, {_ZONE} AS zone FROM (SELECT o_orderkey % 101 AS score FROM orders)",
)

_AFTER = [c for c in columns_of(ORDERS) if c != "constant_col"]


def _cleaned(df):
    df = clean.drop_duplicates(df).df
    df = clean.drop_missing(df, ["o_totalprice"]).df
    return clean.drop_columns(df, ["constant_col"]).df


def _compare_sql() -> str:
    base = VIEWS[ORDERS].sql
    after = (
        f"SELECT DISTINCT * FROM ({base}) WHERE o_totalprice IS NOT NULL"
    )
    sides = []
    for side, sql, names in (("before", base, columns_of(ORDERS)), ("after", after, _AFTER)):
        texts = [c for c in ORDER_TEXTS if c in names]
        mb = " + ".join(
            f"coalesce(sum(octet_length(encode({c}))), 0)" for c in texts
        ) + f" + count(*) * 8 * {len(ORDER_NUMBERS)}"
        ctes = f"WITH d AS ({sql}), {health_sql(texts, ORDER_NUMBERS, names)}, {_SCORE}"
        cols = ", ".join(names)
        ctes = ctes.replace(f"WITH d AS ({sql})", f"WITH d AS (SELECT {cols} FROM ({sql}))", 1)
        sides.append(
            f"SELECT * FROM ({ctes} SELECT '{side}' AS side, CAST(count(*) AS DOUBLE) AS n, "
            f"CAST(count(*) * {len(names)} AS DOUBLE) AS cells, ({mb}) / 1048576.0 AS mb, "
            "CAST((SELECT score FROM z) AS DOUBLE) AS score FROM d)"
        )
    rows = union([
        f"SELECT '{m}' AS measure, max({c}) FILTER (WHERE side = 'before') AS b, "
        f"max({c}) FILTER (WHERE side = 'after') AS a FROM s2"
        for m, c in (("rows", "n"), ("cells", "cells"), ("mb", "mb"), ("health_score", "score"))
    ])
    return (
        f"WITH s2 AS ({union(sides)}), r2 AS ({rows}) SELECT measure, round(b, 6) AS before, "
        "round(a, 6) AS after, round(a - b, 6) AS diff, "
        "CASE WHEN b <> 0 THEN round((a - b) / b * 100, 1) END AS pct_change, "
        "CASE WHEN measure = 'health_score' THEN a - b > 0 ELSE a - b < 0 END AS improving FROM r2"
    )


ENTRIES["p19_compare"] = Entry(
    lambda spark, sf: compare.compare(
        view(spark, sf, ORDERS), _cleaned(view(spark, sf, ORDERS))
    ),
    _compare_sql(),
)
