"""Chart-data queries (V1-V9)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalogue.base import Entry, columns_of, over, table, view
from catalogue.profiling import _BYTES, LINE_NUMBERS, _matrix_sql, _round_r, _spearman_sql, union
from tablewise.operators import chart

ENTRIES: dict[str, Entry] = {}
LINES, ORDERS, EVENTS = "dirty_lines", "dirty_orders", "gappy_events"


def add(name: str, source: str, body: str | None, run) -> None:
    ENTRIES[name] = Entry(
        lambda spark, sf: run(view(spark, sf, source)), over(source, body) if body else None
    )


_WORST = union([
    f"SELECT {i} AS i, '{c}' AS \"column\", "
    f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS missing_pct FROM d"
    for i, c in enumerate(columns_of(LINES))
])
add(
    "v01_missing_bars", LINES,
    f"SELECT \"column\", missing_pct FROM ({_WORST}) ORDER BY missing_pct DESC, i LIMIT 4",
    lambda df: chart.missing_bars(df, 4),
)

_VARIED = [c for c in LINE_NUMBERS if c != "level"]
add(
    "v02_heatmap_pearson", LINES,
    _matrix_sql(_VARIED, lambda a, b: f"(SELECT corr({a}, {b}) FROM d)")
    + "".join(
        f" UNION ALL SELECT '{a}', '{b}', CAST(NULL AS DOUBLE)"
        for c in _VARIED for a, b in ((c, "level"), ("level", c))
    )
    + " UNION ALL SELECT 'level', 'level', CAST(NULL AS DOUBLE)",
    lambda df: _round_r(chart.correlation_cells(df)),
)
_PAIR = ["l_quantity", "l_discount"]
add(
    "v02_heatmap_spearman", LINES, _matrix_sql(_PAIR, _spearman_sql),
    lambda df: _round_r(chart.correlation_cells(df.select(*_PAIR), "spearman")),
)


def _rounded(df, names, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in names})


def _histogram_sql(value: str, bins: int) -> str:
    return (
        f", v AS (SELECT {value} AS v FROM d WHERE {value} IS NOT NULL), s AS (SELECT min(v) AS lo, "
        f"(max(v) - min(v)) / {bins} AS w, count(*) AS total FROM v), b AS (SELECT "
        f"least({bins - 1}, CAST(floor((v - lo) / w) AS INT)) AS bin, count(*) AS n "
        "FROM v, s GROUP BY 1) SELECT bin, round(lo + bin * w, 6) AS lower, "
        "round(lo + (bin + 1) * w, 6) AS upper, n, round(n / (total * w), 10) AS density FROM b, s"
    )


add(
    "v03_histogram", LINES, _histogram_sql("l_extendedprice", 30),
    lambda df: _rounded(_rounded(chart.histogram(df, "l_extendedprice"), ["lower", "upper"], 6),
                        ["density"], 10),
)
# Texts that are no numbers ("id-17") are left out of the bins.
add(
    "v03_histogram_text", ORDERS, _histogram_sql("TRY_CAST(mixed_col AS DOUBLE)", 12),
    lambda df: _rounded(_rounded(chart.histogram(df, "mixed_col", 12), ["lower", "upper"], 6),
                        ["density"], 10),
)
add(
    "v04_density", EVENTS,
    ", v AS (SELECT value AS v, count(*) AS w FROM d WHERE value IS NOT NULL GROUP BY value), "
    "s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, "
    "stddev_samp(value) * pow(count(*), -0.2) AS h FROM d WHERE value IS NOT NULL), "
    "g AS (SELECT CAST(p AS INT) AS point, lo + p * ((hi - lo) / 199) AS x FROM range(0, 200) AS r(p), s) "
    "SELECT point, round(x, 6) AS x, round(sum(w * exp(-power((x - v) / h, 2) / 2)) "
    f"/ (any_value(n) * any_value(h) * {math.sqrt(2 * math.pi)!r}), 8) AS density "
    "FROM g, v, s GROUP BY point, x",
    lambda df: _rounded(_rounded(chart.density_curve(df, "value"), ["x"], 6), ["density"], 8),
)
# Pooling the values into 2000 cells must reproduce the exact curve to three digits.
add(
    "v04_density_pooled", EVENTS,
    "SELECT CAST(200 AS BIGINT) AS points, TRUE AS close",
    lambda df: chart.density_curve(df, "value")
    .join(
        chart.density_curve(df, "value", cells=2000).select(
            "point", F.col("density").alias("pooled")
        ),
        "point",
    )
    .agg(
        F.count(F.lit(1)).alias("points"),
        (F.max(F.abs(F.col("density") - F.col("pooled"))) < 1e-3 * F.max("density")).alias("close"),
    ),
)


def _top_sql(c: str, n: int) -> str:
    counts = (
        f", c AS (SELECT CAST({c} AS STRING) AS category, count(*) AS n FROM d "
        f"WHERE {c} IS NOT NULL GROUP BY {c}), t AS (SELECT *, row_number() OVER "
        "(ORDER BY n DESC, category) AS pos FROM c)"
    )
    return (
        f"{counts} SELECT CASE WHEN pos <= {n} THEN category ELSE 'Other' END AS category, "
        "CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1"
    )


add("v05_top_categories", ORDERS, _top_sql("rare_class", 10),
    lambda df: chart.top_categories(df, "rare_class"))
add("v05_top_categories_few", ORDERS, _top_sql("o_orderstatus", 10),
    lambda df: chart.top_categories(df, "o_orderstatus"))

_BOX = (
    ", q AS (SELECT count(o_totalprice) AS n, quantile_cont(o_totalprice, 0.25) AS q25, "
    "quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75 FROM d), "
    "f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM q) "
)
add(
    "v06_box_plot", ORDERS,
    _BOX + "SELECT any_value(n) AS n, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50, "
    "round(any_value(q75), 6) AS q75, min(o_totalprice) FILTER (WHERE o_totalprice BETWEEN lo AND hi) "
    "AS whisker_low, max(o_totalprice) FILTER (WHERE o_totalprice BETWEEN lo AND hi) AS whisker_high, "
    "count(*) FILTER (WHERE o_totalprice < lo OR o_totalprice > hi) AS n_outliers FROM d, f",
    lambda df: _rounded(chart.box_plot(df, "o_totalprice"), ["q25", "q50", "q75"], 6),
)
add(
    "v06_box_outliers", ORDERS,
    _BOX + "SELECT o_totalprice AS v FROM d, f WHERE o_totalprice < lo OR o_totalprice > hi",
    lambda df: chart.box_outliers(df, "o_totalprice"),
)
add(
    "v07_class_shares", ORDERS,
    "SELECT o_orderstatus AS category, count(*) AS n, "
    "round(count(*) / (SELECT count(o_orderstatus) FROM d), 8) AS share, "
    "round(1.0 / (SELECT count(DISTINCT o_orderstatus) FROM d), 8) AS balanced "
    "FROM d WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus",
    lambda df: _rounded(chart.class_shares(df, "o_orderstatus"), ["share", "balanced"], 8),
)
add(
    "v08_footprint_bars", ORDERS,
    "SELECT \"column\", round(b / 1048576.0, 6) AS mb FROM (" + union([
        f"SELECT '{c}' AS \"column\", {b} AS b FROM d" for c, b in _BYTES.items()
    ]) + ") ORDER BY b DESC, \"column\" LIMIT 5",
    lambda df: chart.footprint_bars(df, 5),
)
ENTRIES["v09_sample"] = Entry(
    lambda spark, sf: chart.steady_sample(table(spark, sf, "lineitem"), 1000)
)
# The sample is as large as asked, made of table rows, and blind to partitioning.
add(
    "v09_sample_steady", EVENTS,
    "SELECT CAST(1000 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS moved",
    lambda df: _steady(df),
)


def _steady(df):
    one = chart.steady_sample(df, 1000, keys=["event_id"])
    two = chart.steady_sample(df.repartition(13), 1000, keys=["event_id"])
    return one.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(one.join(df, "event_id", "left_anti").agg(F.count(F.lit(1))).scalar()).alias("strangers"),
        F.lit(one.join(two, "event_id", "left_anti").agg(F.count(F.lit(1))).scalar()).alias("moved"),
    )


add(
    "v09_sample_whole", EVENTS, "SELECT * FROM d",
    lambda df: chart.steady_sample(df, 10_000_000),
)
