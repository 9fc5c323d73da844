"""The 0-100 health score: capped deductions over eight categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import categorical_columns, numeric_columns, text_columns
from tablewise.operators import profile, stats

# --- fixed values: the most each category may take off ------------------------
CAPS = {
    "missing": 30,
    "duplicates": 15,
    "outliers": 10,
    "imbalance": 10,
    "mixed_dtype": 10,
    "cardinality": 5,
    "constant": 10,
    "date_inconsistency": 10,
}
# --- fixed values: highest score of each zone ----------------------------------
ZONES = ((40, "Critical"), (60, "Needs Work"), (80, "Good"), (100, "Excellent"))


def health_zone(score: int) -> str:
    if not 0 <= score <= 100:
        raise ValueError(f"score must be between 0 and 100, got {score}")
    return next(zone for top, zone in ZONES if score <= top)


def zone_of(score: Column) -> Column:
    out = F.when(score <= ZONES[0][0], ZONES[0][1])
    for top, zone in ZONES[1:]:
        out = out.when(score <= top, zone)
    return out


def _capped(category: str, value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(CAPS[category])), value))


def _line(category: str, n_rows: Column, value: Column, reason: Column, affected: Column):
    """One category row; the reason is null when there is nothing to say."""
    return F.struct(
        F.lit(category).alias("category"),
        n_rows.cast("bigint").alias("n_rows"),
        F.coalesce(_capped(category, value.cast("double")), F.lit(0.0)).alias("amount"),
        reason.alias("reason"),
        affected.cast("array<string>").alias("affected_columns"),
    )


def _listed(rule: Column) -> Column:
    """Aggregate over per-column rows: names for which the rule holds, in column order."""
    kept = F.array_sort(F.collect_list(F.when(rule, F.struct("i", "column"))))
    return F.transform(kept, lambda s: s["column"])


def _cell_lines(df: DataFrame) -> DataFrame:
    """Missing cells and constant columns, out of one scan."""
    k = len(df.columns)
    folded = stats.column_facts(df).agg(
        F.max("n_rows").alias("n"),
        F.sum("missing").alias("holes"),
        _listed(F.col("missing") > 0).alias("holed"),
        _listed(F.col("constant")).alias("fixed"),
    )
    share = F.col("holes") / (F.col("n") * k)
    return folded.select(
        F.inline(
            F.array(
                _line(
                    "missing",
                    F.coalesce("n", F.lit(0)),
                    60.0 * share,
                    F.when(
                        F.col("holes") > 0,
                        F.format_string(
                            "%d of all cells are missing (%.2f%%), in %d column(s)",
                            F.col("holes"), share * 100, F.size("holed"),
                        ),
                    ),
                    F.col("holed"),
                ),
                _line(
                    "constant",
                    F.coalesce("n", F.lit(0)),
                    50.0 * F.size("fixed") / k,
                    F.when(
                        F.size("fixed") > 0,
                        F.format_string("%d constant column(s)", F.size("fixed")),
                    ),
                    F.col("fixed"),
                ),
            )
        )
    )


def _text_lines(df: DataFrame) -> DataFrame:
    """Mixed values and inconsistent dates, out of one scan of the text columns."""
    n, best = F.col("n"), F.array_max("hits")
    folded = profile.text_facts(df).agg(
        _listed(profile.classes_used() >= 2).alias("mixed"),
        F.count_if(profile.suspected_date(n, best)).alias("suspected"),
        _listed(profile.inconsistent_date(n, best)).alias("bad"),
    )
    return folded.select(
        F.inline(
            F.array(
                _line(
                    "mixed_dtype",
                    F.lit(0),
                    50.0 * F.size("mixed") / len(df.columns),
                    F.when(
                        F.size("mixed") > 0,
                        F.format_string("%d column(s) mix value types", F.size("mixed")),
                    ),
                    F.col("mixed"),
                ),
                _line(
                    "date_inconsistency",
                    F.lit(0),
                    10.0 * F.size("bad") / F.greatest(F.lit(1), F.col("suspected")),
                    F.when(
                        F.size("bad") > 0,
                        F.format_string(
                            "%d of %d date column(s) have over 10%% of values in another "
                            "layout",
                            F.size("bad"), F.col("suspected"),
                        ),
                    ),
                    F.col("bad"),
                ),
            )
        )
    )


def _duplicate_line(df: DataFrame) -> DataFrame:
    share = F.col("members") / F.col("n_rows")
    return stats.duplicate_counts(df).select(
        F.inline(
            F.array(
                _line(
                    "duplicates",
                    F.col("n_rows"),
                    50.0 * F.when(F.col("n_rows") > 0, share),
                    F.when(
                        F.col("members") > 0,
                        F.format_string(
                            "%d row(s) have an exact copy (%.2f%%)",
                            F.col("members"), share * 100,
                        ),
                    ),
                    F.array(),
                )
            )
        )
    )


def _outlier_line(df: DataFrame) -> DataFrame:
    ratio = F.col("iqr_outliers") / F.col("n")
    folded = profile.outlier_counts(df).agg(
        F.avg(ratio).alias("mean_ratio"),
        F.count(F.lit(1)).alias("columns"),
        _listed(F.col("iqr_outliers") > 0).alias("affected"),
    )
    return folded.select(
        F.inline(
            F.array(
                _line(
                    "outliers",
                    F.lit(0),
                    100.0 * F.col("mean_ratio"),
                    F.when(
                        F.col("mean_ratio") > 0,
                        F.format_string(
                            "%.2f%% of values on average lie outside the quartile fences "
                            "of %d numeric column(s)",
                            F.col("mean_ratio") * 100, F.col("columns"),
                        ),
                    ),
                    F.col("affected"),
                )
            )
        )
    )


def _class_lines(df: DataFrame) -> DataFrame:
    """Imbalance and cardinality, both out of one value-count pass."""
    names = categorical_columns(df)
    high = profile._high_cardinality(
        F.col("classes"), F.col("classes") / F.col("n_rows")
    )
    skewed = (F.col("classes") >= 2) & (F.col("gini") > profile.GINI_LIMIT)

    folded = stats.value_profile(df, names).agg(
        F.max("n_rows").alias("n"),
        F.max(F.when(F.col("classes") >= 2, F.col("gini"))).alias("worst"),
        _listed(skewed).alias("skewed"),
        _listed(high).alias("high"),
    )
    worst = F.when((F.col("n") >= 2) & (F.col("worst") > profile.GINI_LIMIT), F.col("worst"))
    limit = profile.GINI_LIMIT
    return folded.select(
        F.inline(
            F.array(
                _line(
                    "imbalance",
                    F.col("n"),
                    CAPS["imbalance"] * (worst - limit) / 0.3,
                    F.when(
                        worst.isNotNull(),
                        F.format_string("class Gini index reaches %.3f (limit 0.70)", worst),
                    ),
                    F.when(worst.isNotNull(), F.col("skewed")).otherwise(F.array()),
                ),
                _line(
                    "cardinality",
                    F.col("n"),
                    10.0 * F.size("high") / max(1, len(names)),
                    F.when(
                        F.size("high") > 0,
                        F.format_string(
                            "%d categorical column(s) are close to unique", F.size("high")
                        ),
                    ),
                    F.col("high"),
                ),
            )
        )
    )


# Which column kinds a category needs.
_NEEDS = {
    "outliers": numeric_columns,
    "imbalance": categorical_columns,
    "cardinality": categorical_columns,
    "mixed_dtype": text_columns,
    "date_inconsistency": text_columns,
}
LINE_SCHEMA = (
    "category string, n_rows bigint, amount double, reason string, "
    "affected_columns array<string>"
)


def health_lines(df: DataFrame) -> DataFrame:
    """(category, n_rows, amount, reason, affected_columns), unrounded amounts."""
    parts = [_cell_lines(df), _duplicate_line(df)]
    if text_columns(df):
        parts.append(_text_lines(df))
    if numeric_columns(df):
        parts.append(_outlier_line(df))
    if categorical_columns(df):
        parts.append(_class_lines(df))
    void = [c for c, needed in _NEEDS.items() if not needed(df)]
    if void:
        rows = [(c, 0, 0.0, None, []) for c in void]
        parts.append(df.sparkSession.createDataFrame(rows, LINE_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def health_deductions(df: DataFrame) -> DataFrame:
    """(category, deduction, reason, affected_columns): one row per category."""
    return health_lines(df).select(
        "category", F.round("amount", 2).alias("deduction"), "reason", "affected_columns"
    )


def health_score(df: DataFrame) -> DataFrame:
    """One row: score, zone, deductions, reasons and affected columns per category.

    An empty table scores 0 with the single reason "No data".
    """
    if not df.columns:
        return df.sparkSession.createDataFrame(
            [(0, "Critical", {}, {"empty": "No data"}, {})],
            "score int, zone string, deductions map<string,double>, "
            "reasons map<string,string>, affected_columns map<string,array<string>>",
        )
    lines = health_lines(df).withColumn("rounded", F.round("amount", 2))

    def entries(value: str, keep: Column) -> Column:
        kept = F.collect_list(F.when(keep, F.struct("category", value)))
        return F.map_from_entries(F.array_sort(kept))

    folded = lines.agg(
        F.max("n_rows").alias("n"),
        F.sum("amount").alias("total"),
        entries("rounded", F.lit(True)).alias("deductions"),
        entries("reason", F.col("reason").isNotNull()).alias("reasons"),
        entries("affected_columns", F.size("affected_columns") > 0).alias("affected"),
    )
    empty = F.col("n") == 0
    score = F.when(empty, 0).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100.0 - F.col("total"))))
    )

    def unless_empty(name: str) -> Column:
        return F.when(empty, F.map_filter(name, lambda k, v: F.lit(False))).otherwise(
            F.col(name)
        )

    return folded.select(
        score.cast("int").alias("score"),
        zone_of(score).alias("zone"),
        unless_empty("deductions").alias("deductions"),
        F.when(empty, F.create_map(F.lit("empty"), F.lit("No data")))
        .otherwise(F.col("reasons"))
        .alias("reasons"),
        unless_empty("affected").alias("affected_columns"),
    )
