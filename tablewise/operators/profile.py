"""Column and table diagnostics.  Every function returns a lazy DataFrame."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import (
    categorical_columns,
    digest_pair,
    dtype_of,
    melt,
    missing,
    name_of,
    numeric_columns,
    present,
    quoted,
    text_columns,
    type_label,
    wide_to_long,
)
from tablewise.functions.dates import LAYOUTS
from tablewise.functions.text import LEXICAL_CLASSES, lexical_class
from tablewise.operators import stats

# --- fixed values: thresholds ------------------------------------------------
IQR_MULTIPLIER = 1.5
ZSCORE_LIMIT = 3.0
GINI_LIMIT = 0.7
HIGH_CARDINALITY_MIN = 50
HIGH_CARDINALITY_RATIO = 0.5
MAX_CLASSES = 50


def empty_frame(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


# ------------------------------------------------------------------ missing

def missing_counts(df: DataFrame) -> DataFrame:
    """(i, column, n_rows, missing): one scan, one row per column."""
    names = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
    )
    return wide.where("n_rows > 0").select(
        "n_rows",
        wide_to_long(
            [(F.lit(c), F.col(f"m{i}")) for i, c in enumerate(names)], ["column", "missing"]
        ),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct), worst column first."""
    return (
        missing_counts(df)
        .select(
            "i",
            "column",
            F.col("missing").alias("missing_count"),
            F.round(F.col("missing") / F.col("n_rows") * 100, 4).alias("missing_pct"),
        )
        .orderBy(F.col("missing_pct").desc(), "i")
        .drop("i")
    )


def rank_columns_by_missing(df: DataFrame, keep: int | None = None) -> DataFrame:
    """(place, column, missing_share): columns by missing share, at most ``keep``."""
    counts = missing_counts(df)
    share = F.col("missing") / F.col("n_rows")
    # One row per column of the table: the window is as small as the schema.
    place = F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(share.desc(), F.col("i"))
    )
    out = counts.select(
        place.alias("place"), "column", F.round(share, 6).alias("missing_share")
    )
    return out.where(F.col("place") <= keep) if keep is not None else out


# --------------------------------------------------------------- duplicates

def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row (total, pct): all members of groups of equal rows."""
    counts = stats.duplicate_counts(df)
    return counts.select(
        F.col("members").alias("total"),
        F.when(F.col("n_rows") > 0, F.round(F.col("members") / F.col("n_rows") * 100, 4))
        .otherwise(0.0)
        .alias("pct"),
    )


def duplicate_sample(df: DataFrame, limit: int = 5) -> DataFrame:
    """Up to ``limit`` rows that have at least one exact copy."""
    h1, h2 = digest_pair(df, df.columns)
    keyed = df.withColumns({"__h1": h1, "__h2": h2})
    twice = (
        keyed.groupBy("__h1", "__h2")
        .count()
        .where("count > 1")
        .orderBy("__h1", "__h2")
        .limit(limit)
        .select("__h1", "__h2")
    )
    return (
        keyed.join(F.broadcast(twice), ["__h1", "__h2"], "left_semi")
        .limit(limit)
        .drop("__h1", "__h2")
    )


# ----------------------------------------------------------------- outliers

def fences(df: DataFrame, columns: list[str], multiplier: float) -> DataFrame:
    """Numeric summary plus (lower, upper), the interquartile fences."""
    spread = F.col("q2") - F.col("q0")
    return stats.numeric_summary(df, columns).withColumns(
        {
            "lower": F.col("q0") - multiplier * spread,
            "upper": F.col("q2") + multiplier * spread,
        }
    )


def outlier_counts(df: DataFrame) -> DataFrame:
    """Per eligible numeric column: fences and both outlier counts.

    Columns with fewer than four values or no variation are left out.
    """
    names = numeric_columns(df)
    eligible = fences(df, names, IQR_MULTIPLIER).where(
        (F.col("n") >= 4)
        & (F.col("std_pop") > 0)
        & (F.col("std_pop") < float("inf"))
    )
    v = F.col("v")
    outside = (v < F.col("lower")) | (v > F.col("upper"))
    far = F.abs(v - F.col("mean")) / F.col("std_pop") > ZSCORE_LIMIT
    # One row per column: an equi-join with a table as small as the schema.
    return (
        stats.long_values(df, names)
        .withColumn("i", F.col("i").cast("int"))
        .join(F.broadcast(eligible), "i")
        .groupBy("i", "column", "n", "lower", "upper")
        .agg(
            F.count_if(outside).alias("iqr_outliers"),
            F.count_if(far).alias("zscore_outliers"),
        )
    )


def outlier_summary(df: DataFrame, method: str = "iqr") -> DataFrame:
    """(column, iqr_outliers, zscore_outliers, lower_bound, upper_bound)."""
    if method not in ("iqr", "zscore", "both"):
        raise ValueError(f"unknown outlier method {method!r}")
    if not numeric_columns(df):
        return empty_frame(
            df,
            "column string, iqr_outliers bigint, zscore_outliers bigint, "
            "lower_bound double, upper_bound double",
        )
    return outlier_counts(df).select(
        "column",
        "iqr_outliers",
        "zscore_outliers",
        F.round("lower", 6).alias("lower_bound"),
        F.round("upper", 6).alias("upper_bound"),
    )


# ---------------------------------------------------------------- imbalance

@F.pandas_udf(T.DoubleType())
def _chi2_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution; gets one row per table column."""

    def tail(x: float, k: float) -> float:
        if pd.isna(x) or pd.isna(k) or k < 1:
            return math.nan
        h = x / 2.0
        if h == 0:
            return 1.0
        even = int(k) % 2 == 0
        total = 0.0 if even else math.erfc(math.sqrt(h))
        # Poisson-like terms h^a e^-h / Gamma(a+1), summed in log space.
        a = 0.0 if even else 0.5
        while a < k / 2.0 - 1e-9:
            total += math.exp(a * math.log(h) - h - math.lgamma(a + 1))
            a += 1.0
        return min(1.0, total)

    return pd.Series([tail(x, k) for x, k in zip(statistic, dof)], dtype="float64")


def imbalance_summary(df: DataFrame, max_cardinality: int = MAX_CLASSES) -> DataFrame:
    """(column, n_classes, gini, chi2_p_value, is_imbalanced) of categorical columns."""
    names = categorical_columns(df)
    if not names:
        return empty_frame(
            df,
            "column string, n_classes bigint, gini double, chi2_p_value double, "
            "is_imbalanced boolean",
        )
    k = F.col("classes")
    chi2 = F.greatest(F.lit(0.0), k / F.col("n") * F.col("sum_sq") - F.col("n"))
    return (
        stats.value_profile(df, names)
        .where(k.between(2, max_cardinality))
        .select(
            "column",
            k.alias("n_classes"),
            F.round("gini", 6).alias("gini"),
            F.round(
                _chi2_tail(chi2.cast("double"), (k - 1).cast("double")), 6
            ).alias("chi2_p_value"),
            (F.col("gini") > GINI_LIMIT).alias("is_imbalanced"),
        )
    )


# -------------------------------------------------------------- distribution

def distribution_summary(df: DataFrame) -> DataFrame:
    """(column, mean, std, min, max, q25, q50, q75, skew, kurtosis)."""
    names = numeric_columns(df)
    if not names:
        fields = "mean std min max q25 q50 q75 skew kurtosis".split()
        return empty_frame(df, ", ".join(["column string", *[f"{f} double" for f in fields]]))
    return stats.numeric_summary(df, names, shape=True).select(
        "column",
        "mean",
        F.col("std_samp").alias("std"),
        "min",
        "max",
        F.col("q0").alias("q25"),
        F.col("q1").alias("q50"),
        F.col("q2").alias("q75"),
        "skew",
        "kurtosis",
    )


def describe_numeric(df: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, range and quartiles, two decimals, long by column."""
    names = numeric_columns(df)
    if not names:
        fields = "mean std min q25 q50 q75 max".split()
        return empty_frame(
            df, ", ".join(["column string", "count bigint", *[f"{f} double" for f in fields]])
        )
    wanted = {
        "mean": "mean", "std": "std_samp", "min": "min", "q25": "q0", "q50": "q1",
        "q75": "q2", "max": "max",
    }
    return stats.numeric_summary(df, names).select(
        "column",
        F.col("n").alias("count"),
        *[
            F.round(F.when(F.col("n") > 1, F.col(src)), 2).alias(dst)
            if dst == "std"
            else F.round(src, 2).alias(dst)
            for dst, src in wanted.items()
        ],
    )


# --------------------------------------------------------------- cardinality

def cardinality_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, unique_count, uniqueness_ratio, dtype, is_high_cardinality).

    ``approx=True`` uses mergeable sketches instead of counting every value: one
    scan without a shuffle of values.
    """
    names = df.columns
    if approx:
        wide = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[
                F.approx_count_distinct(
                    F.to_json(quoted(c))
                    if isinstance(dtype_of(df, c), (T.MapType, T.ArrayType, T.StructType))
                    else present(df, c),
                    0.02,
                ).alias(f"u{i}")
                for i, c in enumerate(names)
            ],
        )
        profile = wide.select(
            "n_rows", wide_to_long([(F.col(f"u{i}"),) for i in range(len(names))], ["classes"])
        ).withColumn("column", name_of(names, F.col("i")))
    else:
        profile = stats.value_profile(df, names)
    labels = F.array(*[F.lit(type_label(f.dataType)) for f in df.schema])
    ratio = F.col("classes") / F.col("n_rows")
    return profile.where("n_rows > 0").select(
        "column",
        F.col("classes").alias("unique_count"),
        F.round(ratio, 6).alias("uniqueness_ratio"),
        F.get(labels, F.col("i")).alias("dtype"),
        _high_cardinality(F.col("classes"), ratio).alias("is_high_cardinality"),
    )


def _high_cardinality(classes: Column, ratio: Column) -> Column:
    return (classes >= HIGH_CARDINALITY_MIN) & (ratio >= HIGH_CARDINALITY_RATIO)


def constant_columns(df: DataFrame) -> DataFrame:
    """(column): columns with exactly one distinct present value."""
    return stats.column_facts(df).where("constant").select("column")


# -------------------------------------------------------------- mixed values

def text_facts(df: DataFrame, classes: bool = True, dates: bool = True) -> DataFrame:
    """Per text column: present values, values per lexical class, hits per date layout.

    One scan; the cells are melted so that each test is compiled once.
    """
    names = text_columns(df)
    cells = melt(df, [(quoted(c),) for c in names], ["v"], keep_nulls=False)
    aggs = [F.count("v").alias("n")]
    if classes:
        cells = cells.withColumn("kind", lexical_class(F.col("v")))
        aggs += [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in LEXICAL_CLASSES]
    if dates:
        cells = cells.withColumn("day", F.when(F.col("v").rlike("[0-9]"), F.trim("v")))
        aggs += [
            F.count(layout.parse(F.col("day"))).alias(f"hit{j}")
            for j, layout in enumerate(LAYOUTS)
        ]
    grouped = cells.groupBy("i").agg(*aggs)
    if dates:
        hits = [F.col(f"hit{j}") for j in range(len(LAYOUTS))]
        grouped = grouped.withColumn("hits", F.array(*hits)).drop(
            *[f"hit{j}" for j in range(len(LAYOUTS))]
        )
    ordinal = F.col("i").cast("int")
    return grouped.withColumns({"i": ordinal, "column": name_of(names, ordinal)})


def classes_used() -> Column:
    """Number of lexical classes that occur, over the columns of :func:`text_facts`."""
    return sum(
        (F.when(F.col(f"n_{k}") > 0, 1).otherwise(0) for k in LEXICAL_CLASSES), F.lit(0)
    )


def mixed_type_columns(df: DataFrame) -> DataFrame:
    """(column, n_integer, n_decimal, n_boolean, n_text): text of two or more classes.

    A variant column counts as mixed when its values have two or more types.
    """
    parts = []
    texts = text_columns(df)
    schema = "column string, n_integer bigint, n_decimal bigint, n_boolean bigint, n_text bigint"
    counts = ["column", *[f"n_{k}" for k in LEXICAL_CLASSES]]
    if texts:
        parts.append(
            text_facts(df, dates=False).where(classes_used() >= 2).select(*counts)
        )
    variants = [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]
    if variants:
        parts.append(_variant_classes(df, variants).where(classes_used() >= 2).select(*counts))
    if not parts:
        return empty_frame(df, schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _variant_classes(df: DataFrame, names: list[str]) -> DataFrame:
    def kind(name: str) -> Column:
        s = F.schema_of_variant(quoted(name))
        return (
            F.when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
            .when(s.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "decimal")
            .when(s == "BOOLEAN", "boolean")
            .when(s != "VOID", "text")
        )

    wide = df.agg(
        *[
            F.count_if(kind(c) == k).alias(f"{k}{i}")
            for i, c in enumerate(names)
            for k in LEXICAL_CLASSES
        ]
    )
    cells = [tuple(F.col(f"{k}{i}") for k in LEXICAL_CLASSES) for i in range(len(names))]
    return wide.select(wide_to_long(cells, [f"n_{k}" for k in LEXICAL_CLASSES])).withColumn(
        "column", name_of(names, F.col("i"))
    )


# --------------------------------------------------------------------- dates

def best_layout(hits: Column) -> Column:
    """Index of the layout with most hits, the first one on ties (array input)."""
    return F.array_position(hits, F.array_max(hits)).cast("int") - 1


def date_columns(df: DataFrame) -> DataFrame:
    """Per text column: values, values parsed by its dominant layout, that layout."""
    return text_facts(df, classes=False).select(
        "i",
        "column",
        "n",
        F.array_max("hits").alias("parsed"),
        best_layout(F.col("hits")).alias("layout"),
    )


def suspected_date(n: Column, parsed: Column) -> Column:
    return (n > 0) & (parsed / n > 0.5)


def inconsistent_date(n: Column, parsed: Column) -> Column:
    return suspected_date(n, parsed) & ((n - parsed) / n > 0.1)


def date_consistency(df: DataFrame, n_samples: int = 5) -> DataFrame:
    """(column, samples): suspected date columns with over 10 % failing values.

    The dominant layout is the one that explains most values; samples are the
    smallest distinct failing texts.
    """
    texts = text_columns(df)
    if not texts:
        return empty_frame(df, "column string, samples array<string>")
    judged = date_columns(df)
    flagged = judged.where(inconsistent_date(F.col("n"), F.col("parsed")))
    cells = melt(df, [(quoted(c),) for c in texts], ["v"], keep_nulls=False).withColumn(
        "i", F.col("i").cast("int")
    )
    # Each cell is tried with the layout of its own column only.
    parsed = F.lit(None).cast("timestamp_ntz")
    for j, layout in enumerate(LAYOUTS):
        parsed = F.when(F.col("layout") == j, layout.parse(F.trim("v"))).otherwise(parsed)
    failing = (
        cells.join(F.broadcast(flagged.select("i", "column", "layout")), "i")
        .where(parsed.isNull())
        .select("i", "column", "v")
    )
    return _smallest_per_column(failing, n_samples).select(
        "column", F.col("kept").alias("samples")
    )


def _smallest_per_column(cells: DataFrame, n: int, some: DataFrame | None = None) -> DataFrame:
    """(i, column, kept): the n smallest distinct texts of each column.

    Distinct values are thinned bucket by bucket before the per-column step, so no
    task sees more than n values per bucket.  ``some`` of the cells, a bounded number, give a
    bound beforehand: whatever is greater than the n-th smallest of them is not among
    the n smallest of all, and is neither aggregated nor shuffled.
    """
    if some is not None:
        place = F.dense_rank().over(Window.partitionBy("i").orderBy("v"))
        bounds = (
            some.withColumn("r", place).where(F.col("r") == n).groupBy("i").agg(F.max("v").alias("bound"))
        )
        cells = cells.join(F.broadcast(bounds), "i", "left").where("bound IS NULL OR v <= bound")
    distinct = cells.groupBy("i", "column", "v").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.pmod(F.xxhash64("v"), F.lit(1024))
    local = F.row_number().over(Window.partitionBy("i", bucket).orderBy("v"))
    final = F.row_number().over(Window.partitionBy("i").orderBy("v"))
    return (
        distinct.withColumn("r", local)
        .where(F.col("r") <= n)
        .withColumn("r", final)
        .where(F.col("r") <= n)
        .groupBy("i", "column")
        .agg(F.sort_array(F.collect_list("v")).alias("kept"))
    )


# ------------------------------------------------------------------- preview

#: Rows whose values bound what a preview has to compare.
_BOUNDING_ROWS = 10_000


def preview_schema(df: DataFrame, n: int = 10) -> DataFrame:
    """(column, dtype, non_null, kb, sample_values): up to n smallest distinct values."""
    from tablewise.functions.columns import as_text
    from tablewise.operators.footprint import column_bytes

    names = df.columns
    wide = df.agg(
        *[F.count_if(~missing(df, c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[column_bytes(df, c).alias(f"b{i}") for i, c in enumerate(names)],
    )
    facts = wide.select(
        wide_to_long(
            [(F.col(f"n{i}"), F.col(f"b{i}")) for i in range(len(names))],
            ["non_null", "bytes"],
        )
    )
    cells, some = (
        melt(rows, [(as_text(df, c),) for c in names], ["v"], keep_nulls=False)
        .withColumn("i", F.col("i").cast("int"))
        .withColumn("column", name_of(names, F.col("i")))
        for rows in (df, df.limit(_BOUNDING_ROWS))
    )
    labels = F.array(*[F.lit(type_label(f.dataType)) for f in df.schema])
    samples = _smallest_per_column(cells, n, some).select("i", "kept")
    return facts.join(F.broadcast(samples), "i", "left").select(
        name_of(names, F.col("i")).alias("column"),
        F.get(labels, F.col("i")).alias("dtype"),
        "non_null",
        F.round(F.col("bytes") / 1024, 2).alias("kb"),
        F.coalesce(F.array_join("kept", ", "), F.lit("")).alias("sample_values"),
    )
