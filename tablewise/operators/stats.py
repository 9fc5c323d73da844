"""Shared aggregate passes: moments, exact quantiles, value profiles, duplicates.

Everything here is lazy and returns one small row per column.  No pass gathers a
whole column in one task: grouped states are either counters per histogram bin
(bounded) or hash-partitioned value counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import (
    NESTED,
    as_double,
    digest_pair,
    dtype_of,
    is_numeric,
    melt,
    name_of,
    present,
    value_digest,
)

# Linear bins per histogram refinement, and logarithmic bins per unit of ln(1+|x|).
LINEAR_BINS = 65_536
LOG_BINS = 256


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, v): every present numeric cell as a double, headed by its column ordinal."""
    return melt(df, [(as_double(df, c),) for c in columns], ["v"], keep_nulls=False)


# ------------------------------------------------------------------ moments

def moments(df: DataFrame, columns: Sequence[str], shape: bool = True) -> DataFrame:
    """One row per numeric column: counts, mean, deviations, range and shape.

    Columns: i, column, n, mean, std_pop, std_samp, min, max, skew, kurtosis; no row
    for a column without values.  Skewness and excess kurtosis carry the small-sample
    correction.  One scan; each task sends one row of partial state per column.
    """
    v = F.col("v")
    aggs = [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]
    if shape:
        aggs += [F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")]
    grouped = long_values(df, columns).groupBy("i").agg(*aggs)
    n = F.col("n").cast("double")
    out = [
        F.col("i").cast("int").alias("i"),
        name_of(list(columns), F.col("i").cast("int")).alias("column"),
        F.col("n"),
        F.col("mean"),
        F.col("std_pop"),
        F.when(n > 1, F.col("std_pop") * F.sqrt(n / (n - 1)))
        .otherwise(0.0)
        .alias("std_samp"),
        F.col("min"),
        F.col("max"),
    ]
    if shape:
        varied = F.col("std_pop") != 0
        skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
        out += [
            F.when(varied & (n > 2), skew).otherwise(0.0).alias("skew"),
            F.when(varied & (n > 3), kurt).otherwise(0.0).alias("kurtosis"),
        ]
    return grouped.select(*out)


# ---------------------------------------------------------------- quantiles

def _log_bin(v: Column) -> Column:
    """Monotone bin of a double; some 180 000 bins at most on either side of zero."""
    size = F.abs(v)
    inner = F.floor(F.signum(v) * F.log1p(size) * LOG_BINS).cast("int")
    return F.when(size == float("inf"), F.signum(v).cast("int") * 1_000_000).otherwise(
        inner
    )


def _pick(binned: DataFrame, group: list[str], order: str, ranks: list[str]) -> DataFrame:
    """Keep the bins that hold a wanted rank; ranks become relative to their bin."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = binned.withColumn("upto", F.sum("n").over(w))
    before = F.col("upto") - F.col("n")
    here = {
        r: F.when((F.col(r) >= before) & (F.col(r) < F.col("upto")), F.col(r) - before)
        for r in ranks
    }
    return (
        counted.withColumns(here)
        .where(F.coalesce(*[F.col(r) for r in ranks]).isNotNull())
        .drop("upto", "n")
    )


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], spread: bool = False
) -> DataFrame:
    """Exact, linearly interpolated quantiles: (i, q0, q1, ...), one row per column.

    With ``spread`` the first histogram also gives n, mean, std_pop, min and max, so that
    they need no scan of their own.

    The two order statistics around each quantile are located by two histogram
    passes (logarithmic, then linear inside the chosen bins) and read from the
    counted values of the final bins.  Only bin counts and the values of a few
    narrow bins are shuffled, so the state per task does not grow with the table
    the way a value-to-count map does.
    """
    ranks = [f"k{p}_{s}" for p in range(len(probabilities)) for s in (0, 1)]
    values = long_values(df, columns).withColumn("b", _log_bin(F.col("v")))

    def histogram(rows: DataFrame, *keys: str, more: Sequence[Column] = ()) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *more
        )

    kept, own = ["total"], Window.partitionBy("i")
    within = [F.avg("v").alias("a"), F.var_pop("v").alias("s2")] if spread else []
    first = histogram(values, "i", "b", more=within).withColumn("total", F.sum("n").over(own))
    if spread:
        # Deviations within bins and of the bins' means; no deviation at all is exactly zero.
        kept += ["mean", "std_pop", "min", "max"]
        squares = F.col("n") * (F.col("s2") + F.pow(F.col("a") - F.col("mean"), F.lit(2)))
        first = (
            first.withColumns(
                {
                    "mean": F.sum(F.col("a") * F.col("n")).over(own) / F.col("total"),
                    "min": F.min("lo").over(own),
                    "max": F.max("hi").over(own),
                }
            )
            .withColumn("std_pop", F.sqrt(F.sum(squares).over(own) / F.col("total")))
            .withColumn("std_pop", F.when(F.col("min") < F.col("max"), F.col("std_pop")).otherwise(0.0))
            .drop("a", "s2")
        )
    for p, probability in enumerate(probabilities):
        at = F.lit(float(probability)) * (F.col("total") - 1)
        first = first.withColumns(
            {
                f"k{p}_0": F.floor(at).cast("long"),
                f"k{p}_1": F.ceil(at).cast("long"),
            }
        )
    coarse = _pick(first, ["i"], "b", ranks)

    # At most two bins per column and probability survive: these joins broadcast.
    width = F.col("hi") - F.col("lo")
    fine = F.least(
        F.lit(LINEAR_BINS - 1),
        F.floor((F.col("v") - F.col("lo")) / width * LINEAR_BINS).cast("int"),
    )
    second = values.join(F.broadcast(coarse), ["i", "b"]).withColumn(
        "b2", F.when(width > 0, fine).otherwise(0)
    )
    narrow = _pick(
        histogram(second, "i", "b", "b2", *kept, *ranks), ["i", "b"], "b2", ranks
    )

    third = values.join(F.broadcast(narrow), ["i", "b"]).where(
        F.col("v").between(F.col("lo"), F.col("hi"))
    )
    counted = third.groupBy("i", "b", "b2", *kept, *ranks, "v").agg(
        F.count(F.lit(1)).alias("n")
    )
    found = _pick(counted, ["i", "b", "b2"], "v", ranks)

    out = [F.max("total").alias("n"), *[F.max(c).alias(c) for c in kept[1:]]] if spread else []
    for p, probability in enumerate(probabilities):
        at = F.lit(float(probability)) * (F.max("total") - 1)
        low = F.max(F.when(F.col(f"k{p}_0").isNotNull(), F.col("v")))
        high = F.max(F.when(F.col(f"k{p}_1").isNotNull(), F.col("v")))
        out.append(
            F.when(low == high, low)
            .otherwise(low + (high - low) * (at - F.floor(at)))
            .alias(f"q{p}")
        )
    return found.groupBy(F.col("i").cast("int").alias("i")).agg(*out)


def numeric_summary(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    shape: bool = False,
) -> DataFrame:
    """Moments with exact quantiles (q0, q1, ...), one row per column.

    Three scans; the shape (skewness, kurtosis) takes one more.
    """
    if not shape:
        found, n = quantiles(df, columns, probabilities, spread=True), F.col("n").cast("double")
        samp = F.when(n > 1, F.col("std_pop") * F.sqrt(n / (n - 1))).otherwise(0.0)
        return found.select(
            "i",
            name_of(list(columns), F.col("i")).alias("column"),
            "n",
            "mean",
            "std_pop",
            samp.alias("std_samp"),
            "min",
            "max",
            *[f"q{p}" for p in range(len(probabilities))],
        )
    return moments(df, columns, shape).join(
        F.broadcast(quantiles(df, columns, probabilities)), "i", "left"
    )


# ------------------------------------------------------------ value profiles

def value_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: n_rows, n, classes, gini, sum_sq, of the value counts.

    Values are counted by 128-bit digest over all columns in one shuffle, with
    map-side combining, so a value held by a third of the rows is one counter.
    The Gini index needs the classes in count order.  Classes of equal count are
    merged first: a column of N rows has at most sqrt(2N) distinct counts, which
    bounds the only ordered window.
    """
    cells = melt(
        df, [value_digest(df, c) for c in columns], ["h1", "h2"], keep_nulls=True
    )
    counts = cells.groupBy("i", "h1", "h2").agg(F.count(F.lit(1)).alias("x"))
    alike = (
        counts.groupBy("i", F.col("h1").isNull().alias("void"), "x")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    w = Window.partitionBy("i", "void").orderBy("x").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # m classes of x members each, standing at places below+1 .. below+m.
    below = F.coalesce(F.sum("m").over(w), F.lit(0))
    x, m = F.col("x").cast("double"), F.col("m").cast("double")
    weighted = alike.withColumn(
        "ranked", x * (m * below.cast("double") + m * (m + 1) / 2)
    )
    held = ~F.col("void")

    def over(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(held, value)), F.lit(0))

    folded = weighted.groupBy("i").agg(
        F.sum(F.col("x") * F.col("m")).alias("n_rows"),
        over(F.col("x") * F.col("m")).alias("n"),
        over(F.col("m")).alias("classes"),
        over(x * x * m).cast("double").alias("sum_sq"),
        over(F.col("ranked")).cast("double").alias("ranked"),
    )
    k = F.col("classes").cast("double")
    raw = 2 * F.col("ranked") / (k * F.col("n")) - (k + 1) / k
    gini = F.when(k > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0)
    ordinal = F.col("i").cast("int")
    return folded.select(
        ordinal.alias("i"),
        name_of(list(columns), ordinal).alias("column"),
        "n_rows",
        "n",
        "classes",
        gini.alias("gini"),
        "sum_sq",
    )


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: n_rows and the members of all groups of equal rows (null = null).

    Rows are grouped by digest, so 16 bytes per distinct row cross the shuffle and
    copies of one row collapse on the map side.
    """
    h1, h2 = digest_pair(df, df.columns)
    groups = (
        df.select(h1.alias("h1"), h2.alias("h2"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"),
    )


def most_frequent(df: DataFrame, names: Sequence[str]) -> list[Column | None]:
    """Each column's most frequent present value (the smallest of ties) as a constant.

    One count of all columns' values in text form, with map-side combining, then one row
    per column.  Ties go by number where the text is one, else by text.
    """
    if not names:
        return []
    cells = melt(
        df,
        [
            (
                (F.to_json(present(df, c)) if isinstance(dtype_of(df, c), NESTED)
                 else present(df, c).cast("string")),
                as_double(df, c) if is_numeric(dtype_of(df, c)) else F.lit(None).cast("double"),
            )
            for c in names
        ],
        ["v", "x"],
        keep_nulls=False,
    )
    counts = cells.groupBy("i", "v", "x").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(F.col("i").cast("int").alias("i")).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("x"), F.col("v"))).alias("best")
    )
    found = {r["i"]: r["best"]["v"] for r in best.collect()}
    return [_typed(found[i], dtype_of(df, c)) if i in found else None for i, c in enumerate(names)]


def _typed(text: str, dtype: T.DataType) -> Column:
    """A value from its text form."""
    if isinstance(dtype, NESTED):
        return F.from_json(F.lit(text), dtype)
    return F.lit(text).cast(dtype)


def column_facts(df: DataFrame) -> DataFrame:
    """(i, column, n_rows, missing, constant): one scan, one row per column.

    A column is constant when the least and the greatest digest of its present values
    agree; no values are shuffled.
    """
    names = df.columns
    cells = melt(df, [value_digest(df, c) for c in names], ["h1", "h2"], keep_nulls=True)
    grouped = cells.groupBy("i").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("h1").alias("n"),
        *[f(h).alias(f"{f.__name__}_{h}") for h in ("h1", "h2") for f in (F.min, F.max)],
    )
    one = (F.col("min_h1") == F.col("max_h1")) & (F.col("min_h2") == F.col("max_h2"))
    ordinal = F.col("i").cast("int")
    return grouped.select(
        ordinal.alias("i"),
        name_of(names, ordinal).alias("column"),
        "n_rows",
        (F.col("n_rows") - F.col("n")).alias("missing"),
        F.coalesce((F.col("n") > 0) & one, F.lit(False)).alias("constant"),
    )
