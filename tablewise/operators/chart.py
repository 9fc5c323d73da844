"""The aggregates behind charts; drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import (
    as_double,
    as_text,
    is_numeric,
    dtype_of,
    missing,
    quoted,
    require_columns,
)
from tablewise.operators import profile
from tablewise.operators.correlate import correlation_matrix
from tablewise.operators.footprint import memory_footprint

WORST_COLUMNS = 25
LARGEST_COLUMNS = 30
TOP_CATEGORIES = 10
KDE_POINTS = 200
SAMPLE_ROWS = 10_000


def missing_bars(df: DataFrame, top_n: int = WORST_COLUMNS) -> DataFrame:
    """(column, missing_pct) of the worst columns."""
    return profile.missing_summary(df).limit(top_n).select("column", "missing_pct")


def correlation_cells(df: DataFrame, method: str = "pearson") -> DataFrame:
    """(col_a, col_b, r) for a heat map, diagonal included."""
    return correlation_matrix(df, method)


def _numbers(df: DataFrame, column: str) -> DataFrame:
    """Column ``v``: the values that are numbers (texts are converted if they can be)."""
    require_columns(df, [column])
    if is_numeric(dtype_of(df, column)):
        v = as_double(df, column)
    else:
        v = quoted(column).cast("string").try_cast("double")
        v = F.when(~F.isnan(v), v)
    return df.select(v.alias("v")).where(F.col("v").isNotNull())


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lower, upper, n, density) over equal-width bins between min and max."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    values = _numbers(df, column)
    span = values.agg(
        F.struct(
            F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")
        ).alias("s")
    ).scalar()
    # A constant column gets one bin of width 1 around its value.
    lo = F.when(span["lo"] < span["hi"], span["lo"]).otherwise(span["lo"] - 0.5)
    width = F.when(
        span["lo"] < span["hi"], (span["hi"] - span["lo"]) / bins
    ).otherwise(F.lit(1.0 / bins))
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width).cast("int"))
    counts = values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin",
        (lo + F.col("bin") * width).alias("lower"),
        (lo + (F.col("bin") + 1) * width).alias("upper"),
        "n",
        (F.col("n") / (span["n"] * width)).alias("density"),
    )


#: Bandwidths beyond which a kernel counts as zero.
REACH = 8.0


def density_curve(
    df: DataFrame, column: str, points: int = KDE_POINTS, cells: int | None = None
) -> DataFrame:
    """(point, x, density): Gaussian kernel density on an even grid from min to max.

    Scott's bandwidth.  Equal values are merged first.  With ``cells`` the values are
    first pooled into that many cells of equal width (kept at their mean), which
    bounds the work for continuous columns whatever their rows.  Values further than REACH
    bandwidths from a point add nothing to it: without ``cells`` a density differs from the
    exact one by at most exp(-REACH**2 / 2), about 1.3e-14, of the kernel's own peak.  No
    rows for fewer than five values or no variation.
    """
    values = _numbers(df, column)
    s = values.agg(
        F.struct(
            F.count("v").alias("n"),
            F.stddev_samp("v").alias("sd"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        ).alias("s")
    ).scalar()
    if cells is None:
        pooled = values.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    else:
        cell = F.floor((F.col("v") - s["lo"]) / (s["hi"] - s["lo"]) * (cells - 1))
        pooled = values.groupBy(F.coalesce(cell, F.lit(0)).alias("cell")).agg(
            F.avg("v").alias("v"), F.count(F.lit(1)).alias("w")
        )
    # A pooled value adds its kernel to the points within REACH bandwidths of it only.
    h = s["sd"] * F.pow(s["n"].cast("double"), F.lit(-0.2))
    step = (s["hi"] - s["lo"]) / (points - 1)
    known = {"h": h, "lo": s["lo"], "step": step, "n": s["n"]}
    drawn = (F.col("n") >= 5) & (F.col("step") > 0)
    grid = (
        df.sparkSession.range(0, points, 1, 1)
        .select(F.col("id").cast("int").alias("point"))
        .withColumns(known)
        .where(drawn)
        .select("point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"), "h", "n")
    )
    place, reach = (F.col("v") - F.col("lo")) / F.col("step"), REACH * F.col("h") / F.col("step")
    first = F.greatest(F.lit(0), F.ceil(place - reach).cast("int"))
    last = F.least(F.lit(points - 1), F.floor(place + reach).cast("int"))
    near = pooled.withColumns(known).where(drawn).withColumns({"first": first, "last": last})
    spread = near.withColumn("point", F.explode(F.expr("CASE WHEN first <= last THEN sequence(first, last) END")))
    u = (F.col("lo") + F.col("point") * F.col("step") - F.col("v")) / F.col("h")
    sums = spread.groupBy("point").agg(F.sum(F.col("w") * F.exp(-u * u / 2)).alias("k"))
    return grid.join(F.broadcast(sums), "point", "left").select(
        "point",
        "x",
        (F.coalesce("k", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias(
            "density"
        ),
    )


def _counts(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return (
        df.where(~missing(df, column))
        .groupBy(as_text(df, column).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_categories(df: DataFrame, column: str, top_n: int = TOP_CATEGORIES) -> DataFrame:
    """(category, n): the most frequent values, the rest summed as ``Other``."""
    counts = _counts(df, column)
    top = counts.orderBy(F.col("n").desc(), "category").limit(top_n)
    total = counts.agg(F.sum("n")).scalar()
    rest = top.agg(F.sum("n").alias("kept")).select(
        F.lit("Other").alias("category"), (total - F.col("kept")).alias("n")
    )
    return top.unionByName(rest.where("n > 0"))


def class_shares(df: DataFrame, column: str) -> DataFrame:
    """(category, n, share, balanced): shares against the even share 1/k."""
    counts = _counts(df, column)
    s = counts.agg(
        F.struct(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).alias("s")
    ).scalar()
    return counts.select(
        "category", "n", (F.col("n") / s["total"]).alias("share"), (1 / s["k"]).alias("balanced")
    )


def _box(values: DataFrame) -> Column:
    """Quartiles and fences of ``v`` as a scalar struct."""
    box = profile.fences(values, ["v"], profile.IQR_MULTIPLIER)
    fields = ("n", "q0", "q1", "q2", "lower", "upper")
    return box.agg(F.struct(*[F.max(c).alias(c) for c in fields]).alias("s")).scalar()


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """One row: q25, q50, q75, whiskers (outermost values within the fences), outliers."""
    values = _numbers(df, column)
    box = _box(values)
    inside = F.col("v").between(box["lower"], box["upper"])
    return values.agg(
        F.count("v").alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    ).select(
        "n", box["q0"].alias("q25"), box["q1"].alias("q50"), box["q2"].alias("q75"),
        "whisker_low", "whisker_high", "n_outliers",
    )


def box_outliers(df: DataFrame, column: str) -> DataFrame:
    """(v): the values outside the fences."""
    values = _numbers(df, column)
    box = _box(values)
    return values.where(~F.col("v").between(box["lower"], box["upper"]))


def footprint_bars(df: DataFrame, top_n: int = LARGEST_COLUMNS) -> DataFrame:
    """(column, mb) of the largest columns."""
    return (
        memory_footprint(df).orderBy(F.col("bytes").desc(), "column").limit(top_n)
        .select("column", "mb")
    )


def steady_sample(
    df: DataFrame, max_rows: int = SAMPLE_ROWS, seed: int = 42, keys: list[str] | None = None
) -> DataFrame:
    """At most ``max_rows`` rows, picked by a seeded hash of the key columns.

    The same rows come out for any partitioning.  Tables of up to ``max_rows`` rows
    pass whole.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    keys = keys or df.columns
    require_columns(df, keys)
    rank = F.xxhash64(F.lit(seed), *[quoted(k) for k in keys])
    # A histogram over the top 16 bits finds the bin that holds the last kept rank,
    # so only the rows up to that bin are sorted, not max_rows of every task.
    bins = df.groupBy(F.shiftright(rank, 48).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin"))
    last = (
        bins.withColumn("upto", upto)
        .agg(F.min(F.when(F.col("upto") >= max_rows, F.col("bin"))).alias("bin"))
        .scalar()
    )
    candidates = df.where(F.shiftright(rank, 48) <= F.coalesce(last, F.lit(2**15)))
    return candidates.orderBy(rank, *[quoted(k) for k in keys]).limit(max_rows)
