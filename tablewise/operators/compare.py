"""Before/after comparison and shape expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators.footprint import total_footprint
from tablewise.operators.health import health_score

MEASURES = ("rows", "cells", "mb", "health_score")


def _measures(df: DataFrame) -> DataFrame:
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    mb = total_footprint(df).select(F.col("bytes") / (1024.0 * 1024.0)).scalar()
    score = health_score(df).select("score").scalar()
    return rows.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("measure"), value.cast("double").alias("v"))
                    for name, value in zip(
                        MEASURES,
                        (F.col("n"), F.col("n") * len(df.columns), mb, score),
                    )
                ]
            )
        )
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(measure, before, after, diff, pct_change, improving) for four measures.

    Higher is better for the health score only; the change is null when the first
    value is 0.
    """
    both = (
        _measures(before).withColumn("side", F.lit("before"))
        .unionByName(_measures(after).withColumn("side", F.lit("after")))
        .groupBy("measure")
        .agg(
            F.max(F.when(F.col("side") == "before", F.col("v"))).alias("before"),
            F.max(F.when(F.col("side") == "after", F.col("v"))).alias("after"),
        )
    )
    diff = F.col("after") - F.col("before")
    return both.select(
        "measure",
        F.round("before", 6).alias("before"),
        F.round("after", 6).alias("after"),
        F.round(diff, 6).alias("diff"),
        F.when(F.col("before") != 0, F.round(diff / F.col("before") * 100, 1)).alias(
            "pct_change"
        ),
        F.when(F.col("measure") == "health_score", diff > 0).otherwise(diff < 0).alias(
            "improving"
        ),
    )


class EmptyTableError(ValueError):
    """The table has no rows or no columns."""


class TableShapeError(ValueError):
    """The table has fewer rows or columns than expected."""


def validate(df: DataFrame, min_rows: int = 1, min_cols: int = 1) -> bool:
    """Raise unless the table has the expected size; reads at most ``min_rows`` rows."""
    if min_rows < 0 or min_cols < 0:
        raise ValueError("minimum sizes must not be negative")
    if not df.columns:
        raise EmptyTableError("the table has no columns")
    seen = df.limit(max(1, min_rows)).count()
    if seen == 0:
        raise EmptyTableError("the table has no rows")
    if seen < min_rows:
        raise TableShapeError(f"expected {min_rows} row(s), found {seen}")
    if len(df.columns) < min_cols:
        raise TableShapeError(f"expected {min_cols} column(s), found {len(df.columns)}")
    return True
