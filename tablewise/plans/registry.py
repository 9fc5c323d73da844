"""Operators by name, and previews of what one of them would change."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from tablewise.operators import clean
from tablewise.operators.clean import CleaningError, OpResult

OPS: dict[str, Callable[..., OpResult]] = {
    "fill_missing": clean.fill_missing,
    "drop_missing": clean.drop_missing,
    "drop_duplicates": clean.drop_duplicates,
    "cap_outliers_iqr": clean.cap_outliers_iqr,
    "remove_outliers_iqr": clean.remove_outliers_iqr,
    "strip_whitespace": clean.strip_whitespace,
    "standardize_case": clean.standardize_case,
    "rename_columns": clean.rename_columns,
    "drop_columns": clean.drop_columns,
    "parse_dates": clean.parse_dates,
    "cast_dtype": clean.cast_dtype,
    "downcast_numeric": clean.downcast_numeric,
    "clip_range": clean.clip_range,
    "normalize_minmax": clean.normalize_minmax,
    "standardize_zscore": clean.standardize_zscore,
    "filter_rows": clean.filter_rows,
    "reset_index_op": clean.reset_index,
}


def apply_op(df: DataFrame, name: str, **params: Any) -> OpResult:
    """Run a registered operator: the cleaned table and its change log, both lazy."""
    if name not in OPS:
        raise CleaningError(f"unknown operator {name!r}; known: {sorted(OPS)}")
    return OPS[name](df, **params)


def preview(df: DataFrame, name: str, n: int = 20, **params: Any) -> DataFrame:
    """(column, old, new): up to ``n`` cells the operator would change.

    Empty for operators that add, drop or rename rather than rewrite cells; their
    change log tells the row counts.
    """
    result = apply_op(df, name, **params)
    if result.changes is None:
        return df.sparkSession.createDataFrame([], "column string, old string, new string")
    return result.changes.limit(n)
