"""Write tables as CSV or Parquet directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import NESTED, dtype_of, quoted, replace_columns

_NO_COLUMN_FORMAT = (
    T.NullType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType,
    T.VariantType,
)


def _as_text(df: DataFrame, name: str) -> Column:
    c, dtype = quoted(name), dtype_of(df, name)
    if isinstance(dtype, (*NESTED, T.VariantType)):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated UTF-8 with a header per part; an empty table keeps its header.

    Nested cells become JSON text, binary cells base64; timestamps keep their
    microseconds and are written without a fraction where it is zero.
    """
    odd = (
        *NESTED, *_NO_COLUMN_FORMAT, T.BinaryType, T.TimestampType, T.TimestampNTZType,
    )
    exprs = {c: _as_text(df, c) for c in df.columns if isinstance(dtype_of(df, c), odd)}
    (
        replace_columns(df, exprs)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet; types without a column format are written as text."""
    exprs = {
        c: _as_text(df, c) for c in df.columns if isinstance(dtype_of(df, c), _NO_COLUMN_FORMAT)
    }
    replace_columns(df, exprs).write.mode(mode).option("compression", "snappy").parquet(path)
