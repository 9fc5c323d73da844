"""Column classes, missing-value rules and small Column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> Column:
    """Reference a column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_categorical(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_categorical(f.dataType)]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """KeyError for names the frame does not have (checked before any job runs)."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise KeyError(f"no such column(s): {unknown}; the table has {df.columns}")


def missing(df: DataFrame, name: str) -> Column:
    """True for null, and for NaN in floating columns."""
    c = quoted(name)
    if isinstance(dtype_of(df, name), FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so that aggregates skip it."""
    c = quoted(name)
    if isinstance(dtype_of(df, name), FLOATING):
        return F.when(~F.isnan(c), c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def replace_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns and keeps order and names."""
    return df.select(
        *[exprs[n].alias(n) if n in exprs else quoted(n) for n in df.columns]
    )


def number_text(c: Column, dtype: T.DataType) -> Column:
    """Text form of a value; doubles print in plain notation from 1e-4 up to 1e16.

    Spark switches to scientific notation at 1e7 and below 1e-3, which would hide
    digit runs from the personal-data matchers and disagree with other readers.
    """
    if isinstance(dtype, NESTED):
        return F.to_json(c)
    text = c.cast("string")
    if not isinstance(dtype, FLOATING):
        return text
    size = F.abs(c)
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.abs(power).cast("string")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
    return F.when(
        text.contains("E"),
        F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific),
    ).otherwise(text)


def as_text(df: DataFrame, name: str) -> Column:
    return number_text(present(df, name), dtype_of(df, name))


def digest_pair(df: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes of a row (128 bits together).

    Grouping on the pair instead of the values keeps shuffles at 16 bytes per
    distinct row, however long the texts are.  Null flags are hashed too, because
    the hash of a null equals its seed.
    """
    values: list[Column] = []
    flags: list[Column] = []
    for n in names:
        dtype = dtype_of(df, n)
        values.append(F.to_json(quoted(n)) if _has_map(dtype) else present(df, n))
        flags.append(missing(df, n))
    return (
        F.xxhash64(*values, *flags),
        F.xxhash64(F.lit(0x5EED), *flags, *values),
    )


def value_digest(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Digest pair of one column's present values; null where the value is missing.

    xxhash64 maps single values of up to 8 bytes one to one, so those need only the
    first half.
    """
    dtype = dtype_of(df, name)
    c = F.to_json(quoted(name)) if _has_map(dtype) else present(df, name)
    first = F.when(c.isNotNull(), F.xxhash64(c))
    if isinstance(
        dtype,
        (
            *INTEGRAL, *FLOATING, T.BooleanType, T.DateType, T.TimestampType,
            T.TimestampNTZType,
        ),
    ):
        return first, F.lit(0).cast("bigint")
    return first, F.when(c.isNotNull(), F.xxhash64(F.lit(0x5EED), c))


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype)
    return isinstance(dtype, T.VariantType)


def melt(
    df: DataFrame, cells: list[tuple[Column, ...]], names: list[str], keep_nulls: bool
) -> DataFrame:
    """Turn per-column cells into rows (i, *names), ``i`` the ordinal of the column.

    SQL's multi-value UNPIVOT plans as an Expand inside whole-stage codegen.  Rows
    whose cells are all null are left out unless ``keep_nulls``.  Aggregating the long
    form by ``i`` compiles to one small loop, where an aggregate per column would outgrow
    what the JIT compiles.
    """
    cols = [[f"c{i}_{j}" for j in range(len(names))] for i in range(len(cells))]
    wide = df.select(
        *[F.lit(i).alias(f"o{i}") for i in range(len(cells))],
        *[c.alias(n) for row, ns in zip(cells, cols) for c, n in zip(row, ns)],
    )
    groups = ", ".join(
        f"({', '.join([f'o{i}', *ns])}) AS `{i}`" for i, ns in enumerate(cols)
    )
    long = df.sparkSession.sql(
        f"SELECT i, {', '.join(names)} FROM {{wide}} "
        f"UNPIVOT INCLUDE NULLS ((i, {', '.join(names)}) FOR label IN ({groups}))",
        wide=wide,
    )
    if keep_nulls:
        return long
    return long.where(" OR ".join(f"{n} IS NOT NULL" for n in names))


def wide_to_long(cells: list[tuple[Column, ...]], names: list[str]) -> Column:
    """Turn the columns of a one-row frame into rows headed by the ordinal ``i``."""
    flat: list[Column] = []
    for i, values in enumerate(cells):
        flat += [F.lit(i), *values]
    return F.stack(F.lit(len(cells)), *flat).alias("i", *names)


def name_of(names: list[str], ordinal: Column) -> Column:
    """Column name for an ordinal produced by :func:`long_form`."""
    return F.get(F.array(*[F.lit(n) for n in names]), ordinal)


def type_label(dtype: T.DataType) -> str:
    return dtype.simpleString()
