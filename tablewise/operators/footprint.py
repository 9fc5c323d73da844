"""Logical storage footprint and narrowing suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import (
    as_double,
    dtype_of,
    missing,
    name_of,
    quoted,
    type_label,
    wide_to_long,
)
from tablewise.operators import stats

MIB = 1024.0 * 1024.0
INT32 = (-(2**31), 2**31 - 1)
FLOAT32_MAX = 3.4028234663852886e38
CATEGORY_RATIO = 0.5
ROUND_TRIP_ERROR = 1e-6

_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8,
    T.TimestampNTZType: 8, T.DecimalType: 16,
}


def column_bytes(df: DataFrame, name: str) -> Column:
    """Aggregate: logical bytes of a column.

    Fixed-width types count their width per row; texts and binaries their bytes;
    nested values the bytes of their JSON form.
    """
    dtype = dtype_of(df, name)
    width = _WIDTHS.get(type(dtype))
    if width:
        return F.count(F.lit(1)) * width
    c = quoted(name)
    if not isinstance(dtype, (T.StringType, T.BinaryType)):
        c = F.to_json(c)
    return F.coalesce(F.sum(F.octet_length(c).cast("bigint")), F.lit(0))


def _bytes_long(df: DataFrame) -> DataFrame:
    names = df.columns
    wide = df.agg(*[column_bytes(df, c).alias(f"b{i}") for i, c in enumerate(names)])
    return wide.select(
        wide_to_long([(F.col(f"b{i}"),) for i in range(len(names))], ["bytes"])
    ).withColumn("column", name_of(names, F.col("i")))


def memory_footprint(df: DataFrame) -> DataFrame:
    """(column, bytes, mb) per column."""
    return _bytes_long(df).select(
        "column", "bytes", F.round(F.col("bytes") / MIB, 6).alias("mb")
    )


def total_footprint(df: DataFrame) -> DataFrame:
    """One row (bytes, mb) over all columns."""
    return _bytes_long(df).agg(
        F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / MIB, 6).alias("mb")
    )


def narrowing_suggestions(df: DataFrame) -> DataFrame:
    """(column, mb, dtype, suggested_dtype, savings_mb) per column.

    bigint to int when the range fits, double to float when the magnitude fits, text
    to a dictionary when under half of the rows are distinct.
    """
    names = df.columns
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(names):
        dtype, c = dtype_of(df, name), quoted(name)
        fits = F.lit(None).cast("boolean")
        if isinstance(dtype, T.LongType):
            fits = F.coalesce(
                (F.min(c) >= INT32[0]) & (F.max(c) <= INT32[1]), F.lit(True)
            )
        elif isinstance(dtype, T.DoubleType):
            fits = F.coalesce(
                F.max(F.abs(as_double(df, name))) <= FLOAT32_MAX, F.lit(True)
            )
        aggs += [column_bytes(df, name).alias(f"b{i}"), fits.alias(f"f{i}")]
    wide = df.agg(*aggs)
    facts = wide.select(
        "n_rows",
        wide_to_long(
            [(F.col(f"b{i}"), F.col(f"f{i}")) for i in range(len(names))], ["bytes", "fits"]
        ),
    )
    texts = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)]
    facts = facts.join(F.broadcast(_dictionaries(df, texts)), "i", "left")
    labels = F.array(*[F.lit(type_label(f.dataType)) for f in df.schema])
    dtype = F.get(labels, F.col("i"))
    sparse = F.col("classes") / F.col("n_rows") < CATEGORY_RATIO
    suggested = (
        F.when((dtype == "bigint") & F.col("fits"), "int")
        .when((dtype == "double") & F.col("fits"), "float")
        .when((F.col("n_rows") > 0) & sparse, "category")
    )
    halved = F.col("n_rows") * 4
    saved = (
        F.when(suggested.isin("int", "float"), halved)
        .when(
            suggested == "category",
            F.greatest(
                F.lit(0), F.col("bytes") - F.col("n_rows") * 4 - F.col("dictionary_bytes")
            ),
        )
        .otherwise(0)
    )
    return facts.select(
        name_of(names, F.col("i")).alias("column"),
        F.round(F.col("bytes") / MIB, 6).alias("mb"),
        dtype.alias("dtype"),
        suggested.alias("suggested_dtype"),
        F.round(saved / MIB, 6).alias("savings_mb"),
    )


def _dictionaries(df: DataFrame, ordinals: list[int]) -> DataFrame:
    """(i, classes, dictionary_bytes) of the text columns: one shuffle of digests."""
    from tablewise.functions.columns import melt, value_digest

    names = [df.columns[i] for i in ordinals]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "i int, classes bigint, dictionary_bytes bigint"
        )
    cells = [
        (*value_digest(df, c), F.octet_length(quoted(c)).cast("bigint")) for c in names
    ]
    place = F.get(F.array(*[F.lit(i) for i in ordinals]), F.col("i").cast("int"))
    return (
        melt(df, cells, ["h1", "h2", "size"], keep_nulls=True)
        .groupBy("i", "h1", "h2", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("i")
        .agg(
            F.count("h1").alias("classes"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("dictionary_bytes"),
        )
        .select(place.alias("i"), "classes", "dictionary_bytes")
    )


def narrowing_plan(df: DataFrame) -> dict[str, str]:
    """Safe narrowings by the strict rule: {column: 'int' | 'float' | 'category'}.

    bigint without missing values inside the int range; double whose round trip
    through float stays below 1e-6; text with under half of the rows distinct.  Reads
    one small row per question, since the answer changes the schema.
    """
    aggs, asked = [], []
    for name in df.columns:
        dtype, c = dtype_of(df, name), quoted(name)
        if isinstance(dtype, T.LongType):
            ok = (
                (F.count_if(missing(df, name)) == 0)
                & (F.min(c) >= INT32[0])
                & (F.max(c) <= INT32[1])
            )
            asked.append((name, "int"))
        elif isinstance(dtype, T.DoubleType):
            x = as_double(df, name)
            ok = F.max(F.abs(x.cast("float").cast("double") - x)) < ROUND_TRIP_ERROR
            asked.append((name, "float"))
        else:
            continue
        aggs.append(F.coalesce(ok, F.lit(False)).alias(f"a{len(asked) - 1}"))
    plan: dict[str, str] = {}
    if aggs:
        row = df.agg(*aggs).first()
        plan.update({n: t for k, (n, t) in enumerate(asked) if row[f"a{k}"]})
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if texts:
        for r in stats.value_profile(df, texts).where("n_rows > 0").collect():
            if r["classes"] / r["n_rows"] < CATEGORY_RATIO:
                plan[r["column"]] = "category"
    return plan
