"""Load tables by extension, with dialect probing, header cleanup and date promotion."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import (
    quoted,
    replace_columns,
    require_columns,
    text_columns,
)
from tablewise.functions.dates import parse_iso
from tablewise.sources.archives import SUFFIXES, suffix_of, unpacked
from tablewise.sources.charset import SPARK_NAMES, recoded
from tablewise.sources.manifest import dialects, json_layouts

# --- fixed values: extension -> format, sampling limits -------------------------
FORMATS = {
    "csv": "csv",
    "tsv": "tsv",
    "parquet": "parquet",
    "json": "json",
    "jsonl": "json",
    "ndjson": "json",
}
COMPRESSION = ("gz", "bz2", "zst", "zip", "xz")
SAMPLE_ROWS = 10_000


class UnsupportedFileError(ValueError):
    """The extension is missing or unknown."""


def format_of(path: str) -> str:
    """Format by extension, after stripping one compression suffix."""
    parts = posixpath.basename(path.rstrip("/")).lower().split(".")[1:]
    packed = parts[-1] if parts and parts[-1] in COMPRESSION else None
    if packed:
        parts = parts[:-1]
    if not parts:
        raise UnsupportedFileError(f"no file extension: {path}")
    if parts[-1] not in FORMATS:
        raise UnsupportedFileError(f"unknown extension .{parts[-1]}; known: {sorted(FORMATS)}")
    if packed in SUFFIXES and FORMATS[parts[-1]] == "parquet":
        raise UnsupportedFileError(f"only text is unpacked from .{packed}: {path}")
    return FORMATS[parts[-1]]


def load(
    spark: SparkSession,
    path: str,
    sample: bool = False,
    order_by: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Read a file, directory or glob by its extension and clean it up.

    The whole input is read unless ``sample`` asks for a capped read.  Zip and xz files
    are unpacked first, member by member, into the session's shared folder; the members
    of a zip file are read as the files of a folder.
    """
    kind = options.pop("format", None) or format_of(path)
    if suffix_of(path) in SUFFIXES:
        path = unpacked(spark, path)
    readers = {"csv": read_csv, "tsv": read_tsv, "parquet": read_parquet, "json": read_json}
    df = readers[kind](spark, path, **options)
    return capped(df, SAMPLE_ROWS, order_by) if sample else df


# Cell texts that stand for a missing value in delimited files (fixed values).
MISSING_MARKS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Header row, inferred types unless ``schema`` is given.

    Without ``sep`` or ``encoding`` all lines of every file are looked at first, and
    files are read in groups of equal dialect, joined by column name; pass both to save
    that scan.  Compressed files are read like plain ones.  Encodings: utf-8, latin-1,
    cp1252, cp1251, shift_jis, gb18030, utf-16-le, utf-16-be.
    """
    if sep is not None and encoding is not None:
        dialects = {(sep, encoding): [path]}
    else:
        dialects = _probed_dialects(spark, path, sep, encoding)
    frames = [
        clean_headers(_csv(spark, paths, s, e, schema, multiline))
        for (s, e), paths in sorted(dialects.items())
    ]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return promote_dates(df) if schema is not None else with_inferred_types(df)


def _probed_dialects(spark, path, sep, encoding) -> dict[tuple[str, str], list[str]]:
    """Files by dialect; a set of files with one dialect stays the path that was given."""
    files = dialects(spark, path).select(
        "path",
        (F.lit(sep) if sep else F.col("delimiter")).alias("sep"),
        (F.lit(encoding) if encoding else F.col("encoding")).alias("encoding"),
    )
    known = files.select("sep", "encoding").distinct().collect()
    if not known:
        raise FileNotFoundError(f"no files at {path}")
    if len({(r["sep"], r["encoding"]) for r in known}) == 1:
        return {(known[0]["sep"], known[0]["encoding"]): [path]}
    # Paths of mixed files go through the driver, which lists them for any read.
    found: dict[tuple[str, str], list[str]] = {}
    for r in files.collect():
        found.setdefault((r["sep"], r["encoding"]), []).append(r["path"])
    return found


def _csv(spark, paths, sep, encoding, schema, multiline) -> DataFrame:
    """Sets that Spark does not read are read byte by byte, as latin-1, and recoded cell by
    cell: bytes of delimiters, quotes and line ends are no part of their longer characters."""
    known = encoding in SPARK_NAMES or encoding.lower().startswith(("utf-", "iso-", "us-"))
    if not known and sep == "|" and encoding in ("shift_jis", "gb18030"):
        raise ValueError(f"a bar may be part of a character of {encoding}: name another delimiter")
    wide = encoding.startswith("utf-16")
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", SPARK_NAMES.get(encoding, encoding if known else "ISO-8859-1"))
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    if wide and not multiline:
        reader = reader.option("lineSep", "\n")
    if schema is not None and known and not wide:
        return reader.schema(schema).csv(paths)
    df = reader.csv(paths)
    if not known:
        df = recoded(df, encoding)
    if wide and not multiline and df.columns:
        # Line ends of two characters leave their first one in the last column.
        last = df.columns[-1]
        df = df.withColumn(last, F.regexp_replace(quoted(last), "\r$", ""))
        df = df.withColumnRenamed(last, last.rstrip("\r"))
    if schema is None:
        return df
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(
        *[quoted(c).try_cast(f.dataType).alias(f.name) for c, f in zip(df.columns, wanted.fields)]
    )


def with_inferred_types(df: DataFrame) -> DataFrame:
    """Type text columns by all their values: bigint, double, boolean, ISO timestamp.

    Missing-value marks become null first.  One aggregate over the table decides for
    all columns; a column that fits no type in full stays text.
    """
    df = replace_columns(
        df,
        {c: F.when(~quoted(c).isin(*MISSING_MARKS), quoted(c)) for c in text_columns(df)},
    )
    readings = {
        "bigint": lambda c: F.when(
            c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("bigint")
        ),
        "double": lambda c: F.when(
            c.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"),
            F.trim(c).try_cast("double"),
        ),
        "boolean": lambda c: F.when(
            c.isin("True", "TRUE", "true", "False", "FALSE", "false"),
            F.lower(c).try_cast("boolean"),
        ),
        "timestamp": parse_iso,
    }
    texts = text_columns(df)
    if not texts:
        return df
    row = df.agg(
        *[
            F.struct(
                F.count(quoted(c)).alias("n"),
                *[F.count(read(quoted(c))).alias(t) for t, read in readings.items()],
            ).alias(f"c{i}")
            for i, c in enumerate(texts)
        ]
    ).first()
    exprs = {}
    for i, c in enumerate(texts):
        seen = row[f"c{i}"]
        fit = next((t for t in readings if seen["n"] and seen[t] == seen["n"]), None)
        if fit:
            exprs[c] = readings[fit](quoted(c))
    return replace_columns(df, exprs)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tab-separated files; otherwise as :func:`read_csv`."""
    return read_csv(spark, path, **{**options, "sep": "\t"})


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return tidy(spark.read.parquet(path))


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    layout: str | None = None,
) -> DataFrame:
    """Records array, JSON Lines, single objects, or an object of column lists.

    ``layout`` ('lines' or 'document') saves looking at the lines of the files first.  Files
    of both layouts are read in two groups and joined by column name; a column whose types
    differ between them becomes the wider one, or text where there is none.
    """
    if layout is None:
        seen = json_layouts(spark, path)
        kinds = sorted(r["json_layout"] for r in seen.select("json_layout").distinct().collect())
        if len(kinds) > 1:
            # Paths of mixed files go through the driver, which lists them for any read.
            found: dict[str, list[str]] = {}
            for r in seen.collect():
                found.setdefault(r["json_layout"], []).append(r["path"])
            frames = [_json(spark, found[k], schema, k) for k in kinds]
            return tidy(_stacked(*frames))
        layout = kinds[0] if kinds else "lines"
    return tidy(_json(spark, path, schema, layout))


def _json(spark: SparkSession, path, schema, layout: str) -> DataFrame:
    if layout not in ("lines", "document"):
        raise ValueError(f"unknown JSON layout {layout!r}")
    reader = spark.read.option("multiLine", layout == "document")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    lists = df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema)
    if lists and df.limit(2).count() == 1:
        df = _from_column_lists(df)
    return df


def _stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both, by column name."""
    numbers = (T.LongType, T.DoubleType)
    for c in set(a.columns) & set(b.columns):
        x, y = a.schema[c].dataType, b.schema[c].dataType
        if x != y:
            wide = "double" if isinstance(x, numbers) and isinstance(y, numbers) else "string"
            a, b = (replace_columns(df, {c: _cell_as(df, c, wide)}) for df in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


def _cell_as(df: DataFrame, name: str, wide: str):
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType))
    return F.to_json(quoted(name)) if nested and wide == "string" else quoted(name).cast(wide)


def _from_column_lists(df: DataFrame) -> DataFrame:
    """One object whose values are all lists: a list per column."""
    sizes = F.array(*[F.size(quoted(c)) for c in df.columns])
    zipped = F.arrays_zip(*[quoted(c) for c in df.columns])
    checked = F.when(
        F.array_min(sizes) == F.array_max(sizes), zipped
    ).otherwise(F.raise_error(F.lit("column lists differ in length")))
    return df.select(F.inline(checked).alias(*df.columns))


# ------------------------------------------------------------------- clean-up

def clean_headers(df: DataFrame) -> DataFrame:
    """Strip a leading byte-order mark and white space from column names."""
    names = [c.lstrip("﻿").strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash after clean-up: {names}")
    return df.toDF(*names)


def promote_dates(df: DataFrame) -> DataFrame:
    """Turn text columns made up of ISO dates into zone-free timestamps.

    All or nothing per column.  The one place that must look at the values before the
    schema is known: a single aggregate over the text columns.
    """
    texts = text_columns(df)
    if not texts or df.isStreaming:
        return df
    row = df.agg(
        *[
            F.struct(
                F.count(quoted(c)).alias("n"), F.count(parse_iso(quoted(c))).alias("ok")
            ).alias(f"c{i}")
            for i, c in enumerate(texts)
        ]
    ).first()
    dated = [c for i, c in enumerate(texts) if row[f"c{i}"]["n"] > 0
             and row[f"c{i}"]["n"] == row[f"c{i}"]["ok"]]
    return replace_columns(df, {c: parse_iso(quoted(c)) for c in dated})


def tidy(df: DataFrame) -> DataFrame:
    return promote_dates(clean_headers(df))


def capped(
    df: DataFrame, n: int = SAMPLE_ROWS, order_by: Sequence[str] | None = None
) -> DataFrame:
    """At most ``n`` rows: any rows, or the first in ``order_by`` order."""
    if order_by:
        require_columns(df, order_by)
        return df.orderBy(*[quoted(c) for c in order_by]).limit(n)
    return df.limit(n)
