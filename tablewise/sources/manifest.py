"""One row per input file: size, character set, delimiter and JSON layout.

All of a file is looked at, as Spark's text reader gives it, so compressed files are judged
by their content and a character far down a file counts like one in its first line.  The
work is one aggregation over lines; what is kept per file does not grow with it, and one row
per file reaches the driver, which lists the files for any read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.sources.charset import byte_facts, guesses, is_utf8

DELIMITERS = (",", ";", "\t", "|")
_PATH = "_metadata.file_path"
#: Widths that are listed for a file, and different ones that are counted exactly.
_LISTED, _TRACKED = 1000, 10_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): every line of every file, its bytes as they are."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    return text.select(F.col(_PATH).alias("path"), "value")


def _fields(line: Column, delimiter: str) -> Column:
    """Fields of a line, delimiters between double quotes left out."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def _widths(delimiter: str) -> Column:
    """Aggregate: the most frequent numbers of fields over one, with their counts.

    Exact up to the number of different widths that the state tracks; lines that differ in
    more ways have no delimiter to speak of.
    """
    width = _fields(F.make_valid_utf8("value"), delimiter)
    filled = F.trim(F.make_valid_utf8("value")) != ""
    return F.call_function(
        "approx_top_k", F.when(filled & (width > 1), width), F.lit(_LISTED), F.lit(_TRACKED)
    )


def _delimiter(widths: list[list]) -> str:
    """The delimiter that gives most lines of a file the same number of fields (over one).

    Ties go to more fields, then to the order of ``DELIMITERS``; comma by default.
    """
    best = max(
        (
            (w["count"], w["item"], -d)
            for d, own in enumerate(widths)
            for w in own or []
            if w["item"] is not None
        ),
        default=(0, 0, 0),
    )
    return DELIMITERS[-best[2]]


def _layout_facts() -> list[Column]:
    """Aggregates: filled lines, and those that are whole objects."""
    text = F.trim(F.make_valid_utf8("value"))
    braced = text.startswith("{") & text.endswith("}")
    whole = F.when(braced, F.try_parse_json(text).isNotNull()).otherwise(False)
    return [F.count_if(text != "").alias("filled"), F.count_if(whole).alias("whole")]


def _judged(spark: SparkSession, path: str, dialect: bool, layout: bool) -> DataFrame:
    """(path, encoding, confidence, delimiter, json_layout) of every file with a line.

    One scan; files that are not UTF-8 are read once more for a guess.  'lines' is the layout
    when most filled lines are whole objects, else 'document'; null without filled lines.
    """
    lines = _lines(spark, path)
    aggs = []
    if dialect:
        aggs += byte_facts()
        aggs += [_widths(d).alias(f"d{i}") for i, d in enumerate(DELIMITERS)]
    if layout:
        aggs += _layout_facts()
    seen = lines.groupBy("path").agg(*aggs).collect()
    guessed = {}
    if dialect:
        open_files = {
            r["path"]: r["zeros"] or (r["mark"] and not r["valid"]) for r in seen if not is_utf8(r)
        }
        guessed = guesses(lines, open_files)
    rows = []
    for r in seen:
        encoding, confidence = guessed.get(r["path"], ("utf-8", 1.0))
        delimiter = _delimiter([r[f"d{i}"] for i in range(len(DELIMITERS))]) if dialect else None
        kind = None
        if layout and r["filled"]:
            kind = "lines" if r["whole"] * 2 > r["filled"] else "document"
        rows.append((r["path"], encoding, confidence, delimiter, kind))
    return spark.createDataFrame(
        rows,
        "path string, encoding string, confidence double, delimiter string, json_layout string",
    )


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(~F.col("path").rlike(r"/[_.][^/]*$")).select(
        F.col(_PATH).alias("path"), F.col("length").alias("bytes")
    )


def _of_files(spark: SparkSession, path: str, judged: DataFrame) -> DataFrame:
    """Every file under ``path`` with what is known of it; files without lines have defaults."""
    return (
        listed_files(spark, path)
        .join(F.broadcast(judged), "path", "left")
        .withColumns(
            {
                "encoding": F.coalesce("encoding", F.lit("utf-8")),
                "confidence": F.coalesce("confidence", F.lit(1.0)),
                "delimiter": F.coalesce("delimiter", F.lit(",")),
            }
        )
    )


def dialects(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, confidence, delimiter) of every file under ``path``."""
    judged = _judged(spark, path, dialect=True, layout=False)
    return _of_files(spark, path, judged).select("path", "encoding", "confidence", "delimiter")


def json_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(path, json_layout) of every file under ``path`` that has a filled line."""
    judged = _judged(spark, path, dialect=False, layout=True)
    return judged.where("json_layout IS NOT NULL").select("path", "json_layout")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, encoding, confidence, delimiter, json_layout) of every file with content.

    Sizes are those on disk; all else describes the decompressed text.
    """
    judged = _judged(spark, path, dialect=True, layout=True)
    return _of_files(spark, path, judged).select(
        "path", "bytes", "encoding", "confidence", "delimiter",
        F.coalesce("json_layout", F.lit("lines")).alias("json_layout"),
    )
