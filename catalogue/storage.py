"""Source, sink, SQL and issue-planting queries (S1-S13, Q1-Q3, G1)."""

from __future__ import annotations

import lzma
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from catalogue.base import Entry, columns_of, over, table, view
from catalogue.profiling import ORDER_TEXTS, _BYTES, flat_health, union
from tablewise.operators import compare, profile
from tablewise.operators.dirty import inject_issues
from tablewise.plans.sql import QueryLog, query, register
from tablewise.sources import readers, writers
from tablewise.sources.manifest import file_manifest
from tablewise.sources.scratch import scratch_path

ENTRIES: dict[str, Entry] = {}
ORDERS, PEOPLE = "dirty_orders", "personal_customers"
#: Rows of a JSON document at most; a power of two, so that no document mixes partitions.
DOCUMENT_ROWS = 1 << 16


def add(name: str, source: str, body: str | None, run) -> None:
    ENTRIES[name] = Entry(
        lambda spark, sf: run(view(spark, sf, source)), over(source, body) if body else None
    )


def _path(df, name: str) -> str:
    return scratch_path(df.sparkSession, name)


# What a text round trip keeps: blanks at the ends, gaps, dates as timestamps.
_ROUND = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, "
    "CAST(CAST(date_text AS DATE) AS TIMESTAMP) AS date_text, constant_col, mixed_col, rare_class "
    "FROM d"
)
# The mixed dates of the view in one spelling, so that they are promoted.
_ISO = "CASE WHEN o_orderkey % 5 = 0 THEN concat(substr(date_text, 7, 4), '-', " \
    "substr(date_text, 4, 2), '-', substr(date_text, 1, 2)) ELSE date_text END"
_ROUND = _ROUND.replace("CAST(date_text AS DATE)", f"CAST({_ISO} AS DATE)")


def _iso_orders(df):
    return df.withColumn("date_text", F.expr(_ISO))


def _csv_trip(df):
    path = _path(df, "orders.csv")
    writers.write_csv(_iso_orders(df), path)
    return readers.load(df.sparkSession, path)


def _tsv_trip(df):
    path = _path(df, "orders.tsv")
    _iso_orders(df).write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_tsv(df.sparkSession, path, encoding="utf-8")


def _parquet_trip(df):
    path = _path(df, "orders.parquet")
    writers.write_parquet(df, path)
    return readers.load(df.sparkSession, path)


def _json_trip(df):
    path = _path(df, "orders.jsonl")
    _iso_orders(df).write.json(path)
    return readers.read_json(df.sparkSession, path).select(*df.columns)


add("s01_load_json_lines", ORDERS, _ROUND, _json_trip)
add("s02_csv_round_trip", ORDERS, _ROUND, _csv_trip)
add("s03_tsv_round_trip", ORDERS, _ROUND, _tsv_trip)
# One day/month date among the ISO ones keeps the column text: all or nothing.
add("s04_parquet_round_trip", ORDERS, "SELECT * FROM d", _parquet_trip)


def _mixed_dialects(df):
    """Half of the rows comma- and UTF-8-, half semicolon- and Latin-1-coded."""
    path = _path(df, "mixed.csv")
    rows = df.select("c_custkey", F.concat(F.lit("Café "), F.col("note")).alias("note"),
                     F.col("pan_no"))

    # Spark writes a header for a first partition without rows, and a header alone is ASCII
    # in any character set; the first range of keys always has rows.
    def side(n):
        return rows.where(f"c_custkey % 2 = {n}").repartitionByRange("c_custkey")

    side(0).write.mode("append").option("header", True).csv(path)
    (
        side(1).write.mode("append").option("header", True)
        .option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    )
    return path


add(
    "s02_csv_mixed_dialects", PEOPLE,
    "SELECT c_custkey, concat('Café ', note) AS note, pan_no FROM d",
    lambda df: readers.load(df.sparkSession, _mixed_dialects(df)),
)
add(
    "s11_manifest", PEOPLE,
    "SELECT 'utf-8' AS encoding, ',' AS delimiter, TRUE AS filled "
    "UNION ALL SELECT 'latin-1', ';', TRUE",
    lambda df: file_manifest(df.sparkSession, _mixed_dialects(df))
    .groupBy("encoding", "delimiter")
    .agg(F.bool_and(F.col("bytes") > 0).alias("filled")),
)


def _people(df):
    return df.select("c_custkey", F.concat(F.lit("ref "), F.col("note")).alias("note"), "pan_no")


_PEOPLE = "SELECT c_custkey, concat('ref ', note) AS note, pan_no FROM d"


def _csv_gz(df):
    """Semicolons and compression, read with default arguments."""
    path = _path(df, "people.csv.gz")
    _people(df).write.option("header", True).option("sep", ";").option("compression", "gzip").csv(path)
    return readers.load(df.sparkSession, path)


def _json_gz(df):
    """Compressed documents, each an indented array of a bounded number of rows."""
    path = _path(df, "people.json.gz")
    rows = _people(df).select(
        F.expr(f"monotonically_increasing_id() div {DOCUMENT_ROWS}").alias("document"),
        F.to_json(F.struct("*"), {"pretty": "true"}).alias("row"),
    )
    documents = rows.groupBy("document").agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit("\n]")).alias("value")
    )
    # A file is one document.
    (
        documents.select("value").write.option("compression", "gzip")
        .option("maxRecordsPerFile", 1).text(path)
    )
    return readers.load(df.sparkSession, path).select("c_custkey", "note", "pan_no")


def _json_mixed(df):
    """Lines and indented documents of a bounded number of rows in one folder."""
    path = _path(df, "people.json")
    even = F.expr("c_custkey % 2 = 0")
    _people(df).where(even).write.json(path)
    rows = _people(df).where(~even).select(
        F.expr(f"monotonically_increasing_id() div {DOCUMENT_ROWS}").alias("document"),
        F.to_json(F.struct("*"), {"pretty": "true"}).alias("row"),
    )
    documents = rows.groupBy("document").agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit("\n]")).alias("value")
    )
    documents.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return readers.read_json(df.sparkSession, path).select("c_custkey", "note", "pan_no")


def _late_latin(df):
    """Files in the order of keys; the only byte outside ASCII stands in the last one's last line."""
    path, last = _path(df, "late.csv"), df.agg(F.max("c_custkey")).first()[0]
    named = F.when(F.col("c_custkey") == last, "Café").otherwise(F.col("note"))
    (
        df.select("c_custkey", named.alias("note"), "pan_no").orderBy("c_custkey")
        .write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    )
    return readers.load(df.sparkSession, path)


add("s02_csv_gz", PEOPLE, _PEOPLE, _csv_gz)
add("s05_json_gz", PEOPLE, _PEOPLE, _json_gz)
add("s05_json_mixed", PEOPLE, _PEOPLE, _json_mixed)
add(
    "s02_late_latin1", PEOPLE,
    "SELECT c_custkey, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM d) THEN 'Café' ELSE note END "
    "AS note, pan_no FROM d",
    _late_latin,
)


# One text for each character set; which one a row has follows from its key.
_TEXTS = {
    "cp1252": "l’été à Köln – 5 €", "cp1251": "Привет, Иван", "shift_jis": "東京都渋谷区のデータ",
    "gb18030": "北京市海淀区数据",
}


def _in_charset(rows, encoding: str):
    """Lines of a file under a header of its own, as the bytes of a character set."""
    codec = {"shift_jis": "cp932"}.get(encoding, encoding)

    def lines(batches):
        head = [b"c_custkey;note;pan_no"]
        for batch in batches:
            text = [t.encode(codec) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(head + text, pa.binary())], ["value"])
            head = []

    line = F.concat_ws(";", "c_custkey", "note", "pan_no").alias("value")
    return rows.select(line).mapInArrow(lines, "value binary").selectExpr("CAST(value AS STRING) AS value")


def _charsets(df):
    """A folder of files in four character sets."""
    path = _path(df, "charsets.csv")
    for n, (encoding, text) in enumerate(_TEXTS.items()):
        rows = df.where(f"c_custkey % {len(_TEXTS)} = {n}").withColumn("note", F.lit(text))
        _in_charset(rows, encoding).write.mode("append").text(path)
    return path


_NOTES = "CASE c_custkey % 4 " + " ".join(
    f"WHEN {n} THEN '{text}'" for n, text in enumerate(_TEXTS.values())
) + " END"
add(
    "s02_csv_charsets", PEOPLE, f"SELECT c_custkey, {_NOTES} AS note, pan_no FROM d",
    lambda df: readers.load(df.sparkSession, _charsets(df)),
)
add(
    "s11_charsets", PEOPLE,
    union([f"SELECT '{e}' AS encoding, ';' AS delimiter, TRUE AS sure" for e in _TEXTS]),
    lambda df: file_manifest(df.sparkSession, _charsets(df))
    .groupBy("encoding", "delimiter")
    .agg(F.bool_and(F.col("confidence") >= 0.5).alias("sure")),
)


def _packed(df, suffix: str):
    """A folder of archives, one written by each task: an xz file, or a zip file of two members."""
    path = _path(df, f"people.csv.{suffix}")

    def pack(batches):
        store, folder = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        store.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():05}.csv.{suffix}"
        with store.open_output_stream(name) as out:
            if suffix == "xz":
                with lzma.open(out, "wb") as member:
                    member.write(b"c_custkey,note,pan_no\n")
                    for batch in batches:
                        member.writelines(b + b"\n" for b in batch.column(1).to_pylist())
            else:
                # Members are written one after the other, so rows come sorted by side.
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    member = side = None
                    for batch in batches:
                        for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                            if own != side:
                                if member:
                                    member.close()
                                member, side = archive.open(f"side{own}.csv", "w"), own
                                member.write(b"c_custkey,note,pan_no\n")
                            member.write(line + b"\n")
                    if member:
                        member.close()
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    line = F.concat_ws(",", "c_custkey", F.concat(F.lit("ref "), "note"), "pan_no")
    rows = df.select((F.col("c_custkey") % 2).alias("side"), line.cast("binary").alias("line"))
    rows.sortWithinPartitions("side").mapInArrow(pack, "name string").collect()
    return readers.load(df.sparkSession, f"{path}/*.csv.{suffix}")


add("s01_zip", PEOPLE, _PEOPLE, lambda df: _packed(df, "zip"))
add("s01_xz", PEOPLE, _PEOPLE, lambda df: _packed(df, "xz"))


def _messy_headers(df):
    messy = df.select(
        F.col("c_custkey").alias("﻿ key "), F.col("pincode").alias("\tpin code  ")
    )
    return readers.clean_headers(messy)


add("s06_headers", PEOPLE, "SELECT c_custkey AS key, pincode AS \"pin code\" FROM d", _messy_headers)
add(
    "s07_promote_dates", ORDERS, _ROUND,
    lambda df: readers.promote_dates(_iso_orders(df)),
)
add("s07_promote_dates_mixed", ORDERS, "SELECT * FROM d", readers.promote_dates)


def _expectations(df):
    verdicts = []
    for label, frame, args in (
        ("as it is", df, {}),
        ("two rows, three columns", df, {"min_rows": 2, "min_cols": 3}),
        ("no rows", df.where("o_orderkey < 0"), {}),
        ("too many columns", df, {"min_cols": 100}),
    ):
        try:
            compare.validate(frame, **args)
            verdicts.append((label, "passed"))
        except ValueError as exc:
            verdicts.append((label, type(exc).__name__))
    return df.sparkSession.createDataFrame(verdicts, "expectation string, verdict string")


add(
    "s08_validate", ORDERS,
    "SELECT 'as it is' AS expectation, CASE WHEN count(*) >= 1 THEN 'passed' END AS verdict FROM d "
    "UNION ALL SELECT 'two rows, three columns', CASE WHEN count(*) >= 2 THEN 'passed' END FROM d "
    "UNION ALL SELECT 'no rows', CASE WHEN count(*) = 0 THEN 'EmptyTableError' END FROM d "
    "WHERE o_orderkey < 0 UNION ALL SELECT 'too many columns', 'TableShapeError'",
    _expectations,
)


def _preview_sql() -> str:
    rows = []
    for c in columns_of(ORDERS):
        dtype = "string" if c in ORDER_TEXTS else "double" if c == "o_totalprice" else "bigint"
        rows.append(
            f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, count({c}) AS non_null, "
            f"round({_BYTES[c]} / 1024.0, 2) AS kb, (SELECT string_agg(v, ', ' ORDER BY v) FROM "
            f"(SELECT DISTINCT CAST({c} AS STRING) AS v FROM d WHERE {c} IS NOT NULL ORDER BY v "
            "LIMIT 4)) AS sample_values FROM d"
        )
    return union(rows)


add("s09_preview_schema", ORDERS, _preview_sql(), lambda df: profile.preview_schema(df, 4))
add(
    "s10_capped_read", ORDERS,
    "SELECT DISTINCT o_orderkey, constant_col FROM d ORDER BY o_orderkey LIMIT 500",
    lambda df: readers.capped(
        df.select("o_orderkey", "constant_col").distinct(), 500, ["o_orderkey"]
    ),
)


def _csv_header(df):
    """An empty table still writes its header; the full one keeps every row."""
    spark, empty, full = df.sparkSession, _path(df, "empty.csv"), _path(df, "full.csv")
    writers.write_csv(df.where("o_orderkey < 0").coalesce(1), empty)
    writers.write_csv(df, full)
    head = spark.read.text(empty).select(F.col("value").alias("header"))
    rows = readers.load(spark, full).agg(F.count(F.lit(1))).scalar()
    return head.withColumn("rows", rows)


add(
    "s12_write_csv", ORDERS,
    f"SELECT '{','.join(columns_of(ORDERS))}' AS header, count(*) AS rows FROM d", _csv_header,
)


def _odd_types(df):
    """Void and interval columns are written as text."""
    path = _path(df, "odd.parquet")
    odd = df.select(
        "o_orderkey", F.lit(None).alias("nothing"),
        F.expr("make_dt_interval(0, 0, 0, o_orderkey % 60)").alias("span"),
    )
    writers.write_parquet(odd, path)
    back = df.sparkSession.read.parquet(path)
    return back.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("nothing").alias("something"),
        F.count_if(F.col("span").startswith("INTERVAL")).alias("spans"),
    )


add(
    "s13_write_parquet", ORDERS,
    "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS something, count(*) AS spans FROM d", _odd_types,
)

# ------------------------------------------------------------------------ SQL

_SQL = (
    "SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END) "
    "AS BIGINT) AS gaps FROM {t} GROUP BY o_orderpriority"
)


def _registered(df):
    register("orders_again", df.limit(0))
    register("orders_again", df)
    return df.sparkSession.sql(_SQL.format(t="orders_again"))


add("q01_register", ORDERS, _SQL.format(t="d"), _registered)
add(
    "q02_query", ORDERS, _SQL.format(t="d"),
    lambda df: query(df.sparkSession, _SQL.format(t="df") + ";", df).df,
)


def _truncated(df):
    few = query(df.sparkSession, "SELECT * FROM df", df, max_rows=10)
    all_rows = query(df.sparkSession, "SELECT o_orderkey FROM df", df)
    return few.df.agg(
        F.count(F.lit(1)).alias("shown"),
        F.lit(few.truncated).alias("few_cut"),
        F.lit(all_rows.truncated).alias("all_cut"),
    )


add(
    "q02_query_truncated", ORDERS,
    "SELECT least(10, count(*)) AS shown, count(*) > 10 AS few_cut, FALSE AS all_cut FROM d",
    _truncated,
)
_JOIN = (
    "SELECT n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers, "
    "round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
)
ENTRIES["q02_query_join"] = Entry(
    lambda spark, sf: query(
        spark, _JOIN, {n: table(spark, sf, n) for n in ("customer", "nation", "orders")}
    ).df,
    _JOIN,
)
# Without a cap all rows come back, here over 100 000 of them at sf0.01.
_TWICE = (
    "SELECT l_orderkey, l_linenumber, 1 AS copy FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, 2 FROM lineitem"
)
ENTRIES["q02_query_all_rows"] = Entry(
    lambda spark, sf: query(spark, _TWICE, {"lineitem": table(spark, sf, "lineitem")}).df, _TWICE
)


def _logged(df):
    log = QueryLog(df.sparkSession, _path(df, "query_log"))
    log.run("SELECT count(*) AS n FROM df", df)
    log.run("SELECT DISTINCT o_orderpriority FROM df", df)
    try:
        log.run("SELECT no_such_column FROM df", df)
    except Exception:  # the failure itself is what gets logged
        pass
    return log.entries().select(
        "sql", "row_count", F.col("error").isNotNull().alias("failed")
    )


add(
    "q03_query_log", ORDERS,
    "SELECT 'SELECT count(*) AS n FROM df' AS sql, CAST(1 AS BIGINT) AS row_count, FALSE AS failed "
    "UNION ALL SELECT 'SELECT DISTINCT o_orderpriority FROM df', count(DISTINCT o_orderpriority), "
    "FALSE FROM d UNION ALL SELECT 'SELECT no_such_column FROM df', CAST(0 AS BIGINT), TRUE",
    _logged,
)

# -------------------------------------------------------------- planted issues

_SPEC = [
    {"issue": "nulls", "column": "o_totalprice", "share": 0.25},
    {"issue": "outliers", "column": "o_totalprice", "share": 0.01, "factor": 1000},
    {"issue": "variants", "column": "o_orderstatus", "share": 0.1, "variants": ["f", "Fin."],
     "only": "F"},
    {"issue": "unit", "column": "o_custkey", "share": 0.08, "unit": " cm"},
    {"issue": "mixed_dates", "column": "o_orderdate"},
    {"issue": "constant", "column": "version", "value": "v1.0"},
    {"issue": "personal", "column": "phone", "category": "mobile"},
    {"issue": "duplicates", "share": 0.02},
]


def _dirty(spark, sf):
    return inject_issues(table(spark, sf, "orders"), ["o_orderkey"], _SPEC)


ENTRIES["g01_inject"] = Entry(_dirty)
# The planted shares come out about as ordered, and equally on any partitioning.


def _planted(spark, sf):
    one = _dirty(spark, sf)
    two = inject_issues(
        table(spark, sf, "orders").repartition(11), ["o_orderkey"], _SPEC
    )
    near = lambda c, share: F.abs(F.avg(c.cast("double")) - share) < 0.03
    return one.agg(
        near(F.col("o_totalprice").isNull(), 0.25).alias("nulls"),
        near(F.col("o_custkey").endswith(" cm"), 0.08).alias("units"),
        (F.countDistinct("version") == 1).alias("constant"),
        (F.count(F.lit(1)) > F.countDistinct("o_orderkey")).alias("copies"),
        F.lit(one.exceptAll(two).agg(F.count(F.lit(1))).scalar() == 0).alias("same"),
    )


ENTRIES["g01_inject_checks"] = Entry(
    _planted, "SELECT TRUE AS nulls, TRUE AS units, TRUE AS constant, TRUE AS copies, TRUE AS same"
)
ENTRIES["g01_inject_health"] = Entry(lambda spark, sf: flat_health(_dirty(spark, sf)))
