"""Table access and the dirty views, written once for both SQL dialects.

The given tables hold no nulls, so each view derives its holes, outliers and variants
from key arithmetic that reads the same in Spark SQL and in plain SQL.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    with_scratch(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_scratch(spark: SparkSession) -> None:
    """A scratch folder for sessions on this machine alone that name none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and (context.master == "local" or context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablewise-"))


@dataclass(frozen=True)
class View:
    source: str
    columns: tuple[str, ...]
    repeat: str | None = None  # rows to add once more

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        base = table(spark, sf_dir, self.source)
        df = base.selectExpr(*self.columns)
        if self.repeat:
            df = df.unionAll(base.where(self.repeat).selectExpr(*self.columns))
        return df

    @property
    def sql(self) -> str:
        body = f"SELECT {', '.join(self.columns)} FROM {self.source}"
        return f"{body} UNION ALL {body} WHERE {self.repeat}" if self.repeat else body


_ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_DMY = f"concat(substr({_ISO}, 9, 2), '/', substr({_ISO}, 6, 2), '/', substr({_ISO}, 1, 4))"


def _key(n: int, key: str = "c_custkey") -> str:
    return f"lpad(CAST({key} % {10 ** n} AS STRING), {n}, '0')"


VIEWS: dict[str, View] = {
    # Orders with gaps, outliers, copies, a constant, a mixed and a mixed-date column.
    "dirty_orders": View(
        "orders",
        (
            "o_orderkey",
            "o_custkey",
            "CASE WHEN o_orderkey % 7 = 2 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
            "CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 500 = 7 "
            "THEN o_totalprice * 1000 ELSE o_totalprice END AS o_totalprice",
            "o_orderpriority",
            f"CASE WHEN o_orderkey % 5 = 0 THEN {_DMY} ELSE {_ISO} END AS date_text",
            "'fixed' AS constant_col",
            "CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS STRING) "
            "ELSE concat('id-', CAST(o_orderkey AS STRING)) END AS mixed_col",
            "CASE WHEN o_orderkey % 50 = 0 THEN concat('c', CAST(o_orderkey % 1000 AS STRING)) "
            "ELSE 'common' END AS rare_class",
        ),
        repeat="o_orderkey % 100 = 1",
    ),
    # Line items with gaps and outliers in several numeric columns.
    "dirty_lines": View(
        "lineitem",
        (
            "l_orderkey",
            "l_partkey",
            "l_linenumber",
            "CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE l_quantity END AS l_quantity",
            "CASE WHEN l_orderkey % 400 = 7 THEN l_extendedprice * 50 "
            "WHEN l_orderkey % 9 = 2 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
            "CASE WHEN l_partkey % 6 = 1 THEN NULL ELSE l_discount END AS l_discount",
            "l_tax",
            "l_returnflag",
            "CAST(3 AS INT) AS level",
        ),
    ),
    # Line items with both kinds of missing numbers, null and NaN.
    "nan_lines": View(
        "lineitem",
        (
            "l_orderkey",
            "l_linenumber",
            "CASE WHEN l_orderkey % 10 = 3 THEN NULL WHEN l_orderkey % 10 = 4 "
            "THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS l_quantity",
            "CASE WHEN l_partkey % 7 = 2 THEN CAST('NaN' AS DOUBLE) "
            "ELSE l_extendedprice END AS l_extendedprice",
            "l_returnflag",
        ),
    ),
    # Orders whose dates stand among many blanks.
    "padded_orders": View(
        "orders",
        (
            "o_orderkey",
            f"CASE WHEN o_orderkey % 5 = 0 THEN rpad({_DMY}, 60, ' ') "
            f"ELSE lpad({_ISO}, 70, ' ') END AS date_text",
        ),
    ),
    # Events with gaps, for order-dependent fills.
    "gappy_events": View(
        "events",
        (
            "event_id",
            "ts",
            "user_id",
            "CASE WHEN event_id % 5 IN (1, 2) OR event_id < 7 THEN NULL ELSE value END AS value",
            "CASE WHEN event_id % 3 = 1 THEN NULL ELSE event_type END AS event_type",
        ),
    ),
    # Customers with untidy text.
    "untidy_customers": View(
        "customer",
        (
            "c_custkey",
            "CASE WHEN c_custkey % 4 = 0 THEN concat('  ', lower(c_name), ' ') "
            "WHEN c_custkey % 11 = 1 THEN NULL ELSE c_name END AS c_name",
            "CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) "
            "ELSE concat('  ', lower(c_mktsegment)) END AS segment",
            "CASE WHEN c_custkey % 2 = 0 THEN 'they''re north-east 2nd' "
            "ELSE 'o''neill McDONALD' END AS label",
            "c_acctbal",
        ),
    ),
    # Customers with personal columns in several spellings.
    "personal_customers": View(
        "customer",
        (
            "c_custkey",
            "CASE WHEN c_custkey % 13 = 5 THEN NULL WHEN c_custkey % 17 = 3 THEN 'none' "
            "WHEN c_custkey % 19 = 4 THEN 'a@b.example.com' "
            "ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS customer_email",
            "CASE WHEN c_custkey % 3 = 0 THEN concat('+91 9', "
            f"{_key(4)}, ' ', {_key(5)}) WHEN c_custkey % 23 = 4 THEN 'n/a' "
            f"ELSE concat('98', {_key(8)}) END AS phone_no",
            "CASE WHEN c_custkey % 29 = 3 THEN '123' ELSE "
            f"concat('2345 67', {_key(2)}, ' ', {_key(4)}) END AS aadhaar_no",
            "CASE WHEN c_custkey % 31 = 3 THEN 'ABC' ELSE "
            f"concat('ABCPL', {_key(4)}, 'F') END AS pan_no",
            f"concat('4111-1111-1111-', {_key(4)}) AS card_no",
            "CAST(400001 + c_custkey % 1000 AS STRING) AS pincode",
            f"concat('HDFC0', {_key(6)}) AS ifsc_code",
            f"concat('27ABCDE', {_key(4)}, 'F1Z5') AS gst_no",
            "CASE WHEN c_custkey % 37 = 2 THEN '  ' ELSE concat('Asha ', c_name) END AS full_name",
            "concat(CAST(c_custkey % 99 AS STRING), ' Lake Road') AS street",
            "concat('ref ', CAST(c_custkey AS STRING)) AS note",
        ),
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name].frame(spark, sf_dir)


def over(name: str, body: str) -> str:
    """SQL over a dirty view, known as ``d``."""
    return f"WITH d AS ({VIEWS[name].sql}) {body}"


def columns_of(name: str) -> list[str]:
    return [c.rsplit(" AS ", 1)[-1].strip() for c in VIEWS[name].columns]


def listed(name: str, replaced: dict[str, str]) -> str:
    """Select list of a view with some columns replaced by SQL expressions."""
    return ", ".join(
        f"{replaced[c]} AS {c}" if c in replaced else c for c in columns_of(name)
    )
