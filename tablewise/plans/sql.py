"""SQL over registered tables, with a query log."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.sources.scratch import scratch_path

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_LOG_SCHEMA = (
    "sql string, ran_at timestamp, row_count bigint, duration_ms bigint, error string"
)


def register(name: str, df: DataFrame) -> None:
    """Make a table known to SQL under a plain name, replacing an older one."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"not a plain table name: {name!r}")
    df.createOrReplaceTempView(name)


@dataclass(frozen=True)
class QueryResult:
    """The rows, at most ``max_rows`` if that is given.

    ``truncated`` tells whether rows were left out.
    """

    df: DataFrame
    truncated: bool = False


def query(
    spark: SparkSession,
    sql: str,
    tables: dict[str, DataFrame] | DataFrame | None = None,
    max_rows: int | None = None,
) -> QueryResult:
    """Run one SELECT; a lone table is known as ``df``.

    Spark itself parses the text (one statement).  Anything but a query is refused
    before it can run, by wrapping the text as a subquery.  All rows are returned, lazily,
    unless ``max_rows`` caps them: then up to one row more is counted at once, and the
    result says whether it was cut.
    """
    if not sql or not sql.strip():
        raise ValueError("empty query")
    if isinstance(tables, DataFrame):
        tables = {"df": tables}
    for name, df in (tables or {}).items():
        register(name, df)
    text = sql.strip().rstrip(";").rstrip()
    full = spark.sql(f"SELECT * FROM (\n{text}\n)")
    if max_rows is None:
        return QueryResult(full)
    return QueryResult(full.limit(max_rows), full.limit(max_rows + 1).count() > max_rows)


class QueryLog:
    """An append-only table of executed queries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def run(
        self,
        sql: str,
        tables: dict[str, DataFrame] | DataFrame | None = None,
        max_rows: int | None = None,
    ) -> DataFrame:
        """Run a query once, append its entry, and return its rows; errors are logged too.

        The rows are written below the shared scratch folder and returned from there, so
        counting them and using them do not run the query again.
        """
        started, ran_at = time.perf_counter(), datetime.now(timezone.utc)
        rows, error = 0, None
        try:
            result = query(self.spark, sql, tables).df
            if max_rows is not None:
                result = result.limit(max_rows)
            path = scratch_path(self.spark, "result")
            result.write.parquet(path)
            result = self.spark.read.schema(result.schema).parquet(path)
            rows = result.count()
            return result
        except Exception as exc:
            error = str(exc)
            raise
        finally:
            spent = int((time.perf_counter() - started) * 1000)
            self.spark.createDataFrame(
                [(sql, ran_at, rows, spent, error)], _LOG_SCHEMA
            ).coalesce(1).write.mode("append").parquet(self.path)

    def entries(self, limit: int | None = 50) -> DataFrame:
        """The last ``limit`` entries, newest first; all of them if it is None."""
        newest = (
            self.spark.read.schema(_LOG_SCHEMA).parquet(self.path).orderBy(F.col("ran_at").desc())
        )
        return newest if limit is None else newest.limit(limit)

    def clear(self) -> None:
        self.spark.createDataFrame([], _LOG_SCHEMA).write.mode("overwrite").parquet(self.path)
