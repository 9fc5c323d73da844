"""The row-local operators and bounded-state forms on a stream of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Entry, table
from tablewise.operators import clean, pii
from tablewise.sources.scratch import scratch_path
from tablewise.streaming import monitor

ENTRIES: dict[str, Entry] = {}


def event_stream(spark, sf):
    """The events table as a file stream."""
    schema = table(spark, sf, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )


def drained(spark, stream, name: str, mode: str = "append"):
    """Run a stream over all present input into a Parquet table and read that back."""
    target, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", state)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _cleaned(stream):
    """A chain of row-local operators, applied to a stream as they are."""
    stream = clean.filter_rows(stream, "event_type", "notin", ["error"]).df
    stream = clean.clip_range(stream, ["value"], 1.0, 100.0).df
    stream = clean.standardize_case(stream, ["event_type"], "title").df
    stream = stream.withColumn("mail", F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.com")))
    return pii.mask_pii(stream, {"mail": ["email"], "props": ["other"]}, "redact")


ENTRIES["st01_row_local"] = Entry(
    lambda spark, sf: drained(spark, _cleaned(event_stream(spark, sf)), "row_local"),
    "SELECT event_id, ts, user_id, concat(upper(event_type[1]), event_type[2:]) AS event_type, "
    "CASE WHEN value < 1 THEN 1.0 WHEN value > 100 THEN 100.0 ELSE value END AS value, "
    "concat(substr(props, 1, 1), repeat('*', length(props) - 2), right(props, 1)) AS props, "
    "'u***@example.com' AS mail FROM events WHERE event_type <> 'error'",
)


def _gaps(stream):
    return stream.withColumn("value", F.when(F.col("event_id") % 4 != 1, F.col("value")))


# In append mode a window comes out once the watermark has passed its end: those
# ending at or before the latest time minus the allowed lateness.
ENTRIES["st02_missing_rates"] = Entry(
    lambda spark, sf: drained(
        spark,
        monitor.missing_rates(
            _gaps(event_stream(spark, sf)), "ts", "1 day", "2 hours", ["value", "event_type"]
        ),
        "missing_rates",
    ).withColumns({c: F.round(c, 8) for c in ("value", "event_type")}),
    "WITH w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n_rows, "
    "round(avg(CASE WHEN event_id % 4 = 1 THEN 1.0 ELSE 0.0 END), 8) AS value, "
    "CAST(0 AS DOUBLE) AS event_type FROM events GROUP BY 1) "
    "SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n_rows, value, event_type "
    "FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
)
ENTRIES["st03_outlier_rates"] = Entry(
    lambda spark, sf: drained(
        spark,
        monitor.outlier_rates(
            event_stream(spark, sf), "ts", "1 day", "2 hours", {"value": (1.0, 150.0)}
        ),
        "outlier_rates",
    ).withColumn("value", F.round("value", 8)),
    "WITH w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n_rows, "
    "round(avg(CASE WHEN value < 1 OR value > 150 THEN 1.0 ELSE 0.0 END), 8) AS value "
    "FROM events GROUP BY 1) "
    "SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n_rows, value "
    "FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
)
# All events of one batch lie within the watermark, so one row per key remains.
ENTRIES["st04_dedupe"] = Entry(
    lambda spark, sf: drained(
        spark,
        monitor.dedupe_within(
            event_stream(spark, sf), "ts", "60 days", ["user_id", "event_type"]
        ).select("user_id", "event_type"),
        "dedupe",
    ),
    "SELECT DISTINCT user_id, event_type FROM events",
)


def _batch_scores(spark, sf):
    target, state = scratch_path(spark, "scores"), scratch_path(spark, "scores-state")
    query = (
        event_stream(spark, sf).writeStream.foreachBatch(monitor.profile_batches(target))
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(target).select("score", "zone")


ENTRIES["st05_batch_scores"] = Entry(_batch_scores)
