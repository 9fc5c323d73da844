"""Quality monitoring on streams.

Row-local operators (masking, scrubbing, filters, case, clipping, parsing with a
pattern) take streaming DataFrames as they are.  This module adds the forms that need
bounded state: windowed rates, deduplication within a watermark, and full profiles per
micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import (
    as_double,
    as_text,
    dtype_of,
    missing,
    quoted,
    replace_columns,
    require_columns,
)
from tablewise.functions.masking import scrub_text
from tablewise.operators.health import health_score


def missing_rates(
    stream: DataFrame, ts: str, width: str, lateness: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Per event-time window: rows and missing share of every column."""
    names = list(columns or [c for c in stream.columns if c != ts])
    require_columns(stream, [ts, *names])
    aggs = {c: F.avg(missing(stream, c).cast("double")) for c in names}
    return _windowed(stream, ts, width, lateness, aggs)


def outlier_rates(
    stream: DataFrame, ts: str, width: str, lateness: str,
    bounds: dict[str, tuple[float, float]],
) -> DataFrame:
    """Per event-time window: share of present values outside known fences."""
    require_columns(stream, [ts, *bounds])
    aggs = {}
    for c, (lower, upper) in bounds.items():
        x = as_double(stream, c)
        aggs[c] = F.avg(((x < lower) | (x > upper)).cast("double"))
    return _windowed(stream, ts, width, lateness, aggs)


def _zone_free(stream: DataFrame, ts: str) -> bool:
    return isinstance(dtype_of(stream, ts), T.TimestampNTZType)


def with_event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Event time must carry a zone: zone-free times are taken as UTC.

    The cast reads them in the session zone, so the zone is shifted out again; daily
    windows then start at midnight whatever the session zone is.
    """
    if not _zone_free(stream, ts):
        return stream
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    return replace_columns(
        stream, {ts: F.from_utc_timestamp(quoted(ts).cast("timestamp"), zone)}
    )


def _windowed(
    stream: DataFrame, ts: str, width: str, lateness: str, aggs: dict[str, Column]
) -> DataFrame:
    start, end = F.col("w.start"), F.col("w.end")
    if _zone_free(stream, ts):
        zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
        start, end = (F.to_utc_timestamp(t, zone).cast("timestamp_ntz") for t in (start, end))
    return (
        with_event_time(stream, ts)
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_rows"), *[a.alias(c) for c, a in aggs.items()])
        .select(
            start.alias("window_start"),
            end.alias("window_end"),
            "n_rows",
            *[quoted(c) for c in aggs],
        )
    )


def dedupe_within(
    stream: DataFrame, ts: str, lateness: str, subset: Sequence[str]
) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark of the first one."""
    require_columns(stream, [ts, *subset])
    timed = with_event_time(stream, ts).withWatermark(ts, lateness)
    return timed.dropDuplicatesWithinWatermark(list(subset))


def scrub_stream(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace personal data in the given text columns of a stream."""
    require_columns(stream, columns)
    return replace_columns(stream, {c: scrub_text(as_text(stream, c)) for c in columns})


def profile_batches(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that appends the health score of every micro-batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        # The score scans the batch several times; the source is read once.
        held = batch.persist()
        try:
            scored = health_score(held).withColumn("batch_id", F.lit(batch_id))
            # One directory per batch keeps a retried batch from being counted twice.
            scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            held.unpersist()

    return sink
