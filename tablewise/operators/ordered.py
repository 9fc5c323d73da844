"""Order-dependent operators without a global window.

Rows are cut into order slices of about equal size, at cut points taken from a
sample of the full ordering key.  Because the key is a total order, equal lead
values (a key holding a third of all rows, say) are split over many slices.  Each
slice is a window partition; what crosses slices is one row per slice, small enough
to broadcast.  There are MOST_SLICES at most, whatever the rows: beyond, slices grow, and
a task sorts its own on disk.  Cut points become literals, so every later pass, also after a lost
executor, assigns the same slice to the same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import present, quoted, require_columns

ROWS_PER_SLICE = 250_000  # what one window task sorts, whatever the size of the table
LEAST_PER_SLICE = 2_000  # keeps small tables in few slices
SAMPLE_PER_SLICE = 32
# Bounds the cut points in a plan, the sampled keys that one task sorts (SAMPLE_PER_SLICE
# times as many) and the rows that are broadcast.
MOST_SLICES = 8192
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
SLICE = "__slice"


def order_key(names: Sequence[str]) -> Column:
    return F.struct(*[quoted(n).alias(f"k{i}") for i, n in enumerate(names)])


def slice_count(spark: SparkSession, rows: int) -> int:
    """Slices that grow with the rows; small tables get several per shuffle task, so that
    their hash placement evens out."""
    spread = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(spread, rows // LEAST_PER_SLICE), -(-rows // ROWS_PER_SLICE))


def slice_number(key: Column, sample: DataFrame, slices: int) -> Column:
    """Slice 0..slices-1 of a key, between cut points of a sample of keys (column k).

    One key per slice travels through the driver and comes back as a literal.
    """
    if slices == 1:
        # Always 0, but no constant: joins on the slice stay equi-joins.
        return F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(slices - 1)),
        lambda j: F.get("a", F.floor(j * F.size("a") / slices).cast("int")),
    )
    ordered = sample.agg(F.array_sort(F.collect_list("k")).alias("a"))
    text = ordered.select(F.to_json(cuts, _JSON)).first()[0]
    dtype = sample.select(F.array("k").alias("a")).schema["a"].dataType
    bounds = F.from_json(F.lit(text), dtype, _JSON)

    # Binary search: add the largest steps whose cut point is not above the key.
    n = slices - 1
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    place = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step
        ).otherwise(at),
    )
    # Declared non-null, or joins on the slice would push a null test of the whole
    # search below the aggregation that precedes them.
    return F.coalesce(place, F.lit(0))


def with_slices(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add ``__slice``, the number of the row's order slice (ascending)."""
    if df.isStreaming:
        raise ValueError("order-dependent operators need a bounded table")
    require_columns(df, order_by)
    rows = df.count()
    slices = min(MOST_SLICES, slice_count(df.sparkSession, rows))
    share = min(1.0, 1.25 * slices * SAMPLE_PER_SLICE / max(1, rows))
    sample = df.select(order_key(order_by).alias("k")).sample(share, seed=17)
    return df.withColumn(SLICE, slice_number(order_key(order_by), sample, slices))


def _by_slice(order: str) -> Window:
    """Window over the slice table: one row per slice."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def add_row_number(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Add the dense 0-based row number in ``order_by`` order (a total order)."""
    sliced = with_slices(df, order_by)
    offsets = sliced.groupBy(SLICE).agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select(
        SLICE, (F.sum("__n").over(_by_slice(SLICE)) - F.col("__n")).alias("__before")
    )
    local = F.row_number().over(
        Window.partitionBy(SLICE).orderBy(*[quoted(c) for c in order_by])
    )
    return (
        sliced.withColumn("__at", local)
        .join(F.broadcast(offsets), SLICE)
        .withColumn(name, F.col("__before") + F.col("__at") - 1)
        .drop(SLICE, "__before", "__at")
    )


def carry(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    forward: bool = True,
) -> DataFrame:
    """Fill gaps with the nearest present value above (or below) in order, per key.

    Adds one column ``__fill_<i>`` per entry of ``columns``; null where no value is
    near.  Keys lead the ordering, so a large key spans several slices and its last
    value is handed from slice to slice.
    """
    require_columns(df, [*columns, *order_by, *keys])
    order = [*keys, *order_by]
    sliced = with_slices(df, order)
    key = F.struct(*[quoted(k).alias(f"g{i}") for i, k in enumerate(keys)]) if keys else (
        F.struct(F.lit(0).alias("g0"))
    )
    rank = order_key(order)

    # The present cell that each slice passes on, with the key it belongs to.
    edge = F.max_by if forward else F.min_by
    passed = []
    for i, c in enumerate(columns):
        v = present(df, c)
        cell = F.struct(key.alias("key"), v.alias("v"))
        passed.append(edge(cell, F.when(v.isNotNull(), rank)).alias(f"__p{i}"))
    edges = sliced.groupBy(SLICE).agg(*passed)
    w = Window.partitionBy(F.lit(0)).orderBy(
        F.col(SLICE).asc() if forward else F.col(SLICE).desc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        SLICE,
        *[F.last(f"__p{i}", ignorenulls=True).over(w).alias(f"__p{i}") for i in range(len(columns))],
    )

    local = Window.partitionBy(SLICE, *[quoted(k) for k in keys]).orderBy(
        *[quoted(c).asc() if forward else quoted(c).desc() for c in order_by]
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.withColumns(
        {
            f"__l{i}": F.last(present(df, c), ignorenulls=True).over(local)
            for i, c in enumerate(columns)
        }
    ).join(F.broadcast(edges), SLICE, "left")
    filled = {
        f"__fill_{i}": F.coalesce(
            F.col(f"__l{i}"),
            F.when(F.col(f"__p{i}")["key"].eqNullSafe(key), F.col(f"__p{i}")["v"]),
        )
        for i in range(len(columns))
    }
    return out.withColumns(filled).drop(
        SLICE, *[f"__{x}{i}" for x in "lp" for i in range(len(columns))]
    )
