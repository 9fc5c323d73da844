"""Pearson and Spearman correlation of numeric columns, in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import (
    as_double,
    melt,
    numeric_columns,
    wide_to_long,
)
from tablewise.operators.ordered import SLICE, with_slices
from tablewise.operators.profile import empty_frame
from tablewise.sources.scratch import scratch_path

PAIRS = "col_a string, col_b string, r double"


def _pairs(names: list[str]) -> list[tuple[int, int]]:
    return [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]


def _correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r, null where a side does not vary."""
    return _bounded(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _cell(df: DataFrame, name: str) -> Column:
    """The number in a cell; infinities have no place in a correlation and count as missing."""
    x = as_double(df, name)
    return F.when(F.abs(x) < float("inf"), x)


def _bounded(r: Column) -> Column:
    """``r`` within -1 and 1; undefined values are null.

    greatest and least skip nulls and take NaN for the largest number, so both are
    taken out first.
    """
    defined = r.isNotNull() & ~F.isnan(r)
    return F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _listed(found: DataFrame, names: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """(col_a, col_b, ia, ib, r) of every pair, from (i, r) by pair ordinal; r may be null."""
    order = F.array(
        *[
            F.struct(
                F.lit(names[a]).alias("col_a"), F.lit(names[b]).alias("col_b"),
                F.lit(a).alias("ia"), F.lit(b).alias("ib"), F.lit(k).alias("k"),
            )
            for k, (a, b) in enumerate(pairs)
        ]
    )
    # Pairs without a complete row still appear, with r null.
    listed = found.sparkSession.range(1).select(F.inline(order))
    return (
        listed.join(found, listed["k"] == found["i"].cast("int"), "left")
        .select("col_a", "col_b", "ia", "ib", "r")
    )


def _pair_rows(
    cells: DataFrame, names: list[str], pairs: list[tuple[int, int]]
) -> DataFrame:
    """Correlate the (i, x, y) rows per pair ordinal ``i``."""
    both = cells.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    found = both.groupBy("i").agg(_correlation(F.col("x"), F.col("y")).alias("r"))
    return _listed(found, names, pairs)


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of every pair of columns over the rows where both are present.

    A task multiplies its rows as matrices and sends one row per pair, so the work per
    row grows with the square of the columns only inside the processor.
    """
    totals = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        x = x.astype(float)
        held = ~np.isnan(x)
        x = np.where(held, x, 0.0)
        own = held.astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            sums = np.stack([own.T @ own, x.T @ own, (x * x).T @ own, x.T @ x])
        totals = sums if totals is None else totals + sums
    if totals is None:
        return
    a, b = np.triu_indices(totals.shape[1], 1)
    n, sx, sxx, sxy = totals
    found = [n[a, b], sx[a, b], sx[b, a], sxx[a, b], sxx[b, a], sxy[a, b]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(a))), *map(pa.array, found)], ["i", *_SUMS]
    )


def _matrix_pairs(
    df: DataFrame, names: list[str], cells: list[Column], shift: float | None = None
) -> DataFrame:
    """Correlations of all pairs of the numeric ``cells``, one per name.

    Values are shifted by the column's least one (or by ``shift``), so that a column without
    variation has sums of exactly zero.
    """
    if shift is None:
        low = list(df.agg(*[F.min(c).alias(f"m{i}") for i, c in enumerate(cells)]).first())
    else:
        low = [shift] * len(cells)
    shifted = df.select(
        *[(c - F.lit(low[i] or 0.0)).alias(f"x{i}") for i, c in enumerate(cells)]
    )
    schema = "i long, " + ", ".join(f"{s} double" for s in _SUMS)
    total = (
        shifted.mapInArrow(_pair_sums, schema)
        .groupBy("i")
        .agg(*[F.sum(s).alias(s) for s in _SUMS])
    )
    n = F.col("n")

    def spread(square: str, plain: str) -> Column:
        """Variance; what is left of cancelled sums counts as none."""
        value = F.col(square) / n - F.pow(F.col(plain) / n, F.lit(2))
        return F.when(value > F.col(square) / n * 1e-13, value)

    over = F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))
    r = (F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n) / over
    found = (
        total.where("n > 0").select("i", r.alias("r")).select("i", _bounded(F.col("r")).alias("r"))
    )
    return _listed(found, names, _pairs(names))


def pearson_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(col_a, col_b, ia, ib, r) over the rows where both cells are present."""
    return _matrix_pairs(df, names, [_cell(df, c) for c in names])


# ----------------------------------------------------------------- spearman

#: Rank columns of a value that tasks hold to look up, over all columns of a table.
LOOKED_UP = 400_000
#: Cells of one task when cells and ranks are shuffled to each other.
CELLS_PER_TASK = 2_000_000
#: A value with more cells than one task should have is spread over this many.
SPREAD = 64


def placed_cells(cells: DataFrame) -> DataFrame:
    """The (g, v, row, n*) cells with ``__slice`` and ``upto*``, running sums of n* in a slice.

    Cells are put in the order of (g, v, row), cut into slices: one shuffle for all groups.
    The table is written once.
    """
    counts = [c for c in cells.columns if c.startswith("n")]
    local = Window.partitionBy(SLICE).orderBy("g", "v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = with_slices(cells, ["g", "v", "row"]).withColumns(
        {f"upto_{c}": F.sum(c).over(local) for c in counts}
    )
    path = scratch_path(cells.sparkSession, "ranks")
    placed.write.parquet(path)
    return cells.sparkSession.read.schema(placed.schema).parquet(path)


def average_ranks(placed: DataFrame) -> DataFrame:
    """(g, v, n0, r*): average ranks of a value in its group, one for each count n*.

    ``placed`` has one row for each value of a group.  What the slices before a slice and the
    groups before a group add up to is broadcast.
    """
    counts = [c for c in placed.columns if c.startswith("n")]

    def before(key: str) -> DataFrame:
        sums = placed.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])
        w = Window.partitionBy(F.lit(0)).orderBy(key)
        return sums.select(
            F.col(key).alias(f"{key}_of"),
            *[(F.sum(c).over(w) - F.col(c)).alias(f"{key}_{c}") for c in counts],
        )

    for key in (SLICE, "g"):
        placed = placed.join(F.broadcast(before(key)), F.col(key) == F.col(f"{key}_of"))
    ranks = []
    for i, c in enumerate(counts):
        last = F.col(f"{SLICE}_{c}") + F.col(f"upto_{c}") - F.col(f"g_{c}")
        ranks.append((last - (F.col(c) - 1) / 2).alias(f"r{i}"))
    return placed.select("g", "v", "n0", *ranks)


def _ranked_values(wide: DataFrame, k: int, gaps: list[int]) -> DataFrame:
    """(g, v, n0, r*) of every value of the columns x0.. of ``wide``, written once.

    r0 ranks among the present cells of the own column, r1.. among the rows where the first,
    second.. of the columns with ``gaps`` is present, too.
    """
    held = F.array(*[F.col(f"x{j}").isNotNull() for j in gaps]) if gaps else F.lit(None)
    cells = melt(
        wide.withColumn("held", held),
        [(F.col("row"), F.col(f"x{i}"), F.col("held")) for i in range(k)],
        ["row", "v", "held"], keep_nulls=True,
    ).where("v IS NOT NULL")
    values = cells.groupBy(F.col("i").cast("int").alias("g"), "v").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("n0"),
        *[F.count_if(F.get("held", F.lit(j))).alias(f"n{j + 1}") for j in range(len(gaps))],
    )
    path = scratch_path(wide.sparkSession, "values")
    values.write.parquet(path)
    values = wide.sparkSession.read.schema(values.schema).parquet(path)
    path = scratch_path(wide.sparkSession, "ranks")
    ranks = average_ranks(placed_cells(values))
    ranks.write.parquet(path)
    return wide.sparkSession.read.schema(ranks.schema).parquet(path)


def _with_ranks(wide: DataFrame, ranks: DataFrame, many: list[int], few: list[int], rows: int) -> DataFrame:
    """The cells x* of the ``few`` columns and, as arrays a*, the ranks of the ``many``.

    Cells of all ``many`` columns meet their ranks in one shuffle and go back to their rows in
    another one; a row's other cells travel with one of them.  Spark rewrites doubles that are
    keys of a join and would shuffle again for that, in the session's number of partitions; the
    key is a value's hash, therefore, and the value itself is compared beside it.
    """
    if not many:
        return wide.select(*[f"x{i}" for i in few])
    width = len([c for c in ranks.columns if c.startswith("r")])
    least = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, rows * len(many) // CELLS_PER_TASK)
    ranks = ranks.where(F.col("g").isin(many))
    often = F.col("n0") > CELLS_PER_TASK // 4
    # Values of so many cells are few; what else they weigh, they are known to every task.
    spread = ranks.where(often).select(F.col("g").alias("og"), F.col("v").alias("ov"))
    ranks = ranks.select(
        F.col("g").alias("rg"), F.col("v").alias("rv"), F.xxhash64("v").alias("rh"),
        F.array(*[f"r{j}" for j in range(width)]).alias("a"),
        F.explode(
            F.when(often, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        ).alias("rs"),
    )
    own = [F.when(F.col(f"x{i}").isNotNull(), F.struct(F.lit(i).alias("g"), F.col(f"x{i}").alias("v"))) for i in many]
    none = F.array(F.struct(F.lit(-1).alias("g"), F.lit(None).cast("double").alias("v")))
    held = F.array_compact(F.array(*own))
    cells = wide.select(
        "row", *[f"x{i}" for i in few],
        F.posexplode(F.when(F.size(held) > 0, held).otherwise(none)).alias("at", "cell"),
    ).select(
        "row", *[F.when(F.col("at") == 0, F.col(f"x{i}")).alias(f"x{i}") for i in few],
        "cell.g", "cell.v",
    )
    # Cells without a value find no rank, wherever they are sent.
    salt = F.when(F.col("ov").isNotNull() | F.col("v").isNull(), F.pmod("row", F.lit(SPREAD)).cast("int"))
    found = (
        cells.join(F.broadcast(spread), (F.col("g") == F.col("og")) & (F.col("v") == F.col("ov")), "left")
        .withColumns({"s": F.coalesce(salt, F.lit(0)), "h": F.xxhash64("v")})
        .repartition(parts, "g", "h", "s")
        .join(
            ranks.repartition(parts, "rg", "rh", "rs"),
            (F.col("g") == F.col("rg")) & (F.col("h") == F.col("rh")) & (F.col("s") == F.col("rs"))
            & (F.col("v") - F.col("rv") == 0),
            "left",
        )
    )
    if len(many) == 1:
        return found.select(*[f"x{i}" for i in few], F.col("a").alias(f"a{many[0]}"))
    return (
        found.repartition(parts, "row").groupBy("row").agg(
            *[F.max(f"x{i}").alias(f"x{i}") for i in few],
            *[F.max(F.when(F.col("g") == i, F.col("a"))).alias(f"a{i}") for i in many],
        ).drop("row")
    )


def _rank_sums(
    k: int, many: list[int], few: list[int], width: int, side: list[list[int]], mean: list[list[float]], table
):
    """A function for mapInArrow: sums over the rows of every pair of columns.

    ``side[a][b]`` is the rank of column a that counts next to b, and ``mean[a][b]`` its mean;
    a column has ``width`` ranks.  ``table`` holds the sorted values of the ``few`` columns and their ranks.
    """
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((4, len(pairs)))
        for batch in batches:
            places, ranks, here = {}, {}, {}
            for i in few:
                x = batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float)
                here[i] = ~np.isnan(x)
                values, ranks[i] = table.value[i]
                places[i] = np.minimum(np.searchsorted(values, x), max(0, len(values) - 1))
            for i in many:
                lists = batch.column(f"a{i}")
                here[i] = lists.is_valid().to_numpy(zero_copy_only=False)
                ranks[i] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                places[i] = np.maximum(np.cumsum(here[i]) - 1, 0)
            centred = {}

            def own(a, b):
                key = a, side[a][b], mean[a][b]
                if key not in centred:
                    if len(ranks[a]):
                        centred[key] = np.where(here[a], ranks[a][places[a], side[a][b]] - mean[a][b], 0.0)
                    else:
                        centred[key] = np.zeros(batch.num_rows)
                return centred[key]

            for p, (a, b) in enumerate(pairs):
                x, y, both = own(a, b), own(b, a), here[a] & here[b]
                if not both.all():
                    x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
                totals[:, p] += both.sum(), x @ x, y @ y, x @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pairs))), *map(pa.array, totals)], ["i", "n", "sxx", "syy", "sxy"]
        )

    return sums


def spearman_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """As :func:`pearson_pairs`, on average ranks of the pairwise complete rows.

    Values, not cells, are ranked: each column's counts of its values are put in order once,
    also for the rows where another column is present.  Ranks of columns with few values are
    looked up where the rows lie; only cells of the others are shuffled, in one shuffle to
    their ranks and in another one back to their rows, whatever the number of columns.
    """
    k = len(names)
    wide = df.select(
        F.monotonically_increasing_id().alias("row"),
        *[_cell(df, c).alias(f"x{i}") for i, c in enumerate(names)],
    )
    seen = wide.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(f"x{i}").alias(f"c{i}") for i in range(k)],
    ).first()
    gaps = [i for i in range(k) if seen[f"c{i}"] < seen["n"]]
    ranks = _ranked_values(wide, k, gaps)
    width = 1 + len(gaps)
    sizes = dict(ranks.groupBy("g").agg(F.count(F.lit(1))).collect())
    few, room = [], LOOKED_UP
    for i in sorted(range(k), key=lambda i: sizes.get(i, 0)):
        room -= sizes.get(i, 0) * width
        if room >= 0:
            few.append(i)
    few.sort()
    many = [i for i in range(k) if i not in few]

    # One row per value of the few; how many rows a pair has follows from the counts.
    kept = ranks.where(F.col("g").isin(few)).toArrow()
    g, v = kept.column("g").to_numpy(), kept.column("v").to_numpy()
    r = np.column_stack([kept.column(f"r{j}").to_numpy() for j in range(width)])
    order = np.lexsort((v, g))
    g, v, r = g[order], v[order], r[order]
    table = wide.sparkSession.sparkContext.broadcast({i: (v[g == i], r[g == i]) for i in few})
    both = wide.agg(
        *[
            F.count_if(F.col(f"x{a}").isNotNull() & F.col(f"x{b}").isNotNull()).alias(f"c{a}_{b}")
            for a, b in _pairs(names) if a in gaps and b in gaps
        ] or [F.lit(0)]
    ).first().asDict() if gaps else {}

    def rows_of(a: int, b: int) -> int:
        return both.get(f"c{min(a, b)}_{max(a, b)}", min(seen[f"c{a}"], seen[f"c{b}"]))

    side = [[1 + gaps.index(b) if b in gaps and a != b else 0 for b in range(k)] for a in range(k)]
    mean = [[(rows_of(a, b) + 1) / 2 for b in range(k)] for a in range(k)]
    held = _with_ranks(wide, ranks, many, few, seen["n"])
    found = (
        held.mapInArrow(
            _rank_sums(k, many, few, width, side, mean, table),
            "i long, n double, sxx double, syy double, sxy double",
        )
        .groupBy("i")
        .agg(*[F.sum(s).alias(s) for s in ("n", "sxx", "syy", "sxy")])
        .where("n > 0")
    )
    r = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    return _listed(found.select("i", _bounded(r).alias("r")), names, _pairs(names))


# ------------------------------------------------------------------- reports

def correlation_pairs(
    df: DataFrame, method: str = "pearson", columns: list[str] | None = None
) -> DataFrame:
    """(col_a, col_b, ia, ib, r) for every pair of numeric columns, a before b."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown correlation method {method!r}")
    names = columns or numeric_columns(df)
    if len(names) < 2:
        return empty_frame(df, "col_a string, col_b string, ia int, ib int, r double")
    return (pearson_pairs if method == "pearson" else spearman_pairs)(df, names)


def correlation_matrix(
    df: DataFrame, method: str = "pearson", columns: list[str] | None = None
) -> DataFrame:
    """(col_a, col_b, r): the whole matrix in long form, both triangles and diagonal.

    r is null where it is not defined (a column without variation).  Infinite cells count as
    missing ones.
    """
    names = columns or numeric_columns(df)
    upper = correlation_pairs(df, method, columns)
    if len(names) < 2:
        return empty_frame(df, PAIRS)
    varied = df.agg(
        *[
            F.coalesce(F.min(_cell(df, c)) < F.max(_cell(df, c)), F.lit(False)).alias(f"v{i}")
            for i, c in enumerate(names)
        ]
    )
    diagonal = varied.select(
        wide_to_long(
            [
                (F.lit(c), F.lit(c), F.when(F.col(f"v{i}"), 1.0))
                for i, c in enumerate(names)
            ],
            ["col_a", "col_b", "r"],
        )
    ).drop("i")
    # Mirror each pair inside its row instead of computing it twice.
    both = upper.select(
        F.inline(
            F.array(
                F.struct("col_a", "col_b", "r"),
                F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r"),
            )
        )
    )
    return both.unionByName(diagonal)


def top_correlations(df: DataFrame, top_n: int = 5) -> DataFrame:
    """(col_a, col_b, r): strongest pairs by absolute value, signed."""
    if top_n <= 0 or len(numeric_columns(df)) < 2:
        return empty_frame(df, PAIRS)
    return (
        correlation_pairs(df)
        .where(F.col("r").isNotNull())
        .orderBy(F.abs("r").desc(), "ia", "ib")
        .limit(top_n)
        .select("col_a", "col_b", "r")
    )
