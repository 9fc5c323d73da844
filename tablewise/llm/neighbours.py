"""Nearest neighbours by inner product: multiprobe hashing with p-stable projections.

Vectors are scaled by the largest norm and get one more coordinate that brings them all to
length one, so that the largest inner product is the smallest distance.  A table hashes a
vector to the cells into which Gaussian projections fall.  A query visits, in every table,
the cells around the place where its neighbours are expected, the likeliest first, and all
vectors found there are compared exactly.

How far neighbours' projections lie from the query's, how many projections a table has and
how many cells must be visited is fitted on the true neighbours of a bounded number of
queries, found by scanning all rows: cells are made larger until the visits reach the asked
recall.  All rows are hashed, and cells may hold any number of rows: cells beyond a limit
are dealt out in blocks, each of which all of the cell's queries visit.

A query first visits a few cells of one table.  The last of the neighbours found there bounds
what it still takes from other cells, so that what cells pass on does not grow with their number.

Equal vectors are searched once; their rows take part by their smallest ids, as many as can
be among the nearest.  A query whose cells hold too few rows is scanned against all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm.common import quoted, ranked, release_memory, small_batches, written

#: Tables, and rows that a cell should hold on average before the fit makes cells larger.
TABLES = 4
CELL_ROWS = 128
#: Cells that a query visits in a table at most, and steps to either side of the expected cell.
VISITS = 512
STEPS = 3
#: Queries on which the visits are fitted, and the recall that they must reach there.
FITTED = 200
RECALL = 0.95
#: Bytes of the rows of a region (one comparison in memory); cells with more are dealt out in blocks.
REGION_BYTES = 1 << 25
#: Cells of the first table that are visited ahead, so that far rows need not be passed on.
AHEAD = 16
#: Cells over the limit that are listed at most; the limit grows beyond.
LISTED = 1_000_000
#: Queries that are scanned against all rows at once.
SCANNED = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TINY = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to three digits."""
    return 0.5 * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3)))


class Cells:
    """Hash tables: Gaussian projections cut into cells of one width."""

    def __init__(self, width: int, size: float, projections: int, norm: float, seed: int):
        r = np.random.default_rng(seed)
        self.axes = r.normal(size=(TABLES, projections, width + 1))
        self.shift = r.uniform(0, size, (TABLES, projections))
        self.odd = (r.integers(1 << 62, size=(TABLES, projections + 1)) * 2 + 1).astype(np.uint64)
        self.size, self.norm = size, norm
        self.slope = np.ones(TABLES)
        self.spread = np.full(TABLES, size)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Rows at length one."""
        x = x / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return np.column_stack([x, rest])

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros(len(q))])

    def keys(self, table: int, cells: np.ndarray) -> np.ndarray:
        """One 64-bit key for the cells of all projections (the last axis)."""
        odd = self.odd[table]
        key = (cells.astype(np.int64).view(np.uint64) * odd[:-1]).sum(-1, dtype=np.uint64) + odd[-1]
        key = (key ^ (key >> np.uint64(31))) * _MIX
        return (key ^ (key >> np.uint64(29))).view(np.int64)

    def row_keys(self, table: int, x: np.ndarray) -> np.ndarray:
        at = self.rows(x) @ self.axes[table].T + self.shift[table]
        return self.keys(table, np.floor(at / self.size))

    def fit(self, q: np.ndarray, owner: np.ndarray, near: np.ndarray) -> None:
        """Where neighbours lie along a projection: a multiple of the query's place, and a spread."""
        for t in range(TABLES):
            a = (self.queries(q) @ self.axes[t].T)[owner].ravel()
            b = (self.rows(near) @ self.axes[t].T).ravel()
            if not len(b):
                continue
            self.slope[t] = (a @ b) / max(a @ a, _TINY)
            self.spread[t] = max(np.sqrt(np.mean((b - self.slope[t] * a) ** 2)), _TINY * self.size)

    def visited(self, table: int, q: np.ndarray, visits: int) -> np.ndarray:
        """Keys of the ``visits`` likeliest cells of each query, the likeliest first.

        Projections are taken one after the other; of the cells so far only the ``visits``
        likeliest can lead to one of the likeliest in the end, so the order is exact.
        """
        place = self.slope[table] * (self.queries(q) @ self.axes[table].T) + self.shift[table]
        cell, spread = np.floor(place / self.size), self.spread[table]
        steps = np.arange(-STEPS, STEPS + 1)
        edges = (cell[:, :, None] + np.arange(-STEPS, STEPS + 2)) * self.size - place[:, :, None]
        chance = np.log(np.diff(_normal(edges / spread), axis=2) + 1e-12)
        chosen = np.zeros((len(q), 1, 0), np.int8)
        score = np.zeros((len(q), 1))
        for j in range(cell.shape[1]):
            grown = (score[:, :, None] + chance[:, j][:, None, :]).reshape(len(q), -1)
            best = np.argsort(-grown, axis=1, kind="stable")[:, :visits]
            score = np.take_along_axis(grown, best, 1)
            before = np.take_along_axis(chosen, (best // len(steps))[:, :, None], 1)
            chosen = np.concatenate([before, steps[best % len(steps)][:, :, None].astype(np.int8)], 2)
        return self.keys(table, cell[:, None, :] + chosen)

    def ranks(self, q: np.ndarray, owner: np.ndarray, near: np.ndarray) -> np.ndarray:
        """For each neighbour the least number of visits that finds it in some table."""
        least = np.full(len(near), VISITS + 1)
        for t in range(TABLES):
            visited, own = self.visited(t, q, VISITS), self.row_keys(t, near)
            for i in range(0, len(near), 500):
                part = slice(i, i + 500)
                same = visited[owner[part]] == own[part][:, None]
                rank = np.where(same.any(1), same.argmax(1) + 1, VISITS + 1)
                least[part] = np.minimum(least[part], rank)
        return least


def _best(scores: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the scores that may be among the ``take`` highest of a query, with ties."""
    if scores.shape[1] > take:
        low = np.partition(scores, scores.shape[1] - take, axis=1)[:, -take]
        return np.nonzero(scores >= (low - _TINY * np.abs(low))[:, None])
    return np.nonzero(np.ones(scores.shape, bool))


def _cut(owner: np.ndarray, score: np.ndarray, pos: np.ndarray, take: int) -> np.ndarray:
    """Where the first ``take`` of each owner are, by score, then position."""
    order = np.lexsort((pos, -score, owner))
    sorted_ = owner[order]
    first = np.searchsorted(sorted_, sorted_)
    return order[np.arange(len(order)) - first < take]


def _scan(asked, width: int, take: int):
    """Scores of all rows against a bounded number of queries: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q = asked.value
        held = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            row, pos = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            x = _matrix(batch.column(2), width)
            for i in range(0, len(q), 100):
                scores = q[i : i + 100] @ x.T
                scores[q_rows[i : i + 100, None] == row] = -np.inf
                a, b = _best(scores, take)
                a, b = (v[scores[a, b] > -np.inf] for v in (a, b))
                exact = (q[a + i] * x[b]).sum(1)
                part = [a + i, row[b], pos[b], exact]
                held = [np.concatenate([h, p]) for h, p in zip(held, part)]
            keep = _cut(held[0], held[3], held[2], take)
            held = [h[keep] for h in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_rows[held[0]]), *map(pa.array, held[1:])], ["q", "row", "pos", "score"]
        )
        release_memory()

    return run


_PLACED = ["region", "side", "row", "pos", "vec", "least", "cells"]
_FOUND = "q long, row long, pos long, score double"


def _nearest(found: DataFrame, take: int) -> DataFrame:
    first = Window.partitionBy("q").orderBy(F.desc("score"), "pos", "row")
    return (
        found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= take).drop("n")
    )


def scanned(rows: DataFrame, queries: DataFrame, width: int, take: int) -> DataFrame:
    """The ``take`` nearest of all ``rows`` (row, pos, vec) to each of a bounded number of queries
    (row, vec), exactly: q, row, pos, score.  A query's own row is left out."""
    got = queries.toArrow()
    asked = (np.asarray(got.column("row"), np.int64), _matrix(got.column("vec").combine_chunks(), width))
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    return _nearest(rows.select("row", "pos", "vec").mapInArrow(_scan(shared, width, take), _FOUND), take)


def fitted_cells(
    rows: DataFrame, queries: DataFrame, n: int, width: int, norm: float, take: int, seed: int
) -> tuple[Cells, int]:
    """Tables for ``n`` rows and the visits that find ``RECALL`` of the sample's neighbours."""
    spark = rows.sparkSession
    sample = written(queries.orderBy(F.xxhash64("row"), "row").limit(FITTED), "sample")
    near = written(scanned(rows, sample, width, take), "near")
    one = Cells(width, 1.0, 1, norm, seed)
    if near.isEmpty():
        return Cells(width, 1.0, 0, norm, seed), 1
    wanted = F.broadcast(near.select("row").distinct())
    vectors = rows.join(wanted, "row", "left_semi").select("row", "vec").toArrow()
    place = {r: i for i, r in enumerate(vectors.column("row").to_pylist())}
    x = _matrix(vectors.column("vec").combine_chunks(), width)
    asked = sample.select("row", "vec").toArrow()
    q_place = {r: i for i, r in enumerate(asked.column("row").to_pylist())}
    q = _matrix(asked.column("vec").combine_chunks(), width)
    links = near.select("q", "row").collect()
    owner = np.array([q_place[r["q"]] for r in links])
    x = x[[place[r["row"]] for r in links]]
    size = float(np.median(np.linalg.norm(one.queries(q)[owner] - one.rows(x), axis=1)))
    projections = max(0, round(np.log2(max(n / CELL_ROWS, 1)) / 2))
    while True:
        cells = Cells(width, max(size, _TINY), projections, norm, seed)
        cells.fit(q, owner, x)
        ranks = np.sort(cells.ranks(q, owner, x))
        visits = int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))) - 1)])
        if visits <= VISITS:
            return cells, visits
        projections -= 1


def _hashed(cells, width: int, regions: int, crowded, tables: range):
    """Every row once in each of the tables, in the region of its cell (in all copies of its block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column("vec"), width), np.asarray(batch.column("row"), np.int64)
            for t in tables:
                keys = cells.value.row_keys(t, x)
                region, at = _row_regions(t, keys, rows, regions, crowded.value if crowded else {})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(region),
                        pa.array(np.zeros(len(at), np.int8)),
                        *(batch.column(c).take(pa.array(at)) for c in ("row", "pos", "vec")),
                        pa.nulls(len(at), pa.float64()),
                        pa.array([k.tobytes() for k in keys[at]], pa.binary()),
                    ],
                    _PLACED,
                )
        release_memory()

    return run


def _block_region(key: int, block: int, copy: int) -> int:
    mixed = (key * 0x9E3779B97F4A7C15 + block * 0xD6E8FEB86659FD93 + copy * 0xC2B2AE3D27D4EB4F) % (1 << 64)
    return -1 - (mixed ^ (mixed >> 32)) % (1 << 62)


def _row_regions(table, keys, rows, regions, crowded):
    """(region, index): a crowded cell's row goes to its block, once for each copy of the block."""
    region = table * regions + keys.view(np.uint64) % np.uint64(regions)
    region, at = region.astype(np.int64), np.arange(len(keys))
    if not crowded:
        return region, at
    hot = [i for i, k in enumerate(keys.tolist()) if k in crowded]
    more = [
        (_block_region(int(keys[i]), int(rows[i]) % blocks, c), i)
        for i in hot
        for blocks, copies in [crowded[int(keys[i])]]
        for c in range(copies)
    ]
    plain = np.ones(len(keys), bool)
    plain[hot] = False
    return (
        np.concatenate([region[plain], np.array([r for r, _ in more], np.int64)]),
        np.concatenate([at[plain], np.array([i for _, i in more], np.int64)]),
    )


def _visiting(cells, width: int, regions: int, crowded, tables: range, visits: int):
    """Every query once in each region that has a cell it visits, with those cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = crowded.value if crowded else {}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                q, rows = _matrix(batch.column("vec"), width), np.asarray(batch.column("row"), np.int64)
                for t in tables:
                    keys = cells.value.visited(t, q, visits)
                    owner = np.repeat(np.arange(len(q)), keys.shape[1])
                    flat = keys.ravel()
                    region = (t * regions + flat.view(np.uint64) % np.uint64(regions)).astype(np.int64)
                    if hot:
                        parts = [
                            (_block_region(k, b, int(rows[o]) % copies), o, k)
                            for o, k in zip(owner.tolist(), flat.tolist())
                            if k in hot
                            for blocks, copies in [hot[k]]
                            for b in range(blocks)
                        ]
                        if parts:
                            more = [np.array(v, np.int64) for v in zip(*parts)]
                            region = np.concatenate([region, more[0]])
                            owner, flat = np.concatenate([owner, more[1]]), np.concatenate([flat, more[2]])
                    order = np.lexsort((region, owner))
                    owner, region, flat = owner[order], region[order], flat[order]
                    new = np.append(True, (owner[1:] != owner[:-1]) | (region[1:] != region[:-1]))
                    starts = np.flatnonzero(new)
                    ends = np.append(starts[1:], len(flat))
                    at = pa.array(owner[starts])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(region[starts]),
                            pa.array(np.ones(len(starts), np.int8)),
                            *(batch.column(c).take(at) for c in ("row", "pos", "vec", "least")),
                            pa.array([flat[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                        ],
                        _PLACED,
                    )
        release_memory()

    return run


def _compare(width: int, take: int):
    """Regions in turn: their rows are held, their queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.asarray(batch.column("region"), np.int64)
            sides = np.asarray(batch.column("side"))
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (sides[1:] != sides[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                part = batch.slice(start, end - start)
                if names[start] != region:
                    region, parts, held = names[start], [], None
                if sides[start] == 0:
                    parts.append(part)
                    continue
                if parts:
                    held, parts = _held(parts, width), []
                if held is not None:
                    for i in range(0, part.num_rows, 2000):
                        yield _found(held, part.slice(i, 2000), width, take)
        release_memory()

    return run


def _held(parts: list[pa.RecordBatch], width: int):
    keys = np.frombuffer(b"".join(k for p in parts for k in p.column("cells").to_pylist()), np.int64)
    row, pos = (
        np.concatenate([np.asarray(p.column(c), np.int64) for p in parts]) for c in ("row", "pos")
    )
    x = np.concatenate([_matrix(p.column("vec"), width) for p in parts])
    order = np.argsort(keys, kind="stable")
    return keys[order], row[order], pos[order], x[order]


def _found(held, part: pa.RecordBatch, width: int, take: int) -> pa.RecordBatch:
    keys, row, pos, x = held
    cells = [np.frombuffer(c, np.int64) for c in part.column("cells").to_pylist()]
    wanted = np.concatenate(cells)
    owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    q, q_row = _matrix(part.column("vec"), width), np.asarray(part.column("row"), np.int64)
    least = np.asarray(part.column("least"), np.float64)
    least = least - _TINY * np.abs(least)
    low, high = keys.searchsorted(wanted, "left"), keys.searchsorted(wanted, "right")
    some = np.flatnonzero(high > low)
    some = some[np.argsort(low[some], kind="stable")]
    edges = np.append(np.flatnonzero(np.append(True, low[some][1:] != low[some][:-1])), len(some))
    got = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for a, b in zip(edges[:-1], edges[1:]):
        asks, start, end = owner[some[a:b]], low[some[a]], high[some[a]]
        for i in range(0, len(asks), 256):
            scores = q[asks[i : i + 256]] @ x[start:end].T
            scores[q_row[asks[i : i + 256], None] == row[start:end]] = -np.inf
            who, what = _best(scores, take)
            fine = (scores[who, what] > -np.inf) & (scores[who, what] >= least[asks[i : i + 256]][who])
            got[0].append(asks[i : i + 256][who[fine]])
            got[1].append(what[fine] + start)
    who, what = (np.concatenate(g) for g in got)
    score = np.empty(len(who))
    for i in range(0, len(who), 10_000):
        score[i : i + 10_000] = (q[who[i : i + 10_000]] * x[what[i : i + 10_000]]).sum(1)
    keep = _cut(who, score, pos[what], take)
    return pa.RecordBatch.from_arrays(
        [pa.array(q_row[who[keep]]), pa.array(row[what[keep]]), pa.array(pos[what[keep]]), pa.array(score[keep])],
        ["q", "row", "pos", "score"],
    )


def _region_rows(width: int) -> int:
    return max(1, REGION_BYTES // (8 * width))


def _crowded(rows: DataFrame, cells, width: int, n: int) -> dict[int, tuple[int, int]]:
    """Cells over the limit: blocks of their rows, and copies of a block for the many queries."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), width)
                found = np.concatenate([cells.value.row_keys(t, x) for t in range(TABLES)])
                key, count = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["key", "n"])

    limit = max(_region_rows(width), TABLES * n // LISTED)
    counts = (
        rows.select("vec").mapInArrow(keys, "key long, n long").groupBy("key")
        .agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()
    )
    return {
        r["key"]: (blocks, 1 + blocks // 16) for r in counts for blocks in [-(-r["n"] // limit)]
    }


def _unique_rows(
    vectors: DataFrame, id_col: str, vec_col: str, asks: Column | str, take: int
) -> tuple[DataFrame, DataFrame, int]:
    """(all rows with the first row of their class, one row per class with its smallest ids, width)."""
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    item = "float" if single else "double"
    vec = F.col(quoted(vec_col)).cast(f"array<{item}>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vec.isNotNull() & ~odd & F.exists(vec, lambda x: x != 0)
    own = vectors.select(
        F.col(quoted(id_col)).alias("id"),
        F.coalesce(F.expr(asks) if isinstance(asks, str) else asks, F.lit(False)).alias("asks"),
        # Adding nothing turns a negative zero into a positive one.
        F.when(sound, F.transform(vec, lambda x: x + F.lit(0.0).cast(item))).alias("vec"),
    ).where("vec IS NOT NULL")
    width = own.agg(F.max(F.size("vec"))).first()[0] or 1
    zeros = F.array_repeat(F.lit(0.0).cast(item), F.lit(width) - F.size("vec"))
    own = own.withColumn("vec", F.concat("vec", zeros))
    if isinstance(own.schema["id"].dataType, T.IntegralType):
        own = own.withColumn("pos", F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)))
    else:
        own = ranked(own, [F.asc_nulls_last("id")], "pos")
    own = written(
        own.withColumns(
            {
                "row": F.monotonically_increasing_id(),
                "a": F.xxhash64("vec"),
                "b": F.xxhash64(F.lit("second"), "vec"),
            }
        ),
        "vectors",
    )
    repeated = written(
        own.groupBy("a", "b").agg(F.min(F.struct("pos", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("a", "b", F.col("first.row").alias("class")),
        "repeated",
    )
    grouped = own.join(repeated, ["a", "b"], "left").withColumn(
        "class", F.coalesce("class", "row")
    )
    low = Window.partitionBy("class").orderBy("pos", "row")
    several = (
        own.select("a", "b", "pos", "row", "id").join(repeated, ["a", "b"])
        .withColumn("n", F.row_number().over(low)).where(F.col("n") <= take + 1)
        .groupBy("class").agg(F.sort_array(F.collect_list(F.struct("pos", "row", "id"))).alias("members"))
    )
    firsts = grouped.where(F.col("class") == F.col("row")).select("row", "pos", "id", "vec")
    classes = firsts.join(several.withColumnRenamed("class", "row"), "row", "left").withColumn(
        "members", F.coalesce("members", F.array(F.struct("pos", "row", "id")))
    )
    return (
        written(grouped.select("id", "asks", "row", "class"), "members"),
        written(classes.drop("id"), "classes"),
        width,
    )


def nearest(
    vectors: DataFrame,
    asks: Column | str,
    take: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: int = 12,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``take`` nearest found of each row where ``asks`` holds.

    Nearness is the inner product of the original vectors in double precision, the largest
    first, ties to the smaller id (null ids last).  All rows but the query's own are
    candidates, copies of it and rows with the same id too; a query has fewer neighbours only if there
    are fewer rows.  Vectors that are null, zero, or hold null or non-finite components take
    no part; shorter ones count as filled up with zeros.  Repeated rows are rows of their own.
    A table without queries or without sound vectors gives an empty table.
    """
    if take < 1:
        raise ValueError("take must be positive")
    spark = vectors.sparkSession
    small_batches(spark)
    members, classes, width = _unique_rows(vectors, id_col, vec_col, asks, take)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, norm = classes.agg(F.count(F.lit(1)), F.max(length)).first()
    asking = members.where("asks")
    queries = written(
        classes.join(asking.select(F.col("class").alias("row")).distinct(), "row", "left_semi")
        .select("row", "pos", "vec"),
        "queries",
    )
    found = _search(classes, queries, n, width, norm, take, seed) if n else None
    own = queries.select(
        F.col("row").alias("q"), "row",
        F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("score"),
    )
    pairs = own if found is None else own.unionByName(found.select("q", "row", "score"))
    wide = asking.select(F.col("id").alias("query_id"), F.col("row").alias("asker"), F.col("class").alias("q"))
    rows = (
        wide.join(pairs, "q").join(classes.select("row", "members"), "row")
        .select("query_id", "asker", "score", F.explode("members").alias("m"))
        .where("m.row <> asker")
    )
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "m.pos", "m.row")
    return (
        rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)
        .select("query_id", "rank", F.col("m.id").alias("vec_id"), "score")
    )


def _search(classes, queries, n, width, norm, take, seed) -> DataFrame:
    spark = classes.sparkSession
    fitted, visits = fitted_cells(classes, queries, n, width, norm, take, seed)
    cells = spark.sparkContext.broadcast(fitted)
    regions = -(-n // _region_rows(width))
    crowded = spark.sparkContext.broadcast(_crowded(classes, cells, width, n))
    item = classes.schema["vec"].dataType.simpleString()
    schema = (
        f"region long, side tinyint, row long, pos long, vec {item}, least double, cells binary"
    )
    rows = classes.select("row", "pos", "vec")

    def found_in(tables: range, visits: int, queries: DataFrame) -> DataFrame:
        index = rows.mapInArrow(_hashed(cells, width, regions, crowded, tables), schema)
        visiting = queries.mapInArrow(
            _visiting(cells, width, regions, crowded, tables, visits), schema
        )
        return (
            index.unionAll(visiting)
            .repartition("region")
            .sortWithinPartitions("region", "side")
            .mapInArrow(_compare(width, take), _FOUND)
        )

    plain = queries.select("row", "pos", "vec").withColumn("least", F.lit(float("-inf")))
    ahead = written(_nearest(found_in(range(1), min(visits, AHEAD), plain), take), "ahead")
    bounds = (
        ahead.groupBy(F.col("q").alias("row"))
        .agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == take)
    )
    bounded = plain.join(bounds, "row", "left").select(
        "row", "pos", "vec", F.coalesce("bound", "least").alias("least")
    )
    compared = ahead.unionAll(found_in(range(TABLES), visits, bounded))
    found = written(_nearest(compared.dropDuplicates(["q", "row"]), take), "found")
    least = min(take, n - 1)
    short = written(
        queries.join(
            found.groupBy("q").count().where(F.col("count") >= least).select(F.col("q").alias("row")),
            "row",
            "left_anti",
        ).withColumn("part", F.floor(F.monotonically_increasing_id() / SCANNED)),
        "short",
    )
    parts = [r[0] for r in short.select("part").distinct().collect()] if least else []
    for part in parts:
        some = short.where(F.col("part") == part)
        whole = written(scanned(classes, some, width, take), "scanned")
        gone = some.select(F.col("row").alias("q"))
        found = found.join(gone, "q", "left_anti").unionByName(whole)
    return found
