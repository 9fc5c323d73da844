import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import neighbours, queries

ASKS = "vec_id % 20 = 0"
SCHEMA = "vec_id long, embedding array<float>"


def brute_force(rows, take=20):
    """{query id: [(id, score)]} of rows (id, vector or None)."""
    width = max((len(v) for _, v in rows if v), default=1)
    sound = [
        (i, np.pad(np.array(v, float), (0, width - len(v))))
        for i, v in rows
        if v and None not in v and np.isfinite(v).all() and np.any(np.array(v))
    ]
    out = []
    for n, (i, q) in enumerate(sound):
        if i is not None and i % 20 == 0:
            near = sorted(
                ((-float(q @ x), j if j is not None else 1 << 63, m) for m, (j, x) in enumerate(sound) if m != n)
            )[:take]
            out.append((i, [(j, -s) for s, j, _ in near]))
    return out


def lists(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (repr(r["query_id"]), r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    hits = total = 0
    for i, near in want:
        low = near[-1][1] - 1e-9
        own = got.get(i, [])
        assert [s for _, s in own] == sorted((s for _, s in own), reverse=True)
        assert len(own) == len(near)
        hits += sum(s >= low for _, s in own)
        total += len(near)
    return hits / total


def test_query(spark, sf_dir):
    rows = [
        (r["vec_id"], r["embedding"])
        for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ]
    df = queries.op12_neighbours(spark, sf_dir)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = lists(df), brute_force(rows)
    assert got.keys() == {i for i, _ in want}
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert len({i for i, _ in near}) == len(near) and q not in {i for i, _ in near}
        for i, s in near:
            assert abs(s - vectors[q] @ vectors[i]) < 1e-12


@pytest.fixture(scope="module")
def many():
    """6000 vectors of unequal lengths in groups, a third of them copies of one."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(40, size=6000)] + 0.4 * r.normal(size=(6000, 16))
    x *= r.uniform(0.5, 2, (6000, 1))
    x[::3] = 3 * x[0]
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


def test_recall_and_copies(spark, many):
    df = spark.createDataFrame(many, SCHEMA).repartition(7)
    got, want = lists(neighbours.nearest(df, ASKS)), brute_force(many)
    assert recall(got, want) >= 0.9
    copies = [i for i in got if i % 3 == 0]
    same = float(np.square(many[0][1]).sum())
    for i in copies[:30]:
        own = [j for j, s in got[i] if abs(s - same) < 1e-9]
        assert len(own) > 5 and own == [j for j in range(0, 66, 3) if j != i][: len(own)]


def test_crowded_cells(spark, many, monkeypatch):
    """Cells over the limit are dealt out in blocks with copies, and nothing is lost."""
    rows = [(i, v) for i, v in many if i % 3 or i == 0]
    monkeypatch.setattr(neighbours, "REGION_BYTES", 30 * 8 * 16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100_000)
    assert recall(lists(neighbours.nearest(df, ASKS)), brute_force(rows)) == 1.0


def test_short_queries(spark, many, monkeypatch):
    """Queries that find too little are scanned against all rows."""
    monkeypatch.setattr(neighbours, "RECALL", 0.0)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 2)
    monkeypatch.setattr(neighbours, "TABLES", 1)
    df = spark.createDataFrame(many, SCHEMA)
    recall(lists(neighbours.nearest(df, ASKS)), brute_force(many))


def test_visits_are_in_order():
    cells = neighbours.Cells(8, 0.7, 4, 1.0, 5)
    q = np.random.default_rng(1).normal(size=(3, 8))
    few, all_ = cells.visited(0, q, 50), cells.visited(0, q, 7**4)
    assert (all_[:, :50] == few).all()
    assert all(len(set(row)) == 7**4 for row in all_.tolist())


def test_awkward(spark):
    rows = [
        (0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [1.0]), (2, [-0.0, 2.0, 1.0]), (3, [0.0, 2.0, 1.0]),
        (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
        (9, [None, 1.0]), (None, [0.5, 0.5, 0.5]), (None, None), (20, [0.0, 1.0, 0.0]), (40, [0.0, 0.0]),
        (60, [-1.0, 3.0]), (60, [-1.0, 3.0]),
    ]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    extra = {c: F.lit("own") for c in ("row", "pos", "q", "score", "class", "rank", "a", "n", "VEC")}
    got = neighbours.nearest(df.withColumns(extra), ASKS).collect()
    want = brute_force(rows)
    have = sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in got)
    assert have == sorted(
        (i, k + 1, round(s, 9)) for i, near in want for k, (_, s) in enumerate(near)
    )
    first = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 20]
    assert first == [60, 60, 2, 3, None, 0, 0, 1]
    assert neighbours.nearest(spark.createDataFrame([], schema), ASKS).collect() == []
    assert neighbours.nearest(df.where("vec_id IN (4, 5, 40)"), ASKS).collect() == []
    assert neighbours.nearest(df.where("vec_id = 20"), ASKS).collect() == []
    with pytest.raises(ValueError):
        neighbours.nearest(df, ASKS, take=0)


def test_text_ids(spark):
    rows = [(f"v{i:02}", [float(i % 5), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = lists(neighbours.nearest(df, "vec_id = 'v03'", take=8))
    assert [i for i, _ in got["v03"]] == ["v04", "v09", "v14", "v19", "v24", "v29", "v08", "v13"]
