"""Order-dependent operators against pandas, with many small slices and hot keys."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import clean, correlate, ordered


@pytest.fixture()
def small_slices(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 40)
    monkeypatch.setattr(ordered, "LEAST_PER_SLICE", 20)


def sensor_rows(n=900):
    r = np.random.default_rng(3)
    # One key holds a third of all rows; long gaps cross slices.
    return pd.DataFrame(
        {
            "key": np.where(np.arange(n) % 3 == 0, "hot", [f"k{i}" for i in r.integers(0, 40, n)]),
            "t": r.permutation(n),
            "v": np.where(r.random(n) < 0.9, np.nan, r.normal(size=n)),
            "s": [None if x < 0.8 else f"s{i}" for i, x in enumerate(r.random(n))],
        }
    )


def as_table(spark, pdf, parts):
    rows = [
        (k, int(t), None if pd.isna(v) else float(v), s)
        for k, t, v, s in pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "key string, t bigint, v double, s string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 50])
@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
def test_fill_matches_pandas(spark, small_slices, parts, forward, keyed):
    pdf = sensor_rows()
    df = as_table(spark, pdf, parts)
    out = clean.fill_missing(
        df, ["v", "s"], "ffill" if forward else "bfill", order_by=["t"],
        keys=["key"] if keyed else (),
    ).df.toPandas().sort_values("t").reset_index(drop=True)
    ordered_rows = pdf.sort_values("t").reset_index(drop=True)
    for c in ("v", "s"):
        source = ordered_rows.groupby("key")[c] if keyed else ordered_rows[c]
        want = source.ffill() if forward else source.bfill()
        same = (out[c] == want) | (out[c].isna() & want.isna())
        assert same.all()


def test_fill_log_counts_cells(spark, small_slices):
    pdf = sensor_rows(200)
    result = clean.fill_missing(as_table(spark, pdf, 4), ["v"], "ffill", order_by=["t"])
    filled = pdf.sort_values("t")["v"].ffill().notna().sum() - pdf["v"].notna().sum()
    row = result.log.first()
    assert (row["rows_before"], row["rows_after"], row["cells_changed"]) == (200, 200, filled)


def test_row_numbers_are_dense(spark, small_slices):
    pdf = sensor_rows()
    out = clean.reset_index(as_table(spark, pdf, 30), ["key", "t"]).df.toPandas()
    want = pdf.sort_values(["key", "t"]).reset_index(drop=True)
    got = out.sort_values("row_no")
    assert got["row_no"].tolist() == list(range(len(pdf)))
    assert got["t"].tolist() == want["t"].tolist()


def test_row_numbers_with_null_keys_come_first(spark, small_slices):
    df = spark.createDataFrame(
        [(None if i % 4 == 0 else i, i) for i in range(400)], "a bigint, b bigint"
    )
    got = clean.reset_index(df, ["a", "b"]).df.orderBy("row_no").collect()
    assert [r["a"] for r in got[:100]] == [None] * 100
    assert [r["row_no"] for r in got] == list(range(400))


def test_row_numbers_by_timestamp_and_double(spark, small_slices):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 0.000123) AS ts, "
        "double(1000 - id) / 7 AS x, id FROM range(500)"
    ).repartition(9)
    for order, sign in ((["ts"], 1), (["x"], -1)):
        got = clean.reset_index(df, order).df.orderBy("row_no").collect()
        assert [r["id"] for r in got] == sorted(range(500), key=lambda i: sign * i)


def test_row_numbers_with_nan_infinity_and_quotes(spark, small_slices):
    xs = [float("nan"), float("inf"), -float("inf")] * 20 + [i / 3 for i in range(200)]
    rows = [(x, f'q"{i}\\,é', i) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "x double, s string, i bigint").repartition(5)
    got = clean.reset_index(df, ["x", "s"]).df.orderBy("row_no").collect()
    want = df.orderBy("x", "s").collect()
    assert [r["i"] for r in got] == [r["i"] for r in want]
    texts = clean.reset_index(df, ["s"]).df.orderBy("row_no").collect()
    assert [r["i"] for r in texts] == [r["i"] for r in df.orderBy("s").collect()]


def test_order_is_required(spark, single_row):
    with pytest.raises(clean.CleaningError):
        clean.fill_missing(single_row, strategy="ffill")
    with pytest.raises(clean.CleaningError):
        clean.reset_index(single_row, [])


@pytest.mark.parametrize("share", [0.0009, 0.3])
def test_slices_follow_the_rows(spark, monkeypatch, share):
    """No slice holds much over its target, whether or not a key is hot."""
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 500)
    monkeypatch.setattr(ordered, "LEAST_PER_SLICE", 500)
    hot = F.when(F.pmod(F.xxhash64("id"), F.lit(10_000)) < int(share * 10_000), -1)
    df = spark.range(40_000).select(hot.otherwise(F.col("id")).alias("key"), "id")
    assert ordered.slice_count(spark, 40_000) == 80
    assert ordered.slice_count(spark, 10**11) == 2 * 10**8
    sizes = ordered.with_slices(df, ["key", "id"]).groupBy(ordered.SLICE).count().collect()
    assert len(sizes) > 70 and max(r["count"] for r in sizes) < 3 * 500


@pytest.mark.parametrize("slices", [1, 7, 8192])
def test_spearman_matches_pandas(spark, small_slices, monkeypatch, slices):
    monkeypatch.setattr(ordered, "MOST_SLICES", slices)
    r = np.random.default_rng(8)
    n = 600
    pdf = pd.DataFrame(
        {
            "a": np.where(np.arange(n) % 3 == 0, 5.0, r.normal(size=n)),
            "b": r.integers(0, 6, n).astype(float),
            "c": r.lognormal(size=n),
        }
    )
    pdf["d"] = np.where(r.random(n) < 0.2, np.nan, pdf["a"] * 2 + r.normal(size=n))
    pdf["e"] = np.where(r.random(n) < 0.3, np.nan, -pdf["c"])
    rows = [tuple(None if pd.isna(x) else float(x) for x in row) for row in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(6)
    want = pdf.corr(method="spearman")
    for x in correlate.correlation_matrix(df, "spearman").collect():
        assert x["r"] == pytest.approx(want.at[x["col_a"], x["col_b"]], abs=1e-9)


@pytest.mark.parametrize("gaps", [False, True])
def test_spearman_shuffles_do_not_grow_with_columns(spark, monkeypatch, gaps):
    """Cells are shuffled once to be ranked and once back to their rows."""

    def exchanges(columns):
        df = spark.range(500).select(
            *[
                F.when((F.col("id") % 7 != 1) | F.lit(not gaps), F.hash("id", F.lit(c)) % 50).cast("double")
                .alias(f"c{c}")
                for c in range(columns)
            ]
        )
        plans = []
        monkeypatch.setattr(
            correlate, "placed_cells",
            lambda cells: plans.append(ordered.with_slices(cells, ["g", "v", "row"]).groupBy(ordered.SLICE).count())
            or placed(cells),
        )
        pairs = correlate.spearman_pairs(df, df.columns)
        count = str(pairs._jdf.queryExecution().executedPlan().toString()).count("Exchange")
        return count, str(plans[0]._jdf.queryExecution().executedPlan().toString()).count("Exchange")

    placed = correlate.placed_cells
    assert exchanges(3) == exchanges(12)


def test_few_slices_for_any_number_of_rows(spark, small_slices, monkeypatch):
    """The number of slices is bounded; fills and numbers are right with large slices, too."""
    monkeypatch.setattr(ordered, "MOST_SLICES", 5)
    pdf = sensor_rows()
    df = as_table(spark, pdf, 9)
    assert ordered.with_slices(df, ["key", "t"]).select(ordered.SLICE).distinct().count() <= 5
    got = clean.reset_index(df, ["t"]).df.toPandas().sort_values("row_no")
    assert got["row_no"].tolist() == list(range(len(pdf)))
    assert got["t"].tolist() == sorted(pdf["t"])
    out = clean.fill_missing(df, ["v"], "ffill", order_by=["t"]).df.toPandas().sort_values("t")
    want = pdf.sort_values("t")["v"].ffill()
    assert out["v"].fillna(-99).tolist() == want.fillna(-99).tolist()


def test_pearson_matches_pandas_and_leaves_constants_null(spark):
    r = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": r.normal(size=300), "b": r.normal(size=300), "k": 2.5})
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    want = pdf.corr()
    for x in correlate.correlation_matrix(df).collect():
        expected = want.at[x["col_a"], x["col_b"]]
        if np.isnan(expected):
            assert x["r"] is None
        else:
            assert x["r"] == pytest.approx(expected)
    top = correlate.top_correlations(df, 5).collect()
    assert [(t["col_a"], t["col_b"]) for t in top] == [("a", "b")]
    assert correlate.top_correlations(df, 0).count() == 0
    with pytest.raises(ValueError):
        correlate.correlation_matrix(df, "kendall")


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_infinities_count_as_missing(spark, method):
    r = np.random.default_rng(9)
    pdf = pd.DataFrame(r.normal(size=(300, 4)), columns=list("abcd"))
    pdf.loc[::50, "a"], pdf.loc[7, "b"], pdf["only"] = np.inf, -np.inf, np.inf
    df = spark.createDataFrame(pdf)
    want = pdf.corr(method)
    undefined = 0
    for x in correlate.correlation_matrix(df, method).collect():
        expected = want.at[x["col_a"], x["col_b"]]
        if np.isnan(expected):
            undefined += 1
            assert x["r"] is None
        else:
            assert x["r"] == pytest.approx(expected, abs=1e-9)
    assert undefined == 9  # the column of infinities with all five


def test_undefined_sums_are_no_correlation(spark):
    """Squares beyond the largest double leave no r; they are not taken for 1.0."""
    df = spark.createDataFrame([(1e200, 1.0), (-1e200, 2.0), (3e200, 5.0)], "a double, b double")
    got = {(x["col_a"], x["col_b"]): x["r"] for x in correlate.correlation_matrix(df).collect()}
    assert got["a", "b"] is None and got["b", "a"] is None
    pairs = df.selectExpr("0L AS i", "a AS x", "b AS y")
    assert [x["r"] for x in correlate._pair_rows(pairs, list("ab"), [(0, 1)]).collect()] == [None]


def test_fewer_than_two_numeric_columns(single_row):
    assert correlate.correlation_matrix(single_row).count() == 0


@pytest.mark.parametrize("looked_up, columns", [(0, "abcd"), (60, "abcd"), (60, "ab")])
def test_spearman_orders_values_and_shuffles_only_columns_of_many(spark, monkeypatch, looked_up, columns):
    """What is put in order grows with the different values, not with rows and pairs."""
    r = np.random.default_rng(11)
    n = 800
    pdf = pd.DataFrame(
        {
            "a": np.where(np.arange(n) % 3 == 0, 5.0, r.normal(size=n).round(2)),
            "b": np.where(r.random(n) < 0.2, np.nan, r.integers(0, 6, n)),
            "c": np.where(r.random(n) < 0.3, np.nan, r.lognormal(size=n).round(3)),
            "d": r.integers(0, 4, n).astype(float),
        }
    )[list(columns)]
    ordered_rows, placed = [], correlate.placed_cells
    monkeypatch.setattr(correlate, "LOOKED_UP", looked_up)
    monkeypatch.setattr(correlate, "CELLS_PER_TASK", 100)
    monkeypatch.setattr(correlate, "SPREAD", 3)
    monkeypatch.setattr(
        correlate, "placed_cells", lambda cells: ordered_rows.append(cells.count()) or placed(cells)
    )
    rows = [tuple(None if pd.isna(x) else float(x) for x in row) for row in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = correlate.correlation_matrix(df, "spearman").collect()
    assert ordered_rows == [sum(pdf[c].nunique() for c in columns)]
    want = pdf.corr(method="spearman")
    for x in got:
        assert x["r"] == pytest.approx(want.at[x["col_a"], x["col_b"]], abs=1e-9)


def test_cells_meet_their_ranks_in_tasks_that_grow_with_the_cells(spark, monkeypatch):
    """No shuffle runs in the session's number of partitions, and each cell finds its rank."""
    monkeypatch.setattr(correlate, "CELLS_PER_TASK", 20)
    monkeypatch.setattr(correlate, "SPREAD", 3)
    values = [None if i % 7 == 3 else -0.0 if i % 5 == 0 else i % 50 / 8 for i in range(400)]
    wide = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(values)], "row long, x0 double, x1 double")
    counts = {v: values.count(v) for v in values if v is not None}  # 0.0 and -0.0 are one value
    ranks = spark.createDataFrame([(0, abs(v), n, v * 1000) for v, n in counts.items()], "g int, v double, n0 long, r0 double")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = correlate._with_ranks(wide, ranks, [0], [1], len(values))
        plan = str(found._jdf.queryExecution().executedPlan().toString())
        got = {r["x1"]: r["a0"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert set(re.findall(r"hashpartitioning\(.*, (\d+)\)", plan)) == {"20"}
    assert got == {float(i): None if v is None else [v * 1000] for i, v in enumerate(values)}
