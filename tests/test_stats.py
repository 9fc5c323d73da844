"""Shared passes against numpy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablewise.operators import stats

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def quantiles_of(spark, values, probs=PROBS, parts=4):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(parts)
    row = stats.quantiles(df, ["x"], probs).first()
    return [row[f"q{i}"] for i in range(len(probs))]


@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [1.0, 2.0],
        [5.0] * 40,
        list(np.random.default_rng(1).normal(0, 1e-9, 500)),
        list(np.random.default_rng(2).lognormal(0, 20, 700)),
        list(-np.random.default_rng(3).lognormal(3, 4, 500)),
        list(np.random.default_rng(4).integers(-3, 4, 900).astype(float)),
        [7.0] * 300 + list(np.random.default_rng(5).uniform(0, 1e6, 600)),
        [1e300, -1e300, 0.0, 5e-324, 1.5],
    ],
)
def test_quantiles_are_exact(spark, values):
    got = quantiles_of(spark, values)
    want = np.quantile(values, PROBS)
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_quantiles_with_infinities(spark):
    got = quantiles_of(spark, [-math.inf, 1.0, 2.0, 3.0, math.inf], [0.0, 0.25, 0.5, 1.0])
    assert got == [-math.inf, 1.0, 2.0, math.inf]


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.floats(allow_nan=False, allow_infinity=False, width=64, min_value=-1e12, max_value=1e12),
        min_size=1, max_size=60,
    )
)
def test_quantiles_property(spark, values):
    assert np.allclose(quantiles_of(spark, values), np.quantile(values, PROBS), rtol=1e-9, atol=1e-9)


def test_quantiles_skip_missing_and_do_not_mind_partitions(spark):
    df = spark.createDataFrame(
        [(float(i) if i % 3 else None, math.nan if i % 5 == 0 else i * 0.5) for i in range(301)],
        "a double, b double",
    )
    pdf = df.toPandas()
    for parts in (1, 200):
        rows = {r["i"]: r for r in stats.quantiles(df.repartition(parts), ["a", "b"], [0.25, 0.5]).collect()}
        for i, c in enumerate("ab"):
            want = pdf[c].quantile([0.25, 0.5]).tolist()
            assert [rows[i]["q0"], rows[i]["q1"]] == pytest.approx(want)


def test_moments_match_pandas(spark):
    x = np.random.default_rng(9).gamma(2.0, 3.0, 400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "flat": 4.0}))
    rows = {r["column"]: r for r in stats.moments(df, ["x", "flat"]).collect()}
    s = pd.Series(x)
    r = rows["x"]
    assert r["mean"] == pytest.approx(s.mean())
    assert r["std_samp"] == pytest.approx(s.std())
    assert r["std_pop"] == pytest.approx(s.std(ddof=0))
    assert r["skew"] == pytest.approx(s.skew())
    assert r["kurtosis"] == pytest.approx(s.kurt())
    assert (rows["flat"]["skew"], rows["flat"]["kurtosis"], rows["flat"]["std_samp"]) == (0, 0, 0)


def gini_by_hand(counts):
    x = np.sort(np.array(counts, dtype=float))
    k = len(x)
    return 2 * (np.arange(1, k + 1) * x).sum() / (k * x.sum()) - (k + 1) / k


def test_value_profile_merges_equal_counts(spark):
    counts = {"a": 7, "b": 7, "c": 1, "d": 1, "e": 1, "f": 90}
    values = [v for v, n in counts.items() for _ in range(n)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(7)
    r = stats.value_profile(df, ["x"]).first()
    assert (r["n_rows"], r["n"], r["classes"]) == (112, 107, 6)
    assert r["gini"] == pytest.approx(gini_by_hand(list(counts.values())))
    assert r["sum_sq"] == sum(n * n for n in counts.values())


def test_duplicate_counts_tell_null_places_apart(spark):
    df = spark.createDataFrame(
        [(None, "a"), ("a", None), (None, "a"), ("b", "b"), ("b", "b"), ("b", "b")],
        "x string, y string",
    )
    r = stats.duplicate_counts(df).first()
    assert (r["n_rows"], r["members"]) == (6, 5)


def test_duplicate_counts_with_nan_zero_and_nested(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (double('nan'), array(1), map('k', 1)), "
        "(double('nan'), array(1), map('k', 1)), (0.0D, array(2), map('k', 2)), "
        "(-0.0D, array(2), map('k', 2)) AS t(x, y, z)"
    )
    assert stats.duplicate_counts(df).first()["members"] == 4


def test_most_frequent_takes_smallest_on_ties(spark):
    df = spark.createDataFrame(
        [("b", 10, None), ("a", 9, None), ("b", 9, None), ("a", 10, None), ("c", 1, None)],
        "x string, y int, z double",
    )
    x, y, z = stats.most_frequent(df, ["x", "y", "z"])
    assert df.select(x, y).first()[:] == ("a", 9) and z is None


def test_most_frequent_of_other_types(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'2024-01-02 03:04:05.6', date'2024-05-06', 1.50BD, true, "
        "array(1, 2), 0.1D), (null, null, null, null, null, double('nan')) AS t(a, b, c, d, e, f)"
    )
    top = stats.most_frequent(df, df.columns)
    assert df.select(*[t.eqNullSafe(df[c]) for t, c in zip(top, df.columns)]).first()[:] == (True,) * 6


def test_column_facts(spark):
    df = spark.createDataFrame(
        [(1, None, "s"), (1, None, None), (1, None, "s")], "a int, b string, c string"
    )
    got = {r["column"]: (r["missing"], r["constant"]) for r in stats.column_facts(df).collect()}
    assert got == {"a": (0, True), "b": (3, False), "c": (1, True)}


def test_summary_takes_its_moments_from_the_histogram(spark):
    """Same figures as their own scan gives, with one scan less; extremes and constants."""
    r = np.random.default_rng(6)
    pdf = pd.DataFrame(
        {
            "a": r.lognormal(8, 3, 4000), "b": r.normal(1e6, 1e-3, 4000), "c": 0.1,
            "d": np.where(r.random(4000) < 0.5, np.nan, r.integers(-5, 6, 4000)), "e": r.normal(size=4000) * 1e150,
        }
    )
    pdf["none"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    names = list(pdf.columns)
    own = {x["column"]: x for x in stats.moments(df, names, shape=False).collect()}
    got = {x["column"]: x for x in stats.numeric_summary(df, names).collect()}
    assert got.keys() == own.keys() == set("abcde")
    for c, x in got.items():
        for field in ("n", "mean", "std_pop", "std_samp", "min", "max"):
            assert x[field] == pytest.approx(own[c][field], rel=1e-9), (c, field)
    assert got["c"]["std_pop"] == 0.0 and got["c"]["std_samp"] == 0.0
    one = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    x = stats.numeric_summary(one, ["x"]).first()
    assert x["mean"] == float("inf") and np.isnan(x["std_pop"])
