"""Diagnostics and the health score."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import chart, compare, footprint, health, profile


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_health_of_the_fixtures(empty_table, clean_table, dirty_table, single_row, gaps_only):
    r = health.health_score(empty_table).first()
    assert (r["score"], r["zone"], r["reasons"]) == (0, "Critical", {"empty": "No data"})
    assert health.health_score(clean_table).first()["score"] >= 70
    r = health.health_score(dirty_table).first()
    assert r["score"] < 100 and set(r["deductions"]) == set(health.CAPS)
    assert set(r["affected_columns"]["missing"]) == {"age", "city"}
    assert r["affected_columns"]["constant"] == ["constant_col"]
    assert r["affected_columns"]["mixed_dtype"] == ["mixed"]
    assert "income" in r["affected_columns"]["outliers"]
    for df in (single_row, gaps_only):
        assert 0 <= health.health_score(df).first()["score"] <= 100


def test_health_without_columns(spark):
    assert health.health_score(spark.createDataFrame([], "")).first()["score"] == 0


def test_health_of_numbers_only_and_texts_only(spark):
    numbers = spark.range(50).withColumn("x", F.col("id") * 1.5)
    r = health.health_score(numbers).first()
    assert r["score"] == 100 and r["zone"] == "Excellent"
    texts = spark.createDataFrame([(f"v{i % 5}",) for i in range(50)], "s string")
    assert health.health_score(texts).first()["score"] <= 85  # copies cost their cap


def test_zone_limits(spark):
    assert [health.health_zone(s) for s in (0, 40, 41, 60, 61, 80, 81, 100)] == [
        "Critical", "Critical", "Needs Work", "Needs Work", "Good", "Good", "Excellent", "Excellent",
    ]
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            health.health_zone(bad)


def test_missing_summary_counts_nan_and_sorts(dirty_table):
    rows = profile.missing_summary(dirty_table).collect()
    pcts = [r["missing_pct"] for r in rows]
    assert pcts == sorted(pcts, reverse=True)
    got = by_column(profile.missing_summary(dirty_table))
    assert got["age"]["missing_count"] >= 20
    assert [r["place"] for r in profile.rank_columns_by_missing(dirty_table, 2).collect()] == [1, 2]


def test_duplicates(dirty_table):
    r = profile.duplicate_summary(dirty_table).first()
    assert (r["total"], r["pct"]) == (10, round(10 / 205 * 100, 4))
    assert profile.duplicate_sample(dirty_table).count() == 5


def test_outliers_skip_small_and_flat_columns(spark, dirty_table):
    got = by_column(profile.outlier_summary(dirty_table))
    assert got["income"]["iqr_outliers"] >= 3
    flat = spark.createDataFrame([(1.0, 5.0, float(i)) for i in range(3)], "a double, b double, c double")
    assert profile.outlier_summary(flat).count() == 0
    with pytest.raises(ValueError):
        profile.outlier_summary(flat, "mad")


@pytest.mark.parametrize(
    "counts, p",
    # Tail values at the 5 % critical points of 1, 2, 3 and 4 degrees of freedom.
    [([50, 50], 1.0), ([10, 10, 10, 10], 1.0), ([1000, 1], 0.0)],
)
def test_imbalance_p_values(spark, counts, p):
    rows = [(f"c{i}",) for i, n in enumerate(counts) for _ in range(n)]
    r = profile.imbalance_summary(spark.createDataFrame(rows, "s string")).first()
    assert r["chi2_p_value"] == pytest.approx(p, abs=1e-6)
    assert r["n_classes"] == len(counts)


def test_chi2_tail_at_critical_values(spark):
    df = spark.createDataFrame(
        [(3.841459, 1.0), (5.991465, 2.0), (7.814728, 3.0), (9.487729, 4.0), (11.070498, 5.0),
         (1e9, 49.0), (0.0, 7.0)], "x double, k double",
    )
    got = [r[0] for r in df.select(profile._chi2_tail("x", "k")).collect()]
    assert got[:5] == pytest.approx([0.05] * 5, abs=1e-6) and got[5:] == [0.0, 1.0]


def test_imbalance_flags(spark):
    rows = [("common",)] * 990 + [(f"r{i}",) for i in range(10)] + [(None,)] * 30
    r = profile.imbalance_summary(spark.createDataFrame(rows, "s string")).first()
    assert r["is_imbalanced"] and r["n_classes"] == 11
    many = spark.createDataFrame([(f"v{i}",) for i in range(60)], "s string")
    assert profile.imbalance_summary(many).count() == 0


def test_cardinality(dirty_table):
    got = by_column(profile.cardinality_summary(dirty_table))
    assert got["id"]["unique_count"] == 200 and got["id"]["is_high_cardinality"]
    assert got["city"]["unique_count"] == 2 and not got["city"]["is_high_cardinality"]
    close = by_column(profile.cardinality_summary(dirty_table, approx=True))
    assert abs(close["id"]["unique_count"] - 200) <= 12


def test_constant_and_mixed(dirty_table, gaps_only):
    assert list(by_column(profile.constant_columns(dirty_table))) == ["constant_col"]
    assert list(by_column(profile.constant_columns(gaps_only))) == ["b"]
    assert list(by_column(profile.mixed_type_columns(dirty_table))) == ["mixed"]


def test_mixed_variant(spark):
    df = spark.sql("SELECT parse_json(j) AS v FROM VALUES ('1'), ('\"a\"'), ('2.5') AS t(j)")
    r = profile.mixed_type_columns(df).first()
    assert (r["n_integer"], r["n_decimal"], r["n_text"]) == (1, 1, 1)


def test_date_consistency(spark):
    texts = [f"2024-01-{d:02d}" for d in range(1, 29)] + ["01/02/2024"] * 6 + ["soon"]
    df = spark.createDataFrame([(t, "word") for t in texts], "d string, w string")
    r = profile.date_consistency(df).collect()
    assert [(x["column"], x["samples"]) for x in r] == [("d", ["01/02/2024", "soon"])]
    steady = df.where("d LIKE '2024%'")
    assert profile.date_consistency(steady).count() == 0


def test_describe_single_value(spark):
    r = profile.describe_numeric(spark.createDataFrame([(4.0,)], "x double")).first()
    assert (r["count"], r["mean"], r["std"], r["q50"]) == (1, 4.0, None, 4.0)
    r = profile.distribution_summary(spark.createDataFrame([(4.0,)], "x double")).first()
    assert (r["std"], r["skew"], r["kurtosis"]) == (0.0, 0.0, 0.0)


def test_footprint_of_nested_and_text(spark):
    df = spark.sql("SELECT 1L AS a, 'é' AS s, array(1, 2) AS n FROM range(3)")
    got = {r["column"]: r["bytes"] for r in footprint.memory_footprint(df).collect()}
    assert got == {"a": 24, "s": 6, "n": 15}
    assert footprint.total_footprint(df).first()["bytes"] == 45


def test_narrowing_of_gaps_and_ranges(spark):
    df = spark.createDataFrame(
        [(None, 2**40, 1e300, "a")] * 4, "void bigint, wide bigint, huge double, s string"
    )
    got = {r["column"]: r["suggested_dtype"] for r in footprint.narrowing_suggestions(df).collect()}
    assert got == {"void": "int", "wide": None, "huge": None, "s": "category"}


def test_compare_says_what_improved(dirty_table, clean_table):
    got = {r["measure"]: r for r in compare.compare(dirty_table, clean_table).collect()}
    assert got["rows"]["diff"] == -155 and got["rows"]["improving"]
    assert got["health_score"]["improving"]


def test_expectations(clean_table, empty_table, spark):
    assert compare.validate(clean_table, 50, 4)
    with pytest.raises(compare.TableShapeError):
        compare.validate(clean_table, 51)
    with pytest.raises(compare.TableShapeError):
        compare.validate(clean_table, 1, 5)
    with pytest.raises(compare.EmptyTableError):
        compare.validate(empty_table)
    with pytest.raises(ValueError):
        compare.validate(clean_table, -1)


def test_histogram_of_a_constant_and_of_texts(spark):
    flat = spark.createDataFrame([(2.0,)] * 9, "x double")
    r = chart.histogram(flat, "x", 4).collect()
    assert sum(x["n"] for x in r) == 9
    assert sum(x["density"] * (x["upper"] - x["lower"]) for x in r) == pytest.approx(1)
    texts = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "s string")
    assert sum(x["n"] for x in chart.histogram(texts, "s", 2).collect()) == 2


def test_density_stays_within_its_error_and_work(spark):
    """Against all kernels at all points; far points have a row, too."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=4000), [60.0, 60.5, 61.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    rows = chart.density_curve(df, "x").orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min(), x.max(), 200)
    peak = 1 / (h * np.sqrt(2 * np.pi))
    want = np.exp(-(((at[:, None] - x) / h) ** 2) / 2).mean(axis=1) * peak
    assert [r["point"] for r in rows] == list(range(200))
    assert np.allclose([r["x"] for r in rows], at, rtol=1e-12)
    assert np.abs(np.array([r["density"] for r in rows]) - want).max() < 2e-14 * peak + 1e-13 * want.max()
    plan = chart.density_curve(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(first" in plan


def test_density_integrates_to_one_and_needs_five_values(spark):
    x = np.random.default_rng(0).normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    rows = chart.density_curve(df, "x").orderBy("point").collect()
    area = np.trapezoid([r["density"] for r in rows], [r["x"] for r in rows])
    assert 0.9 < area <= 1.0 and len(rows) == 200
    assert chart.density_curve(df.limit(4), "x").count() == 0
    assert chart.density_curve(spark.createDataFrame([(1.0,)] * 9, "x double"), "x").count() == 0


def test_sample_is_steady(spark):
    df = spark.range(5000).withColumn("x", F.col("id") * 2)
    one = {r["id"] for r in chart.steady_sample(df, 100).collect()}
    two = {r["id"] for r in chart.steady_sample(df.repartition(30), 100).collect()}
    other = {r["id"] for r in chart.steady_sample(df, 100, seed=1).collect()}
    assert one == two and len(one) == 100 and one != other
    assert chart.steady_sample(df, 9000).count() == 5000
    with pytest.raises(ValueError):
        chart.steady_sample(df, 0)


def test_top_categories_fold_the_rest(spark):
    df = spark.createDataFrame([(f"v{i % 14:02d}",) for i in range(140)], "s string")
    rows = {r["category"]: r["n"] for r in chart.top_categories(df, "s").collect()}
    assert rows["Other"] == 40 and len(rows) == 11


def test_preview_compares_few_values(spark, monkeypatch):
    """Values over the bound that a few rows give are not aggregated; the result is whole."""
    monkeypatch.setattr(profile, "_BOUNDING_ROWS", 400)
    df = spark.range(0, 20_000, 1, 4).select(
        F.format_string("v%06d", (F.col("id") * 7919) % 20_000).alias("many"),
        F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("few"),
        F.when(F.col("id") == 19_999, "late").alias("rare"),
        F.lit(None).cast("string").alias("none"),
    )
    seen = []
    plain = profile._smallest_per_column

    def counted(cells, n, some=None):
        kept = plain(cells, n, some)
        seen.append(kept._jdf.queryExecution().optimizedPlan().toString())
        return kept

    monkeypatch.setattr(profile, "_smallest_per_column", counted)
    got = {r["column"]: r["sample_values"] for r in profile.preview_schema(df, 4).collect()}
    assert got == {
        "many": "v000000, v000001, v000002, v000003", "few": "a, b", "rare": "late", "none": "",
    }
    assert "bound" in seen[0]
