"""Cleaning operators: expected behaviour and the traps around missing cells."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows_of
from tablewise import CleaningError, OPS, apply_op, preview
from tablewise.operators import clean


@pytest.fixture(scope="module")
def gappy(spark):
    return spark.createDataFrame(
        [(1, 1.0, "b"), (2, None, "a"), (3, math.nan, None), (4, 3.0, "b"), (5, 8.0, "a")],
        "id bigint, x double, s string",
    )


def column(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_registry_has_all_operators():
    assert set(OPS) == {
        "fill_missing", "drop_missing", "drop_duplicates", "cap_outliers_iqr",
        "remove_outliers_iqr", "strip_whitespace", "standardize_case", "rename_columns",
        "drop_columns", "parse_dates", "cast_dtype", "downcast_numeric", "clip_range",
        "normalize_minmax", "standardize_zscore", "filter_rows", "reset_index_op",
    }


def test_unknown_operator_and_column(clean_table):
    with pytest.raises(CleaningError):
        apply_op(clean_table, "nonexistent")
    with pytest.raises(KeyError):
        apply_op(clean_table, "drop_columns", columns=["nope"])


def test_median_leaves_no_gaps(dirty_table):
    out = clean.fill_missing(dirty_table, ["age"], "median").df
    assert out.where("age IS NULL OR isnan(age)").count() == 0


def test_mean_median_mode_constant(gappy):
    assert column(clean.fill_missing(gappy, ["x"], "mean").df, "x") == [1, 4, 4, 3, 8]
    assert column(clean.fill_missing(gappy, ["x"], "median").df, "x") == [1, 3, 3, 3, 8]
    assert column(clean.fill_missing(gappy, ["s"], "mode").df, "s") == ["b", "a", "a", "b", "a"]
    assert column(clean.fill_missing(gappy, None, "constant", 0).df, "x") == [1, 0, 0, 3, 8]
    result = clean.fill_missing(gappy, ["x"], "constant", "text")
    assert result.log.first()["warnings"]
    with pytest.raises(CleaningError):
        clean.fill_missing(gappy, ["x"], "constant")
    with pytest.raises(CleaningError):
        clean.fill_missing(gappy, ["x"], "guess")


def test_integer_column_with_gaps_widens_for_the_mean(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "id bigint, n int")
    assert column(clean.fill_missing(df, ["n"], "mean").df, "n") == [1.0, 1.5, 2.0]


def test_mode_of_nothing_warns(gaps_only):
    result = clean.fill_missing(gaps_only, ["a"], "mode")
    row = result.log.first()
    assert row["cells_changed"] == 0 and len(row["warnings"]) == 1


def test_log_counts_changes(gappy):
    row = clean.fill_missing(gappy, ["x", "s"], "median").log.first()
    assert row["op"] == "fill_missing"
    assert (row["rows_before"], row["rows_after"], row["cells_changed"]) == (5, 5, 2)
    assert row["affected_columns"] == ["x"]
    assert len(row["warnings"]) == 1  # s is no numeric column


def test_empty_table_is_left_alone(empty_table):
    for name, params in (
        ("fill_missing", {"strategy": "median"}),
        ("drop_duplicates", {}),
        ("normalize_minmax", {"columns": ["a"]}),
        ("remove_outliers_iqr", {"columns": ["a"]}),
        ("strip_whitespace", {}),
    ):
        result = apply_op(empty_table, name, **params)
        assert result.df.count() == 0
        log = result.log.first()
        assert log["rows_before"] == 0 and log["warnings"]


def test_drop_missing(gappy):
    assert column(clean.drop_missing(gappy).df, "id") == [1, 4, 5]
    assert column(clean.drop_missing(gappy, ["x", "s"], "all").df, "id") == [1, 2, 4, 5]
    assert column(clean.drop_missing(gappy, None, "any", thresh=2).df, "id") == [1, 2, 4, 5]
    once = clean.drop_missing(gappy).df
    assert rows_of(clean.drop_missing(once).df, "*") == rows_of(once, "*")


def test_drop_duplicates(dirty_table, spark):
    assert clean.drop_duplicates(dirty_table).df.count() == 200
    assert clean.drop_duplicates(dirty_table, keep="none").df.count() == 195
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 20), (None, 3, 30), (None, 4, 40), ("c", 5, 50)],
        "k string, o int, v int",
    )
    first = clean.drop_duplicates(df, ["k"], "first", order_by=["o"]).df
    last = clean.drop_duplicates(df, ["k"], "last", order_by=["o"]).df
    none = clean.drop_duplicates(df, ["k"], "none").df
    assert sorted(r["v"] for r in first.collect()) == [10, 30, 50]
    assert sorted(r["v"] for r in last.collect()) == [20, 40, 50]
    assert [r["v"] for r in none.collect()] == [50]
    assert first.columns == df.columns
    for parts in (1, 60):
        again = clean.drop_duplicates(df.repartition(parts), ["k"], "last", order_by=["o"]).df
        assert rows_of(again, "*") == rows_of(last, "*")


def test_cap_and_remove_outliers(dirty_table):
    capped = clean.cap_outliers_iqr(dirty_table, ["income", "city"])
    assert capped.df.agg(F.max("income")).first()[0] < 9_999_999
    assert len(capped.log.first()["warnings"]) == 1
    kept = clean.remove_outliers_iqr(dirty_table, ["income", "age"])
    pdf = dirty_table.toPandas()
    want = pdf
    for c in ("income", "age"):
        low, high = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        inside = pdf[c].between(low - 1.5 * (high - low), high + 1.5 * (high - low))
        want = want[(inside | pdf[c].isna()).loc[want.index]]
    assert sorted(r["id"] for r in kept.df.collect()) == sorted(want["id"])
    assert kept.df.agg(F.max("income")).first()[0] < 9_999_999
    log = kept.log.first()
    assert log["rows_after"] == kept.df.count() < log["rows_before"]


def test_clip_keeps_missing_cells_missing(gappy):
    got = column(clean.clip_range(gappy, ["x"], 2, 5).df, "x")
    assert got[0] == 2 and got[1] is None and math.isnan(got[2]) and got[3:] == [3, 5]
    with pytest.raises(CleaningError):
        clean.clip_range(gappy, ["x"])
    with pytest.raises(CleaningError):
        clean.clip_range(gappy, ["x"], 5, 2)


def test_clip_of_integers_keeps_the_type_for_whole_bounds(gappy):
    assert dict(clean.clip_range(gappy, ["id"], 2).df.dtypes)["id"] == "bigint"
    assert column(clean.clip_range(gappy, ["id"], 2.5).df, "id") == [2.5, 2.5, 3, 4, 5]


def test_scalings(gappy, gaps_only):
    assert column(clean.normalize_minmax(gappy, ["x"]).df, "x") == pytest.approx(
        [0, None, None, 2 / 7, 1]
    )
    z = [v for v in column(clean.standardize_zscore(gappy, ["x"]).df, "x") if v is not None]
    assert sum(z) == pytest.approx(0) and sum(v * v for v in z) / 3 == pytest.approx(1)
    flat = clean.normalize_minmax(gaps_only, ["b"])
    assert {r["b"] for r in flat.df.collect()} == {0.0}
    assert flat.log.first()["warnings"]


def test_constant_column_with_gaps_becomes_zero_everywhere(spark):
    df = spark.createDataFrame([(1, 4.0), (2, None), (3, 4.0)], "id bigint, x double")
    assert column(clean.normalize_minmax(df, ["x"]).df, "x") == [0, 0, 0]
    assert column(clean.standardize_zscore(df, ["x"]).df, "x") == [0, 0, 0]
    void = spark.createDataFrame([(1, None), (2, None)], "id bigint, x double")
    assert column(clean.normalize_minmax(void, ["x"]).df, "x") == [None, None]
    assert column(clean.standardize_zscore(void, ["x"]).df, "x") == [0, 0]


def test_strip_knows_all_white_space_and_repeats_safely(spark):
    df = spark.createDataFrame([(1, "   a b\t\n"), (2, None), (3, "\x1cz")], "id int, s string")
    once = clean.strip_whitespace(df).df
    assert column(once, "s") == ["a b", None, "z"]
    assert column(clean.strip_whitespace(once).df, "s") == ["a b", None, "z"]


@pytest.mark.parametrize("text", ["they're ab-cd 2nd élan", "O'NEILL mcDonald", "x1y2z", "", "ß straße"])
def test_case_matches_python(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, s string")
    for case, want in (("lower", text.lower()), ("upper", text.upper())):
        assert column(clean.standardize_case(df, ["s"], case).df, "s") == [want]
    if "ß" not in text:
        assert column(clean.standardize_case(df, ["s"], "title").df, "s") == [text.title()]
    with pytest.raises(CleaningError):
        clean.standardize_case(df, ["s"], "camel")


def test_rename_refuses_unsafe_names(gappy):
    assert clean.rename_columns(gappy, {"x": "new name"}).df.columns == ["id", "new name", "s"]
    for bad in ({"x": "a\nb"}, {"x": "a`b"}, {"x": "s"}, {"x": 3}):
        with pytest.raises(CleaningError):
            clean.rename_columns(gappy, bad)
    with pytest.raises(KeyError):
        clean.rename_columns(gappy, {"nope": "y"})


def test_odd_column_names_work(spark):
    df = spark.createDataFrame([(1, " a ", 2.0), (2, None, None)], "id int, `a.b c` string, `x``y` double")
    assert column(clean.strip_whitespace(df).df, "a.b c") == ["a", None]
    assert column(clean.fill_missing(df, ["x`y"], "median").df, "x`y") == [2.0, 2.0]
    assert clean.drop_missing(df, ["a.b c"]).df.count() == 1


DATES = [
    ("2024-03-05", "2024-03-05"), ("05/03/2024", None), ("2024-2-30", None), (None, None),
    ("2024-12-31", "2024-12-31"), ("junk", None),
]


def test_parse_dates(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DATES)], "id int, d string")
    result = clean.parse_dates(df, ["d"])
    assert dict(result.df.dtypes)["d"] == "timestamp_ntz"
    got = [str(v)[:10] if v else None for v in column(result.df, "d")]
    assert got == [w for _, w in DATES]
    assert result.log.first()["cells_changed"] == 5
    again = clean.parse_dates(result.df, ["d"])
    assert column(again.df, "d") == column(result.df, "d") and again.log.first()["warnings"]
    other = clean.parse_dates(df, ["d"], "%d/%m/%Y").df
    assert [v is not None for v in column(other, "d")] == [False, True, False, False, False, False]
    with pytest.raises(PySparkException):
        clean.parse_dates(df, ["d"], errors="raise").df.collect()
    with pytest.raises(CleaningError):
        clean.parse_dates(df, ["d"], "%Q")


@pytest.mark.parametrize(
    "text",
    ["5 Mar 2024", "05-March-2024", "March 5, 2024", "05-Mar-24", "05.03.2024", "2024/3/5",
     "2024-03-05T00:00:00", "2024-03-05 00:00"],
)
def test_date_layouts(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, d string")
    assert str(column(clean.parse_dates(df, ["d"]).df, "d")[0]) == "2024-03-05 00:00:00"


def test_casts(spark, gappy):
    df = spark.createDataFrame(
        [(1, 2.9, "7", "x"), (2, -2.9, " 8 ", "")], "id int, x double, n string, s string"
    )
    assert column(clean.cast_dtype(df, ["x"], "int").df, "x") == [2, -2]
    assert column(clean.cast_dtype(df, ["n"], "int").df, "n") == [7, 8]
    assert column(clean.cast_dtype(df, ["n"], "float").df, "n") == [7.0, 8.0]
    assert column(clean.cast_dtype(df, ["s"], "bool").df, "s") == [True, False]
    assert column(clean.cast_dtype(gappy, ["x"], "bool").df, "x") == [True] * 5
    for frame, columns, dtype in ((gappy, ["x"], "int"), (df, ["s"], "int"), (df, ["s"], "float")):
        with pytest.raises(PySparkException):
            clean.cast_dtype(frame, columns, dtype).df.collect()
    with pytest.raises(CleaningError):
        clean.cast_dtype(df, ["x"], "complex")


@pytest.mark.parametrize(
    "x", [1.0, 12345678.0, 1.5e7, 123456789012.25, 1e15, 1e16, 1.5e300, 0.001, 0.0001, 0.00012345, 1e-5, -2.5e-7, 1e22]
)
def test_number_text_matches_python(spark, x):
    df = spark.createDataFrame([(1, x)], "id int, x double")
    assert column(clean.cast_dtype(df, ["x"], "str").df, "x") == [repr(x)]


def test_downcast(spark):
    df = spark.createDataFrame(
        [(i, 2**40 + i, i / 4, i / 3 * 1e9, None if i else 1, "ab"[i % 2]) for i in range(40)],
        "small bigint, big bigint, exact double, rough double, gaps bigint, s string",
    )
    result = clean.downcast_numeric(df)
    types = dict(result.df.dtypes)
    assert types == {
        "small": "int", "big": "bigint", "exact": "float", "rough": "double", "gaps": "bigint",
        "s": "string",
    }
    assert result.log.first()["affected_columns"] == ["small", "exact", "s"]


@pytest.mark.parametrize(
    "op, value, ids",
    [
        ("==", 3.0, [4]), ("!=", 3.0, [1, 2, 3, 5]), (">", 1.0, [4, 5]), (">=", 3, [4, 5]),
        ("<", 3, [1]), ("<=", 3, [1, 4]), ("in", [1.0, 8.0], [1, 5]),
        ("notin", [1.0, 8.0], [2, 3, 4]), ("contains", "8.", [5]),
    ],
)
def test_filters(gappy, op, value, ids):
    assert column(clean.filter_rows(gappy, "x", op, value).df, "id") == ids


def test_filter_argument_errors(gappy):
    for op, value in (("~", 1), ("in", 1), ("contains", 3), (">", "a")):
        with pytest.raises(CleaningError):
            clean.filter_rows(gappy, "x", op, value)


def test_texts_and_numbers_never_match(gappy):
    assert column(clean.filter_rows(gappy, "s", "==", 5).df, "id") == []
    assert column(clean.filter_rows(gappy, "s", "!=", 5).df, "id") == [1, 2, 3, 4, 5]
    assert column(clean.filter_rows(gappy, "x", "in", ["a", None, 8]).df, "id") == [5]
    assert column(clean.filter_rows(gappy, "x", "notin", ["a"]).df, "id") == [1, 2, 3, 4, 5]
    with pytest.raises(CleaningError):
        clean.filter_rows(gappy, "s", "<", 5)


def test_constant_fill_widens_where_needed(spark):
    df = spark.createDataFrame([(1, None), (2, 7)], "id bigint, n int")
    for value, dtype in ((3, "int"), (2**40, "bigint"), (0.5, "double")):
        out = clean.fill_missing(df, ["n"], "constant", value).df
        assert column(out, "n") == [value, 7] and dict(out.dtypes)["n"] == dtype


def test_preview_shows_changes_and_leaves_the_table(gappy):
    before = rows_of(gappy.drop("x"), "*")
    shown = preview(gappy, "fill_missing", columns=["s"], strategy="constant", value="?")
    assert [tuple(r) for r in shown.collect()] == [("s", None, "?")]
    assert rows_of(gappy.drop("x"), "*") == before
    assert preview(gappy, "drop_missing").count() == 0


def test_reset_index_keeps_the_old_numbers(spark):
    df = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "row_no bigint, s string")
    kept = clean.reset_index(df, ["s"], drop=False).df.orderBy("s").collect()
    assert [(r["index"], r["row_no"]) for r in kept] == [(10, 0), (20, 1), (30, 2)]
    assert clean.reset_index(df, ["s"]).df.columns == ["s", "row_no"]
