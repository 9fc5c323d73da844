import os
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from session import make_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return make_session("tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def clean_table(spark):
    """50 faultless rows."""
    r = np.random.default_rng(5)
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "id": np.arange(50),
                "age": r.integers(18, 70, 50),
                "income": r.normal(50_000, 15_000, 50).round(2),
                "city": r.choice(["Pune", "Agra", "Kochi"], 50),
            }
        )
    )


@pytest.fixture(scope="session")
def dirty_table(spark):
    """205 rows: gaps, outliers, a constant, mixed texts and five copies."""
    r = np.random.default_rng(6)
    n = 200
    age = r.integers(18, 70, n).astype(float)
    age[r.choice(n, 20, replace=False)] = np.nan
    income = r.normal(50_000, 15_000, n).round(2)
    income[r.choice(n, 3, replace=False)] = 9_999_999
    rows = [
        (
            i, float(age[i]), float(income[i]),
            None if i % 11 == 3 else ["Pune", "Agra"][i % 2],
            "fixed", str(i) if i % 7 == 0 else f"x{i}",
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows + rows[:5],
        "id bigint, age double, income double, city string, constant_col string, mixed string",
    )


@pytest.fixture(scope="session")
def empty_table(spark):
    return spark.createDataFrame([], "a bigint, b string")


@pytest.fixture(scope="session")
def single_row(spark):
    return spark.createDataFrame([(1, "x")], "a bigint, b string")


@pytest.fixture(scope="session")
def gaps_only(spark):
    return spark.createDataFrame([(None, 1)] * 50, "a string, b bigint")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
