import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated and near rows."""
    passage = " ".join(f"word{i % 37} tail{i % 11} x{i}" for i in range(120))
    return [
        (1, passage, "en", "a", 1),
        (2, passage, "en", "b", 1),
        (3, passage + "\n", "en", "a", 1),
        (4, passage + " ", "en", None, 1),
        (5, "", "en", "a", 0),
        (6, None, None, None, None),
        (7, " \t\n", "de", "b", 3),
        (8, "one", "de", "b", 3),
        (9, "One two", "de", "c", 3),
        (9, "One two", "de", "c", 3),
        (9, "another text under the same id", "de", "c", 3),
        (None, "a row without an id", "fr", "c", 3),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (10, "é" * 30_000, "fr", "a", 30_000),
        (11, "long " * 20_000, "fr", "a", 100_000),
        (12, passage.replace("x77", "y77"), "en", "z", 1),
        (13, "日本語 のテキスト   \x1f mixed lines", "ja", "z", 1),
        (14, "tie", "en", "z", 3),
        (15, "tie", "en", "z", 3),
        (-16, "t i e", "en", "z", 5),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with columns that are named like those the operators make."""
    extra = [
        "id", "ids", "size", "key", "kept", "row", "hash", "print", "part", "shard", "score",
        "n_tokens", "decoded", "_key_a", "_stay", "_hash", "_SCORE", "copies", "target", "u`v",
    ]
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit("own") for c in extra}).withColumn(
        "m", F.create_map(F.lit("k"), "source")
    )


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
