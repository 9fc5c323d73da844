"""Finding, masking and scrubbing personal data."""

import hashlib
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogue import personal
from tablewise.functions.masking import redact_value, scrub_text, synthetic_value
from tablewise.functions.patterns import PATTERNS, header_hint, matches
from tablewise.operators import pii
from tablewise.plans import card

CASES = [
    ("pan", "My PAN is ABCPL1234C confirmed", True),
    ("pan", "Code ABCXL1234C", False),
    ("aadhaar", "2345 6789 0123", True),
    ("aadhaar", "1234 5678 9012", False),
    ("mobile", "Call me on +91 98765 43210", True),
    ("mobile", "9876543210", True),
    ("mobile", "1234567890", False),
    ("mobile", "19876543210", False),
    ("aadhaar", "+91 98765 43210", True),  # the overlap is real
    ("email", "contact: user@example.com", True),
    ("email", "no at sign", False),
    ("credit_card", "pay 4111 1111 1111 1111 now", True),
    ("pincode", "Pune 411001", True),
    ("pincode", "4110012", False),
    ("ifsc", "HDFC0001234", True),
    ("gstin", "27ABCDE1234F1Z5", True),
    ("mobile", "٩٨٧٦٥٤٣٢١٠", False),  # first digit must be ASCII 6-9
    ("aadhaar", "2٣٤٥ ٦٧٨٩ ٠١٢٣", True),  # the others may be any decimal digit
    ("email", "éuser@example.com", False),  # no word boundary inside a word
]


@pytest.mark.parametrize("category, text, want", CASES)
def test_matchers(spark, category, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(matches(F.col("s"), category)).first()[0]
    assert got is want
    assert bool(re.search(PATTERNS[category], text)) is want  # same answer as Python's engine


@pytest.mark.parametrize(
    "header, want",
    [
        ("Email ID", "email"), ("customer_email_id", "email"), ("pincode", "pincode"),
        ("c_acctbal", "credit_card"), ("company", "pan"), ("hotel", "mobile"),
        ("full-name", "name"), ("age", None), (" ", None), ("shipping_address", "address"),
        ("o_orderkey", None),
    ],
)
def test_header_hints(header, want):
    assert header_hint(header) == want


def test_detect(spark, empty_table):
    df = spark.createDataFrame(
        [(f"user{i}@example.com", i, f"98{i:08d}" if i < 5 else "-") for i in range(20)],
        "customer_email string, age bigint, note string",
    )
    found = pii.pii_plan(df)
    assert found["customer_email"] == ["email"] and "age" not in found
    assert found["note"] == ["mobile"]  # a quarter of the values
    assert pii.pii_plan(empty_table) == {}
    counts = {r["category"]: r["n_columns"] for r in pii.pii_summary(df).collect()}
    assert counts == {"(any)": 2, "email": 1, "mobile": 1}


def test_mostly_missing_columns_go_by_header_only(spark):
    df = spark.range(300).select(
        F.when(F.col("id") == 0, "9876543210").alias("a"),
        F.when(F.col("id") == 0, "9876543210").alias("phone"),
    )
    assert pii.pii_plan(df) == {"phone": ["mobile"]}


def test_numbers_are_scanned_as_plain_text(spark):
    df = spark.createDataFrame([(9876543210.0,), (9876501234.0,)], "x double")
    assert "mobile" in pii.pii_plan(df)["x"]


@pytest.mark.parametrize(
    "category, value, want",
    [
        ("pan", "ABCDE1234F", "ABCDE****F"), ("pan", "ABC", "***"),
        ("email", "user@domain.com", "u***@domain.com"), ("email", "u@d.com", "***@d.com"),
        ("email", "nobody", "***"), ("email", "a@b@c", "***@b@c"), ("email", "@c", "***@c"),
        ("mobile", "9876543210", "98******10"), ("mobile", "+91 98765-43210", "98******10"),
        ("mobile", "12", "**"), ("aadhaar", "2345 6789 0123", "XXXX-XXXX-0123"),
        ("aadhaar", "23", "**"), ("credit_card", "4111-1111-1111-1234", "************1234"),
        ("credit_card", "41", "**"), ("gstin", "27ABCDE1234F1Z5", "27*****1234***"),
        ("gstin", "27", "**"), ("ifsc", "HDFC0001234", "HDFC0******"), ("ifsc", "H", "*"),
        ("pincode", "411 001", "41****"), ("pincode", "41", "**"), ("name", "Asha  Rao", "A*** R***"),
        ("name", "   ", "***"), ("address", "12 Lake Road", "12 *********"), ("address", "12 L", "****"),
        ("uid", "secret", "s****t"), ("uid", "ab", "**"), ("uid", "", ""),
    ],
)
def test_redaction(spark, category, value, want):
    got = spark.createDataFrame([(value,)], "s string").select(redact_value(F.col("s"), category))
    assert got.first()[0] == want


def test_hash(spark):
    df = spark.createDataFrame([("ä",), (None,)], "s string")
    got = [r["s"] for r in pii.mask_pii(df, {"s": ["email"]}, "hash", salt="pepper").collect()]
    assert got == [hashlib.sha256("pepper:ä".encode()).hexdigest()[:10], None]


@pytest.mark.parametrize("category", list(PATTERNS))
def test_fakes_match_their_matcher_and_repeat(spark, category):
    df = spark.range(400).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("s"))
    one = synthetic_value(F.col("s"), category, 42)
    two = synthetic_value(F.col("s"), category, 43)
    r = df.agg(
        F.count_if(matches(one, category)), F.countDistinct(one), F.count_if(one == two),
        F.count_if(one.isNull()),
    ).first()
    assert r[0] == 400 and r[1] > 380 and r[2] < 5 and r[3] == 0


def test_fakes_keep_gaps(spark):
    df = spark.createDataFrame([(None, 1), ("x", 2)], "name string, n int")
    out = pii.mask_pii(df, {"name": ["name"], "n": []}).orderBy("n").collect()
    assert out[0]["name"] is None and " " in out[1]["name"] and out[1]["n"] == 2


def test_mask_arguments(single_row):
    with pytest.raises(ValueError):
        pii.mask_pii(single_row, {}, "rot13")
    with pytest.raises(KeyError):
        pii.mask_pii(single_row, {"nope": ["email"]})


TEXTS = [
    "mail a.b@x.org or call +91 98765 43210, PAN ABCPL1234C",
    "card 4111 1111 1111 1111 and 2345 6789 0123 at 411001",
    "ifsc HDFC0001234; gst 27ABCDE1234F1Z5; écrivez à jean@exemple.fr",
    "9876543210 9876543211,9876543212", "nothing here", "", "411001 411002 x411003",
]
ORDER = ["mobile", "aadhaar", "pan", "email", "credit_card", "pincode", "ifsc", "gstin"]
MARKS = {
    "mobile": "<PHONE>", "aadhaar": "<AADHAAR>", "pan": "<PAN>", "email": "<EMAIL>",
    "credit_card": "<CARD>", "pincode": "<PINCODE>", "ifsc": "<IFSC>", "gstin": "<GSTIN>",
}


@pytest.mark.parametrize("listed", [[], ["credit_card"], ["email", "aadhaar"]])
def test_scrub_matches_pythons_engine(spark, listed):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, s string")
    got = [r[0] for r in df.orderBy("id").select(scrub_text(F.col("s"), listed)).collect()]
    for text, out in zip(TEXTS, got):
        for category in listed + ORDER:
            text = re.sub(PATTERNS[category], MARKS[category], text)
        assert out == text


def test_scrub_whole_cells(spark):
    df = spark.createDataFrame([("Asha",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(scrub_text(F.col("s"), ["email", "name"])).collect()] == [
        "<NAME>", "", None,
    ]


def test_card_is_scrubbed_and_tells_the_reasons(spark, dirty_table, empty_table):
    df = spark.createDataFrame(
        [(f"person{i}@x.com", i * 10, i * 3.5) for i in range(9)], "email string, score int, x double"
    )
    text = card.dataset_card(df, "people", order_by=["score"])
    assert "person" not in text and "<EMAIL>" in text and "### Strongest correlations" in text
    assert "(3 columns, 9 rows)" in text
    assert "constant column" in card.dataset_card(dirty_table)
    assert card.dataset_card(empty_table) == "(empty table)"
    short = card.scrubbed_card(df, 3)
    assert "person" not in short and short.count("<EMAIL>") == 3
    assert "<EMAIL>" not in card.scrubbed_card(df, 3, max_chars=100)


def test_card_shrinks_to_its_budget(spark):
    wide = spark.range(30).select(
        *[F.when(F.col("id") > i, F.col("id") * i).alias(f"column_{i:02d}") for i in range(26)]
    )
    full = card.dataset_card(wide, max_tokens=100_000)
    assert "column_00 |" in full and "### Numbers" in full
    mid = card.dataset_card(wide, max_tokens=card.estimate_tokens(full) - 10)
    assert "*(6 more columns left out)*" in mid and "### Numbers" in mid
    small = card.dataset_card(wide, max_tokens=50)
    assert "left out to stay within the budget" in small and "### Quality" in small


def test_scrub_has_word_edges_as_its_sql_and_pythons_engine(spark):
    """Superscripts belong to a word, combining marks do not."""
    texts = [
        "ABCPL1234C²", "²user@example.com", "½HDFC0001234", "éABCPL1234C", "हिuser@example.com",
        "27ABCDE1234F1Z5̈", "_ABCPL1234C", "éuser@example.com ABCPL1234C",
    ]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(len(texts)), "text": texts}))
    sql = dict(con.execute(personal.ENTRIES["i08_scrub_documents"].sql).fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    for i, out in df.select("id", scrub_text(F.col("s"))).collect():
        text = texts[i]
        for category in ORDER:
            text = re.sub(PATTERNS[category], MARKS[category], text)
        assert out == text == sql[i]


def test_scrub_takes_all_of_an_address_beside_another(spark):
    """The SQL twin leaves the start of the second address, and takes a mark before one in."""
    texts = {
        "x ab.12@mail1.example.com cd.34@mail2.example.com": "x <EMAIL> <EMAIL>",
        "see -cd.34@mail2.example.com": "see -<EMAIL>",
        "über.23@mail3.example.com": "über<EMAIL>",
    }
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for text, out in df.select("s", scrub_text(F.col("s"))).collect():
        assert out == texts[text] == re.sub(PATTERNS["email"], "<EMAIL>", text)
