import hashlib
import re
from collections import defaultdict

import pytest

from tablewise.llm import exact
from tests.llm.conftest import awkward_rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {
        t: (min(m)[3], len(m), hashlib.sha256(t.encode()).hexdigest()) for t, m in groups.items()
    }


def check(df, rows):
    want, got = expected(rows), df.collect()
    assert len(got) == len(rows)
    by_hash = defaultdict(list)
    for r in got:
        by_hash[r["text_sha256"]].append(r)
    assert len(by_hash) == len(want)
    for keep, size, digest in want.values():
        members = by_hash[digest]
        assert len(members) == size
        assert sum(r["kept"] for r in members) == 1
        assert all(r["keep_id"] == keep and r["group_size"] == size for r in members)
        assert [r["id"] for r in members if r["kept"]] == [keep]


def test_awkward(awkward):
    check(exact.exact_groups(awkward, digest_all=True), [(r[0], r[1]) for r in awkward_rows()])


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check(exact.exact_groups(documents, digest_all=True), rows)


def test_full_hash_only_for_survivors(documents):
    got = exact.exact_groups(documents).collect()
    assert any(r["text_sha256"] is None for r in got)
    assert all(r["text_sha256"] for r in got if r["group_size"] > 1)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 17])
def test_full_bitmap_changes_nothing(documents, bits, monkeypatch):
    monkeypatch.setattr(exact, "BITMAP_BITS", bits)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check(exact.exact_groups(documents, digest_all=True), rows)


def test_same_length_and_prefix(spark):
    head = "p" * 200
    rows = [(i, head + str(i % 3)) for i in range(9)]
    check(
        exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), digest_all=True),
        rows,
    )


def test_dedup_keeps_rows_and_columns(clashing):
    kept = exact.exact_dedup(clashing)
    assert kept.columns == clashing.columns
    texts = [normal(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({normal(r[1]) for r in awkward_rows()})


def test_empty(no_docs):
    assert exact.exact_groups(no_docs).collect() == []
    assert exact.exact_dedup(no_docs).collect() == []


def test_half_of_all_rows_in_one_group(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 4000, 1, 6).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("the same text"), F.repeat(F.lit(" "), (F.col("id") % 9).cast("int"))))
        .otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"),
    )
    got = exact.exact_groups(df).collect()
    hot = [r for r in got if r["id"] % 2 == 0]
    assert {(r["keep_id"], r["group_size"]) for r in hot} == {(8, 2000)}
    assert [r["id"] for r in hot if r["kept"]] == [8]
    assert all(r["keep_id"] == r["id"] and r["kept"] for r in got if r["id"] % 2)
