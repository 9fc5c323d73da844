import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewise.llm import mixing
from tests.llm.conftest import awkward_rows


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, share=1.5, most=2):
    """Targets by source: excess over a source's limit is shared out again until none is left."""
    weight = {
        s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))
    }
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in fixed]
        left = budget - sum(fixed.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in rest}
        fixed |= {s: most * sizes[s] for s in over}


def check(df, got, tolerance):
    size_of = defaultdict(int)
    rows = df.select("doc_id", "text", "source").collect()
    for r in rows:
        size_of[r["source"]] += words(r["text"])
    want = targets(size_of)
    assert sorted((repr(r["doc_id"]), words(r["text"])) for r in rows) == sorted(
        (repr(r["id"]), r["size"]) for r in got
    )
    by_target = defaultdict(lambda: [0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["copies"] * r["size"]
        by_target[r["source_size"], round(r["target"], 3)][0] += r["taken"]
    expected = defaultdict(float)
    for s, t in want.items():
        expected[size_of[s], round(t, 3)] += t
    assert by_target.keys() == expected.keys()
    for key, t in expected.items():
        assert abs(by_target[key][0] - t) <= tolerance(key[0], t)


def test_documents(documents):
    got = mixing.mix_report(documents).collect()
    # Ten documents in a source here: the error is at most half of the shortest one.
    check(documents, got, lambda size, target: 0.02 * size + 30)


def test_larger_sources(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") * 7919 % 97 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4))
        .alias("source"),
    )
    check(df, mixing.mix_report(df).collect(), lambda size, target: 3)


def test_entropy_balance(spark):
    """Below the limit, log rates are proportional to size: the dual's optimum."""
    df = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 20 + 1).cast("int")).alias("text"),
        F.when(F.col("id") < 500, "a").otherwise("b").alias("source"),
    )
    import math

    got = [r for r in mixing.mix_report(df).collect() if r["rate"] < 2 and r["size"]]
    by_source = defaultdict(set)
    for r in got:
        by_source[r["target"]].add(round(math.log(r["rate"]) / r["size"], 9))
    assert by_source and all(len(v) == 1 for v in by_source.values())


def test_reruns_agree(documents):
    first = sorted(map(tuple, mixing.mix_report(documents).collect()))
    again = sorted(map(tuple, mixing.mix_report(documents.repartition(7)).collect()))
    assert [r[:6] for r in first] == [r[:6] for r in again]


def test_large_classes(spark, monkeypatch):
    """Classes that are cut by leading hash bits take exactly their copies."""
    monkeypatch.setattr(mixing, "PIECE", 10)
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.lit("three short words").alias("text"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"),
    )
    check(df, mixing.mix_report(df).collect(), lambda size, target: 3)


def test_awkward(clashing, no_docs):
    # One document has nearly all words of its source: half of it is the best there is.
    check(clashing, mixing.mix_report(clashing).collect(), lambda size, target: 0.5 * size)
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    report = mixing.mix_report(clashing).collect()
    assert mixed.count() == sum(r["copies"] for r in report)
    assert mixing.mix_report(no_docs).collect() == []
    assert mixing.mix(no_docs).collect() == []


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_report(df).collect()] == [
        (0, 0.0, 0)
    ] * 2


def test_repeated_rows_meet_the_target(spark):
    """A source of one repeated row takes its target, not all or nothing."""
    df = spark.range(0, 2600, 1, 5).select(
        F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") < 2000, "one two three four").otherwise(F.repeat(F.lit("w "), (F.col("id") % 30).cast("int")))
        .alias("text"),
        F.when(F.col("id") < 2000, "a").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"),
        (F.col("id") % 5).alias("other"),
    )
    report = mixing.mix_report(df)
    got = report.collect()
    check(df, got, lambda size, target: 8)
    assert len({r["copies"] for r in got if r["id"] == 7}) == 2
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixed.where("doc_id = 7").count() == sum(r["copies"] for r in got if r["id"] == 7)
    again = mixing.mix_report(df.repartition(3)).collect()
    assert sorted((r["id"], r["copies"]) for r in again) == sorted((r["id"], r["copies"]) for r in got)


def test_tilts_that_do_not_settle(documents, monkeypatch):
    monkeypatch.setattr(mixing, "_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        mixing.mix_report(documents)
