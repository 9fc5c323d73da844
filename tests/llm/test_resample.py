import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import queries, resample
from tests.llm.conftest import awkward_rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = WORDS.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [crc32(r.encode()) % 10_000 for r in runs]


def brute_force(rows, aims, longest=1, percent=10, least=20):
    """(id, n_features, weight, score, rank) of rows (id, text) with distinct ids."""
    own = [features(t, longest) for _, t in rows]
    s = Counter(b for _, f in own for b in f)
    t = Counter(b for a in aims for b in features(a, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(
            1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))
        )

    out = []
    for (doc, _), (n, f) in zip(rows, own):
        name = f"2024:{'' if doc is None else doc}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, n, len(f), weight, weight + noise])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0]))
    place = {r[0]: i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((d, n, w, x, place.get(d)) for d, _, n, w, x in out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect())


def test_query(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    aims = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    got = queries.op13_resample(spark, sf_dir)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert sorted(map(tuple, got.collect())) == brute_force(rows, aims)
    assert sum(r["rank"] is not None for r in got.collect()) > 10


@pytest.mark.parametrize("longest", [2, 3])
def test_runs_of_words(documents, spark, sf_dir, longest, monkeypatch):
    some = documents.where("doc_id < 60").select("doc_id", "text")
    rows = [tuple(r) for r in some.collect()]
    aims = spark.createDataFrame([("An item the river met",), (None,)], "text string")
    got = resample.importance_resample(some, aims, percent=37, longest=longest)
    assert as_rows(got) == brute_force(rows, ["An item the river met"], longest, 37)


def test_slices_of_long_texts(monkeypatch):
    raw = "Der Fluß, the RIVER-bank 42 日本 x".encode() * 50
    words = resample.words_of(raw)
    whole = sorted(words + [b" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)])
    monkeypatch.setattr(resample, "SLICE", 16)
    parts = list(resample._runs(raw, 3))
    assert len(parts) > 20
    assert sum(n for n, _ in parts) == len(words)
    assert sorted(f for _, fs in parts for f in fs) == whole


@pytest.mark.parametrize(
    "make",
    [
        lambda i: i,
        lambda i: F.hash(i) % 1000,
        lambda i: F.when(i % 3 == 0, 7).otherwise(F.hash(i)),
        lambda i: F.lit(5),
        lambda i: -i * i,
    ],
)
def test_cutoff(spark, monkeypatch, make):
    monkeypatch.setattr(resample, "BLOCK", 500)
    scores = spark.range(0, 20_000, 1, 7).select(make(F.col("id")).cast("long").alias("x"))
    high = np.sort([r[0] for r in scores.collect()])[::-1]
    for take in (1, 777, 20_000):
        assert resample.cutoff(scores, take, few=50) == high[take - 1]


def test_awkward(spark, clashing, no_docs):
    aims = spark.createDataFrame([(None,), ("",), ("word1 tail2",)], "text string")
    got = resample.importance_resample(clashing, aims, percent=60).collect()
    rows = awkward_rows()
    assert sorted((repr(r["id"]), r["n_words"]) for r in got) == sorted(
        (repr(r[0]), features(r[1], 1)[0]) for r in rows
    )
    able = [r for r in got if r["n_words"] >= 20]
    drawn = sorted((r for r in able if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 60 * len(able) // 100 + 1))
    left = max(r["score"] for r in able if not r["rank"])
    assert all(a["score"] >= b["score"] for a, b in zip(drawn, drawn[1:])) and drawn[-1]["score"] >= left
    assert all(r["weight"] == 0 for r in got if r["n_features"] == 0)
    assert resample.importance_resample(no_docs, aims).collect() == []


def test_repeated_rows(spark):
    """A third of the rows under one id with one text: each gets a rank of its own."""
    df = spark.range(0, 900, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"),
        F.lit("a b c " * 10).alias("text"),
    )
    got = resample.importance_resample(df, df, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 451))
    order = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert order == sorted(order, key=lambda r: (-r["score"], r["id"]))
