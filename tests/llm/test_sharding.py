import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewise.llm import sharding
from tests.llm.conftest import awkward_rows


def published(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_one():
    keys = [0, 1, 42, 2**63, 2**64 - 1, *(xxhash.xxh64_intdigest(str(i)) for i in range(3000))]
    for shards in (1, 2, 7, 24, 1000):
        got = sharding.jump(np.array(keys, np.uint64), shards)
        assert got.tolist() == [published(k, shards) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(20_000)], np.uint64)
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    moved = before != after
    assert (after[moved] == 24).all() and 0.03 < moved.mean() < 0.05


def check(got, rows):
    assert len(got) == len(rows)
    slots, shard_of = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(r["id"], r["shard"]) == r["shard"]
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(
        (repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert sorted((repr(r["id"]), r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        if r["id"] is not None:
            key = xxhash.xxh64_intdigest(str(r["id"]).encode(), 42)
            assert (r["shard"], r["grown_shard"]) == (published(key, 24), published(key, 25))


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check(sharding.assign_shards(documents).collect(), rows)


def test_awkward(clashing, no_docs):
    check(sharding.assign_shards(clashing).collect(), [(r[0], r[1]) for r in awkward_rows()])
    assert sharding.assign_shards(no_docs).collect() == []


def test_hot_key(spark):
    df = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"),
        F.lit("same").alias("text"),
    )
    got = sharding.assign_shards(df).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(map(len, slots.values())) == 3000


def test_no_shards(documents):
    with pytest.raises(ValueError):
        sharding.assign_shards(documents, shards=0)
