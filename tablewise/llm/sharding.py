"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import quoted, text_of, written

#: Fixed value: multiplier of the published jump hash's linear congruential step.
JUMP_STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; expected log(shards) rounds over the whole array."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        with np.errstate(over="ignore"):
            state[going] = state[going] * np.uint64(JUMP_STEP) + np.uint64(1)
        step = (1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1)
        landed = np.floor((shard[going] + 1) * step)
        inside = landed < shards
        going = going[inside]
        shard[going] = landed[inside].astype(np.int64)
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a key, by the hash of its text form (nulls share one shard)."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def place(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy().view(np.uint64), shards))

    return place(F.xxhash64(key.cast("string")))


def assign_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``shard`` depends on the id and the number of shards alone; ``grown_shard`` is where
    the row goes when one shard is appended: to that one, or nowhere.  ``slot`` counts a
    shard's rows from 0 without gaps.  Null text is empty (size 8, checksum 0); null ids
    share a shard; repeated rows get a slot each; an empty table gives an empty table.

    Slots are counted in pieces, one for each shard and input partition, so that a shard
    holding any share of the rows is never sorted in one task.
    """
    text = text_of(text_col)
    key = F.col(quoted(id_col))
    rows = written(
        docs.select(
            key.alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            shard_of(key, shards).alias("shard"),
            shard_of(key, shards + 1).alias("grown_shard"),
            F.spark_partition_id().alias("piece"),
        ),
        "placed",
    )
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        rows.groupBy("shard", "piece")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy("shard", "piece").orderBy("id", "text_crc32", "size")
    return rows.join(starts, ["shard", "piece"]).select(
        "id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        "grown_shard",
    )
