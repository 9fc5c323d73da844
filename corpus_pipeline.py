"""The corpus pipeline: toxicity, exact and near duplicates, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``docs``, whatever they are; extra columns stay.  Null texts count as empty, repeated
rows are treated as rows of their own, and an empty table passes through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm import bpe, exact, mixing, simhash, toxicity
from tablewise.llm.common import fresh, table, text_of, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the lexicon is learned from the labels."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest, then the smallest id."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their SimHash the one with the smallest id."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as entropy balancing takes them, so that sources meet their targets."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (packed, 4 bytes each), their number, and whether
    decoding gives the text back.  New columns get other names where ``docs`` has theirs."""
    names = {n: n if n not in docs.columns else fresh(docs, n) for n in ("ids", "n_tokens", "exact")}
    decoded = fresh(docs, "decoded")
    coded = bpe.with_tokens(
        docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, names=(names["ids"], decoded)
    )
    return coded.withColumns(
        {
            names["n_tokens"]: F.floor(F.length(names["ids"]) / 4).cast("long"),
            names["exact"]: F.col(decoded) == text_of("text").cast("binary"),
        }
    ).drop(decoded)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned scores, XXH64 and byte-pair merges are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
