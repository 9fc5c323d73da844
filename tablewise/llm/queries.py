"""One query per operator over its whole table; each takes (spark, sf_dir).

No query here has an SQL twin unless ``SQL`` lists one: XXH64, CRC-32, byte-pair merges,
learned models and iterated solutions are outside SQL.  Those are tested against brute
force in ``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm import (
    alignment,
    bpe,
    exact,
    lattice,
    minhash,
    mixing,
    neighbours,
    resample,
    sharding,
    simhash,
    token_counts,
    toolcalls,
    toxicity,
)
from tablewise.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
BYTE_TOKENS = "byte_bpe_50k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
    )
    return coded.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return lattice.score_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)
    ).withColumnRenamed("id", "doc_id")


def op3_minhash_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, the fingerprints of each document and its edited text, and likeness."""
    return minhash.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id, and the class's copies and links."""
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        simhash.hex_print(F.col("print")).alias("fingerprint"),
        "component_id",
        "copies",
        "links",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ).withColumnRenamed("id", "doc_id")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results made from all conversations: linked, ordered, validated, as JSON."""
    conversations = table(spark, sf_dir, "conversations")
    return toolcalls.link_calls(
        toolcalls.derived_messages(conversations), toolcalls.tool_table(conversations)
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed(
        "id", "doc_id"
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)
    ).withColumnRenamed("id", "doc_id")


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    return sharding.assign_shards(table(spark, sf_dir, "documents")).withColumnRenamed(
        "id", "doc_id"
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    return alignment.alignment_report(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(BYTE_TOKENS),
        public_tokenizers.path(PIECES),
        public_tokenizers.PATTERN,
    ).withColumnRenamed("id", "doc_id")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest vectors found of every twentieth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the benchmark."""
    return resample.importance_resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_lattice_lm,
        op3_minhash_prints,
        op4_simhash_trie,
        op5_toxicity,
        op6_tool_calls,
        op7_exact_dedup,
        op8_token_counts,
        op9_entropy_mix,
        op10_jump_shards,
        op11_alignment,
        op12_neighbours,
        op13_resample,
    )
}
SQL: dict[str, str] = {"op6_tool_calls": toolcalls.ORACLE, "op13_resample": resample.ORACLE}
