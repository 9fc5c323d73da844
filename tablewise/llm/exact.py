"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after white space is deleted.  The first scan
keeps a length and the hash of a short prefix per row.  Lengths that occur once are
settled; among the others, prefixes that occur once are.  What survives is put into a
bitmap of fixed size, which the second scan reads beside the texts: only rows it lets
through are hashed whole and grouped.  A row that a full bitmap lets through for nothing
costs one more hash, never a wrong group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import SPACE, keep_rows, quoted, row_key, text_of, written

#: Characters of the normalised text that the prefix hash covers.
PREFIX = 64
#: Bits of the survivors' bitmap (8 MB, whatever the input): 32768 bits in each row.
BITMAP_BITS = 1 << 26
_ROW_BITS = 32768


def _position(length: Column, head: Column) -> Column:
    return F.pmod(F.xxhash64(length, head), F.lit(BITMAP_BITS))


def _bitmap(survivors: DataFrame) -> DataFrame:
    """(part, bits): at most BITMAP_BITS / 32768 rows of 4 KB."""
    at = _position(F.col("length"), F.col("head"))
    return (
        survivors.select(
            F.floor(at / _ROW_BITS).cast("int").alias("part"),
            F.pmod(at, F.lit(_ROW_BITS)).alias("bit"),
        )
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def _is_set(bits: Column, position: Column) -> Column:
    bit = F.pmod(position, F.lit(_ROW_BITS))
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8).cast("int") + 1)
    return F.coalesce(byte.cast("int").bitwiseAND(mask) != 0, F.lit(False))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_all: bool = False,
    with_key: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 [, key].

    Of equal texts the row with the most code points in its original text stays, then
    the one with the smallest id (null ids last), then any one of the rest.  Null text
    counts as empty; empty texts and texts of white space form one group.  Repeated rows
    are members like any other, and exactly one row of a group is kept.  An empty table
    gives an empty table.  ``text_sha256`` is null for texts that refinement settles
    before the full hash, unless ``digest_all``.  ``with_key`` adds the row's ``row_key``.
    """
    text = text_of(text_col)
    normal = F.regexp_replace(text, SPACE, "")
    base = docs.select(
        F.col(quoted(id_col)).alias("id"),
        F.length(text).cast("long").alias("n_chars"),
        normal.alias("normal"),
        *([row_key(docs).alias("key")] if with_key else []),
    ).withColumns(
        {
            "length": F.octet_length("normal").cast("long"),
            "head": F.xxhash64(F.substring("normal", 1, PREFIX)),
        }
    )
    signatures = written(base.select("length", "head"), "signatures")
    # Counted by length and prefix at once, so that a hot length is summed before it is dealt.
    heads = signatures.groupBy("length", "head").count()
    lengths = heads.groupBy("length").agg(F.sum("count").alias("n")).where("n > 1")
    heads = heads.join(lengths, "length", "left_semi").where("count > 1")
    bitmap = F.broadcast(written(_bitmap(heads), "bitmap"))
    at = _position(F.col("length"), F.col("head"))
    digest = F.sha2(F.col("normal"), 256)
    joined = base.join(bitmap, F.floor(at / _ROW_BITS).cast("int") == F.col("part"), "left")
    rows = joined.withColumn("candidate", _is_set(F.col("bits"), at))
    hashed = written(
        rows.select(
            "id",
            "n_chars",
            "candidate",
            (digest if digest_all else F.when(F.col("candidate"), digest)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
            *(["key"] if with_key else []),
        ),
        "hashed",
    )
    candidates = hashed.where("candidate")
    # Written, so that the join below has two plain sides and splits a hot group's rows.
    groups = candidates.groupBy("sha").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(
            F.struct(
                (-F.col("n_chars")).alias("chars"),
                F.isnull("id").alias("none"),
                F.col("id"),
                F.col("row"),
            )
        ).alias("best"),
    )
    key = ["key"] if with_key else []
    grouped = candidates.join(written(groups, "groups"), "sha").select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *key,
    )
    alone = hashed.where("NOT candidate").select(
        "id",
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *key,
    )
    return grouped.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per group of equal texts; see ``exact_groups``."""
    return keep_rows(docs, exact_groups(docs, id_col, text_col, with_key=True))
