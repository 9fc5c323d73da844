"""Document fingerprints by one-permutation MinHash with optimal densification.

Every five-word shingle is hashed once; the leading bits of the hash choose a bin and the
smallest hash of a bin represents it.  An empty bin borrows from the first filled one in
its own fixed random order of bins, so that two texts that miss the same bin ask the same
ones.  Of each bin four low-order bits are stored; chance agreement of so few bits is
taken out of the likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import quoted, small_batches, text_of, written

SHINGLE = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
LOW_BITS = 4
#: Odd multipliers of the words of a shingle; any would do, but all texts need the same.
_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(SHINGLE)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over their whole range."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(1)
def _orders() -> np.ndarray:
    """For each bin the order in which it asks the others: a permutation by hash."""
    pairs = np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1)
    return np.argsort(_mixed(pairs).reshape(BINS, BINS), axis=1, kind="stable")


def sketch(text: bytes) -> np.ndarray | None:
    """The low-order bits of each bin; None for a text without words."""
    words = text.lower().split()
    if not words:
        return None
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        shingles = (hashes * _PLACES[: len(words)]).sum(dtype=np.uint64, keepdims=True)
    else:
        n = len(words) - SHINGLE + 1
        shingles = hashes[:n] * _PLACES[0]
        for k in range(1, SHINGLE):
            shingles += hashes[k : k + n] * _PLACES[k]
    shingles = np.sort(_mixed(shingles))
    bins = (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    low = np.zeros(BINS, np.uint8)
    low[bins[first]] = shingles[first] & np.uint64((1 << LOW_BITS) - 1)
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    orders = _orders()
    for asked in range(8):
        if not len(empty):
            return low
        lender = orders[empty, asked]
        found = filled[lender]
        low[empty[found]] = low[lender[found]]
        empty = empty[~found]
    lender = orders[empty, filled[orders[empty]].argmax(axis=1)]
    low[empty] = low[lender]
    return low


def packed(bits: np.ndarray | None) -> str:
    """Two bins in a byte, as hexadecimal digits; "" for a text without words."""
    return "" if bits is None else ((bits[::2] << 4) | bits[1::2]).tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    pairs = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.column_stack([pairs >> 4, pairs & 15]).ravel()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated resemblance, 0 to 1: the share of equal bins less what chance gives."""
    if a is None or b is None:
        return float(a is b)
    chance = 1 / (1 << LOW_BITS)
    return float(max(0.0, ((a == b).mean() - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(text: str, own, following: str, next_one) -> tuple:
    changed = edited(text, following).encode()
    bits = sketch(changed)
    return (
        len(text),
        hashlib.sha256(changed).hexdigest(),
        packed(own),
        packed(bits),
        likeness(own, bits),
        likeness(own, next_one),
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row with the one after it; the ends of the partition keep their text."""
    part = TaskContext.get().partitionId()
    held = None
    schema = None
    unpack = zstandard.ZstdDecompressor().decompress

    def batch_of(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
        )

    for batch in batches:
        if schema is None:
            schema = pa.schema(
                [
                    ("edge", pa.string()), ("part", pa.int32()), ("id", batch.schema.field("id").type),
                    ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
                ]
            )
        rows = []
        ids = batch.column("id").to_pylist()
        for row_id, raw in zip(ids, batch.column("text")):
            raw = unpack(raw.as_py())
            text, bits = raw.decode("utf-8", "replace"), sketch(raw)
            if held is None:
                rows.append(("first", part, row_id, *[None] * 1, None, packed(bits), None, None, None, text))
            else:
                rows.append((None, part, held[0], *_compared(held[1], held[2], text, bits), None))
            held = (row_id, text, bits)
            if len(rows) >= 500:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)
    if held is not None:
        yield batch_of([("last", part, held[0], None, None, packed(held[2]), None, None, None, held[1])])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next row is the one after in descending order of ids (nulls last; rows of equal id
    in the order of their texts' hashes), and the first one after the last.  A single row
    is its own next.  Null text counts as empty: its fingerprint is "", equal to that of
    any text without words and unlike all others.  Repeated rows stay repeated; an empty
    table gives an empty table.

    The rows are range-partitioned once, their texts compressed, and each partition is
    read in order.  What crosses partitions is one text per partition.
    """
    text = text_of(text_col)
    order = [F.col("id").desc_nulls_last(), F.col("hash"), F.col("text")]

    @F.arrow_udf("binary")
    def compressed(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.array([pack(t.as_py()) for t in texts], pa.binary())

    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(quoted(id_col)).alias("id"),
        compressed(text.cast("binary")).alias("text"),
        F.xxhash64(text).alias("hash"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    compared = written(
        rows.repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .select("id", "text")
        .mapInArrow(
            _neighbours, f"edge string, part int, id {id_type}, {_RESULT}, text string"
        ),
        "neighbours",
    )
    inner = compared.where("edge IS NULL").drop("edge", "part", "text")
    firsts = compared.where("edge = 'first'").select(
        F.col("part").alias("next_part"),
        F.col("text").alias("next_text"),
        F.col("fingerprint").alias("next_print"),
    )
    # One row per partition: which part follows, and the first part after the last.
    whole = Window.orderBy("part")
    parts = compared.where("edge = 'last'").select("part")
    follows = parts.withColumn("next_part", F.lead("part").over(whole)).withColumn(
        "next_part", F.coalesce("next_part", F.first("part").over(whole))
    )
    lasts = (
        compared.where("edge = 'last'")
        .select("part", "id", "text")
        .join(follows, "part")
        .join(firsts, "next_part")
        .select("id", "text", "next_text", "next_print")
    )

    text_type, likeness_type = pa.string(), pa.float64()
    kinds = {
        "n_chars": pa.int64(), "edited_sha256": text_type, "fingerprint": text_type,
        "edited_fingerprint": text_type, "near_edited": likeness_type, "near_next": likeness_type,
    }

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "next_text", "next_print"))
            found = [
                _compared(text, sketch(text.encode()), after, unpacked(after_print))
                for text, after, after_print in zip(*columns)
            ]
            columns = [
                pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *kinds])

    return inner.unionByName(lasts.mapInArrow(settle, f"id {id_type}, {_RESULT}"))
