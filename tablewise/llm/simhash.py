"""Near duplicates by SimHash, linked by a self-join of binary tries.

Distinct fingerprints only are joined.  The join goes down a binary trie with pairs of
nodes, adds up the bits in which they differ and drops a pair as soon as that exceeds the
error budget.  To share the work out, three tries are grown, each over the fingerprint
rotated so that another third of its bits leads: two fingerprints that differ in at most
two bits agree on a whole third, so in one of the tries they part below a common node at
that depth.  Those nodes are the pieces of work.  A node over very many fingerprints is
cut once more, into pairs of sub-nodes within the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    fresh,
    keep_rows,
    quoted,
    row_key,
    small_batches,
    text_of,
    written,
)
from tablewise.llm.components import connected

BITS = 64
SHINGLE = 3
BUDGET = 2
#: Fixed value: the seed of the shingles' XXH64.
SEED = 42
#: Bit ranges of the three tries' leading thirds, as (first bit from the top, length).
THIRDS = ((0, 22), (22, 21), (43, 21))
#: A trie node over more fingerprints than this is cut by so many more bits.
HOT_NODE = 100_000
CUT_BITS = 10
_BLOCK = 1 << 19
_ONES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles: a bit is 1 if set in over half of their hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(words) - 2
        )
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 255):
        part = hashes[start : start + 255]
        for low in range(8):
            lanes = int(((part >> np.uint64(low)) & _ONES).sum(dtype=np.uint64))
            counts[low::8] += np.frombuffer(lanes.to_bytes(8, "little"), np.uint8)
    return sum(1 << int(b) for b in np.flatnonzero(counts * 2 > len(hashes)))


def simhash(text: Column) -> Column:
    """The fingerprint of a text column as a signed 64-bit number."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        found = np.fromiter(
            (fingerprint(t.as_buffer().to_pybytes()) for t in texts), np.uint64, len(texts)
        )
        return pa.array(found.view(np.int64))

    return prints(text.cast("binary"))


def _turned(prints: np.ndarray, first: int) -> np.ndarray:
    """Fingerprints with bit ``first`` (from the top) rotated to the front."""
    if first == 0:
        return prints
    return (prints << np.uint64(first)) | (prints >> np.uint64(BITS - first))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def join_tries(
    keys: np.ndarray, frontier: tuple[np.ndarray, ...], budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in the sorted ``keys`` that differ in 1 to ``budget`` bits.

    ``frontier``: arrays (depth, a, a_end, b, b_end, errors) of node pairs, a node being a
    range of keys that share their first ``depth`` bits.  Pairs go down one bit at a time;
    a pair of ranges with few key pairs is settled by comparing the keys.  The frontier
    is worked off in blocks, last in first out, so memory stays bounded.
    """
    stack = [frontier]
    while stack:
        depth, a, a_end, b, b_end, errors = stack.pop()
        if len(a) > _BLOCK:
            for part in range(0, len(a), _BLOCK):
                stack.append(
                    tuple(x[part : part + _BLOCK] for x in (depth, a, a_end, b, b_end, errors))
                )
            continue
        n, m = a_end - a, b_end - b
        few = (n * m <= 32) | (depth >= BITS)
        if few.any():
            size = (n * m)[few]
            pair = np.repeat(np.flatnonzero(few), size)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            left = a[pair] + nth // m[pair]
            right = b[pair] + nth % m[pair]
            near = (left < right) & (_popcount(keys[left] ^ keys[right]) <= budget)
            if near.any():
                yield left[near], right[near]
        more = ~few
        if not more.any():
            continue
        depth, a, a_end, b, b_end, errors = (
            x[more] for x in (depth, a, a_end, b, b_end, errors)
        )
        bit = np.uint64(1) << (np.uint64(BITS - 1) - depth.astype(np.uint64))
        a_mid = np.searchsorted(keys, (keys[a] & ~(bit | (bit - np.uint64(1)))) | bit)
        b_mid = np.searchsorted(keys, (keys[b] & ~(bit | (bit - np.uint64(1)))) | bit)
        a_mid, b_mid = np.clip(a_mid, a, a_end), np.clip(b_mid, b, b_end)
        below, one_more = depth + 1, errors + 1
        apart = a != b
        children = []
        for keep, pair in (
            (np.ones(len(a), bool), (below, a, a_mid, b, b_mid, errors)),
            (np.ones(len(a), bool), (below, a_mid, a_end, b_mid, b_end, errors)),
            (one_more <= budget, (below, a, a_mid, b_mid, b_end, one_more)),
            ((one_more <= budget) & apart, (below, a_mid, a_end, b, b_mid, one_more)),
        ):
            _, x, x_end, y, y_end, _ = pair
            keep = keep & (x < x_end) & (y < y_end)
            if keep.any():
                children.append(tuple(v[keep] for v in pair))
        if children:
            stack.append(tuple(np.concatenate(v) for v in zip(*children)))


def _links_of_trie(trie: int, prints, side, other) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of one trie's pieces in this task."""
    first, length = THIRDS[trie]
    turned = _turned(prints, first)
    piece = np.lexsort((turned, other, side))
    side, other, turned = side[piece], other[piece], turned[piece]
    lead = turned >> np.uint64(BITS - length)
    new = np.ones(len(turned), bool)
    new[1:] = (side[1:] != side[:-1]) | (other[1:] != other[:-1])
    # Pieces that were cut are small and joined one by one; the others all at once.
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(turned))
    for lo, hi in zip(starts, ends):
        keys, cut = turned[lo:hi], side[lo] >= 0
        depth = length + (CUT_BITS if cut else 0)
        top = keys >> np.uint64(BITS - depth)
        edge = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
        node_end = np.append(edge[1:], len(keys))
        if cut:
            p, q = int(side[lo]), int(other[lo])
            sub = (top & np.uint64((1 << CUT_BITS) - 1)).astype(np.int64)[edge]
            group = (top >> np.uint64(CUT_BITS))[edge]
            a, b = np.flatnonzero(sub == p), np.flatnonzero(sub == q)
            common, ia, ib = np.intersect1d(group[a], group[b], return_indices=True)
            a, b = a[ia], b[ib]
            errors = np.full(len(a), bin(p ^ q).count("1"))
        else:
            a = b = np.flatnonzero(node_end - edge > 1)
            errors = np.zeros(len(a), np.int64)
        if not len(a):
            continue
        frontier = (
            np.full(len(a), depth), edge[a], node_end[a], edge[b], node_end[b], errors
        )
        for left, right in join_tries(keys, frontier, BUDGET):
            u, v = keys[left], keys[right]
            back = (BITS - first) % BITS
            u, v = _turned(u, back), _turned(v, back)
            seen = np.zeros(len(u), bool)  # an earlier trie has this link too
            for other_first, other_length in THIRDS[:trie]:
                ours = np.uint64(((1 << other_length) - 1) << (BITS - other_first - other_length))
                seen |= ((u ^ v) & ours) == 0
            u, v = u[~seen].view(np.int64), v[~seen].view(np.int64)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [
        [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for b in batches if b.num_rows
    ]
    if not held:
        return
    trie, prints, side, other = (np.concatenate(x) for x in zip(*held))
    for t in range(len(THIRDS)):
        own = trie == t
        if own.any():
            yield from _links_of_trie(t, prints[own].view(np.uint64), side[own], other[own])


def near_links(prints: DataFrame, hot_node: int = HOT_NODE) -> DataFrame:
    """(u, v): every pair of the distinct fingerprints (column ``print``) within the budget."""
    lead, tries = [], []
    for t, (first, length) in enumerate(THIRDS):
        low = BITS - first - length
        lead.append(
            F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << length) - 1))
        )
    for t in range(len(THIRDS)):
        tries.append(F.struct(F.lit(t).alias("trie"), lead[t].alias("lead")))
    routed = prints.select("print", F.explode(F.array(*tries)).alias("x")).select(
        "print", "x.trie", "x.lead"
    )
    nodes = routed.groupBy("trie", "lead").count().where("count > 1")
    crowded = nodes.where(F.col("count") > hot_node).select("trie", "lead")
    shared = routed.join(nodes, ["trie", "lead"])
    masks = [m for m in range(1 << CUT_BITS) if m.bit_count() <= BUDGET]
    # The next bits below the leading third, in the rotation of the trie.
    below = F.lit(None)
    for t, (first, length) in enumerate(THIRDS):
        at = (first + length) % BITS
        if at + CUT_BITS <= BITS:
            bits = F.shiftrightunsigned("print", BITS - at - CUT_BITS)
        else:
            raise ValueError("the bits below a third must not wrap")
        below = F.when(F.col("trie") == t, bits.bitwiseAND(F.lit((1 << CUT_BITS) - 1))).otherwise(
            below
        )
    calm = shared.where(F.col("count") <= hot_node).select(
        "trie", "print", "lead", F.lit(-1).cast("long").alias("side"),
        F.lit(-1).cast("long").alias("other"),
    )
    hot = (
        shared.where(F.col("count") > hot_node)
        .withColumn("own", below)
        .withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
        .withColumn("far", F.col("own").bitwiseXOR(F.col("mask")))
        .select(
            "trie", "print", "lead",
            F.least("own", "far").cast("long").alias("side"),
            F.greatest("own", "far").cast("long").alias("other"),
        )
    )
    pieces = calm.unionAll(hot).repartition("trie", "lead", "side", "other")
    return pieces.select("trie", "print", "side", "other").mapInArrow(_join_pieces, "u long, v long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_node: int = HOT_NODE,
    with_key: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, print (signed long), component_id, copies, links
    [, root, key].

    Null text counts as empty; texts without words have fingerprint 0 and are linked like
    any other.  Equal fingerprints are one class (``copies`` rows); ``links`` counts the
    other classes within the budget.  ``component_id`` is the smallest id that can be
    reached over links (nulls are passed over; null if there is no other).  Repeated rows
    stay repeated; an empty table gives an empty table.  ``with_key`` adds the row's
    ``row_key`` and the component's own name, one of its fingerprints.
    """
    small_batches(docs.sparkSession)
    rows = written(
        docs.select(
            F.col(quoted(id_col)).alias("id"),
            simhash(text_of(text_col)).alias("print"),
            *([row_key(docs).alias("key")] if with_key else []),
        ),
        "prints",
    )
    classes = written(
        rows.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")),
        "classes",
    )
    links = written(near_links(classes.select("print"), hot_node), "links")
    roots = connected(links)
    degree = (
        links.select(F.explode(F.array("u", "v")).alias("print"))
        .groupBy("print")
        .agg(F.count(F.lit(1)).alias("links"))
    )
    linked = classes.join(degree, "print", "left").join(
        roots.withColumnRenamed("node", "print"), "print", "left"
    ).withColumn("root", F.coalesce("root", "print"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select(
        "print", "component_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "root"
    )
    return rows.join(named, "print").select(
        "id", "print", "component_id", "copies", "links", *(["root", "key"] if with_key else [])
    )


def hex_print(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id.

    Rows that share that id are told apart by their hash; of identical rows one stays.
    Null ids come last.
    """
    groups = written(near_groups(docs, id_col, text_col, with_key=True), "groups")
    best = groups.groupBy("root").agg(
        F.min(F.struct(F.isnull("id").alias("none"), F.col("id"), F.col("key"))).alias("best")
    )
    chosen = best.select(F.col("best.key").alias("key")).distinct().withColumn("first", F.lit(True))
    n = fresh(groups, "n")
    counted = groups.groupBy("key").agg(F.count(F.lit(1)).alias(n)).join(chosen, "key", "left")
    # One row of each chosen key stays, all rows of the others go.
    decisions = counted.select(
        "key", F.explode(F.expr(f"IF({n} > 1, array(first, CAST(NULL AS BOOLEAN)), array(first))"))
        .alias("first")
    ).select("key", F.coalesce("first", F.lit(False)).alias("kept"))
    return keep_rows(docs, decisions)
