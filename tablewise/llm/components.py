"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import checkpointed


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (u, v): ``root`` is the component's least node.

    Each round hangs every node's larger neighbours on its least neighbour, then the
    smaller ones; components shrink to stars in a logarithmic number of rounds.  The
    minima, one row per node, are written before they are joined: both sides of the join
    are plain then, and Spark splits the links of a hot node over tasks.  The rounds are
    cut from their lineage in the shared folder.
    """
    edges = checkpointed(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u > v")
        .distinct()
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = checkpointed(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        turned = checkpointed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        was = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = turned.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = turned
        if was == now:
            break
    else:
        raise RuntimeError("the links did not contract")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
